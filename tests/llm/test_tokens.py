"""Words that go to the tokenizer's model in rows, against the library's ids."""

import json
import random

import numpy as np
from tokenizers import Tokenizer

from tabwright.llm import queries, tokens

CONTENT = queries.byte_bpe()
LIBRARY = Tokenizer.from_str(CONTENT)


def ids_of(texts):
    return [np.frombuffer(b, "<u2").tolist() for b in tokens.Encoder(CONTENT).stream(texts)]


def test_new_words_reach_the_model_many_at_a_time():
    encoder, rows, draw = tokens.Encoder(CONTENT), [], random.Random(3)

    class Counted:
        def encode_batch_fast(self, texts, **more):
            rows.extend(texts)
            return model.encode_batch_fast(texts, **more)

    model, encoder.model = encoder.model, Counted()
    words = ["".join(draw.choices("abcdeéñßzZ", k=draw.randint(1, 12))) for _ in range(3000)]
    text = " ".join(w + draw.choice(["", ".", ",", '?"']) for w in words)
    found = [np.frombuffer(b, "<u2").tolist() for b in encoder.stream([text])]
    assert found == [LIBRARY.encode(text, add_special_tokens=False).ids]
    assert 0 < len(rows) <= len(set(words)) // tokens.ROW + 1


def test_odd_white_space_gives_the_librarys_ids():
    spaces, draw = [" ", "  ", "\n", "\n ", " \n", "\t", "\xa0", " ", "\x1c", "\x85", "\0"], random.Random(5)
    texts = ["", " ", "\n", " a", "a ", "\xa0\xa0 \xa0b", "é\xa0à \xa0à", "x　y ж"]
    texts += ["".join(draw.choice(["à", "word", "x1", "ж", "Ġ", "don't", "..", "日本"]) + draw.choice(spaces[: draw.randint(1, 11)]) for _ in range(40)) for _ in range(300)]
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_models_that_merge_words_get_them_one_by_one():
    shape = json.loads(CONTENT)["model"]
    space = tokens._BYTES[32]
    assert not tokens._joins_words(shape)
    assert tokens._joins_words({**shape, "ignore_merges": True})
    assert tokens._joins_words({**shape, "vocab": {**shape["vocab"], f"{space}of{space}the": 50_257}})
