"""Token ids of whole texts with a byte-level BPE tokenizer, through a memory of words already encoded.

Byte-level BPE first cuts a text into pieces and then encodes each piece by itself. Between a character that is no white
space and a following space or line break there is always such a cut, so a text can be encoded word by word,
each with the white space before it. Natural text repeats its words, and the library sees each one once. A word of Latin letters is
one such piece, and so is the punctuation after it: the first goes to the library's model without the cutting, many words in a row, the
second is looked up. No merge joins a word to the space after it, so where a token begins with a space, a word begins. Texts with other white space than spaces and line breaks are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from tabwright.llm.memory import ENTRY, LIMIT

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]")
#: All that ``_ODD`` finds below U+0100.
_ODD_LATIN = [chr(c) for c in range(256) if _ODD.match(chr(c))]
#: Punctuation that ends words, and the last letter of Unicode's Latin blocks that every version of it agrees on.
_TAIL, _LATIN = ".,;:!?)\"]»", "\u024f"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: chr(256 + n) for n, b in enumerate(others)}
    return [moved.get(b, chr(b)) for b in range(256)]


_BYTES = _byte_letters()
#: Bytes of text whose words are held at once; new words that the model gets in a row.
SLICE, ROW = 300_000, 64


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content, which tasks get with their function; tokenizer files are a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _library(content: str):
    """The tokenizer, opened once in a Python worker; its size is fixed."""
    from tokenizers import Tokenizer

    opened = vars(sys.modules.setdefault("_opened_tokenizers", types.ModuleType("_opened_tokenizers"))).setdefault("by_content", {})
    key = hash(content)
    if key not in opened:
        opened[key] = Tokenizer.from_str(content)
    return opened[key]


def _joins_words(model: dict) -> bool:
    """Whether the model could merge words in a row, each after a space, with one another."""
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return True
    space = _BYTES[32]
    value = {letter: b for b, letter in enumerate(_BYTES)}
    for token in model["vocab"]:
        if space in token.lstrip(space):  # harmless if what lies between two spaces is never a part of a word
            text = bytes(value[c] for c in token).decode(errors="replace") if all(c in value for c in token) else "a"
            if any(c.isalpha() or c == "\ufffd" for c in text):
                return True
    return False


class Encoder:
    """Encodes texts to little-endian unsigned 16-bit ids.

    Words are held up to about ``limit`` bytes, in two generations: when the younger is full it becomes the older, and words
    met again move back, so frequent words stay. The memory ends with the encoder, that is with the task.
    """

    def __init__(self, content: str, limit: int = 4 * LIMIT):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        shape = json.loads(content)
        before = shape.get("pre_tokenizer") or {}
        if shape.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer without normalisation is needed")
        if any(" " in t["content"] or "\n" in t["content"] or t.get("lstrip") or t.get("rstrip") for t in shape.get("added_tokens", [])):
            raise ValueError("added tokens must not touch white space")
        self.library, self.generations, self.tails = _library(content), [{}, {}], {}
        self.model = Tokenizer(self.library.model)  # the same model without the cutting
        self.row = 1 if _joins_words(shape["model"]) else ROW
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[i for t, i in shape["model"]["vocab"].items() if t[:1] == _BYTES[32]]] = True
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.limit, self.held = limit, 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = [array("H", e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in found:
                a.byteswap()
        return [a.tobytes() for a in found]

    @staticmethod
    def _odd(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _ODD.search(text) is not None
        return any(c in text for c in _ODD_LATIN)

    @classmethod
    def _words(cls, text: str) -> list[str] | None:
        """Pieces; one without white space in front stands for the same with a space, except the first. None: odd white space."""
        plain = text.replace("\n", " ")
        odd = cls._odd(text)
        if not odd and "  " not in plain and plain[:1] != " " and plain[-1:] != " " and "\0" not in text:
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\0" + pieces[0]
            return pieces
        if odd:
            return None
        pieces = _CHUNK.findall(text)
        return [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in " \n\0" else "\0" + p for p in pieces]

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 1000:
                self.tails.clear()
            self.tails[tail] = self._encode([tail])[0]
        return self.tails[tail]

    def _by_words(self, rows) -> list[bytes]:
        """Ids of each word of encoded rows."""
        if self.row == 1:
            return [np.array(e.ids, "<u2").tobytes() for e in rows]
        flat = array("H")
        for e in rows:
            flat.extend(e.ids)
        ids = np.frombuffer(flat, np.uint16)
        starts = (2 * np.flatnonzero(self.begins[ids])).tolist()
        raw = ids.astype("<u2").tobytes()
        return [raw[s:e] for s, e in zip(starts, [*starts[1:], len(raw)])]

    def _learn_words(self, new: set[str]) -> list[str]:
        """Encode Latin words, with or without punctuation at their end, each after a space; returns the other pieces."""
        (known, older), others, tailed, fresh, letters, begun, space = self.generations, [], [], [], [], set(), _BYTES[32]
        for p in new:
            word = p if p.isalpha() else p.rstrip(_TAIL)
            plain = word.isascii()
            if not word.isalpha() or not plain and max(word) > _LATIN:
                others.append(p)
                continue
            if word is not p:
                tailed.append((p, word))
                if word in known or word in new or word in begun:
                    continue
                begun.add(word)
            if word in older:
                known[word] = older[word]
                continue
            letters.append(word if plain else "".join([_BYTES[b] for b in word.encode()]))
            fresh.append(word)
        for k in range(0, len(fresh), 20_000):
            rows = [space + space.join(letters[i : min(i + self.row, k + 20_000)]) for i in range(k, min(k + 20_000, len(fresh)), self.row)]
            known.update(zip(fresh[k : k + 20_000], self._by_words(self.model.encode_batch_fast(rows, add_special_tokens=False))))
        for p, word in tailed:
            known[p] = known[word] + self._tail(p[len(word) :])
        return others

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a text that occurs again is encoded once."""
        distinct = dict.fromkeys(texts)
        for text, ids in zip(distinct, self._encode_distinct(list(distinct))):
            distinct[text] = ids
        return [distinct[t] for t in texts]

    def _encode_distinct(self, texts: list[str]) -> list[bytes]:
        (known, older), cut, new = self.generations, [], set()
        for t in texts:
            pieces = self._words(t)
            cut.append(pieces)
            if pieces:
                new.update(pieces)
        new = {p for p in new if p not in known}
        again = {p for p in new if p in older}
        known.update((p, older[p]) for p in again)
        self.held += sum(map(len, new)) + ENTRY * len(new)
        new -= again
        order = self._learn_words(new)
        for k in range(0, len(order), 20_000):
            some = order[k : k + 20_000]
            whole = [p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in some]
            known.update(zip(some, self._encode(whole)))
        get = known.__getitem__
        out = [b"".join(map(get, pieces)) if pieces is not None else self._encode([t])[0] for t, pieces in zip(texts, cut)]
        if 2 * self.held > self.limit:
            self.generations[:] = {}, known
            self.held = 0
        return out

    def stream(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of one text after the other, a slice of text at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > SLICE:
                yield from self.encode(held)
                held, size = [], 0
        if held:
            yield from self.encode(held)


def shared(df: DataFrame, content: str):
    """The tokenizer's content as a broadcast: a file of fixed size that does not grow with the data."""
    return df.sparkSession.sparkContext.broadcast(content)
