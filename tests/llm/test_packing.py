"""Token ids against the library, plans, and packed pieces against the whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from tabwright.llm import queries
from tabwright.llm.packing import best_fill, pack, plan
from tabwright.llm.tokens import Encoder

CONTENT = queries.byte_bpe()
LIBRARY = Tokenizer.from_str(CONTENT)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab1.,' \n\t\r\xa0\x1cé²½<|>\0", "<|endoftext|>", " the", "don't", "  ", "\n\n"]), max_size=30).map("".join))
def test_encoder_is_the_library(text):
    assert np.frombuffer(Encoder(CONTENT).encode([text])[0], "<u2").tolist() == ids(text)


def test_encoder_on_real_texts():
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()] + [None, "", " ", "x " * 30_000]
    for remembered in (50, 500_000):
        got = list(Encoder(CONTENT, remembered).stream(texts))
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids(t) for t in texts]


def test_best_fill():
    assert sum(k * v for k, v in best_fill({700: 3, 5: 30}, 1450, [1450]).items()) == 1450
    assert best_fill({700: 1}, 1000, [1000]) is None and best_fill({}, 10, [10, 0]) == {}


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = random.Random(2)
    histogram = Counter(rng.randint(1, 127) for _ in range(2000))
    patterns, loose = plan(dict(histogram), 128)
    used = Counter(loose)
    for pattern, times in patterns:
        total = sum(k * n for k, n in pattern.items())
        assert total == 128 or total & (total - 1) == 0
        for k, n in pattern.items():
            used[k] += n * times
    assert used == histogram and sum(k * n for k, n in loose.items()) < sum(k * n for k, n in histogram.items()) / 4


def check(rows, docs, capacity):
    """Every id in exactly one piece, sequences gapless, padding only below a power of two."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, texts in docs.items():
        own = [[*ids(t), 1] for t in texts]
        assert sorted(r.doc_tokens for r in pieces[doc_id] if r.start == 0) == sorted(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == crc(own[0][at : at + r.length])
                at += r.length
            assert at == len(own[0])
        else:
            assert sum(r.length for r in pieces[doc_id]) == sum(map(len, own))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_op7(spark):
    docs = defaultdict(list)
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall():
        docs[i].append(t)
    rows = queries.QUERIES["op7_packing"](spark, SMALL).collect()
    assert check(rows, docs, 2048) == 0


@pytest.mark.parametrize("capacity", [64, 37])
def test_hot_lengths_and_edge_cases(spark, capacity):
    rng = random.Random(1)
    texts = {i: ["same words in every copy of this text here"] for i in range(150)}
    texts |= {200 + i: [" ".join(rng.choices("a bc def".split(), k=rng.randint(0, 90)))] for i in range(60)}
    texts |= {900: [None], 901: [""], None: ["x", None], 902: ["t u v", "t u v"], 903: ["long " * 9000]}
    rows = [(i, t, 7, "z") for i, ts in texts.items() for t in ts]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, uid string")
    padding = check(pack(df, CONTENT, capacity=capacity).collect(), texts, capacity)
    assert padding == 0 or capacity == 37
    assert pack(df.limit(0), CONTENT).count() == 0
