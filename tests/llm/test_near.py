"""Near copies against exact Jaccard similarities of all pairs."""

import random

import duckdb
import pytest

import corpus_pipeline
from tabwright.llm import near
from tabwright.llm.near import drop_near_copies

MIDDLE = "/root/testdata/sf0.01"


def grams(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def survivors(docs):
    """Brute force: the smallest doc_id of each component over all pairs."""
    ids, sets = sorted(docs), {i: grams(t) for i, t in docs.items()}
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
                ra, rb = top(a), top(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i for i in ids if parent[i] == i}


def test_stage_drops_all_near_copies_of_the_table(spark):
    docs = {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{MIDDLE}/documents.parquet'").fetchall()}
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{MIDDLE}/documents.parquet"), MIDDLE).collect()]
    expected = survivors(docs)
    assert len(got) == len(set(got)) and set(got) == expected


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    """Texts of one passage and some words of their own meet in many bands, but are not compared with each other."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    passage = [word() for _ in range(100)]
    docs = {i: " ".join(passage + [word() for _ in range(rng.randint(45, 55))]) for i in range(300)}
    docs |= {1000 + i: docs[i] + " more" for i in range(0, 300, 30)}
    compared = []

    def counted(*args, real=near._prefix_pairs):
        compared.append(real(*args))
        return compared[-1]

    monkeypatch.setattr(near, "_prefix_pairs", counted)
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    assert {r.doc_id for r in near.drop_near_copies(df).collect()} == survivors(docs)
    assert compared[0].count() < 400


def test_graded_copies_chains_and_edges(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    docs, at = {}, 0
    for _ in range(40):
        text = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(5):  # a chain: each copy changes the last one
            docs[at] = " ".join(text)
            at += 1
            for _ in range(rng.choice([0, 1, 1, 2, len(text) // 40])):
                text[rng.randrange(len(text))] = word()
    line = " ".join(word() for _ in range(60))
    docs |= {at + i: f"{line} {' '.join(word() for _ in range(rng.choice([5, 10, 14, 20, 60])))}" for i in range(60)}
    docs |= {1000: "Four words ARE few", 1001: "four words are few", 1002: "a b c", 1003: ""}
    rows = [(i, t, "k") for i, t in docs.items()] + [(1003, None, "k"), (1002, "a b c", "k"), (None, docs[0], "k"), (None, "only here", "k"), (None, "only here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = drop_near_copies(df)
    assert out.columns == df.columns and drop_near_copies(df.limit(0)).count() == 0
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted(survivors(docs)) and got.count(None) == 1
    with pytest.raises(ValueError):
        drop_near_copies(df, similarity=0.5)
