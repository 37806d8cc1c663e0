"""Removed passages against a dictionary of all windows."""

import hashlib
import random
import re

import duckdb
import pytest

from conftest import SMALL
from tabwright.llm import queries, repeats

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    first = {}
    ws = [SPLIT.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, ws):
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, ws):
        gone = {i + j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_op8(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = rows(queries.QUERIES["op8_substring_dedup"](spark, SMALL))
    assert got == brute(docs, 50) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("window,run,small", [(6, 3, True), (5, 5, False), (7, 1, False), (50, 8, True)])
def test_passages_copies_and_edge_cases(spark, monkeypatch, window, run, small):
    if not small:
        monkeypatch.setattr(repeats, "_BROADCAST_VALUES", -1)
    rng = random.Random(window)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=2 * window + 3)
    docs = []
    for d in range(70):
        w = rng.choices(words, k=rng.randint(0, 4 * window))
        if d % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 2):len(passage) - rng.randint(0, 2)]
        docs.append((d, " ".join(w)))
    docs += [(100 + i, docs[3][1]) for i in range(20)] + [(1, docs[3][1]), (1, docs[3][1]), (50, docs[6][1].replace(" ", "\n "))]
    docs += [(None, docs[3][1]), (None, None), (200, None), (201, "a b " * 400), (202, "a b " * 90), (203, " \t")]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, uid string, at int")
    assert rows(repeats.repeated_words(df, window, run)) == brute(docs, window)
    assert repeats.repeated_words(df.limit(0), window, run).count() == 0
