"""Exact and near duplicates against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from conftest import SMALL
from tabwright.llm import exact, queries
from tabwright.llm.components import components
from tabwright.llm.exact import build_index, drop_exact_duplicates, exact_duplicates
from tabwright.llm.scratch import Scratch
from tabwright.llm.simhash import BKTree, drop_near_duplicates, fingerprint, near_duplicates, near_links

SCHEMA = "doc_id long, text string, uid string, key int"


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in ws.replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(prints):
    """doc_id -> smallest doc_id reachable over links of at most 3 bits, all pairs."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_fingerprint():
    for text in ["", None, "one", "One two", "a b c d e f a b c d", "Ä B\tc\nd É é", "x " * 400]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_op1_matches_all_pairs(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    expected = plain_components(prints)
    rows = queries.QUERIES["op1_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", expected[i]) for i in docs
    }
    assert len(rows) == len(docs)


def test_tree_finds_all_within_radius():
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ sum(1 << rng.randrange(64) for _ in range(k)) for v in values for k in (1, 2, 3, 4)]
    tree = BKTree(3)
    for v in values:
        tree.add(v)
    for v in values:
        assert {values[i] for i in tree.near(v)} == {w for w in values if (v ^ w).bit_count() <= 3}


@pytest.mark.parametrize("tree_size", [3, 1024])
def test_links_join_the_same_prints(spark, tree_size):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    values = {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)} | {rng.getrandbits(64) for _ in range(60)}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    scratch = Scratch(spark)
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components(near_links(prints, scratch, 3, tree_size), scratch).collect()}
    mask = (1 << 64) - 1
    expected = plain_components({v: v & mask for v in signed})
    assert {v: found.get(v, v) for v in signed} == expected


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(links, Scratch(spark)).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_near_edge_cases(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n", "x", 2), (None, "a b c d", "y", 3), (5, "A B C D", "z", 4),
            (5, "A B C D", "z", 4), (None, "other words are here", "q", 5)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (1, 1), (2, 1), (3, 1), (5, 5), (5, 5)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "uid", "key"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits,capacity", [(64, 4096), (64, 2), (4, 3), (1, 1)])
def test_exact_with_collisions(spark, monkeypatch, bits, capacity):
    if capacity == 3:
        monkeypatch.setattr(exact, "_BROADCAST_KEYS", -1)
    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, "x", "X", "é", "x "] + [f"text {k}" for k in range(30)]), "u", 1) for i in range(120)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA), bits=bits, capacity=capacity).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    expected = sorted(
        (i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in rows
    )
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected


def test_index_buckets_hold_their_capacity(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS key", "1L AS n")
    index = build_index(keys, Scratch(spark), capacity=50)
    sizes = [r["count"] for r in index.buckets.groupBy("bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 50
    slots = [r.slot for r in index.directory.collect()]
    assert len(slots) == len(set(slots)) and max(slots) < 1 << index.depth


def test_exact_edge_cases(spark):
    rows = [(None, "t", "a", 1), (None, "t", "a", 1), (4, "s", "a", 1), (4, "s", "b", 2), (None, "s", "c", 3), (9, "long " * 50_000, "", None)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.kept for r in got) == 3 and sorted(r.group_size for r in got) == [1, 2, 2, 3, 3, 3]
    kept = drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "uid", "key"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 9]
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline_stage_drops_what_lies_within_three_bits(spark):
    """The stage goes by fingerprints: what op1 links is one document, other texts stay however many words they share."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = {1: " ".join(base), 2: " ".join([*base[:-1], "last"]), 3: " ".join([*base[:50], "one", *base[51:100], "two", *base[101:]])}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    expected = set(plain_components(prints).values())
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, SMALL).collect()} == expected == {1, 3}
