"""Ranked search against scoring every document; summaries against their blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabwright.llm import ranking
from tabwright.llm.ranking import Best, Shard, Weights

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    cut = [(d, Counter(plain_terms(t))) for d, t, *_ in docs]
    cut = [(d, c) for d, c in cut if c]
    n_docs, n_terms = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(plain_terms(text))
        scored = []
        for d, c in cut:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(n * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, item_id int, rank string")
    found = ranking.ranked(df, spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n_docs, n_items):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Straße", "ÉCOLE", "école", "x9"]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", ", ", "\x00"]).join(rng.choices(words, weight, k=n)).title()
    docs = [(i, text(rng.choice([1, 5, 40, 200])), "s", 1, "r") for i in range(n_docs)]
    docs += [(n_docs + i, docs[i % 3][1], None, None, None) for i in range(60)]  # ties beyond the 20th place
    docs += [(7, docs[0][1], "", 0, ""), (None, docs[1][1], "", 0, ""), (None, None, "", 0, ""), (8000, "", "", 0, ""), (8001, " -!", "", 0, ""), (8002, "w250 " * 60_000, "", 0, "")]
    items = [(i, text(rng.choice([1, 8, 40]))) for i in range(n_items)]
    items += [(0, items[0][1]), (1, "w250 w250 w4"), (None, "w5 Straße"), (50, None), (51, ""), (52, "nowhere found"), (53, docs[2][1])]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block, shard, per_block", [(64, 8192, 512), (4, 60, 512), (16, 200, 9)])
def test_against_scoring_all_documents(spark, monkeypatch, block, shard, per_block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "SHARD", shard)
    docs, items = corpus(block, 700, 25)
    # Items with one id and different texts are ranked one by one, so equal ids and ranks may repeat.
    assert run(spark, docs, items, per_block=per_block) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(1, 5, 3)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, "?", "", 1, "")], items) == []


def shard_of(rng, numbers=(), n_docs=600, n_terms=80):
    chance = 1 / np.arange(1, n_terms + 1)
    rows = [np.unique(rng.choice(n_terms, size=rng.integers(1, 25), p=chance / chance.sum())) for _ in range(n_docs)]
    term = np.concatenate(rows)
    weights = Weights(n_docs, 50 * n_docs, rng.integers(0, 9000, n_terms))
    together = rng.random((n_terms, n_terms)) < 0.3
    together |= together.T | np.eye(n_terms, dtype=bool)
    if len(numbers):
        together[np.ix_(numbers, numbers)] = True
    lengths = np.array(list(map(len, rows)))
    return Shard.build(np.arange(n_docs) * 3, rng.integers(20, 90, n_docs), lengths, term, rng.integers(1, 6, len(term)), weights, together), weights, together


def test_summaries_are_the_maxima_of_their_blocks(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 8)
    monkeypatch.setattr(ranking, "_AT_ONCE", 900)
    shard, weights, together = shard_of(np.random.default_rng(2))
    assert (Shard.opened(shard.image()).sum_value == shard.sum_value).all()
    dense = np.zeros((len(shard.doc_ids), len(weights.term)), np.int64)
    for d in range(len(dense)):
        dense[d, shard.term[shard.at[d] : shard.at[d + 1]]] = shard.value[shard.at[d] : shard.at[d + 1]]
    for t in range(len(weights.term)):
        docs = []
        for b in range(shard.lists[t], shard.lists[t + 1]):
            members = shard.posts[shard.blocks[b] : shard.blocks[b + 1]]
            docs += members.tolist()
            summary = np.zeros(dense.shape[1], np.int64)
            summary[shard.sum_term[shard.sums[b] : shard.sums[b + 1]]] = shard.sum_value[shard.sums[b] : shard.sums[b + 1]]
            assert (summary == np.where(together[t], dense[members].max(axis=0), 0)).all()
        assert sorted(docs) == np.flatnonzero(dense[:, t]).tolist()


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 8)
    rng, skipped = np.random.default_rng(4), 0
    for _ in range(40):
        shard, weights, together = shard_of(rng, numbers := rng.choice(80, size=6, replace=False))
        wanted = np.zeros(len(weights.term), np.int64)
        wanted[numbers] = weights.term[numbers] * rng.integers(1, 3, len(numbers))
        full = np.zeros(len(shard.doc_ids), np.int64)
        np.add.at(full, np.repeat(np.arange(len(full)), np.diff(shard.at)), shard.value * wanted[shard.term])
        best = Best(5)
        scored = shard.search(numbers, wanted, best)
        order = np.lexsort((shard.doc_ids, -full))[:5]
        order = order[full[order] > 0]
        assert best.doc.tolist() == shard.doc_ids[order].tolist() and best.score.tolist() == full[order].tolist()
        skipped += np.count_nonzero(full) - scored
    assert skipped > 0
