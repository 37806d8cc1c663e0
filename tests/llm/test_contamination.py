"""Containment against brute force over all pairs."""

import random

import pytest

from tabwright.llm.contamination import contaminated, distinct_shingles, drop_contaminated, plain_words, required, sketch_size


def brute(docs, items, width=5, threshold=0.8):
    grams = lambda t: distinct_shingles(plain_words(t), width)
    return sorted(
        (d, i, len(grams(q) & grams(t)), len(grams(q)))
        for d, t, *_ in docs for i, q in items
        if grams(q) and len(grams(q) & grams(t)) >= 0.8 * len(grams(q)) - 1e-9
    )


def test_sketch_always_meets_a_containing_document():
    for size in range(1, 3000):
        k = sketch_size(size, 0.8)
        assert 1 <= k <= size and size - required(size, 0.8) < k


@pytest.mark.parametrize("block_bytes", [8_000_000, 900])
def test_against_all_pairs(spark, block_bytes):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "É"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 60])))) for i in range(40)] + [(77, None), (78, "  "), (79, "?!")]
    docs = []
    for d in range(80):
        ws = rng.choices(vocabulary, k=rng.randint(0, 120))
        if d % 2:
            q = (items[d % 40][1] or "").split()
            for _ in range(rng.randint(0, 2)):
                q[rng.randrange(len(q))] = "changed"
            at = rng.randint(0, len(ws))
            ws[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in q]
        docs.append((d, " ".join(ws), 0.5, "x"))
    docs += [(100 + i, q, 0.1, "y") for i, q in items] + [(200, items[5][1], 1.0, None)] * 2 + [(300, "pad " * 20_000 + items[6][1], 0.0, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, containment double, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(df, bench, block_bytes=block_bytes).collect()
    expected = brute(docs, items)
    assert sorted((r.doc_id, r.item_id, r.shared, r.item_size) for r in found) == expected
    kept = drop_contaminated(df, bench, block_bytes=block_bytes)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in docs if d[0] not in {e[0] for e in expected})


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a text here", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0 and drop_contaminated(docs, none).count() == 1
    assert contaminated(docs.limit(0), none).count() == 0
