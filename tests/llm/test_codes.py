"""Codes against plain integer code; slices and masks against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from tabwright.llm import codes


def plain(rows, n_parts=8, size=16, rounds=6):
    """vec_id -> (code, error) rows and the codebook digest, by comparing every part with every entry."""
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][2]) // n_parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(r[2], p)) for r in kept[:size]] for p in range(n_parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(n_parts):
            met = {}
            for r in kept:
                met.setdefault(nearest(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            for k, parts in met.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(n_parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    totals = {}
    for _, label, _, e in out:
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, totals[label]) for i, label, c, e in out], key=repr), digest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error string, code string")


def run(spark, rows):
    coded, books = codes.compress(table(spark, rows))
    found = codes.with_label_errors(coded)
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in found.collect()), key=repr), books.digest()


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(3)
    for n, width, spread in [(1, 3, 5), (2, 1, 3), (16, 8, 4), (16, 8, 900), (64, 5, 30), (40, 2, 0)]:
        entries = rng.integers(-spread, spread + 1, (n, width))
        parts = np.concatenate([rng.integers(-2 * spread - 1, 2 * spread + 2, (500, width)), entries])
        index = codes.SliceIndex(entries)
        at, least = index.nearest(parts)
        squares = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == squares.argmin(axis=1)).all() and (least == squares.min(axis=1)).all()
        radius = rng.integers(0, spread + 1, len(parts))
        inside = (np.abs(parts[:, None] - entries[None]).max(axis=2) <= radius[:, None])
        masks = index.candidates(parts, radius)
        assert all(int(m) == sum(1 << k for k in np.flatnonzero(row).tolist()) for m, row in zip(masks, inside))
    with pytest.raises(ValueError):
        codes.SliceIndex(np.zeros((65, 2), np.int64))


def test_against_plain_code(spark):
    rng = random.Random(5)
    vector = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(24)]
    rows = [(i, vector(), rng.choice([1, 2, None]), "e", "c") for i in range(120)]
    same = vector()
    rows += [(500 + i % 7, same, 3, None, None) for i in range(60)] + [(None, vector(), None, "", "")] * 3
    rows += [(3, None, 1, "", ""), (4, [None] + same[1:], 1, "", ""), (5, [math.nan] + same[1:], 1, "", ""), (6, [math.inf] + same[1:], 1, "", "")]
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    rows = [(i, [0.5 * i, -0.25] * 4, None, "", "") for i in range(n)] + [(99, None, 1, "", "")]
    assert run(spark, rows) == plain(rows)


def test_uneven_or_huge_vectors_raise(spark):
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [1.0] * 8, 1, "", ""), (2, [1.0] * 16, 1, "", "")]))
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [1.0] * 9, 1, "", "")]))
    with pytest.raises(Exception, match="out of range"):
        codes.compress(table(spark, [(1, [1e30] * 8, 1, "", "")]))
