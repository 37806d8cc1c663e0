"""Gradients of the cumulative-link model, learning planted grades, held-out accuracy."""

import random

import duckdb
import numpy as np
import pytest

from conftest import SMALL
from tabwright.llm import quality, queries
from tabwright.llm.quality import Hasher, OrdinalModel, shape


def test_shapes_and_features():
    assert shape("Abc12!!!") == "Xx9!!" and shape("éa") == "x" and shape("|") == "|"
    for text in [None, "", " ", "word " * 20_000, "A b\nA b"]:
        places, values = Hasher()(text)
        assert len(places) == len(values) > 0 and np.isfinite(values).all()


def test_steps_raise_the_likelihood():
    rng = np.random.default_rng(2)
    rows = [(int(g), np.array([int(g), 10]), np.array([1.0, 1.0])) for g in rng.integers(0, 4, 200)]
    likelihood = lambda m: sum(np.log(np.diff(np.concatenate([[0], m.below(p, v), [1]]))[g]) for g, p, v in rows)
    start = OrdinalModel.start(4)
    done = start.trained(rows, 5, 0.3, 0.0)
    assert likelihood(done) > 0.3 * likelihood(start) and (np.diff(done.thresholds()) > 0).all()
    right = sum(int((1 - done.below(p, v) > 0.5).sum()) == g for g, p, v in rows) / len(rows)
    assert right > 0.95


def test_learns_planted_grades_and_edge_cases(spark):
    rng = random.Random(5)
    kinds = ["junk### text$$$ here###", "plain words in a row", "Well formed, careful sentences."]
    rows = [(i, " ".join(rng.choices(kinds[i % 3].split(), k=25)), 0.0) for i in range(450)]
    docs = spark.createDataFrame([*rows, (None, None, None), (900, "", 1.0), (900, "", 1.0)], "doc_id long, text string, score double")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(450)] + [(1, 7), (None, 1), (2, None)], "doc_id long, grade int")
    got = quality.grade(docs, quality.fit(docs, ratings, 3)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 453 and all(round(by[i].expected_grade) == i % 3 for i in range(450))
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    unrated = quality.fit(docs, ratings.limit(0), 3)
    assert quality.grade(docs, unrated).count() == 453 and quality.grade(docs.limit(0), unrated).count() == 0
    with pytest.raises(ValueError):
        quality.fit(docs, ratings, 1)


def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = queries.QUERIES["op4_quality"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.85
