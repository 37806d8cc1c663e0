"""The automaton against edit distances, learning on planted terms, held-out accuracy."""

import random
import zlib

import duckdb
import pytest

from conftest import SMALL
from tabwright.llm import queries, toxicity
from tabwright.llm.toxicity import HitFinder, LexiconAutomaton, allowed_edits, greedy_terms

SCHEMA = "doc_id long, text string, score double"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_gives_edit_distances():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(25)]
    automaton = LexiconAutomaton(terms, max_states=500)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        expected = min((e for t in terms if (e := edits(word, t)) <= allowed_edits(t)), default=None)
        assert automaton.distance(word) == expected


def test_context_of_hits():
    finder = HitFinder(["dreadful", "scamp"], ["scalp"])
    f = lambda text: dict(zip(toxicity.FEATURES, finder.features(text)))
    assert f("what a dreadful day")["exact"] > 0 and f("what a dreadfull day")["fuzzy"] > 0
    assert f("my scalp hurts") == f("") == f(None)
    assert f('she found "dreadful scamp" odd')["exact"] == 0 < f('she found "dreadful scamp" odd')["quoted"]
    assert f("you dreadful thing")["directed"] > 0 == f("a dreadful thing")["directed"]
    assert f("d word " * 20_000)["exact"] == 0 and f("x dreadful### y")["exact"] > 0


def test_greedy_leaves_out_words_of_copies():
    assert greedy_terms([[0, 1], [0, 1], [0, 1], [0], [0], [2], [2], [2]], 3) == [0, 2]
    assert greedy_terms([[0, 1], [0, 1], [0, 1], [0], [0], [2], [2], [2]], 3, [1]) == [1, 2]


def test_learns_planted_terms(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        ws = rng.choices(plain, k=30)
        toxic = i % 6 == 0
        if toxic:
            ws[rng.randrange(30)] = rng.choice(["grumbler", "muddlehead"])
        rows.append((i, " ".join(ws), 0.0))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None), (900, "", 1.0), (900, "", 1.0), (901, "a grumbbler here", 0.0)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.terms) == {"grumbler", "muddlehead"}
    got = toxicity.score(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 604 and all(by[i].predicted == t for i, t in labels) and by[900].predicted == 0
    assert by[901].score > by[900].score
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "text", 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    rows = queries.QUERIES["op5_toxicity"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    assert len(rows) == 1000 and right >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
