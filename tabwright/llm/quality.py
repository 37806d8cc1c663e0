"""Document quality by ordinal cumulative-link regression on hashed text.

Ratings are grades 0..K-1. One weight vector over hashed features is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - x.w). The result is the expected grade and the probability of the tail that a
selection asks for. The thresholds stay ordered because their gaps are exponentials.

The fit takes a bounded sample of rated rows, dealt to a fixed number of blocks: each block makes adaptive gradient steps over its
rows from the common weights, the blocks' weights are averaged, and so on for a few rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch, rows_of

BITS = 16
FOLDS = 5
_RUNS = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile("[^\\W\\d_A-ZX]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def shape(token: str) -> str:
    """Runs of capitals, other letters and digits become X, x and 9; repeated signs two of them."""
    for pattern, by in _RUNS:
        token = pattern.sub(by, token)
    return token[:12]


class Hasher:
    """Sparse features of a text: words, word shapes by share, and a few coarse measures, all hashed into one space."""

    def __init__(self, remembered: int = 300_000):
        self.remembered, self.known = remembered, {}

    def _places(self, token: str) -> tuple[int, int]:
        p = self.known.get(token)
        if p is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            p = self.known[token] = (_place("w:" + token.lower()), _place("s:" + shape(token)))
        return p

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").split()
        n, counts = max(len(tokens), 1), Counter(tokens)
        values: dict[int, float] = {}
        norm = np.sqrt(sum(np.log1p(list(counts.values())) ** 2)) if counts else 1.0
        shapes: Counter = Counter()
        for token, c in counts.items():
            word, form = self._places(token)
            values[word] = values.get(word, 0.0) + float(np.log1p(c)) / norm if c > 1 else values.get(word, 0.0) + 0.6931 / norm
            shapes[form] += c
        for form, c in shapes.items():
            values[form] = values.get(form, 0.0) + 3.0 * (c / n) ** 0.5
        lines = (text or "").split("\n")
        measures = {
            "words": min(int(np.log2(n)), 15), "variety": int(10 * len(counts) / n), "most": int(10 * max(counts.values(), default=0) / n),
            "lines": int(10 * len(set(lines)) / len(lines)), "length": min(int(len(text or "") / n), 20), "constant": 0,
        }
        for name, v in measures.items():
            at = _place(f"m:{name}={v}")
            values[at] = values.get(at, 0.0) + 1.0
        places = sorted(values)
        return np.array(places, np.int64), np.array([values[p] for p in places])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray  # the first threshold, then the logarithms of the gaps

    @staticmethod
    def start(grades: int) -> OrdinalModel:
        return OrdinalModel(np.zeros(1 << BITS), np.concatenate([[-1.0], np.zeros(grades - 2)]))

    def thresholds(self) -> np.ndarray:
        return np.cumsum(np.concatenate([self.cuts[:1], np.exp(self.cuts[1:])]))

    def below(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0..K-2."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds() - self.weights[places] @ values, -30, 30)))

    def trained(self, rows: list[tuple], epochs: int, rate: float, decay: float) -> OrdinalModel:
        """Adaptive gradient steps over the rows (grade, places, values), in the order given."""
        model = OrdinalModel(self.weights.copy(), self.cuts.copy())
        seen_w, seen_c = np.full(1 << BITS, 1e-2), np.full(len(self.cuts), 1e-2)
        for _ in range(epochs):
            for grade, places, values in rows:
                below = np.concatenate([[0.0], model.below(places, values), [1.0]])
                low, high = below[grade], below[grade + 1]
                share = max(high - low, 1e-9)
                by_score = high + low - 1  # derivative of the log-likelihood by the score
                by_cut = np.zeros(len(self.cuts))
                if grade < len(self.cuts):
                    by_cut[grade] += high * (1 - high) / share
                if grade:
                    by_cut[grade - 1] -= low * (1 - low) / share
                gaps = np.concatenate([[1.0], np.exp(model.cuts[1:])])
                step_c = np.cumsum(by_cut[::-1])[::-1] * gaps
                step_w = by_score * values - decay * model.weights[places]
                seen_w[places] += step_w**2
                seen_c += step_c**2
                model.weights[places] += rate * step_w / np.sqrt(seen_w[places])
                model.cuts = np.clip(model.cuts + rate * step_c / np.sqrt(seen_c), -8, 8)
        return model


def fit(
    docs: DataFrame, ratings: DataFrame, grades: int, max_rows: int = 20_000, blocks: int = 8, rounds: int = 3, epochs: int = 2,
    rate: float = 0.3, decay: float = 1e-4,
) -> OrdinalModel:
    """Learn from ``ratings`` (doc_id, grade), of which about ``max_rows`` at most, chosen by a hash of doc_id, are used.

    Rows whose ``crc32(doc_id) mod 5`` is 0 are never learned from. Grades outside 0..grades-1 and NULLs are ignored; of several
    ratings for a document the smallest counts. Without ratings the model knows nothing and gives one score to all.
    """
    if grades < 2:
        raise ValueError("at least two grades are needed")
    scratch = Scratch(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rated = (
        ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
        .where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .where(fold != 0)
    )
    share = min(1.0, max_rows / max(rated.count(), 1))
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = rated.where(ticket < int(share * 1_000_000))

    def hashed(batches):
        hasher = Hasher()
        for b in batches:
            xs = [hasher(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("block"), b.column("ticket"), b.column("grade"), pa.array([x[0] for x in xs], pa.list_(pa.int64())), pa.array([x[1] for x in xs], pa.list_(pa.float64()))],
                ["block", "ticket", "grade", "places", "vals"],
            )

    # At most about max_rows small rows, whatever the size of the tables.
    sample = rows_of(docs).join(F.broadcast(chosen), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.xxhash64("doc_id", F.lit(2)).alias("ticket"), "grade", "text"
    )
    table = scratch.table(sample.mapInArrow(hashed, "block int, ticket long, grade int, places array<long>, vals array<double>"), "quality-sample")
    dealt = table.repartition(blocks, "block").sortWithinPartitions("block", "ticket")
    model = OrdinalModel.start(grades)
    for _ in range(rounds):

        def step(batches, model=model):
            held: dict[int, list] = {}
            for b in batches:
                rows = zip(b.column("block").to_pylist(), b.column("grade").to_pylist(), b.column("places"), b.column("vals"))
                for block, grade, places, values in rows:
                    held.setdefault(block, []).append((grade, places.values.to_numpy(), values.values.to_numpy()))
            for block in sorted(held):
                m = model.trained(held[block], epochs, rate, decay)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(held[block])]), pa.array([m.weights.astype(np.float32).tobytes()]), pa.array([m.cuts.tolist()])], ["n", "weights", "cuts"]
                )

        # One row per block: a fixed number of vectors of fixed size.
        parts = dealt.mapInArrow(step, "n long, weights binary, cuts array<double>").collect()
        if not parts:
            break
        parts.sort(key=lambda r: (r.n, bytes(r.weights)))
        total = sum(r.n for r in parts)
        model = OrdinalModel(
            sum(np.frombuffer(r.weights, np.float32).astype(float) * (r.n / total) for r in parts),
            sum(np.array(r.cuts) * (r.n / total) for r in parts),
        )
    scratch.drop(table)
    return model


def grade(docs: DataFrame, model: OrdinalModel, tail: int = 1, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, score (probability of grade ``tail`` or more), predicted.

    NULL and empty texts are graded by their lack of words. A NULL doc_id counts as held out. Repeated rows come out repeated, an
    empty table gives no rows, extra columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))  # fixed size

    def graded(batches):
        own, hasher = OrdinalModel(*weights.value), Hasher()
        for b in batches:
            above = np.array([1 - own.below(*hasher(t.as_py())) for t in b.column("text")]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(np.ascontiguousarray(above[:, tail - 1]))], ["doc_id", "expected_grade", "score"]
            )

    out = rows_of(docs).select("doc_id", "text").mapInArrow(graded, "doc_id long, expected_grade double, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "expected_grade", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
