"""Toxicity from a learned lexicon, its misspellings, and the context of each hit.

Three things are learned from labelled rows whose ``crc32(doc_id) mod 5`` is not 0:

* the lexicon (remainders 1-3): terms that stand almost only in toxic texts. Near copies count once, so a copied text doesn't make all its
  words look toxic. Terms with ample evidence are taken; weaker ones only if they explain texts that no other term does;
* ordinary words (remainders 1-3): words of clean texts that lie within reach of a term and must not count as its misspelling;
* weights (remainder 4) of a logistic score over hits by kind and context.

Scoring runs every word through the product of the lexicon trie and a Levenshtein automaton, made deterministic while it
reads; most words leave it after two or three letters. A hit is quoted if it stands between quotation marks or after a
reporting verb within the context window, directed if the window addresses somebody.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.memory import released
from tabwright.llm.scratch import Scratch, rows_of
from tabwright.llm.words import WordHashes, shingle_hashes, words

WINDOW = 6
FOLDS = 5
_EDGE = "\"'`´“”„«»‹›‘’.,;:!?()[]{}<>*#$%&|~^+=-_/\\@…¡¿"
_OPENING, _CLOSING = "\"“„«‹‘", "\"”“»›’"
_PART = re.compile(r"[^\W_]+")
#: Reporting words and forms of address in the languages of the documents.
REPORTING = frozenset(
    "said says wrote writes called quoted quote quotes reported alleged dit écrit cité appelé citation sagte schrieb nannte"
    " zitierte zitat dijo escribió llamó citó cita".split()
)
ADDRESSING = frozenset("you your you're youre u tu toi vous votre du dich dein ihr euch tú usted ustedes vosotros".split())
FEATURES = ("exact", "fuzzy", "far", "quoted", "directed", "dense")
_PERMUTE = [(np.uint64(a), np.uint64(m)) for a, m in ((0x1F83D9ABFB41BD6B, 0x9E3779B97F4A7C15), (0x5BE0CD19137E2179, 0xC2B2AE3D27D4EB4F), (0x3C6EF372FE94F82B, 0x165667B19E3779F9))]
#: Means of the weights before anything is learned: a misspelling counts less than the term, a quotation little.
_PRIOR = np.array([-3.0, 3.0, 2.0, 1.0, 0.2, 0.5, 0.5])


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class LexiconAutomaton:
    """Product of a trie of terms and the Levenshtein automaton of each, determinised lazily.

    A state is a set of (trie node, edits); reading a letter follows the trie (no edit), any child (substitution), no
    child (insertion), and children beforehand (deletions). ``distance`` gives the fewest edits to any term that lie
    within that term's allowance, or None.
    """

    terms: Iterable[str]
    max_states: int = 50_000
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [-1])
    reach: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for term in self.terms:
            at, k = 0, allowed_edits(term)
            self.reach[0] = max(self.reach[0], k)
            for c in term:
                nxt = self.children[at].setdefault(c, len(self.children))
                if nxt == len(self.children):
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                at = nxt
                self.reach[at] = max(self.reach[at], k)
            self.ends[at] = k
        self.forget()

    def forget(self) -> None:
        start = self._closed({0: 0})
        self._ids = {start: 0}
        self._states, self._moves, self._accepts = [start], [{}], [self._accept(start)]

    def _closed(self, best: dict[int, int]) -> frozenset:
        todo = list(best.items())
        while todo:
            node, e = todo.pop()
            if best[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and best.get(child, 99) > e + 1:
                    best[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(best.items())

    def _accept(self, state: frozenset) -> int | None:
        return min((e for node, e in state if e <= self.ends[node]), default=None)

    def _step(self, state: frozenset, c: str) -> frozenset:
        best: dict[int, int] = {}
        for node, e in state:
            moves = [(child, e + (letter != c)) for letter, child in self.children[node].items()] + [(node, e + 1)]
            for to, cost in moves:
                if cost <= self.reach[to] and best.get(to, 99) > cost:
                    best[to] = cost
        return self._closed(best)

    def distance(self, word: str) -> int | None:
        if len(self._states) > self.max_states:
            self.forget()
        at = 0
        for c in word:
            nxt = self._moves[at].get(c)
            if nxt is None:
                state = self._step(self._states[at], c)
                nxt = self._ids.setdefault(state, len(self._states)) if state else -1
                if nxt == len(self._states):
                    self._states.append(state)
                    self._moves.append({})
                    self._accepts.append(self._accept(state))
                self._moves[at][c] = nxt
            if nxt < 0:
                return None
            at = nxt
        return self._accepts[at]


def parts(token: str) -> list[str]:
    """A token without its outer punctuation, and its pieces where there is punctuation inside."""
    core = token.strip(_EDGE)
    if not core:
        return []
    if core.isalpha():
        return [core]
    return [core, *(p for p in _PART.findall(core) if p != core)]


class HitFinder:
    """Counts of hits by kind and context in a text; the features of the score."""

    def __init__(self, terms: Iterable[str], ordinary: Iterable[str], remembered: int = 150_000):
        self.automaton, self.ordinary = LexiconAutomaton(sorted(terms)), frozenset(ordinary)
        self.remembered, self.known = remembered, {}

    def _edits(self, token: str) -> int | None:
        best = None
        for p in parts(token):
            e = None if p in self.ordinary else self.automaton.distance(p)
            if e is not None and (best is None or e < best):
                best = e
        return best

    def hits(self, tokens: list[str]) -> list[tuple[int, int]]:
        if len(self.known) > self.remembered:
            self.known.clear()
        known, found = self.known, []
        for t in set(tokens):
            if t not in known:
                known[t] = self._edits(t)
            if known[t] is not None:
                found.append(t)
        if not found:
            return []
        wanted = set(found)
        return [(i, known[t]) for i, t in enumerate(tokens) if t in wanted]

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        counts = dict.fromkeys(FEATURES, 0.0)
        hits = self.hits(tokens)
        for i, e in hits:
            window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            at = min(i, WINDOW)
            opened = any(t[0] in _OPENING for t in window[: at + 1])
            closed = any(t.rstrip(".,;:!?")[-1:] in _CLOSING and t.rstrip(".,;:!?") for t in window[at:])
            if opened and closed or any(t.strip(_EDGE) in REPORTING for t in window[:at]):
                counts["quoted"] += 1
                continue
            counts[("exact", "fuzzy", "far")[min(e, 2)]] += 1
            counts["directed"] += any(t.strip(_EDGE) in ADDRESSING for t in window)
        counts["dense"] = 10 * len(hits) / max(len(tokens), 10)
        return [np.log1p(counts[f]) for f in FEATURES]


def greedy_terms(sets: list[list[int]], least: int, sure: Iterable[int] = ()) -> list[int]:
    """The sure candidates, then others in the order in which they explain most texts not yet explained, down to ``least`` texts."""
    holders = defaultdict(set)
    for d, s in enumerate(sets):
        for t in s:
            holders[t].add(d)
    chosen, explained = list(sure), set()
    for t in chosen:
        explained |= holders[t]
    heap = [(-len(h), t) for t, h in holders.items() if t not in set(chosen)]
    heapq.heapify(heap)
    while heap:
        size, t = heapq.heappop(heap)
        now = len(holders[t] - explained)
        if now < least:
            continue
        if -size != now:
            heapq.heappush(heap, (-now, t))
            continue
        chosen.append(t)
        explained |= holders[t]
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Logistic weights, the constant first, by Newton's method with a Gaussian prior around ``_PRIOR``."""
    x = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, len(_PRIOR)))
    w = _PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - _PRIOR))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    terms: list[str]
    ordinary: list[str]
    weights: list[float]

    def finder(self) -> HitFinder:
        return HitFinder(self.terms, self.ordinary)

    def score(self, features: list[float]) -> float:
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds three MinHash values over five-word shingles."""
    known = WordHashes()
    for b in batches:
        least = [[], [], []]
        for t in b.column("text"):
            h = shingle_hashes(words(t.as_py(), lower=True), 5, known)
            for k, (add, by) in enumerate(_PERMUTE):
                least[k].append(int(((h ^ add) * by).min().view(np.int64)) if len(h) else 0)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in least)], [*b.schema.names, "h0", "h1", "h2"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
            seen[toxic].update({p for t in set(text.as_py().lower().split()) for p in parts(t)})
        terms = sorted(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))],
            ["term", "toxic", "clean"],
        )


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 30_000, least: int = 3, purity: float = 0.4, ample: float = 0.6
) -> ToxicityModel:
    """Learn from at most about ``max_rows`` labelled rows, chosen by a hash of doc_id.

    A term is a candidate if the lower Wilson bound of its share of toxic texts reaches ``purity``, and sure if it reaches ``ample``.
    Of rows that share one of three MinHash values only the first is used. Labels that are neither
    0 nor 1 are ignored; of several labels for a document the largest counts. Without labels the lexicon is
    empty and every text scores low.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold.cast("int")).where("fold != 0")
    )
    share = min(1.0, max_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about max_rows small rows, whatever the size of the tables.
    signed = rows_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "fold", "toxic", "text").mapInArrow(
        released(_signed), "doc_id long, fold int, toxic int, text string, h0 long, h1 long, h2 long"
    )
    drawn = scratch.table(signed, "toxicity-drawn")
    firsts = drawn.dropDuplicates(["doc_id"])
    for k in range(3):  # the smallest doc_id of each value; no value's rows meet in one task
        first = drawn.groupBy(f"h{k}").agg(F.min("doc_id").alias("doc_id"))
        firsts = firsts.join(first, [f"h{k}", "doc_id"], "left_semi")
    sample = scratch.table(
        firsts.select("fold", "toxic", "text").repartition(spark.sparkContext.defaultParallelism * 2), "toxicity-sample"
    )
    lexical = sample.where("fold < 4").select("text", "toxic")
    counts = scratch.table(
        lexical.mapInArrow(released(_term_counts), "term string, toxic long, clean long").groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "toxicity-terms",
    )
    n, share_toxic = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    z = 1.96
    bound = (share_toxic + z * z / (2 * n) - z * F.sqrt(share_toxic * (1 - share_toxic) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    found = counts.where((F.col("toxic") >= least) & (bound >= purity)).select("term", (bound >= ample).alias("sure")).orderBy("term").collect()
    candidates = [r.term for r in found]
    place = {t: i for i, t in enumerate(candidates)}

    def candidate_sets(batches):
        for b in batches:
            sets = [sorted({place[p] for t in set(x.as_py().lower().split()) for p in parts(t) if p in place}) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32()))], ["found"])

    sets = [r.found for r in lexical.where("toxic = 1").mapInArrow(candidate_sets, "found array<int>").collect()]
    terms = [candidates[i] for i in greedy_terms(sets, least, [i for i, r in enumerate(found) if r.sure])]

    def lookalikes(batches):
        automaton = LexiconAutomaton(terms)
        for b in batches:
            near = [t for t in b.column("term").to_pylist() if automaton.distance(t)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["term"])

    ordinary = counts.where((F.col("clean") > 0) & (bound < purity)).select("term").mapInArrow(lookalikes, "term string")
    model = ToxicityModel(terms, sorted(r.term for r in ordinary.collect()), list(_PRIOR))

    def features(batches):
        finder = model.finder()
        for b in batches:
            rows = [finder.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "f"])

    rest = sample.where("fold = 4").select("toxic", "text").mapInArrow(features, "toxic int, f array<double>").collect()
    model.weights = fit_weights(np.array([r.f for r in rest]).reshape(len(rest), len(FEATURES)), np.array([r.toxic for r in rest], float)).tolist()
    scratch.drop(drawn, sample, counts)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    NULL and empty texts score like any text without hits. A NULL doc_id counts as held out, since it can have no label.
    Repeated rows come out repeated, an empty table gives no rows, extra columns are ignored.
    """

    def scored(batches):
        finder = model.finder()
        for b in batches:
            s = pa.array([model.score(finder.features(t.as_py())) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), s], ["doc_id", "score"])

    out = rows_of(docs).select("doc_id", "text").mapInArrow(released(scored), "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns, without a shuffle."""
    at = docs.columns.index("text")

    def kept(batches):
        finder = model.finder()
        for b in batches:
            mask = [model.score(finder.features(t.as_py())) < threshold for t in b.column(at)]
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(released(kept), docs.schema)
