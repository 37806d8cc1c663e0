"""Finding, for each text, the most similar reference text.

Similarity is 2M/T: M matched characters in the Ratcliff/Obershelp sense, T the
summed lengths. Pairs are found by an equi-join on character 3-grams with an
exact bound, and only those candidates are scored.

Why no pair is lost: matched characters form a common subsequence, so a pair
with ratio >= t has at most ``d1 = l1 - t(l1+l2)/2`` characters of the text
unmatched and ``d2 = l2 - t(l1+l2)/2`` of the reference. An unmatched text
character removes at most q of the text's q-grams and an inserted reference
character at most q-1, so all but ``q*d1 + (q-1)*d2`` of them also occur in the
reference. Any larger set of grams of the text therefore hits the reference;
the grams rarest among the references are taken.

Long references go another way, as nearly all of a language's 3-grams occur in any long text. From ``LONG`` characters on the matcher starts
blocks only at characters that make up at most a hundredth of the reference, or at the beginning of both texts. So a reference with R
such characters has at most R + 1 blocks. Of its k-grams only every s-th is looked at: a block of n characters holds (n - k - s + 2) / s of these at least, so
M matched characters leave at least (M - (R + 1)(k + s - 2)) / s of them in the text. Tasks count them for a text and a block of references in one go, k and s
as large as that bound bears. The matcher is then run on the places where it can start a block alone, until too few characters are left to reach the threshold.
"""

from __future__ import annotations

import difflib
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabwright.session import materialise

_Q = 3
#: References of one gram and length bucket that one task meets at a time.
_SHARE = 1000
#: Length from which the matcher passes over frequent characters.
LONG = 200
#: Gram sizes for long references; characters of references and of texts that one task meets at a time.
_SIZES, _BLOCK, _LOAD = (16, 12, 8, 6, 4, 3, 2), 4_000_000, 16_000_000
#: Part of the matched characters that grams across the ends of blocks may take from the bound; largest step from gram to gram.
_GIVEN, _STEP = 0.65, 32


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all positions of ``a`` at once as the bits of one number.

    Matched characters form a common subsequence, so this is an exact upper bound on them.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    open_ = whole
    for c in b:
        met = open_ & at.get(c, 0)
        open_ = (open_ + met | open_ - met) & whole
    return len(a) - open_.bit_count()


def similarity_from(threshold: float):
    """Order-sensitive matching ratio of two texts; 0 where it cannot reach the threshold."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            if 2 * common_subsequence(x, y) < threshold * (len(x) + len(y)) - 1e-9:
                out.append(0.0)
                continue
            out.append(difflib.SequenceMatcher(None, x, y).ratio())
        return pd.Series(out, dtype="float64")

    return ratio


def _sizes_needed(least: float, threshold: float) -> list[int]:
    """Gram sizes some text length needs; long texts always have the largest."""
    needed = {_Q}
    length = max(1, math.ceil(least - 1e-9)) if math.isfinite(least) else 1
    while True:
        shortest, longest = length * threshold / (2 - threshold), length * (2 - threshold) / threshold
        for q in range(_Q, 0, -1):
            lost = 0.0
            for other in (shortest, float(length), longest):
                matched = (length + other) * threshold / 2
                lost = max(lost, q * max(length - matched, 0) + (q - 1) * max(other - matched, 0))
            if length - q + 1 > math.floor(lost + 1e-6):
                needed.add(q)
                break
        if length > 1000:
            return sorted(needed, reverse=True)
        length += 1


def _grams(text: Column, q: int) -> Column:
    """Every q-gram of the text, in order; the look-ahead makes them overlap."""
    return F.regexp_extract_all(text, F.lit(f"(?=(.{{{q}}}))"), F.lit(1))


def _lost(length: Column, threshold: float, q: int) -> Column:
    """Most q-grams a text of this length can lose over all reference lengths.

    Lost grams are linear in the reference length, so the extremes of the
    allowed lengths bound them; the rounding below only ever raises the bound.
    """
    shortest, longest = length * threshold / (2 - threshold), length * (2 - threshold) / threshold

    def at(other: Column) -> Column:
        matched = (length + other) * threshold / 2
        return q * F.greatest(length - matched, F.lit(0.0)) + (q - 1) * F.greatest(other - matched, F.lit(0.0))

    return F.floor(F.greatest(at(shortest), at(longest), at(length.cast("double"))) + 1e-6)


def best_references(
    values: DataFrame, references: DataFrame, threshold: float, group: str = "column"
) -> DataFrame:
    """Best reference at or above ``threshold`` for each (group, value).

    ``references`` carries ``n``, its count; ties go to the more frequent, then
    the smaller text. Returns (group, value, corrected, score).
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    # Below this length only an identical text reaches the threshold.
    least = threshold / (2 * (1 - threshold)) if threshold < 1 else math.inf
    texts = values.select(group, "value").withColumn("__l", F.length("value")).filter(
        F.col("__l") >= F.lit(least - 1e-9)
    )
    refs = references.select(F.col(group).alias("__g"), F.col("value").alias("__ref"), F.col("n").alias("__n"))
    long = F.length("__ref") >= LONG
    reach = (2 - threshold) / threshold  # the lengths of two close texts differ by no more than this factor
    scored = _short_matches(texts.filter(F.col("__l") <= LONG * reach), refs.filter(~long), threshold, least, group)
    if not refs.filter(long).isEmpty():
        scored = scored.unionByName(_long_matches(texts.filter(F.col("__l") >= LONG / reach - 1e-6), refs.filter(long), threshold, group))
    best = F.min_by(
        F.struct(F.col("__ref").alias("corrected"), F.col("score")),
        F.struct(-F.col("score"), -F.col("__n"), F.col("__ref")),
    )
    return scored.groupBy(group, "value").agg(best.alias("__b")).select(
        group, "value", F.col("__b.corrected").alias("corrected"), F.col("__b.score").alias("score")
    )


def _short_matches(texts: DataFrame, refs: DataFrame, threshold: float, least: float, group: str) -> DataFrame:
    """(group, value, __ref, __n, score) of all pairs at or above the threshold."""
    # Grams are joined by digest, so that long texts are not copied once per gram.
    texts = texts.withColumn("__v", F.md5("value"))
    refs = refs.withColumn("__r", F.md5("__ref"))
    parts = []
    for q in _sizes_needed(least, threshold):
        # A text is joined with the longest grams that its length guarantees.
        fits = F.col("__l") - q + 1 > _lost(F.col("__l"), threshold, q)
        longer = [F.col("__l") - p + 1 > _lost(F.col("__l"), threshold, p) for p in range(_Q, q, -1)]
        here = fits
        for other in longer:
            here = here & ~other
        mine = texts.filter(here)
        parts.append(_candidates(mine, refs, threshold, q, group))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    full = pairs.join(texts.select(group, "__v", "value"), [group, "__v"]).join(
        refs.select(F.col("__g").alias(group), "__r", "__ref", "__n"), [group, "__r"]
    )
    scored = full.withColumn("score", similarity_from(threshold)("value", "__ref")).filter(F.col("score") >= threshold)
    return scored.select(group, "value", "__ref", "__n", "score")


class _Rolled:
    """Hashes of a text's k-grams in order, for one k after another."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.k, self.hashes = 1, self.codes

    def grams(self, k: int) -> np.ndarray:
        if k < self.k:
            self.k, self.hashes = 1, self.codes
        for j in range(self.k, k):
            n = max(len(self.codes) - j, 0)
            self.hashes = self.hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + self.codes[j : j + n]
        self.k = k
        return self.hashes


def most_blocks(reference: str) -> int:
    """Most blocks that the matcher can find in a reference of at least ``LONG`` characters."""
    limit = len(reference) // 100 + 1
    return 1 + sum(n for n in Counter(reference).values() if n <= limit)


@dataclass
class _Grams:
    """Every ``steps``-th k-gram of some references: sorted hashes, and for each the references that hold it, as often as they do.

    ``slots`` marks the hashes by ``bits`` of theirs, which spares most grams of other texts the search.
    """

    k: int
    refs: np.ndarray
    lengths: np.ndarray
    blocks: np.ndarray
    steps: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    bits: int
    slots: np.ndarray

    def close(self, text: str, threshold: float, rolled: _Rolled | None = None) -> np.ndarray:
        """References that share as many grams with a text as a pair at or above the threshold must."""
        matched = threshold * (len(text) + self.lengths) / 2
        near = np.minimum(len(text), self.lengths) >= matched - 1e-9
        if not near.any():
            return self.refs[:0]
        grams = (rolled or _Rolled(text)).grams(self.k)
        grams = grams[self.slots[_slot(grams, self.bits)]]
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = np.unique(at[self.keys[at] == grams])
        spans = self.first[at + 1] - self.first[at]
        held = np.repeat(self.first[at] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        shared = np.bincount(self.owner[held], minlength=len(self.refs))
        return self.refs[near & (shared >= (matched - self.blocks * (self.k + self.steps - 2)) / self.steps - 1e-6)]


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.intp)


def gram_tables(references: list[str], threshold: float) -> list[_Grams]:
    """The references by the gram size at which at least half of their matched characters would still count if all grams were looked at."""
    by_size = defaultdict(list)
    for i, ref in enumerate(references):
        blocks = most_blocks(ref)
        each = len(ref) * threshold / (2 - threshold) / blocks  # matched characters in a block, at least on average
        k = next((k for k in _SIZES if k - 1 <= each / 2), _SIZES[-1])
        by_size[k].append((i, len(ref), blocks, max(1, min(_STEP, int(each * _GIVEN) - k + 2))))
    out = []
    for k, some in sorted(by_size.items()):
        found = [_Rolled(references[i]).grams(k)[::step].copy() for i, _, _, step in some]
        hashes = np.concatenate(found)
        order = np.argsort(hashes, kind="stable")
        owner = np.repeat(np.arange(len(some), dtype=np.int32), [len(h) for h in found])[order]
        keys, first = np.unique(hashes[order], return_index=True)
        bits = min(24, max(10, len(keys).bit_length() + 3))
        slots = np.zeros(1 << bits, bool)
        slots[_slot(keys, bits)] = True
        out.append(_Grams(k, *map(np.array, zip(*some)), keys, np.append(first, len(hashes)), owner, bits, slots))
    return out


class Matcher:
    """``difflib.SequenceMatcher`` of texts with one reference of at least ``LONG`` characters, given up as soon as a ratio is out of reach."""

    def __init__(self, reference: str):
        self.reference = reference
        self.places = difflib.SequenceMatcher(None, "", reference).b2j  # of the characters that start blocks

    def ratio(self, text: str, threshold: float) -> float:
        """The matching ratio, 0 where it is below the threshold."""
        a, b, places = text, self.reference, self.places
        spots = [i for i, c in enumerate(a) if c in places]
        length = len(a) + len(b)
        bound, matched, least = min(len(a), len(b)), 0, threshold * length / 2 - 1e-9
        todo = [(0, len(a), 0, len(b))]
        while todo:
            if bound < least:
                return 0.0
            alo, ahi, blo, bhi = todo.pop()
            bound -= min(ahi - alo, bhi - blo)
            i, j, n = alo, blo, 0
            runs, before = {}, -2
            begin, end = bisect_left(spots, alo), bisect_left(spots, ahi)
            for x in range(begin, end):
                at = spots[x]
                if at != before + 1:
                    runs = {}
                before, more = at, x + 1 < end and spots[x + 1] == at + 1
                if n and not runs and not more:  # a run of one character, which no other follows
                    continue
                other = places[a[at]]
                other = other[bisect_left(other, blo) : bisect_left(other, bhi)]
                if not n and other:
                    i, j, n = at, other[0], 1
                if not runs:
                    runs = dict.fromkeys(other, 1)
                    continue
                new = {}
                for to in other:
                    k = new[to] = runs.get(to - 1, 0) + 1
                    if k > n:
                        i, j, n = at - k + 1, to - k + 1, k
                runs = new
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
                n += 1
            if n:
                matched += n
                bound += n
                for part in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                    if part[0] < part[1] and part[2] < part[3]:
                        todo.append(part)
                        bound += min(part[1] - part[0], part[3] - part[2])
        score = 2.0 * matched / length
        return score if score >= threshold else 0.0


def _long_matches(texts: DataFrame, refs: DataFrame, threshold: float, group: str) -> DataFrame:
    """(group, value, __ref, __n, score) of all pairs at or above the threshold; every reference has at least ``LONG`` characters.

    A text goes to the bucket of its length, a reference also to the buckets beside its own. Buckets of many references are split into shares that
    all its texts meet, buckets of many texts into parts that all references meet.
    """
    own = _length_bucket(F.length("__ref"), threshold)
    met = refs.withColumn("__bucket", F.explode(F.sequence(own - 1, own + 1)))
    held = met.groupBy("__g", "__bucket").agg(F.ceil(F.sum(F.length("__ref")) / _BLOCK).cast("int").alias("__shares"))
    asked = materialise(
        texts.withColumn("__bucket", _length_bucket(F.col("__l"), threshold)).join(held.withColumnRenamed("__g", group), [group, "__bucket"]), "long-texts"
    )
    loads = materialise(
        asked.groupBy(group, "__bucket", "__shares").agg(F.ceil(F.sum("__l") / _LOAD).cast("int").alias("__parts")), "loads"
    )  # one row per group and bucket
    keys = [group, "__bucket", "__share", "__part"]
    dealt = asked.join(loads.drop("__shares"), [group, "__bucket"]).select(
        group, "__bucket", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)).alias("__share"),
        F.pmod(F.xxhash64("value"), "__parts").cast("int").alias("__part"), "value",
    )
    sides = met.withColumnRenamed("__g", group).join(loads, [group, "__bucket"]).select(
        group, "__bucket", F.pmod(F.xxhash64("__ref"), "__shares").cast("int").alias("__share"),
        F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "__ref", "__n",
    )

    def match(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        values, references, found = mine["value"].tolist(), theirs["__ref"].tolist(), []
        tables, close = gram_tables(references, threshold) if values else [], defaultdict(list)
        for value in values:
            rolled = _Rolled(value)
            for table in tables:
                for i in table.close(value, threshold, rolled).tolist():
                    close[i].append(value)
        for i, some in close.items():
            matcher = Matcher(references[i])
            for value in some:
                score = matcher.ratio(value, threshold)
                if score >= threshold:
                    found.append((key[0], value, references[i], theirs["__n"].iloc[i], score))
        return pd.DataFrame(found, columns=[group, "value", "__ref", "__n", "score"])

    kinds = [(group, texts), ("value", texts), ("__ref", refs), ("__n", refs)]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c, df in kinds] + [T.StructField("score", T.DoubleType())])
    return dealt.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(match, schema)


def _candidates(texts: DataFrame, refs: DataFrame, threshold: float, q: int, group: str) -> DataFrame:
    """(group, __v, __r): digests of texts and references that may be close enough."""
    index = refs.select(
        "__g", "__r", F.length("__ref").alias("__rl"), F.explode(_grams(F.col("__ref"), q)).alias("__gram")
    ).distinct()
    spread = index.groupBy("__g", "__gram").agg(F.count(F.lit(1)).alias("__df"))
    grams = texts.select(group, "__v", "__l", F.posexplode(_grams(F.col("value"), q)).alias("__at", "__gram"))
    counted = grams.join(
        spread.select(F.col("__g").alias(group), "__gram", "__df"), [group, "__gram"], "left"
    ).withColumn("__df", F.coalesce("__df", F.lit(0)))
    rare = W.partitionBy(group, "__v").orderBy("__df", "__gram", "__at")
    probe = (
        counted.withColumn("__k", F.row_number().over(rare))
        .filter((F.col("__k") <= _lost(F.col("__l"), threshold, q) + 1) & (F.col("__df") > 0))
        .select(group, "__v", "__l", "__gram")
        .distinct()
    )
    # References come in buckets of a geometric length scale: those near enough lie in a text's own bucket or beside it.
    bucket = _length_bucket(F.col("__rl"), threshold)
    sized = index.withColumn("__bucket", bucket)
    held = sized.groupBy("__g", "__gram", "__bucket").agg(F.count(F.lit(1)).alias("__m"))
    # A gram of more than _SHARE references is split, and its texts meet every share, so no task holds them all.
    shares = F.ceil(F.col("__m") / _SHARE).cast("int")
    dealt = sized.join(held, ["__g", "__gram", "__bucket"]).withColumn("__share", F.pmod(F.xxhash64("__r"), shares).cast("int")).withColumnRenamed("__g", "__rg")
    own = _length_bucket(F.col("__l"), threshold)
    asked = probe.withColumn("__bucket", F.explode(F.sequence(own - 1, own + 1))).join(
        held.withColumnRenamed("__g", group), [group, "__gram", "__bucket"]
    ).withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1)))
    near = 2 * F.least("__l", "__rl") >= threshold * (F.col("__l") + F.col("__rl")) - 1e-9
    keys = ["__gram", "__bucket", "__share"]
    hit = asked.select(group, "__v", "__l", *keys).join(
        dealt.select("__rg", "__r", "__rl", *keys).withColumnRenamed("__rg", group), [group, *keys]
    ).filter(near)
    return hit.select(group, "__v", "__r").distinct()


def _length_bucket(length: Column, threshold: float) -> Column:
    """Lengths that differ by no more than the threshold allows differ by at most one bucket."""
    if threshold == 1:
        return length.cast("int")
    return F.floor(F.log(length.cast("double")) / math.log((2 - threshold) / threshold) * (1 - 1e-9)).cast("int")
