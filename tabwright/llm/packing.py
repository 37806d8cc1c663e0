"""Packing documents into training sequences by minimum bin slack.

Every document is cut into full sequences and a rest. Only the histogram of the rests' lengths (one count per length below
the capacity) decides how they are combined: the largest remaining length opens a window, a bitset subset-sum over the
remaining multiset finds the fill closest to the capacity, backtracking tells how many of each length it takes, and the
pattern is used as often as the counts allow. So the plan depends on the capacity and not on the number of
documents. A window is accepted if it fills the capacity, or a power of two, exactly. Lengths that find no such window
are laid end to end and cut at the window borders, the last ones at powers of two, so nothing is padded.

Rests get their place by their rank within their length. Ranks come from counts per (length, salt), so a length that
holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch
from tabwright.llm.memory import LIMIT, released
from tabwright.llm.tokens import Encoder, shared

#: Documents that share one salt when ranks are dealt, on average.
_PER_SALT = 500_000


def best_fill(counts: dict[int, int], room: int, targets: list[int]) -> dict[int, int] | None:
    """Counts of lengths that add up to the first reachable target; None if there is none. Targets are at most ``room``."""
    reach, steps, best = 1, [], targets[0]
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left -= take
            size *= 2
        if reach >> best & 1:
            break
    goal = next((t for t in targets if reach >> t & 1), None)
    if goal is None:
        return None
    used: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> goal & 1:
            used[length] = used.get(length, 0) + take
            goal -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns (length -> count) with how often each is used, and the counts that fit no exact window."""
    left, patterns, rest = dict(histogram), [], {}
    while left:
        largest = max(left)
        others = {k: v - (k == largest) for k, v in left.items() if v > (k == largest)}
        powers = [1 << b for b in range(capacity.bit_length(), -1, -1) if largest <= 1 << b <= capacity]
        targets = [t - largest for t in dict.fromkeys([capacity, *powers])]
        fill = best_fill({k: v for k, v in others.items() if k <= targets[0]}, targets[0], targets)
        if fill is None:
            rest[largest] = left.pop(largest)
            continue
        pattern = dict(fill)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        patterns.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return patterns, rest


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def _cut_documents(batches: Iterator[pa.RecordBatch], content, end: int, capacity: int, word_bytes: int) -> Iterator[pa.RecordBatch]:
    encoder, tail = Encoder(content.value, word_bytes), np.array([end], "<u2").tobytes()
    for b in batches:
        n, fulls, rests = [], [], []
        for ids in encoder.stream(t.as_py() for t in b.column("text")):
            ids += tail
            n.append(len(ids) // 2)
            cut = n[-1] // capacity * capacity * 2
            fulls.append([_crc(ids[k : k + 2 * capacity]) for k in range(0, cut, 2 * capacity)])
            rests.append(_crc(ids[cut:]))
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(fulls, pa.list_(pa.int64())), pa.array(rests, pa.int64())],
            ["uid", "doc_id", "text_key", "doc_tokens", "fulls", "rest_crc"],
        )


def _crcs_of_cuts(batches: Iterator[pa.RecordBatch], content, end: int, word_bytes: int) -> Iterator[pa.RecordBatch]:
    encoder, tail = Encoder(content.value, word_bytes), np.array([end], "<u2").tobytes()
    for b in batches:
        keys, starts, lengths, crcs = [], [], [], []
        ids_of = encoder.stream(t.as_py() for t in b.column("text"))
        for key, cuts, ids in zip(b.column("text_key").to_pylist(), b.column("cuts").to_pylist(), ids_of):
            for c in cuts:
                keys.append(key)
                starts.append(c["start"])
                lengths.append(c["length"])
                crcs.append(_crc((ids + tail)[2 * c["start"] : 2 * (c["start"] + c["length"])]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, lengths, crcs)], ["text_key", "start", "length", "crc"])


def _ranked(rests: DataFrame, salts: int) -> DataFrame:
    """``rank`` from 0 within each length."""
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("uid")) - 1
    return salted.withColumn("own", own).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "own", "base")


def _numbered_fulls(docs: DataFrame, salts: int) -> DataFrame:
    """``first``: how many full sequences the documents before have, in an order of salts."""
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts))).withColumn("k", F.size("fulls").cast("long"))
    # One row per salt: a few per million documents.
    before = W.orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("salt").agg(F.sum("k").alias("k")).select("salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("k").over(W.partitionBy("salt").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return salted.withColumn("own", own).join(bases, "salt").withColumn("first", F.col("base") + F.col("own"))


def _border_points(at: Column, end: Column, capacity: int, borders: list[int]) -> Column:
    """Where a piece laid from ``at`` to ``end`` must be cut, both ends included."""
    following = (F.floor(at / capacity) + 1) * capacity
    inner = F.array(following, *(F.lit(b).cast("long") for b in borders))
    return F.array_sort(F.array_distinct(F.concat(F.array(at), F.filter(inner, lambda p: (p > at) & (p < end)), F.array(end))))


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048, word_bytes: int = 4 * LIMIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the content of the tokenizer file; ``word_bytes`` bounds the memory of encoded words in a worker. NULL and empty texts consist of the end id. Rows with equal or
    NULL doc_ids are separate documents. An empty table gives no pieces. Extra columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    content = shared(docs, tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")
    )
    cut = scratch.table(
        rows.mapInArrow(
            released(lambda batches: _cut_documents(batches, content, end, capacity, word_bytes)),
            "uid long, doc_id long, text_key long, doc_tokens long, fulls array<long>, rest_crc long",
        ),
        "packing-documents",
    )
    n_docs, n_fulls = cut.agg(F.count("*"), F.coalesce(F.sum(F.size("fulls")), F.lit(0))).first()
    salts = max(64, n_docs // _PER_SALT)
    rests = cut.select(
        "uid", "doc_id", "text_key", "doc_tokens", "rest_crc", (F.size("fulls") * F.lit(capacity)).cast("long").alias("start"),
        F.pmod(F.col("doc_tokens"), F.lit(capacity)).alias("length"),
    ).where("length > 0")
    histogram = {r.length: r["count"] for r in rests.groupBy("length").count().collect()}  # below ``capacity`` rows
    patterns, loose = plan(histogram, capacity)

    # Where the ranks of each length go; its size depends on the capacity alone.
    intervals, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            intervals.append((length, used[length], used[length] + n * times, sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    tail, at = [], 0
    for length, n in sorted(loose.items(), reverse=True):
        tail.append((length, used[length], at))
        at += length * n
    whole, last = divmod(at, capacity)
    borders, ids = [], whole
    at_border = whole * capacity
    for b in range(capacity.bit_length(), -1, -1):
        if last >> b & 1:
            borders.append((at_border, ids))
            at_border += 1 << b
            ids += 1

    ranked = scratch.table(_ranked(rests, salts), "packing-ranks")
    schema = "at_length long, low long, high long, first long, each long, begin long"
    spots = F.broadcast(spark.createDataFrame(intervals, schema))
    placed = ranked.join(spots, (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    packed = placed.select(
        "doc_id", "start", "length", F.col("rest_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("first") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("begin") + F.pmod(within, F.col("each")) * F.col("length")).alias("offset"),
    )

    tails = F.broadcast(spark.createDataFrame(tail, "at_length long, low long, base long"))
    laid = ranked.join(tails, (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low"))).withColumn(
        "at", F.col("base") + (F.col("rank") - F.col("low")) * F.col("length")
    )
    points = _border_points(F.col("at"), F.col("at") + F.col("length"), capacity, [p for p, _ in borders])
    pieces = laid.withColumn("points", points).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("points") - 2)).alias("i")
    ).select(
        "doc_id", "text_key", "doc_tokens", "rest_crc", F.col("length").alias("whole"),
        (F.col("start") + F.col("points")[F.col("i")] - F.col("at")).alias("start"),
        (F.col("points")[F.col("i") + 1] - F.col("points")[F.col("i")]).alias("length"),
        F.col("points")[F.col("i")].alias("at"),
    )
    border_at, border_id = F.floor(F.col("at") / capacity) * capacity, F.floor(F.col("at") / capacity)
    for p, k in borders:
        border_at = F.when(F.col("at") >= p, F.lit(p).cast("long")).otherwise(border_at)
        border_id = F.when(F.col("at") >= p, F.lit(k).cast("long")).otherwise(border_id)
    pieces = scratch.table(
        pieces.withColumns({"sequence_id": border_id + sequence, "offset": F.col("at") - border_at}), "packing-tail"
    )
    cuts = pieces.where("length < whole").select("text_key", F.struct("start", "length").alias("cut")).distinct()
    wanted = cuts.groupBy("text_key").agg(F.collect_list("cut").alias("cuts"))
    crcs = scratch.table(
        rows.select("text_key", "text").join(wanted, "text_key").mapInArrow(
            released(lambda batches: _crcs_of_cuts(batches, content, end, word_bytes)), "text_key long, start long, length long, crc long"
        ).distinct(),
        "packing-crcs",
    )
    content.destroy()
    loosened = pieces.join(crcs, ["text_key", "start", "length"], "left").select(
        "doc_id", "start", "length", F.coalesce("crc", "rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )

    numbered = _numbered_fulls(cut.where(F.size("fulls") > 0), salts).select("*", F.posexplode("fulls").alias("i", "crc"))
    fulls = numbered.select(
        "doc_id", (F.col("i") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("i") + F.lit(sequence + ids).cast("long")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.union(loosened).union(fulls)
