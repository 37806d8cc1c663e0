"""Token files as wavelet matrices: one compressed file per shard of documents, answering queries on the ids inside.

A shard's ids are ranked by how often they occur, which makes the high bits rare. The ranks are stored as bit-planes, the highest bit first; after each plane the ranks are stably parted by that bit. With counts of
ones per block (rank) a plane maps a position down, and by searching those counts (select) back up. That gives the id at
a position, the number of times an id occurs before a position, and the places where it occurs, without decoding the rest.

File layout, little-endian: ``WVM1``; counts of documents, ids, planes and distinct ids (u32 each); per section (document lengths
u32, ids by rank u16, then planes) its compressed size (u32); the sections, each zstd-compressed. Counts for rank are derived when a file is opened.

Documents are dealt to tasks by ranges of doc_id; every task writes its documents in ascending order in shards of bounded
size, as binary values of a Parquet table in the shared folder, so that writing is atomic and a lost executor repeats
its range. Offsets of shards are running sums over one row per shard.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.llm.memory import released
from tabwright.llm.tokens import Encoder, shared
from tabwright.session import scratch_path

_MAGIC = b"WVM1"
_BLOCK = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class BitPlane:
    """Packed bits with the number of ones before each block."""

    def __init__(self, packed: np.ndarray, n: int):
        self.n, size = n, _BLOCK // 8
        self.packed = np.concatenate([packed, np.zeros(-len(packed) % size + size, np.uint8)])
        self.before = np.concatenate([[0], np.cumsum(_ONES[self.packed].reshape(-1, size).sum(axis=1, dtype=np.int64))])
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    def _block(self, b: int) -> np.ndarray:
        return np.unpackbits(self.packed[b * _BLOCK // 8 : (b + 1) * _BLOCK // 8])

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones before place ``i``."""
        b = i // _BLOCK
        return int(self.before[b]) + int(self._block(b)[: i % _BLOCK].sum())

    def select(self, bit: int, ks: np.ndarray) -> np.ndarray:
        """Places of the ``ks``-th (from 0, ascending) ones or zeros."""
        count = self.before if bit else np.arange(len(self.before)) * _BLOCK - self.before
        blocks = np.searchsorted(count, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        for b in np.unique(blocks):
            at = blocks == b
            out[at] = np.flatnonzero(self._block(b) == bit)[ks[at] - count[b]] + b * _BLOCK
        return out


class WaveletMatrix:
    def __init__(self, planes: list[BitPlane], n: int, ranked: np.ndarray):
        self.planes, self.n, self.ranked = planes, n, ranked
        self.rank_of = {v: r for r, v in enumerate(ranked.tolist())}

    def __getitem__(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in self.planes:
            bit, ones = p.bit(i), p.rank1(i)
            value = value << 1 | bit
            i = p.zeros + ones if bit else i - ones
        return int(self.ranked[value])

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of the id of a rank before ``end`` lie below the last plane."""
        low, high = 0, end
        for k, p in enumerate(self.planes):
            a, b = p.rank1(low), p.rank1(high)
            low, high = (p.zeros + a, p.zeros + b) if value >> (len(self.planes) - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, end: int | None = None) -> int:
        """How often an id occurs before ``end``."""
        if value not in self.rank_of:
            return 0
        low, high = self._range(self.rank_of[value], self.n if end is None else end)
        return high - low

    def places(self, value: int) -> np.ndarray:
        """All places of an id, ascending."""
        if value not in self.rank_of:
            return np.empty(0, np.int64)
        value = self.rank_of[value]
        low, high = self._range(value, self.n)
        at = np.arange(low, high)
        for k, p in zip(range(len(self.planes)), reversed(self.planes)):
            bit = value >> k & 1
            at = p.select(bit, at - p.zeros if bit else at)
        return at

    def select(self, value: int, k: int) -> int:
        """The place of an id's ``k``-th occurrence, from 0."""
        places = self.places(value)
        if not 0 <= k < len(places):
            raise IndexError(k)
        return int(places[k])


def encode_shard(ids: np.ndarray, lengths: list[int]) -> bytes:
    """File image of a shard: all ids in order, and how many belong to each document."""
    counts = np.bincount(ids, minlength=1 << 16)
    order, distinct = np.argsort(-counts, kind="stable").astype("<u2"), int(np.count_nonzero(counts))
    rank = np.empty(1 << 16, np.uint16)
    rank[order] = np.arange(1 << 16, dtype=np.uint32).astype(np.uint16)
    n_planes = max(1, (distinct - 1).bit_length() if distinct else 1)
    press = zstandard.ZstdCompressor(level=1)
    sections = [press.compress(np.array(lengths, "<u4").tobytes()), press.compress(order[:distinct].tobytes())]
    now = rank[ids]
    for k in range(n_planes - 1, -1, -1):
        bits = (now & np.uint16(1 << k)) != 0
        sections.append(press.compress(np.packbits(bits).tobytes()))
        now = np.concatenate([now.take(np.flatnonzero(~bits)), now.take(np.flatnonzero(bits))])
    head = _MAGIC + struct.pack("<4I", len(lengths), len(ids), n_planes, distinct) + struct.pack(f"<{len(sections)}I", *map(len, sections))
    return head + b"".join(sections)


def _sections(image: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    if image[:4] != _MAGIC:
        raise ValueError("not a token shard")
    n_docs, n, n_planes, distinct = struct.unpack_from("<4I", image, 4)
    sizes = struct.unpack_from(f"<{n_planes + 2}I", image, 20)
    at, raw, open_ = 20 + 4 * len(sizes), [], zstandard.ZstdDecompressor()
    for size in sizes:
        raw.append(open_.decompress(image[at : at + size], max_output_size=max(4 * n_docs, 2 * distinct, n // 8 + 1)))
        at += size
    return np.frombuffer(raw[0], "<u4"), np.frombuffer(raw[1], "<u2"), [np.frombuffer(r, np.uint8) for r in raw[2:]], n


def open_shard(image: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    """The ids under rank and select, and the documents' lengths."""
    lengths, ranked, planes, n = _sections(image)
    return WaveletMatrix([BitPlane(p, n) for p in planes], n, ranked), lengths


def decode_shard(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order (undoing the partings from the last plane up) and the documents' lengths."""
    lengths, ranked, planes, n = _sections(image)
    now = np.zeros(n, np.uint16)
    for k, p in enumerate(reversed(planes)):
        bits = np.unpackbits(p, count=n).view(bool)
        zeros = n - int(np.count_nonzero(bits))
        above = np.empty(n, np.uint16)
        above[~bits] = now[:zeros]
        above[bits] = now[zeros:] | np.uint16(1 << k)
        now = above
    return ranked[now] if n else now, lengths


def _shards(batches: Iterator[pa.RecordBatch], content, end: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encoder, tail = Encoder(content.value), np.array([end], "<u2").tobytes()
    docs, parts, size, before, task = [], [], 0, 0, None

    def image() -> pa.RecordBatch:
        lengths = [len(p) // 2 for p in parts]
        blob = encode_shard(np.frombuffer(b"".join(parts), "<u2"), lengths)
        columns = [[task], [before], [len(parts)], [sum(lengths)]]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array([docs], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
            ["task", "before", "n_docs", "n_ids", "doc_ids", "image"],
        )

    for b in batches:
        task = b.column("task")[0].as_py() if b.num_rows else task
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.stream(t.as_py() for t in b.column("text"))):
            ids += tail
            if parts and size + len(ids) // 2 > shard_ids:
                yield image()
                docs, parts, size, before = [], [], 0, before + size
            docs.append(doc_id)
            parts.append(ids)
            size += len(ids) // 2
    if parts:
        yield image()


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 2, shard_ids: int = 2_000_000, per_task: int = 64_000_000) -> None:
    """Write all documents in ascending doc_id order (NULLs first, ties by text) as shards to a Parquet table at ``path``.

    ``tokenizer`` is the content of the tokenizer file. NULL texts are empty; every document ends with the id ``end``. A shard holds at most
    ``shard_ids`` ids unless a single document is longer; a task gets about ``per_task`` characters. An empty table
    gives an empty file table. Extra columns are ignored.
    """
    content = shared(docs, tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / per_task))
    # The hash parts rows of one doc_id, or of none.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "text")
    dealt.select("doc_id", "text", F.spark_partition_id().cast("long").alias("task")).mapInArrow(
        released(lambda batches: _shards(batches, content, end, shard_ids)),
        "task long, before long, n_docs long, n_ids long, doc_ids array<long>, image binary",
    ).write.parquet(path)
    content.destroy()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: first (ids of all shards before), n_ids, doc_ids and image, in no order."""
    shards = spark.read.parquet(path)
    # A shard knows the ids before it in its task; what lies before a task is one row per task, some 16,000 a terabyte.
    earlier = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(bases), "task").select((F.col("base") + F.col("before")).alias("first"), "n_ids", "doc_ids", "image")


def documents_of(shards: DataFrame) -> DataFrame:
    """One row per document, from the decoded files: doc_id, start, n_tokens, ids_crc32."""

    def decoded(batches):
        for b in batches:
            for first, doc_ids, image in zip(b.column("first").to_pylist(), b.column("doc_ids"), b.column("image")):
                ids, lengths = decode_shard(image.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(starts + first), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("first", "doc_ids", "image").mapInArrow(released(decoded), "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, value: int) -> DataFrame:
    """place: every place of an id among all ids, looked up by rank and select without decoding."""

    def found(batches):
        for b in batches:
            for first, image in zip(b.column("first").to_pylist(), b.column("image")):
                yield pa.RecordBatch.from_arrays([pa.array(open_shard(image.as_py())[0].places(value) + first, pa.int64())], ["place"])

    return shards.select("first", "image").mapInArrow(found, "place long")


def token_table(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """``documents_of`` a file table written to the shared folder."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end)
    return documents_of(read_tokens(docs.sparkSession, path))
