"""CSV files with quoted line breaks, read in splits like any other text.

A line begins a record if the quotes before it in its file are even in number. One pass counts the quotes of every file block, running sums over the
blocks (a row each) tell how each block begins, and a second pass follows the quotes within its own block. Lines that are records by themselves go on as
they are; only the pieces of a record with line breaks are shuffled, to be put together, across block borders too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Encodings that keep line breaks and quotes as single bytes, so that lines can be cut before they are decoded.
_PLAIN = {"utf8": "UTF-8", "iso88591": "ISO-8859-1", "latin1": "ISO-8859-1", "usascii": "US-ASCII", "ascii": "US-ASCII", "windows1252": "windows-1252", "cp1252": "windows-1252"}


def plain_encoding(name: str) -> str | None:
    return _PLAIN.get(name.lower().replace("-", "").replace("_", ""))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the block in the file) and value, the line's bytes as they are, in file order within each block."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def quotes_in(value: str) -> Column:
    return (F.octet_length(value) - F.octet_length(F.replace(F.col(value), F.lit('"'), F.lit("")))).cast("long")


def looked_over(lines: DataFrame) -> tuple[bool, bool]:
    """Whether some quoted value spans lines, and whether all bytes are valid UTF-8."""
    r = lines.agg(F.bool_or(quotes_in("value") % 2 == 1), F.bool_and(F.is_valid_utf8("value"))).first()
    return bool(r[0]), r[1] is not False


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line: its block and number there, the number of the block's records begun up to it, and whether it begins or ends within quotes."""
    block, n, open_, begun = None, 0, False, 0
    for b in batches:
        blocks, odd, inside = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if blocks[low] != block:
                block, n, open_, begun = blocks[low], 0, bool(inside[low]), 0
            after = np.logical_xor.accumulate(np.concatenate([[open_], odd[low:high]]))
            number = begun + np.cumsum(~after[:-1])
            part = b.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.arange(n, n + high - low)), pa.array(number), pa.array(after[:-1]), pa.array(after[1:]), part.column(1)],
                ["block", "line", "number", "opens", "closes", "value"],
            )
            n, open_, begun = n + high - low, bool(after[-1]), int(number[-1])


def records_of(lines: DataFrame) -> DataFrame:
    """(record, first): every record's text, with its line breaks, and whether it is the first of its file; blank lines left out."""
    block = F.xxhash64("file", "start").alias("block")
    counts = lines.groupBy("file", "start").agg(F.sum(quotes_in("value")).alias("quotes"))
    earlier, earlier_of = (W.partitionBy(c).orderBy("start").rowsBetween(W.unboundedPreceding, -1) for c in ("file", "of"))
    # One row per block of the files, some 8,000 a terabyte.
    blocks = counts.select(
        block, F.col("file").alias("of"), "start", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("inside"),
    )
    followed = (
        lines.withColumn("block", block)
        .join(F.broadcast(blocks.select("block", "inside")), "block")
        .select("block", "value", (quotes_in("value") % 2 == 1).alias("odd"), "inside")
        .mapInArrow(_followed, "block long, line long, number long, opens boolean, closes boolean, value string")
    )
    whole = followed.filter(~F.col("opens") & ~F.col("closes"))
    start = F.broadcast(blocks.select("block", (F.col("start") == 0).alias("at_start")))
    single = whole.join(start, "block").select(F.col("value").alias("record"), (F.col("at_start") & (F.col("line") == 0)).alias("first"))
    # A piece before a block's first record start (number 0) belongs to the last record begun in an earlier block of its file.
    pieces = followed.filter(F.col("opens") | F.col("closes"))
    last = pieces.groupBy("block").agg(F.max("number").alias("most"))
    carried = blocks.join(last, "block", "left").withColumn(
        "home", F.last(F.when(F.col("most") > 0, F.struct("block", "most")), ignorenulls=True).over(earlier_of)
    )
    placed = pieces.join(F.broadcast(carried.select("block", "of", "start", "home")), "block")
    own = F.when(F.col("number") > 0, F.struct("block", F.col("number").alias("most"))).otherwise(F.col("home"))
    ordered = F.sort_array(F.collect_list(F.struct("start", "line", "value")))
    joined = placed.groupBy("of", own.alias("record_at")).agg(ordered.alias("parts")).select(
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"),
        ((F.col("parts")[0]["start"] == 0) & (F.col("parts")[0]["line"] == 0)).alias("first"),
    )
    cut = single.unionByName(joined)
    return cut.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record != ''")


def read_records(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """All columns of the files as text; the header of each file is left out, the first file's gives the names."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.options(header=True, multiLine=True, encoding=encoding, **options).csv(path).columns
    rows = records_of(lines_of(spark, path)).filter(~F.col("first"))
    record = F.decode(F.col("record").cast("binary"), encoding)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return rows.select(F.from_csv(record, schema, options).alias("r")).select("r.*").toDF(*names)
