"""Archives read back exactly; copies, repeated rows, NULLs and damage."""

import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabwright.llm import warc
from tabwright.session import scratch_path

LONG = "<p>" + "ä" * 60 + "\r\n\r\nWARC/1.1\r\n</p>"
ROWS = [
    (5, "http://a/", LONG, "x"), (3, "http://b/", LONG, "x"), (3, "http://b/", LONG, "x"), (9, None, LONG, None),
    (None, "http://n/", LONG, "x"), (1, "http://c/\r\nWARC-Type: forged", "short", "x"), (2, "http://d/", "short", "x"),
    (4, "http://e/", None, "x"), (6, "http://f/", "", "x"), (None, "u", "N" * 200, "x"), (None, "u", "N" * 200, "x"),
    (7, "http://g/", "long " * 50_000, "x"), (8, "http://h/", "y" * 99, "x"), (10, "http://i/", "y" * 99, "x"), (11, "http://j/", "z" * 100, "x"),
    (12, "http://k/", "z" * 100, "x"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def plain(rows, least=100):
    """The contract, row by row."""
    first, out = {}, []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        best = first.get(body)
        if best is None or (page is not None and (best[0] is None or page < best[0])):
            first[body] = (page,)
    met = set()
    for page, _, html, _ in rows:
        body = (html or "").encode()
        home = first[body][0]
        response = len(body) < least or (page == home and body not in met)
        if page == home:
            met.add(body)
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if response else "revisit", None if response else home))
    return sorted(out, key=repr)


def test_rows_like_plain_code(spark):
    got = warc.archived(table(spark, ROWS)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(ROWS)
    assert sorted((bytes(r.payload) for r in got)) == sorted((t or "").encode() for _, _, t, _ in ROWS)
    forged = next(r for r in got if r.page_id == 1)
    assert forged.record_type == "response" and forged.url == "http://c/%0D%0AWARC-Type: forged"
    assert next(r for r in got if r.page_id == 9).url is None
    assert warc.archived(table(spark, [])).count() == 0


def test_a_payload_shared_by_many_records_is_stored_once_and_dealt_out(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.when(F.col("id") % 3 == 0, "c" * 150).otherwise(F.concat(F.lit("d" * 120), "id")).alias("html"))
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 2001
    records = warc.read_records(spark, path)
    kinds = records.groupBy("record_type").agg(F.count("*"), F.count_distinct("refers_to")).collect()
    assert sorted(map(tuple, kinds)) == [("response", 2001, 0), ("revisit", 999, 1)]
    assert "payload#" not in records.select("page_id", "record_type")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_damaged_payloads_are_noticed(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(table(spark, ROWS), path)
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).collect()
    spark.createDataFrame(stored, "digest binary, payload binary, copies long").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(spark, path).collect()


def test_files_round_trip(spark):
    records = warc.archived(table(spark, ROWS))
    path = scratch_path(spark, "warc-files")
    warc.write_files(records, path)
    got = sorted((r.header, bytes(r.content)) for r in warc.read_files(spark, path).collect())
    assert got == sorted((r.header, b"" if r.record_type == "revisit" else bytes(r.payload)) for r in records.collect())
    files = [f for f in Path(path).iterdir() if f.name.endswith(".gz")]
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert sum(1 for _ in warc.parse_records(raw)) == len(ROWS)
    with pytest.raises(ValueError):
        list(warc.parse_records(raw[:-200]))
