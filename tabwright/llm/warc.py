"""Content-addressed WARC archives: payload bytes once, exact record headers apart, records rebuilt by joins.

An archive is two tables in the shared folder. ``payloads`` holds every distinct payload once under its SHA-256 with
the number of records that share it; ``headers`` holds each record's exact header block and the digest of its payload.
Payloads are grouped by digest and bytes, so a digest that two payloads share is noticed when writing; reading hashes the
stored bytes again and fails if they don't give their digest. Catalyst takes the payload out of the join where a caller asks only for what follows from it.

Copies are combined before the shuffle. A record finds the first one with its payload through a small table; the few digests that
hold over 1/200 of all records each are sent to the records, the others joined. In rebuilding, a payload shared by many records is
sent once per ``_SHARE`` of them, so that no task gets all records of one payload.

Archives can be exported to and imported from plain WARC files (``write_files``, ``read_files``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch, join_hot
from tabwright.session import scratch_path

#: Payloads of fewer bytes are never written as revisits.
LEAST_SHARED = 100
#: Records that one copy of a payload serves when records are rebuilt.
_SHARE = 256
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is NULL. Line breaks within the value are percent-encoded."""
    plain = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit("\r\n")), F.lit(""))


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, NULL if there is none."""
    found = F.regexp_extract(header, rf"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_shared: int = LEAST_SHARED) -> None:
    """One record per row of ``pages`` (page_id, url, html), written as an archive below ``path``.

    The payload is the html in UTF-8; NULL is empty. Of records with equal payloads of at least ``least_shared`` bytes the one with the
    smallest page_id is a response and the others revisit it; shorter payloads are all responses. Of repeated rows
    with the smallest page_id the first is the response. NULL page_ids come after all others and get records without that field.
    A NULL url gives no target line. An empty table gives an empty archive. Extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    rows.groupBy("digest", "payload").agg(F.count("*").alias("copies")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    entries = scratch.table(
        rows.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", "digest", F.octet_length("payload").alias("bytes")), "warc-entries"
    )
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "copies")
    if not stored.groupBy("digest").count().where("count > 1").isEmpty():
        raise RuntimeError("two payloads share a SHA-256 digest")
    unnamed = F.col("page_id").isNull()
    groups = scratch.table(
        entries.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct(unnamed.alias("unnamed"), "page_id", "uid")).alias("first")).where("copies > 1"),
        "warc-groups",
    )
    met = join_hot(entries, groups, "digest", F.col("copies"), entries.count())
    revisit = (F.col("bytes") >= least_shared) & (F.col("uid") != F.col("first.uid"))
    name = lambda page, uid: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), uid.cast("string"), F.lit(">"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", name(F.col("page_id"), F.col("uid"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        _field("WARC-Refers-To", F.when(revisit, name(F.col("first.page_id"), F.col("first.uid")))),
        _field("WARC-Profile", F.when(revisit, _PROFILE)),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")),
    )
    met.select(
        "uid", header.alias("header"), "digest", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    scratch.drop(entries, groups)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: uid, header, page_id, record_type, refers_to, url, payload_digest, payload_bytes, payload.

    ``page_id`` and ``refers_to`` come from the record's own header. Revisits carry the full payload too. Stored bytes that don't
    give their digest raise an error.
    """
    told = F.lower(F.hex("digest"))
    own = F.sha2("payload", 256)
    checked = lambda c: F.when(own == told, c).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), told)))
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _SHARE).cast("int"))).alias("share"),
        checked(F.col("payload")).alias("payload"),
        checked(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        checked(own).alias("payload_digest"),
    )
    shares = F.floor((F.col("copies") - 1) / _SHARE).cast("int") + 1
    headers = spark.read.parquet(f"{path}/headers").withColumn("share", F.pmod(F.xxhash64("uid"), shares).cast("int"))
    page = lambda field: F.try_element_at(F.split(header_field(F.col("header"), field), ":"), F.lit(3)).try_cast("long")
    return headers.join(payloads, ["digest", "share"]).select(
        "uid",
        "header",
        page("WARC-Record-ID").alias("page_id"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        header_field(F.col("header"), "WARC-Target-URI").alias("url"),
        "payload_digest",
        "payload_bytes",
        "payload",
    )


def write_files(records: DataFrame, path: str) -> None:
    """The records as WARC files: header block, empty line, content (none in a revisit), two line breaks; gzip."""
    content = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    whole = F.concat(F.col("header"), F.lit("\r\n"), content)
    records.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def parse_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and content of each record of an uncompressed WARC file, by the stated lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, end + 2) if end >= 0 else None
        if length is None or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        start = end + 4
        stop = start + int(length.group(1))
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield data[at : end + 2], data[start:stop]
        at = stop + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """header and content of every record in WARC files, plain or gzip. A file is one task's work, as usual for archives of a GB."""
    import zlib

    def unpacked(raw: bytes) -> bytes:
        out = []
        while raw[:2] == b"\x1f\x8b":  # one or many members
            member = zlib.decompressobj(31)
            out.append(member.decompress(raw))
            raw = member.unused_data
        return b"".join(out) or raw

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0):
                records = list(parse_records(unpacked(file.as_py())))
                for k in range(0, len(records), 1000):
                    heads, bodies = zip(*records[k : k + 1000])
                    yield pa.RecordBatch.from_arrays([pa.array([h.decode("utf-8", "replace") for h in heads]), pa.array(bodies, pa.binary())], ["header", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, "header string, content binary")


def archived(pages: DataFrame) -> DataFrame:
    """``read_records`` of an archive of ``pages`` written to the shared folder."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_records(pages.sparkSession, path)
