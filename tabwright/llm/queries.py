"""The operators applied to their whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import codes, contamination, exact, links, packing, pii, quality, ranking, repeats, simhash, toxicity, warc, wavelet
from tabwright.llm.tokens import read_tokenizer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def byte_bpe() -> str:
    """Content of the 50k byte-level BPE tokenizer file."""
    import public_tokenizers

    return read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query()
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(_documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact.exact_duplicates(_documents(spark, folder)).drop("uid")


@query(r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS ws FROM texts
), grams AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram
  FROM words WHERE len(ws) > 0
), sizes AS (SELECT id, count(*) AS item_size FROM grams WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, q.id AS item_id, count(*) AS shared, any_value(item_size) AS item_size, count(*) / any_value(item_size) AS containment
FROM grams d JOIN grams q ON d.gram = q.gram AND d.kind = 0 AND q.kind = 1 JOIN sizes s ON s.id = q.id
GROUP BY d.id, q.id HAVING count(*) >= 0.8 * any_value(item_size)
""")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that contain at least four fifths of a benchmark item's word shingles, with the item."""
    return contamination.contaminated(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of all documents: 0 poor, 1 good but toxic, 2 good; learned from the labels outside the held-out fifth."""
    docs, labels = _documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)).alias("grade"))
    return quality.grade(docs, quality.fit(docs, ratings, 3))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out fifth."""
    docs = _documents(spark, folder)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(_documents(spark, folder), byte_bpe())


@query()
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the passages of 50 words and more that an earlier document has."""
    return repeats.repeated_words(_documents(spark, folder))


RULES = [
    links.Rule("allow", "org", "/"),
    links.Rule("block", "example.org", "/es/"),
    links.Rule("block", "example.org", "/en/1"),
    links.Rule("allow", "com", "/fr/"),
    links.Rule("block", "com", "/de/"),
]


@query()
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return links.judge(spark.read.parquet(f"{folder}/pages.parquet"), RULES)


@query()
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.find(_documents(spark, folder))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query()
def op6_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written as wavelet-matrix files and read back."""
    return wavelet.token_table(_documents(spark, folder), byte_bpe())


@query("""
SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN strlen(body) >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= 100 AND page_id != first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
""")
def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all pages, archived with every payload stored once and read back."""
    found = warc.archived(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _codes_sql(rounds: int = 6, n_parts: int = 8, size: int = 16) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT uid, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.uid, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d
    FROM parts p JOIN book{r} b ON p.part = b.part AND p.dim = b.dim GROUP BY p.uid, p.part, b.entry
  ) GROUP BY uid, part)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
  SELECT n.part, n.entry, p.dim, sum(p.x)::BIGINT AS s, count(*) AS c
  FROM near{r} n JOIN parts p ON n.uid = p.uid AND n.part = p.part GROUP BY n.part, n.entry, p.dim),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.dim, CASE WHEN m.c IS NULL THEN b.x ELSE (m.s - ((m.s % m.c) + m.c) % m.c) // m.c END AS x
  FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry AND b.dim = m.dim)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS uid, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (SELECT uid, unnest(ints) AS x, unnest(range(len(ints))) AS i, len(ints) // {n_parts} AS width FROM kept
), parts AS MATERIALIZED (SELECT uid, i // width AS part, i % width AS dim, x FROM flat
), book0 AS MATERIALIZED (SELECT part, uid AS entry, dim, x FROM parts WHERE uid < {size}
), {", ".join(steps)}, coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' ORDER BY n.part) AS code, sum(n.d)::BIGINT AS error
  FROM kept k JOIN near{rounds} n ON k.uid = n.uid GROUP BY k.uid, k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, dim)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all usable vectors, with their errors."""
    coded, books = codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return codes.with_label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


@query(r"""
WITH cut AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), docs AS MATERIALIZED (SELECT id, len(ts) AS n, ts FROM cut WHERE kind = 0 AND len(ts) > 0
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), tfs AS MATERIALIZED (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(ts) AS term FROM docs) GROUP BY id, n, term
), wanted AS MATERIALIZED (SELECT id AS item_id, term, count(*) AS times FROM (SELECT id, unnest(ts) AS term FROM cut WHERE kind = 1) GROUP BY id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term) CROSS JOIN total
), scored AS (
  SELECT item_id, id AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN tfs USING (term) JOIN weights USING (term) CROSS JOIN total GROUP BY item_id, id
), ordered AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ordered WHERE rank <= 20
""")
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item, of all documents."""
    return ranking.ranked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
