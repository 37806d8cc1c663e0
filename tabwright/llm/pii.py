"""Personal data in texts: fixed patterns, and further spans that gradient-boosted trees select from looser candidates.

Four kinds are looked for. Fixed patterns with a check (digits, octets, Luhn) give the base spans. High-recall generators propose
looser spans of the same kinds, which may overlap each other: obfuscated addresses, long numbers, dotted numbers. Trees
see the format and the context of a candidate, but neither the checks nor the marks that make it a base span ('@' and '(at)', '+' and
nothing look the same); they learn which candidates coincide with base spans. A
threshold per kind is calibrated on all candidates outside the fit. Candidates above it that touch no base span are added,
the best of each overlapping set.

Everything is DataFrame operations: texts are cut by the patterns, only matches with a little context leave the scan, and
positions are running sums over the cuts of one document. Patterns use possessive loops and look-behinds, so they take linear
time and no stack on long runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Stands for a single space or hyphen between two digits, which makes a spaced number one run.
_JOINT, _OTHER = "", ""
_CONTEXT = 24
#: (kind, base?, pattern, what a text must contain to be searched); cards are looked for in the text with joints.
_PATTERNS = [
    ("email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?:[A-Za-z0-9-]|(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-]))++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", True, rf"[0-9][0-9{_JOINT}]{{15,}}+", None),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("email", False, r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]{1,64}+ ?(?:@|[(\[] ?at ?[)\]]) ?[a-z0-9-]{1,63}+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[a-z0-9-]{1,63}+){1,8}", None),
    ("ip", False, r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3,5}", "."),
    ("card", False, rf"(?<![0-9])[0-9][0-9{_JOINT}]{{11,30}}+", None),
    ("phone", False, r"[(+]{0,2}[0-9][0-9()./ -]{5,24}[0-9]", None),
]
FEATURES = (
    [f"is_{k}" for k in KINDS]
    + ["n_chars", "n_digits", "n_letters", "n_gaps", "n_dots", "n_groups", "longest_group", "first_group", "last_group", "parens"]
    + ["digit_before", "letter_before", "blank_before", "quote_before", "digit_after", "letter_after", "blank_after", "digits_around", "cue_phone", "cue_card", "cue_mail", "cue_net"]
)
#: Words before a span that speak for a kind, in the languages of the documents.
_CUES = {
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|telefon|anruf|tél|téléphone|appel|teléfono|llama)",
    "card": r"(?i)\b(card|visa|credit|account|karte|konto|carte|compte|tarjeta|cuenta)",
    "mail": r"(?i)\b(mail|e-mail|contact|write|kontakt|correo|courriel)",
    "net": r"(?i)\b(ip|host|server|address|login|adresse|servidor)",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """For digit strings of at most 19 digits."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(match: Column) -> Column:
    plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).cast("int"), F.lit(999)) <= 255))


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == "ip", _octets(match))
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(F.lit(True))
    )


def matches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, kind, base, match, start, end, before, after: one row per match of any pattern.

    A document without any has one row with a NULL kind. Positions count code points, the end is exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.regexp_replace(F.translate(text, _JOINT, _OTHER), "(?<=[0-9])[ -](?=[0-9])", _JOINT)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), marked.alias("marked")
    )
    cut = []
    for i, (kind, _, pattern, needs) in enumerate(_PATTERNS):
        of = "marked" if kind == "card" else "text"
        found, rest = F.regexp_extract_all(of, F.lit(pattern), 0), F.split(of, pattern, -1)
        if needs:
            has = F.contains(F.col("text"), F.lit(needs))
            found, rest = F.when(has, found).otherwise(F.array().cast("array<string>")), F.when(has, rest).otherwise(F.array("text"))
        cut += [found.alias(f"m{i}"), rest.alias(f"r{i}")]
    cut_up = rows.select("uid", "doc_id", *cut)
    parts = [
        F.arrays_zip(
            F.array_repeat(F.lit(i), F.size(f"m{i}")).alias("p"), F.col(f"m{i}").alias("m"),
            F.slice(f"r{i}", F.lit(1), F.size(f"m{i}")).alias("b"), F.slice(f"r{i}", F.lit(2), F.size(f"m{i}")).alias("a"),
        ).cast("array<struct<p:int,m:string,b:string,a:string>>")
        for i in range(len(_PATTERNS))
    ]
    each = cut_up.select("uid", "doc_id", F.posexplode_outer(F.concat(*parts)).alias("pos", "x"))
    table = scratch.table(
        each.select(
            "uid", "doc_id", "pos", F.col("x.p").alias("p"), F.col("x.m").alias("match"), F.length("x.b").alias("gap"),
            F.right("x.b", F.lit(_CONTEXT)).alias("before"), F.left("x.a", F.lit(_CONTEXT)).alias("after"),
        ),
        "pii-matches",
    )
    so_far = F.sum(F.col("gap") + F.length("match")).over(W.partitionBy("uid", "p").orderBy("pos"))
    # A row without a match has no pattern; an array's place after NULL would be its last.
    kind, base = (F.when(F.col("p").isNotNull(), F.element_at(F.array(*(F.lit(p[k]) for p in _PATTERNS)), F.col("p") + 1)) for k in (0, 1))
    return table.select(
        "uid", "doc_id", kind.alias("kind"), base.alias("base"), "match", so_far.cast("long").alias("end"),
        (so_far - F.length("match")).cast("long").alias("start"), "before", "after",
    )


def _unmarked(kind: Column, match: Column) -> Column:
    """The match in one form, whether or not it bears the marks by which base spans are told."""
    plain = F.regexp_replace(F.regexp_replace(match, r"(?i) ?(?:@|[(\[] ?at ?[)\]]) ?", "@"), r"(?i) ?(?:\.|[(\[] ?dot ?[)\]]) ?", ".")
    return F.when(kind == "email", plain).otherwise(F.regexp_replace(match, r"^[(+]*\+[(+]*", ""))


def with_features(found: DataFrame) -> DataFrame:
    m, before, after = _unmarked(F.col("kind"), F.col("match")), F.col("before"), F.col("after")
    digits = _digits(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    last, following = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    size = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    values = {f"is_{k}": F.col("kind") == k for k in KINDS} | {
        "n_chars": F.length(m), "n_digits": F.length(digits), "n_letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "n_gaps": F.length(F.regexp_replace(m, f"[^ {_JOINT}-]", "")), "n_dots": F.length(F.regexp_replace(m, r"[^.]", "")),
        "n_groups": F.size(groups), "longest_group": F.array_max(sizes), "first_group": F.try_element_at(sizes, F.lit(1)),
        "last_group": F.try_element_at(sizes, F.lit(-1)), "parens": F.contains(m, F.lit("(")),
        "digit_before": last.rlike("[0-9]"), "letter_before": last.rlike(r"\p{L}"), "blank_before": last.rlike(r"^\s?$"), "quote_before": last.rlike("[\"'=]"),
        "digit_after": following.rlike("[0-9]"), "letter_after": following.rlike(r"\p{L}"), "blank_after": following.rlike(r"^[\s.,;]?$"),
        "digits_around": F.length(_digits(F.concat(before, after))), **{f"cue_{k}": before.rlike(p) for k, p in _CUES.items()},
    }
    return found.withColumns({k: size(v.cast("int")) for k, v in values.items()})


def _touched(found: DataFrame) -> DataFrame:
    """``label``: the candidate overlaps a base span of its kind; ``touches``: it overlaps one of any kind."""
    out = found
    for name, keys in (("label", ["uid", "kind"]), ("touches", ["uid"])):
        w = W.partitionBy(*keys).orderBy("start")
        earlier = F.max(F.when(F.col("base"), F.col("end"))).over(w.rangeBetween(W.unboundedPreceding, 0))
        later = F.min(F.when(F.col("base"), F.col("start"))).over(w.rangeBetween(0, W.unboundedFollowing))
        out = out.withColumn(name, F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False)))
    return out


@dataclass
class SpanModel:
    trees: GBTClassificationModel | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def scored(self, candidates: DataFrame) -> DataFrame:
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates))
        return self.trees.transform(data).withColumn("p", vector_to_array("probability")[1])


def fit(candidates: DataFrame, max_rows: int = 40_000, precision: float = 0.98, trees: int = 20, depth: int = 4, seed: int = 7) -> SpanModel:
    """Trees on at most about ``max_rows`` distinct candidates (kind, match and context), shared out among the kinds.

    Within a kind a hash chooses them; a fifth of all distinct candidates never takes part. Everything outside the fit calibrates.
    Candidates that coincide with base spans are known to be personal data, the others are unlabelled, not wrong: with c the mean score
    of the known ones of a kind, an unlabelled one of score p counts as (1 - c) / c * p / (1 - p) of a hit, at most 1. Per kind
    the threshold is the lowest score (in steps of 0.05, at least 0.5) above which at least ``precision`` are hits. Repeats count once, as
    coinciding if most of them do. A kind without such a score adds nothing, and neither does a table in which all candidates
    or none coincide with base spans.
    """
    scratch = Scratch(candidates.sparkSession)
    keys = ["kind", "match", "before", "after"]
    distinct = scratch.table(candidates.groupBy(*keys).agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("double").alias("y")), "pii-distinct")
    left, share = max_rows, F.lit(0.0)
    counts = sorted((r["count"], r.kind) for r in distinct.groupBy("kind").count().collect())
    for i, (n, kind) in enumerate(counts):
        quota = min(n, left // (len(counts) - i))
        share, left = F.when(F.col("kind") == kind, F.lit(quota / n)).otherwise(share), left - quota
    ticket = F.xxhash64(*keys)
    chosen = (F.pmod(ticket, F.lit(1_000_000)) < share * 1_000_000) & (F.pmod(F.floor(ticket / 1_000_000).cast("long"), F.lit(5)) != 0)
    split = distinct.withColumn("fits", chosen)
    if split.where("fits").select("y").distinct().count() < 2:
        return SpanModel()
    learn = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(split.where("fits")))
    model = SpanModel(GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, seed=seed).fit(learn.select("features", "y")))
    rest = scratch.table(model.scored(split.where("NOT fits")).select("kind", "y", "p"), "pii-rest")
    known = {r.kind: min(max(r.c, 0.05), 1.0) for r in rest.where("y = 1").groupBy("kind").agg(F.avg("p").alias("c")).collect()}
    odds = F.lit(0.0)
    for kind, c in known.items():
        odds = F.when(F.col("kind") == kind, F.lit((1 - c) / c)).otherwise(odds)
    hit = F.when(F.col("y") == 1, 1.0).otherwise(F.least(F.lit(1.0), odds * F.col("p") / F.greatest(1 - F.col("p"), F.lit(1e-9))))
    steps = rest.groupBy("kind", F.floor(F.col("p") * 20).cast("int").alias("step")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits")).collect()
    scratch.drop(distinct, rest)
    for kind in KINDS:
        rows = [0.0, 0.0]
        for step in range(20, 9, -1):
            for r in steps:
                if r.kind == kind and r.step == step:
                    rows = [rows[0] + r.n, rows[1] + r.hits]
            if rows[0] and rows[1] >= precision * rows[0]:
                model.thresholds[kind] = step / 20
    return model


def _added(candidates: DataFrame, model: SpanModel) -> DataFrame:
    """Of the candidates above their threshold, the best of each set that overlaps."""
    bound = F.lit(2.0)
    for kind, t in model.thresholds.items():
        bound = F.when(F.col("kind") == kind, F.lit(t)).otherwise(bound)
    chosen = model.scored(candidates.where("not touches")).where(F.col("p") >= bound).select("uid", "doc_id", "kind", "start", "end", "p")
    ordered = W.partitionBy("uid").orderBy("start", "end", "kind")
    reach = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    sets = chosen.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("set", F.sum("new").over(ordered))
    best = F.row_number().over(W.partitionBy("uid", "set").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "kind"))
    return sets.withColumn("place", best).where("place = 1").select("uid", "doc_id", "kind", "start", "end")


def find(docs: DataFrame, max_rows: int = 40_000, precision: float = 0.98) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind number, start, end) in that order.

    NULL and empty texts have no spans. Documents without doc_id and repeated rows stay. An empty table gives no rows. Extra
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = matches(docs, scratch)
    usable = found.where(~F.col("base") | _valid(F.col("kind"), F.col("match")))
    spans = scratch.table(_touched(usable), "pii-spans")
    candidates = spans.where("NOT base")
    model = fit(candidates, max_rows, precision)
    base = spans.where("base").select("uid", "kind", "start", "end", F.lit(True).alias("base"))
    if model.thresholds:
        base = base.union(_added(candidates, model).select("uid", "kind", "start", "end", F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(number.alias("kind"), "start", "end")
    gathered = base.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans")
    )
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return found.select("uid", "doc_id").distinct().join(gathered, "uid", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long")
