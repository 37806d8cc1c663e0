import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import scalars as S
from tabwright.functions import similarity
from tabwright.functions.similarity import best_references
from tabwright.operators import profile as P
from tabwright.operators import statistics as Z
from tabwright.plans import preparation
from tabwright.plans.state import PrepState

LOANS = "loan_id long, pages double, language string, lent_on string, target int"


@pytest.fixture(scope="module")
def train(spark):
    """Eight loans of a library: gaps in three columns, one language written in three ways."""
    return spark.createDataFrame(
        [(11, 120.0, "Suomi", "2021-03-05", 1), (12, 310.0, "SUOMI", "2021-03-09", 0), (13, None, "Eesti", None, 0), (14, 95.0, "suomi ", "2021-04-01", 1),
         (15, 240.0, None, "2021-04-17", 1), (16, 180.0, "eesti", "2021-05-02", 0), (17, 410.0, "Eesti", "2021-05-20", 1), (18, 66.0, "Suomi", "2021-06-11", 0)], LOANS)


def test_roles(spark, train):
    s = P.detect_structure(train)
    assert "loan_id" in s.ids and "pages" in s.numeric and "language" in s.categorical
    assert s.dates == ["lent_on"] and s.labels == ["target"]
    assert s.date_formats == {"lent_on": "yyyy-M-d"}
    summary = P.structure_summary(s.frame(spark)).first()
    assert (summary["n_rows"], summary["n_columns"], summary["n_features"]) == (8, 5, 3)


def test_merged_sketches_give_the_roles_of_the_whole(spark, train, tmp_path):
    whole = P.detect_structure(train)
    halves = [P.column_sketches(train.filter(f"loan_id % 2 = {k}")) for k in (0, 1)]
    halves[0].write.parquet(str(tmp_path / "sketches"))
    merged = P.merge_sketches(spark.read.parquet(str(tmp_path / "sketches")), halves[1], P.column_sketches(train.limit(0)))
    assert P.structure_of(merged, train).profile == whole.profile
    alone = P.structure_of(merged)
    assert [(p["column"], p["feature_type"], p["date_format"]) for p in alone.profile] == [(p["column"], p["feature_type"], p["date_format"]) for p in whole.profile]
    with pytest.raises(ValueError):
        P.structure_of(P.column_sketches(train.limit(0)))
    with pytest.raises(Exception, match="types differ"):
        P.merge_sketches(halves[0], P.column_sketches(train.withColumn("pages", F.lit("x")))).collect()


def test_common_subsequence_bounds_the_matcher():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé ", k=rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.common_subsequence(a, b) == table[-1][-1]
        assert sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) <= table[-1][-1]


def test_long_references_meet_only_texts_that_share_their_grams(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_BLOCK", 4000)
    monkeypatch.setattr(similarity, "_LOAD", 6000)
    rng = random.Random(31)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300)] + ["quiz", "jazz", "kayak", "vex"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    refs = sorted({text(rng.randint(34, 160)) for _ in range(40)} | {text(3) for _ in range(5)} | {"ab" * 110, "a" * 230, "é" * 205})

    def edited(t, share):
        return "".join(rng.choice(["", "x", "q", c + c]) if rng.random() < share else c for c in t)

    values = sorted({text(rng.randint(3, 160)) for _ in range(80)} | {edited(r, s) for r in refs for s in (0.001, 0.004, 0.02)} | {r[:-9] + "x" for r in refs} | {"ab" * 105})
    v = spark.createDataFrame([(g, x) for x in values for g in ("c", "d", None)], "column string, value string")
    r = spark.createDataFrame([("c", x, 5) for x in refs] + [(None, refs[0], 5)], "column string, value string, n long")
    got = {(x["column"], x["value"]): (x["corrected"], x["score"]) for x in best_references(v, r, 0.9).collect()}
    want, compared = {}, 0
    for x in values:
        score, ref = min((-difflib.SequenceMatcher(None, x, y).ratio(), y) for y in refs)
        if -score >= 0.9:
            want["c", x] = ref, -score
    assert got == want and sum(len(x) >= 200 for _, x in want) > 40
    long = [x for x in refs if len(x) >= 200]
    tables = similarity.gram_tables(long, 0.9)
    for x in values:
        compared += sum(len(t.close(x, 0.9)) for t in tables)
        for y in long:
            assert similarity.most_blocks(y) >= sum(m.size > 0 for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks())
    assert compared < 400  # of some 20,000 pairs


def test_matcher_of_long_references_gives_the_ratio_of_difflib():
    """The same ratio wherever it reaches the threshold, and far fewer grams of a reference are kept than it has."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(200)] + ["quiz", "jazz", "kayak", "vex", "zz top"]
    reached = 0
    for n in (40, 150, 700):
        for _ in range(12):
            ref = " ".join(rng.choices(words, k=n))
            if len(ref) < similarity.LONG:
                continue
            matcher = similarity.Matcher(ref)
            for share in (0.0, 0.002, 0.02, 0.1):
                text = "".join(rng.choice(["", "x", "q", c + c, "jz"]) if rng.random() < share else c for c in ref)
                for other in (text, text[len(text) // 9 :], "q" + text[:-20], ref[len(ref) // 2 :] + ref[: len(ref) // 2]):
                    score = difflib.SequenceMatcher(None, other, ref).ratio()
                    for threshold in (0.7, 0.9):
                        assert matcher.ratio(other, threshold) == (score if score >= threshold else 0.0)
                        reached += score >= threshold
    assert reached > 100
    refs = [" ".join(rng.choices(words, k=300)) for _ in range(20)]
    kept = sum(len(t.owner) for t in similarity.gram_tables(refs, 0.9))
    assert 0 < kept < sum(map(len, refs)) / 2


def test_a_gram_of_all_references_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_SHARE", 3)
    rng = random.Random(12)
    refs = [f"the {''.join(rng.choices('abcdefg', k=rng.randint(3, 9)))} inn" for _ in range(60)]
    texts = [r[:k] + rng.choice("xyz") + r[k + 1 :] for r in refs for k in rng.sample(range(len(r)), 2)]
    v = spark.createDataFrame([("c", t) for t in sorted(set(texts))], "column string, value string")
    r = spark.createDataFrame([("c", x, 5) for x in sorted(set(refs))], "column string, value string, n long")
    got = {x["value"]: (x["corrected"], x["score"]) for x in best_references(v, r, 0.85).collect()}
    for t in set(texts):
        score, ref = min((-difflib.SequenceMatcher(None, t, x).ratio(), x) for x in refs)
        assert got.get(t) == ((ref, -score) if -score >= 0.85 else None)


def test_power_transform_finds_the_peak(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.gamma(1.5, 8.0, 900) - 4, [np.nan, np.inf]])
    fit = Z.fit_yeo_johnson(spark.createDataFrame([(float(v), 3.0) for v in x] + [(None, 3.0)], "x double, same double").repartition(5), ["x", "same"])
    kept = x[np.isfinite(x)]

    def likelihood(power):
        y = np.where(kept >= 0, np.expm1(power * np.log1p(np.abs(kept))) / power, -np.expm1((2 - power) * np.log1p(np.abs(kept))) / (2 - power))
        return -len(kept) / 2 * np.log(y.var()) + (power - 1) * (np.sign(kept) * np.log1p(np.abs(kept))).sum()

    grid = np.arange(-1, 2, 0.0005) + 1e-7
    assert abs(fit["x"]["lambda"] - grid[np.argmax([likelihood(p) for p in grid])]) < 1e-3
    assert fit["same"]["lambda"] == 0.0


def test_correlations_of_many_columns_in_one_scan(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(1e6, 1.0, (300, 40))
    x[:, 1] = 2 * x[:, 0] + rng.normal(0, 0.5, 300)
    x[:, 2] = 7.0
    x[::3, 3] = np.nan
    names = [f"c{i}" for i in range(40)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {(r["left"], r["right"]): r["correlation"] for r in Z.correlation_table(df, names).collect()}
    assert len(got) == 40 * 39 // 2
    for (a, b), value in got.items():
        i, j = names.index(a), names.index(b)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert value is None if 2 in (i, j) else value == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)


def test_decimals_and_small_integers_are_numbers(spark):
    df = spark.range(60).selectExpr("CAST(id % 7 * 1.25 AS DECIMAL(9,2)) AS price", "CAST(id % 9 AS SHORT) AS rooms", "CAST(id % 4 AS BYTE) AS floor",
                                    "id % 2 = 0 AS lift", "CAST(id AS STRING) AS code")
    s = P.detect_structure(df)
    roles = {p["column"]: p["is_numeric"] for p in s.profile}
    assert roles["price"] and roles["rooms"] and roles["floor"] and not roles["lift"]


def test_uuid_and_unique_columns_are_ids(spark):
    df = spark.range(40).selectExpr(
        "uuid() AS u", "id * 1.5 AS measure", "id % 3 AS few", "CAST(id AS string) AS code")
    s = P.detect_structure(df)
    assert {"u", "code"} <= set(s.ids) and "few" not in s.ids


def test_fit_and_replay(spark, train, tmp_path):
    done = preparation.fit(train)
    assert done.features.count() == train.count() and done.state.label == "target"
    assert "loan_id" in done.state.excluded and "target" in done.labelled.columns
    done.state.save(spark, str(tmp_path / "state"))
    state = PrepState.load(spark, str(tmp_path / "state"))
    later = spark.createDataFrame([(31, None, "Sámi", None, 0), (32, 205.0, "SUOMI", "2021-07-30", 1), (33, 77.0, None, "2021-08-02", 0)], LOANS)
    out = preparation.transform(later, state)
    assert out.columns == done.features.columns and out.count() == 3
    assert out.na.drop().count() == 3
    assert done.report().filter("section = 'final_features'").count() == len(out.columns)


def test_replay_of_the_training_rows_gives_the_features(spark, train):
    done = preparation.fit(train)
    again = preparation.transform(train, done.state)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.features.collect()))


def test_misspelt_new_value_is_matched_and_unknown_is_not(spark):
    rows = [("abcdefghijkl", float(i % 7)) for i in range(20)] + [("zzzzyyyyxxxx", float(i % 5)) for i in range(20)]
    df = spark.createDataFrame([(a, b, i % 3) for i, (a, b) in enumerate(rows)], "name string, v double, w int")
    structure = P.detect_structure(df)
    structure.profile = [{**p, "is_id": False, "is_label": False, "is_excluded": False, "is_feature": True} for p in structure.profile]
    state = preparation.fit(df, structure, corr_threshold=2.0).state
    probe = spark.createDataFrame([("abcdefghijkl", 1.0, 0), ("abcdefghijk", 1.0, 0), ("other", 1.0, 0)], df.schema)
    values = [r["name"] for r in preparation.transform(probe, state, distinct=False).select("name").collect()]
    assert len(set(values)) == 2


@pytest.mark.parametrize("threshold", [0.9, 0.7])
def test_similarity_join_finds_what_comparing_all_pairs_finds(spark, threshold):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc d") for _ in range(rng.randint(1, 13))).strip() or "a"
    refs = sorted({word() for _ in range(60)})
    values = sorted({word() for _ in range(60)} | {r[:-1] for r in refs if len(r) > 1} | {r + "x" for r in refs})
    r = spark.createDataFrame([("c", v, 3 + len(v) % 2) for v in refs], "column string, value string, n long")
    v = spark.createDataFrame([("c", x) for x in values], "column string, value string")
    got = {x["value"]: (x["corrected"], x["score"]) for x in best_references(v, r, threshold).collect()}
    want = {}
    for x in values:
        score, _, ref = min((-difflib.SequenceMatcher(None, x, y).ratio(), -(3 + len(y) % 2), y) for y in refs)
        if -score >= threshold and len(x) >= threshold / (2 * (1 - threshold)) - 1e-9:
            want[x] = (ref, -score)
    assert got == want


def test_yeo_johnson(spark):
    df = spark.range(2000).select(((F.rand(1) ** 3) * 20 - 2).alias("x"))
    fit = Z.fit_yeo_johnson(df, ["x"])["x"]
    assert abs(fit["skew"]) < abs(Z.skew_stats(df, ["x"])["x"]["skew"])
    back = df.select("x", S.yeo_johnson_inverse(S.yeo_johnson(F.col("x"), fit["lambda"]), fit["lambda"]).alias("y"))
    assert back.agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < 1e-9

    def likelihood(lam):
        r = df.agg(F.count("x").alias("n"), F.var_pop(S.yeo_johnson(F.col("x"), lam)).alias("v"),
                   F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("g")).first()
        import math
        return -r["n"] / 2 * math.log(r["v"]) + (lam - 1) * r["g"]

    assert likelihood(fit["lambda"]) >= max(likelihood(fit["lambda"] + d) for d in (-0.01, 0.01))


def test_outlier_actions(spark):
    df = spark.range(100).selectExpr("IF(id < 10, 1000.0, double(id % 10)) AS clipped", "IF(id < 20, 1000.0, double(id % 10)) AS flagged",
                                     "double(id % 10) AS calm", "1.0D AS flat")
    from tabwright.operators.quantiles import exact_quantiles
    _, treated = Z.outliers(df, exact_quantiles(df, df.columns, [0.25, 0.5, 0.75]), 100)
    assert [treated[c]["action"] for c in df.columns] == [Z.WINSORISED, Z.FLAGGED, Z.UNTREATED, Z.UNTREATED]
    assert Z.choose_scaler([10.0, 0.0]) == "RobustScaler" and Z.choose_scaler([1.0]) == "StandardScaler"


def test_correlation_matches_numpy(spark):
    import numpy as np
    df = spark.range(500).selectExpr("double(id) AS a", "double(id * id % 97) AS b", "double(id * 3 + id % 5) AS c", "2.0D AS k")
    moments, corr = Z.moments_and_correlation(df, df.columns)
    m = np.corrcoef(df.select("a", "b", "c").toPandas().T)
    assert abs(corr[("a", "b")] - m[0, 1]) < 1e-12 and abs(corr[("a", "c")] - m[0, 2]) < 1e-12
    assert corr[("a", "k")] is None and moments["k"]["std"] == 0
    assert Z.correlated(["a", "b", "c"], corr, 0.9) == ["c"]
