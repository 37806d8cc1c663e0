"""Base spans against plain patterns, and added spans that keep the base ones."""

import hashlib
import random
import re

import duckdb

from conftest import SMALL
from tabwright.llm import pii, queries
from tabwright.llm.scratch import Scratch

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])]


def check(rows, docs):
    by = sorted(((r.doc_id or -1, r) for r in rows), key=lambda x: (x[0], x[1].base_sha256))
    plain = sorted(((d or -1, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base(t)).encode()).hexdigest(), t) for d, t in docs), key=lambda x: x[:2])
    assert [(d, r.base_sha256) for d, r in by] == [x[:2] for x in plain]
    for (_, r), (_, _, t) in zip(by, plain):
        own = base(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in own) for k in pii.KINDS]
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(own) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        extra = [x for x in spans if x not in own]
        assert all(b[2] <= x[1] or x[2] <= b[1] for x in extra for b in own)
        assert all(0 <= s < e <= len(t) for _, s, e in spans)


def as_query(spark, df):
    class Reader:
        @staticmethod
        def parquet(_):
            return df

    class Session:
        read = Reader

    return queries.QUERIES["op10_pii"](Session, "")


def test_op10(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    check(queries.QUERIES["op10_pii"](spark, SMALL).collect(), docs)


def test_random_and_odd_texts(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "x_d@e.f-g.h.", "@", ".", "..", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0255.0.0.00", "4111 1111-1111 1111", "4111111111111111", "41111111111111110",
            "5500 0000  0000 0004", "+1 (974) 555-3436", "+4917", "++49 30 123456", "é", "😀", "", "12", " ", "-", "- ", "12", "(", ")", "a.b@c", "%+-@x.y", "\n", "٣"]
    docs = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(400)]
    docs += [(500, None), (501, ""), (None, "mail a@b.co"), (502, "1" * 100_000), (503, "1 " * 50_000), (504, "a." * 3_000 + "@"), (505, "a@" + "b." * 30_000 + "c"),
             (506, "9.9." * 20_000), (507, "+1" * 20_000), (508, "x@y.z " * 3000), (508, "x@y.z " * 3000), (509, "word " * 20_000)]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, kind string, uid int")
    check(as_query(spark, df).collect(), docs)
    assert pii.find(df.limit(0)).count() == 0


def test_trees_add_spans_without_the_checks(spark):
    rng = random.Random(3)

    def card(good):
        d = [rng.randint(0, 9) for _ in range(15)]
        total = sum(sum(divmod(x * (1 + (i + 1) % 2), 10)) for i, x in enumerate(reversed(d)))
        return "".join(map(str, d)) + str((-total + (not good)) % 10)

    docs = [(i, f"pay with card {card(True)} today" if i % 2 else f"part number {rng.randint(10**12, 10**13)} of the list") for i in range(600)]
    docs.append((9999, f"pay with card {card(False)} today"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in as_query(spark, df).collect()}
    check(rows.values(), docs)
    assert rows[9999].n_card == 0 and "card:14:30" in rows[9999].spans
    assert not any(rows[i].spans for i in range(0, 600, 2))


def test_matches_cover_each_text(spark):
    df = spark.createDataFrame([(1, "a 1.2.3.4 b"), (2, "nothing")], "doc_id long, text string")
    rows = pii.matches(df, Scratch(spark)).where("base or kind is null").collect()
    assert sorted((r.doc_id, r.kind or "", r.start, r.end, r.base, r.match) for r in rows) == [(1, "ip", 2, 9, True, "1.2.3.4"), (2, "", None, None, None, None)]


def test_trees_add_spans_without_the_marks(spark):
    rng = random.Random(9)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    docs = []
    for i in range(0, 1200, 4):
        docs += [(i, f"please mail {name()}.{name()}@{name()}.com for more"), (i + 1, f"please call +{number(rng.randint(1, 3))} {number(rng.randint(2, 3))} {number(rng.randint(6, 7))} for more"),
                 (i + 2, f"the lot {number(3)} {number(rng.randint(2, 3))} {number(6)} of goods"), (i + 3, f"the total was {number(8)} pieces")]
    docs += [(5000, "please mail jane.roe (at) example (dot) com for more"), (5001, "please mail joe.doe @ example . com for more"), (5002, "please call 030 123 4567891 for more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in as_query(spark, df).collect()}
    check(rows.values(), docs)
    assert rows[5000].spans == "email:12:43" and rows[5001].spans == "email:12:35" and rows[5002].spans == "phone:12:27"
    assert rows[5000].n_email == rows[5002].n_phone == 0
    assert not any(rows[i + k].spans for i in range(0, 1200, 4) for k in (2, 3))


def luhn(digits):
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_mistyped_cards_beside_cues_are_added_and_serial_numbers_are_not(spark):
    rng = random.Random(21)

    def number(valid):
        while True:
            d = "".join(rng.choices("0123456789", k=16))
            if luhn(d) == valid:
                return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    docs = []
    for i in range(0, 1600, 4):
        docs += [(i, f"please charge my credit card {number(True)} today"), (i + 1, f"the serial no {number(False)} was printed below"),
                 (i + 2, f"batch of serial no {number(False)} left the works"), (i + 3, "nothing of note")]
    docs += [(9000 + i, f"please charge my credit card {number(False)} today") for i in range(20)]
    rows = {r.doc_id: r for r in as_query(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check(rows.values(), docs)
    added = [rows[9000 + i].spans for i in range(20)]
    assert all(s.startswith("card:") for s in added) and all(rows[9000 + i].n_card == 0 for i in range(20))
    assert not any(rows[i + k].spans for i in range(0, 1600, 4) for k in (1, 2, 3))


def test_thresholds_do_not_depend_on_how_large_the_table_is(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = [("phone", f"+{number(11)}", "please call ", True) for _ in range(3000)] + [("phone", number(8), "lot ", False) for _ in range(3000)]
    rows += [("email", f"m{i}@x{i}.com", "mail ", True) for i in range(40)] + [("phone", "12345678901", "please call ", False)] * 3000
    df = spark.createDataFrame(rows, "kind string, match string, before string, label boolean").selectExpr("*", "' for more' AS after")
    for n in (300, 40_000):  # the first sample holds a few hundredths of the candidates, the second all of them
        assert set(pii.fit(df, max_rows=n).thresholds) == {"email", "phone"}
