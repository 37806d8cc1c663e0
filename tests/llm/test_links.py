"""Url verdicts against plain Python, and the spread of trust against a dense iteration."""

import random
import re

import duckdb
import numpy as np
import pytest

from conftest import SMALL
from tabwright.llm import queries
from tabwright.llm.links import Rule, host_links, judge, spread
from tabwright.llm.scratch import Scratch


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def dense(seeds, edges, damping=0.85, rounds=400):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    out = {}
    for good in (True, False):
        m = np.zeros((len(hosts), len(hosts)))
        for s, t, n in edges:
            m[(at[s], at[t]) if good else (at[t], at[s])] += n
        for i in range(len(hosts)):
            m[i] = m[i] / m[i].sum() if m[i].sum() else np.eye(len(hosts))[i]
        seed = np.array([seeds.get(h, (0, 0))[0 if good else 1] for h in hosts], float)
        x = seed.copy()
        for _ in range(rounds):
            x = (1 - damping) * seed + damping * (x @ m)
        out[good] = x
    return {h: (out[True][i], out[False][i]) for h, i in at.items()}


def test_op9(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SMALL}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.QUERIES["op9_url_filters"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    counts = {}
    for _, u in pages:
        r = ruled(*cut(u), queries.RULES)
        if r:
            c = counts.setdefault(cut(u)[0], [0, 0])
            c[r.verdict == "block"] += 1
    for i, u in pages:
        r = ruled(*cut(u), queries.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (*cut(u), r and r.name)
        trust, distrust = counts.get(cut(u)[0], (0, 0))  # the tables have no links between hosts
        assert got[i].verdict == (r.verdict if r else "block" if distrust > trust else "allow")


def test_spread_matches_dense_iteration(spark):
    rng = random.Random(8)
    hosts = [f"h{i}" for i in range(25)]
    edges = {(a, b): rng.randint(1, 5) for a, b in ((rng.choice(hosts), rng.choice(hosts[:20])) for _ in range(60)) if a != b}
    edges |= {("hot", h): 1 for h in hosts}
    seeds = {h: (rng.randint(0, 3), rng.randint(0, 2)) for h in hosts[:8]}
    got = spread(
        spark.createDataFrame([(h, float(a), float(b)) for h, (a, b) in seeds.items()], "host string, trust double, distrust double"),
        spark.createDataFrame([(*k, v) for k, v in edges.items()], "source string, target string, links long"),
        Scratch(spark), 0.85, 60, 0.0,
    ).collect()
    expected = dense(seeds, [(*k, v) for k, v in edges.items()])
    assert len(got) > 15
    for r in got:
        assert r.trust == pytest.approx(expected[r.host][0], abs=2e-3) and r.distrust == pytest.approx(expected[r.host][1], abs=2e-3)


def test_links_decide_and_edge_cases(spark):
    rules = [Rule("block", "bad.net", "/"), Rule("allow", "good.net", "/")]
    link = lambda h: f'<A HREF = "https://{h}/x"> <a href="/own">'
    pages = [(1, "http://bad.net/", "", 1), (2, "http://good.net/", link("Praised.net"), 1), (3, "http://praised.net/a", None, 1),
             (4, "http://spam.net/?q", link("bad.net"), 1), (5, "http://other.net", link("other.net"), 1), (6, None, None, None),
             (7, "no scheme", link("bad.net"), 1), (None, "HTTP://X.BAD.net/y#z", "", 2), (4, "http://spam.net/?q", link("bad.net"), 1),
             (8, "http://notbad.net/", "", 1), (9, "http://bad.net", "", 1), (10, "x" * 100_000 + "://A?://", "", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    got = sorted(((r.page_id or 0), r.host[:9], r.path, r.rule, r.verdict) for r in judge(df, rules).collect())
    assert got == [
        (0, "x.bad.net", "/y", "bad.net/", "block"), (1, "bad.net", "/", "bad.net/", "block"), (2, "good.net", "/", "good.net/", "allow"),
        (3, "praised.n", "/a", None, "allow"), (4, "spam.net", "/", None, "block"), (4, "spam.net", "/", None, "block"),
        (5, "other.net", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "notbad.ne", "/", None, "allow"),
        (9, "bad.net", "", None, "block"), (10, "a", "", None, "allow"),
    ]
    assert {(r.source, r.target) for r in host_links(df).collect()} == {("good.net", "praised.net"), ("spam.net", "bad.net")}
    assert judge(df.limit(0), rules).count() == 0


def test_far_hosts_are_reached_beside_a_large_seed_mass(spark):
    rules = [Rule("block", "bad.net", "/"), Rule("block", "alone.net", "/")]
    chain = [f"h{i}.net" for i in range(33)]
    pages = [(i, f"http://{h}/", f'<a href="http://{t}/">') for i, (h, t) in enumerate(zip(chain, chain[1:] + ["bad.net"]))]
    pages += [(100 + i, f"http://bad.net/{i}", None) for i in range(10)]
    few = spark.createDataFrame(pages, "page_id long, url string, html string")
    many = spark.range(1000, 1_001_000).selectExpr("id AS page_id", "'http://alone.net/x' AS url", "CAST(NULL AS STRING) AS html")
    got = {r.page_id: r for r in judge(few.union(many), rules).where("page_id < 1000").collect()}
    expected = dense({"bad.net": (0, 10)}, [(h, t, 1) for h, t in zip(chain, chain[1:] + ["bad.net"])])
    assert [got[i].verdict for i in range(33)] == ["block"] * 33
    for i, h in enumerate(chain):
        assert got[i].distrust == pytest.approx(expected[h][1], rel=2e-3)
