import re

import numpy as np

from pyspark.sql import functions as F

from riskframe.llm.url_filter import RULES, host_edges, judge_urls, site_of, spread

SCHEMA = "page_id long, url string, html string, host string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


URLS = [
    "http://WWW.a.example.net/en/1?x#y", "https://a.example.net/de/", "http://net/", "http://net", "x://org/fr/ü", "http://b.example.com/de/1", "http://b.example.com/fr/",
    None, "no scheme", "a://b://c/d", "http://host#f/x", "http://notnet/", "http://sub.org/fr", "://", "http://\nx.org/fr/\n?", "http://c.org/en/",
]


def test_parts_and_rules_match_brute_force(spark):
    rows = [(k, u, None, "clash") for k, u in enumerate(URLS)] + [(0, URLS[0], "", "clash"), (None, URLS[5], "<a href='http://q.example/x'>", "clash")]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want_host, want_path = parse(next(x[1] for x in rows if x[0] == r.page_id))
        want_rule, want_verdict = rule(want_host, want_path)
        assert (r.host, r.path, r.rule) == (want_host, want_path, want_rule)
        assert r.verdict == want_verdict if want_rule else r.verdict in ("allow", "block")


def test_spread_matches_dense_iteration(spark):
    rng = np.random.default_rng(5)
    n = 12
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.3) * (1 - np.eye(n))
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", float(w[a, b])) for a in range(n) for b in range(n) if w[a, b]], "src string, dst string, weight double")
    t0, d0 = np.zeros(n), np.zeros(n)
    t0[:2], d0[2] = 0.5, 1.0
    seeds = spark.createDataFrame([(f"h{k}", float(t0[k]), float(d0[k])) for k in range(n)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in spread(edges, seeds, rounds=5, damping=0.8).collect()}
    for start, m, side in ((t0, w, 0), (d0, w.T, 1)):
        total = m.sum(1, keepdims=True)
        step = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
        now = start
        for _ in range(5):
            now = 0.2 * start + 0.8 * now @ step
        assert np.allclose([got.get(f"h{k}", (0, 0))[side] for k in range(n)], now)


def test_distrust_runs_against_links_and_trust_along(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(1, "http://bad.net/x", ""), (2, "http://spam.site/", link("bad.net")), (3, "http://fine.site/", ""), (4, "http://good.org/fr/", link("fine.site"))]
    df = spark.createDataFrame([(*p, "") for p in pages], SCHEMA)
    edges = {(r.src, r.dst) for r in host_edges(df.withColumn("host", df.url.substr(8, 100)).replace({}), 0.0).where("weight > 0").collect()}
    assert edges  # links were found
    got = {r.page_id: r.verdict for r in judge_urls(df, level=0.5).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_production_settings_block_direct_linkers_whatever_the_number_of_seeds(spark):
    link = lambda h: f'<a href="https://{h}/x">'
    for n_seeds, n_plain in ((1, 40), (30, 10)):
        rows = [(k, f"http://bad{k}.net/", "", "") for k in range(n_seeds)]
        rows += [(100 + k, f"http://spam{k}.site/", link(f"bad{k}.net"), "") for k in range(n_seeds)]
        rows += [(200 + k, f"http://plain{k}.site/", link(f"plain{k + 1}.site"), "") for k in range(n_plain)] + [(300, "http://good.org/fr/", link("plain0.site"), "")]
        got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {k: "block" if k < 200 else "allow" for k, *_ in rows}


def test_spread_runs_until_it_has_converged(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    p = np.array([[0, 1, 0], [0.5, 0, 0.5], [0, 1, 0]])
    want = 0.15 * np.linalg.inv(np.eye(3) - 0.85 * p)
    got = {r.host: (r.trust, r.distrust) for r in spread(edges, seeds, None, 0.85).collect()}
    assert np.allclose([got[h] for h in "abc"], want[[0, 2]].T, atol=2e-3)


def link(*hosts):
    return "".join(f'<a href="https://{h}">' for h in hosts)


def verdicts(spark, pages):
    return {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame([(*p, "") for p in pages], SCHEMA)).collect()}


def test_sites_end_below_public_suffixes(spark):
    want = {
        "a.b.example.com": "example.com", "example.com": "example.com", "spam.co.uk": "spam.co.uk", "www.spam.co.uk": "spam.co.uk", "co.uk": None,
        "a.github.io": "a.github.io", "x.a.github.io": "a.github.io", "github.io": None, "com": None, "10.0.0.1": None, "": None, "co.com": "co.com", "x.co.com": "co.com",
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: r.site for r in df.select("host", site_of(F.col("host")).alias("site")).collect()} == want


def test_hosts_of_one_registry_do_not_share_blame(spark):
    pages = [(1, "http://bad.net/x", ""), (2, "http://spam.co.uk/", link("bad.net/x"))] + [(10 + k, f"http://plain{k}.co.uk/", "") for k in range(5)]
    assert verdicts(spark, pages) == {1: "block", 2: "block", **{10 + k: "allow" for k in range(5)}}


def test_a_blocked_path_does_not_spill_on_its_host(spark):
    pages = [(k, f"http://example.com/{p}", "") for k, p in enumerate(["de/1", "de/2", "fr/1", "es/1"])]
    pages += [(10, "http://www.example.com/fr/", ""), (11, "http://www.example.com/de/", "")]
    pages += [(20, "http://to-de.site/", link("example.com/de/1")), (21, "http://to-fr.site/", link("EXAMPLE.com/fr/1"))]
    assert verdicts(spark, pages) == {0: "block", 1: "block", 2: "allow", 3: "allow", 10: "allow", 11: "block", 20: "block", 21: "allow"}


def test_ties_alone_never_block_but_links_reach_over_them(spark):
    pages = [(k, f"http://h{k}.example.com/de/", "") for k in range(9)] + [(20, "http://h0.example.com/x", ""), (21, "http://example.com/x", "")]
    assert {k: v for k, v in verdicts(spark, pages).items() if k >= 20} == {20: "allow", 21: "allow"}
    rows = [("seed", "site", 0.1, True), ("site", "seed", 0.1, True), ("friend", "seed", 1.0, False), ("kin", "friend", 0.1, True)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double, tie boolean")
    seeds = spark.createDataFrame([("seed", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r for r in spread(edges, seeds, 6, 0.85).collect()}
    assert got["site"].distrust > 0 and got["site"].linked == 0
    assert got["friend"].linked == got["friend"].distrust > 0 and got["kin"].linked == got["kin"].distrust > 0


def test_blocked_hosts_without_pages_are_seeds_too(spark):
    pages = [(1, "http://spam.site/", link("never-crawled.net/x")), (2, "http://plain.site/", link("other.site/"))]
    assert verdicts(spark, pages) == {1: "block", 2: "allow"}
