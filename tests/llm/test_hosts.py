"""The url filter against its SQL, its parts against plain versions, and odd tables."""

from collections import defaultdict
from math import isclose, sqrt

from pyspark.sql import functions as F

from pairloom.llm import hosts
from pairloom.llm.queries import MAX_BAD, QUERIES, RULES, SQL

from ..compare import connect, differences
from .cases import FOLDER


def test_query_matches_sql(spark):
    assert differences(QUERIES["op10_url_filter"](spark, FOLDER), connect(FOLDER), SQL["op10_url_filter"]) is None


URLS = {
    None: ("", ""), "": ("", ""), "a.org/x": ("", ""), "http:/a.org": ("", ""), "http://": ("", ""), "://B.com/x": ("b.com", "/x"),
    "HTTP://A.Org": ("a.org", ""), "http://a.org?q=/y": ("a.org", ""), "http://a.org#f/y": ("a.org", ""), "http://a.org/p/Q?x#y": ("a.org", "/p/Q"),
    "http://a.org/p#x?y": ("a.org", "/p"), "http://a.org/to/http://b.com/z": ("a.org", "/to/http://b.com/z"), "x://É.ORG:80/é\n/z": ("É.org:80", "/é\n/z"),
    "http:///only/path": ("", "/only/path"),
}


def test_url_parts(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", *[c.alias(n) for c, n in zip(hosts.url_parts(F.col("url")), ("host", "path"))])
    assert {r["url"]: (r["host"], r["path"]) for r in df.collect()} == URLS


def test_longest_rule_wins(spark):
    want = {
        ("example.org", "/es/1"): "example.org/es/", ("www.example.org", "/en/12"): "example.org/en/1", ("example.org", "/en/2"): "org/",
        ("notexample.org", "/es/1"): "org/", ("org", "/"): "org/", ("a.org", ""): None, ("borg", "/"): None, ("a.com", "/fr/x"): "com/fr/", ("com", "/de/"): "com/de/",
        ("a.com", "/en/"): None, ("", ""): None,
    }
    name, verdict = hosts.rule_of(F.col("host"), F.col("path"), RULES)
    rows = spark.createDataFrame(list(want), "host string, path string").select("host", "path", name.alias("rule"), verdict.alias("verdict")).collect()
    assert {(r["host"], r["path"]): r["rule"] for r in rows} == want
    assert {r["rule"]: r["verdict"] for r in rows} == {r.name: r.verdict for r in RULES} | {None: None}


def test_levels(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "www.x.com": ("com", "x.com"), "x.com:8080": ("com", "x.com"),
        "me:pw@www.x.com:80": ("com", "x.com"), "192.168.0.1:80": ("192.168.0.1", "192.168.0.1"), "[::1]:80": ("[::1]", "[::1]"), "alone": ("alone", "alone"), "": ("", ""),
    }
    names = hosts.level_names(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", names["suffix"].alias("suffix"), names["domain"].alias("domain")).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in rows} == want


def test_bad_hosts_are_blocked_by_the_query(spark, tmp_path):
    """Hosts that differ: the bad ones are blocked, also one with few labelled pages of a bad domain; its neighbours under co.uk are not."""
    sites = {"a.co.uk": 9, "b.co.uk": 0, "www.spam.com": 9, "www.fine.com": 1, "10.0.0.1:80": 8, "x.net": 0, "new.spam.com": None}
    pages, labels = [], []
    for h, (host, bad) in enumerate(sites.items()):
        for k in range(40):
            i = h * 100 + k
            pages.append((i, f"http://{host}/en/{i + 200000}", ""))
            if bad is not None:
                labels.append((i + 200000, int(k % 10 >= bad), 0))
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    rows = QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()
    blocked = {r["host"] for r in rows if r["verdict"] == "block"}
    assert blocked == {"a.co.uk", "www.spam.com", "10.0.0.1:80", "new.spam.com"} and {r["host"] for r in rows if r["verdict"] == "allow"} == set(sites) - blocked
    con = __import__("duckdb").connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert differences(QUERIES["op10_url_filter"](spark, str(tmp_path)), con, SQL["op10_url_filter"]) is None


def plain_strength(counts, least=1.0, most=1000.0):
    n, bad, k = sum(a for a, _ in counts), sum(b for _, b in counts), sum(a > 0 for a, _ in counts)
    if not n:
        return most, 0.5
    p, rho = bad / n, 0.0
    free = n - sum(a * a for a, _ in counts) / n - (k - 1)
    if 0 < p < 1 and free > 0:
        spread = sum(a * (b / a - p) ** 2 for a, b in counts if a)
        rho = (spread / (p * (1 - p)) - (k - 1)) / free
    return 1 / min(max(rho, 1 / (most + 1)), 1 / (least + 1)) - 1, p


def plain_bounds(rows, z=1.645):
    """host: (n, bad, mean, bound) of (host, bad) rows."""
    counts = {level: defaultdict(lambda: [0, 0]) for level in hosts.LEVELS}
    names = lambda host: (host.split(".")[-1], ".".join(host.split(".")[-2:]), host)
    for host, bad in rows:
        for level, name in zip(hosts.LEVELS, names(host)):
            counts[level][name][0] += bad is not None
            counts[level][name][1] += bad or 0
    strength = {level: plain_strength(list(counts[level].values())) for level in hosts.LEVELS}
    found = {}
    for host in counts["host"]:
        mean = strength["suffix"][1]
        for level, name in zip(hosts.LEVELS, names(host)):
            (n, bad), s = counts[level][name], strength[level][0]
            mean = (bad + s * mean) / (n + s)
        found[host] = (n, bad, mean, mean - z * sqrt(mean * (1 - mean) / (n + s + 1)))
    return found


def test_reputation_is_shrunk_level_by_level(spark):
    rows = [(f"{s}.{d}.{t}", int((k * 7 + len(s) * d_bad) % 10 < d_bad)) for t in ("com", "org") for d, d_bad in (("good", 1), ("bad", 8), ("mixed", 4)) for s in ("a", "bb", "ccc") for k in range(len(s) * 6)]
    rows += [("new.bad.com", None), ("new.good.org", None), ("alone", 1), ("", None), ("", 0)] + [("hot.good.com", k % 11 == 0) for k in range(200)]
    rows = [(h, None if b is None else int(b)) for h, b in rows]
    want = plain_bounds(rows)
    got = {r["host"]: r for r in hosts.host_reputation(spark.createDataFrame(rows, "host string, bad long")).collect()}
    assert got.keys() == want.keys()
    for host, (n, bad, mean, bound) in want.items():
        r = got[host]
        assert (r["n"], r["bad"]) == (n, bad) and isclose(r["mean"], mean, rel_tol=1e-9) and isclose(r["bound"], bound, rel_tol=1e-9, abs_tol=1e-12)
    assert got["new.bad.com"]["mean"] > 0.4 > 0.25 > got["new.good.org"]["mean"]


def test_reputation_without_labels(spark):
    schema = "host string, bad long"
    assert hosts.host_reputation(spark.createDataFrame([], schema)).count() == 0
    only = hosts.host_reputation(spark.createDataFrame([("a.com", None)], schema)).first()
    assert (only["n"], only["bad"], only["mean"]) == (0, 0, 0.5)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, path string, id long, bad long, n long, bound double, rule string"
    more = ("h", "clash", "clash", 1, 1, 1, 0.0, "clash")
    pages = spark.createDataFrame([(i, u, *more) for i, u in enumerate(URLS)] + [(1, "", *more), (None, "http://x.net/a", *more)], schema)
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (99, 1), (None, 1), (6, None)], "page_id long, bad long")
    rows = hosts.url_verdicts(pages, outcomes, RULES, MAX_BAD).collect()
    assert sorted((r["page_id"], r["host"], r["path"]) for r in rows if r["page_id"] is not None) == sorted([(i, *p) for i, p in enumerate(URLS.values())] + [(1, "", "")])
    assert {(r["host"], r["rule"]) for r in rows if r["page_id"] is None} == {("x.net", None)}
    assert all(r["verdict"] in ("allow", "block") for r in rows)
    assert {r["n_labelled"] for r in rows if r["host"] == ""} == {2}
    assert hosts.url_verdicts(pages, outcomes.limit(0), RULES, MAX_BAD).where("n_labelled = 0").count() == len(rows)
    assert hosts.url_verdicts(pages.limit(0), outcomes, RULES, MAX_BAD).count() == 0
