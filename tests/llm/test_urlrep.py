import math

import pytest
from pyspark.sql import functions as F

from sparkseek.llm import urlrep as U

PAGES = "page_id long, url string"


def test_parts(spark):
    cases = {
        "http://A.Example.COM/De/x?q#f": ("a.example.com", "/De/x"), "http://a.b?x/y": ("a.b", ""), "http://a.b#/": ("a.b", ""), "x://y://z/": ("y:", "//z/"), "://": ("", ""), "no scheme/": ("", ""), None: ("", ""), "": ("", ""),
        "http://ÀB.net/é?": ("Àb.net", "/é"), "http://u@h.net:80/p": ("u@h.net:80", "/p"), "http://a\nb/c\nd": ("a\nb", "/c\nd"),
    }
    host, path = U.host_and_path(F.col("url"))
    got = spark.createDataFrame([(u,) for u in cases], "url string").select("url", host.alias("h"), path.alias("p")).collect()
    assert {r.url: (r.h, r.p) for r in got} == cases


def test_rules(spark):
    def fits(host, path, rules):
        own = [(len(r), len(r.split("/")[0]), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        return min(((-n, -h, r, a != "block", a) for n, h, r, a in own), default=(0, 0, None, 0, None))

    rules = [*U.RULES, ("allow", "b.net/"), ("block", "net/xy"), ("allow", "a.b.net/xyz"), ("allow", "same.org/p"), ("block", "same.org/p"), ("block", "x.io")]
    pages = [(h, p) for h in ("net", "a.net", "anet", "b.net", "a.b.net", "example.net", "w.example.net", "example.com", "myexample.com", "m.example.com", "q.org", "same.org", "x.io", "", "net.") for p in ("", "/", "/en/", "/en", "/de/x", "/fr/", "/xyz", "/xy", "/p")]
    df = spark.createDataFrame([(h, p, "other") for h, p in pages], "host string, path string, rules string")
    got = U.with_rule(df, U.rule_table(spark, tuple(rules))).collect()
    assert len(got) == len(pages)
    for r in got:
        best = fits(r.host, r.path, rules)
        assert (r.rule, r.action) == (best[2], best[4]), r
    assert U.with_rule(df, U.rule_table(spark).limit(0)).where("rule is null").count() == len(pages)


def test_domains(spark):
    cases = {"a.b.example.com": ("com", "example.com"), "x.co.uk": ("co.uk", "x.co.uk"), "a.x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "1.2.3.4": ("", "1.2.3.4"), "[::1]": ("", "[::1]"), "u:p@h.net:80": ("net", "h.net"), "h.net.": ("net", "h.net")}
    s, d = U.registered(F.col("h"))
    assert {r.h: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in cases], "h string").select("h", s.alias("s"), d.alias("d")).collect()} == cases


def shrunk(counts, above):
    """Posterior means of groups; counts: group -> (n, x, mean of the level above)."""
    s = sum((x - n * m) ** 2 for n, x, m in counts.values())
    b = sum(n * m * (1 - m) for n, x, m in counts.values())
    d = sum(n * (n - 1) * m * (1 - m) for n, x, m in counts.values())
    k = U.DEFAULT_K if d == 0 else U.MOST_K if s <= b else min(U.MOST_K, max(U.LEAST_K, d / (s - b) - 1))
    return {g: (x + k * m) / (n + k) for g, (n, x, m) in counts.items()}, k


@pytest.mark.parametrize("few", [0, 10_000])
def test_reputation(spark, few, monkeypatch):
    monkeypatch.setattr(U, "FEW", few)  # both kinds of join
    hosts = {f"h{i}.{d}": (n, x) for i, (d, n, x) in enumerate([("bad.com", 90, 88), ("bad.com", 5, 5), ("bad.com", 0, 0), ("good.com", 80, 3), ("good.com", 2, 2), ("one.org", 1, 1), ("two.org", 40, 1), ("x.co.uk", 7, 4)])}
    got = {r.host: r for r in U.reputation(spark.createDataFrame([(h, n, x) for h, (n, x) in hosts.items()], "host string, n long, x long")).collect()}
    group = lambda h, level: {"suffix": "co.uk" if h.endswith("co.uk") else h.split(".")[-1], "domain": h.split(".", 1)[1], "host": h}[level]
    above = {h: (sum(x for _, x in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1) for h in hosts}
    for level in U.LEVELS:
        counts = {}
        for h, (n, x) in hosts.items():
            g = counts.get(group(h, level), (0, 0, 0))
            counts[group(h, level)] = (g[0] + n, g[1] + x, above[h])
        means, k = shrunk(counts, above)
        above = {h: means[group(h, level)] for h in hosts}
    for h, (n, _) in hosts.items():
        assert math.isclose(got[h]["mean"], above[h], rel_tol=1e-9)
        assert math.isclose(got[h].lower, above[h] - 3 * math.sqrt(above[h] * (1 - above[h]) / (n + k + 1)), rel_tol=1e-9, abs_tol=1e-12)
    assert got["h0.bad.com"].lower > U.LIMIT > got["h3.good.com"].lower and got["h2.bad.com"]["mean"] > got["h5.one.org"]["mean"]


def test_judge(spark):
    pages = [(i, f"http://spam.bad.com/p{i}", "k") for i in range(60)] + [(100 + i, f"http://fine.good.com/p{i}", "k") for i in range(60)]
    pages += [(200, "http://new.bad.com/", ""), (201, None, ""), (None, "http://spam.bad.com/x", ""), (0, "http://spam.bad.com/p0", ""), (202, "http://a.net/z", ""), (203, "http://fine.good.com/" + "x/" * 100_000, "")]
    outcomes = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(0, 0), (0, None), (None, 1), (777, 1)]
    got = U.judge(spark.createDataFrame(pages, PAGES + ", HOST string"), spark.createDataFrame(outcomes, "page_id long, unwanted int"), U.rule_table(spark)).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault((r.host, r.rule), set()).add(r.verdict)
    assert by == {("spam.bad.com", None): {"block"}, ("fine.good.com", None): {"allow"}, ("new.bad.com", None): {"block"}, ("", None): {"allow"}, ("a.net", "net/"): {"block"}}
    assert {r.n_outcomes for r in got if r.host == "spam.bad.com"} == {61}
    assert U.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], "page_id long, unwanted int"), U.rule_table(spark)).count() == 0
    alone = U.judge(spark.createDataFrame([(1, "http://a.com/")], PAGES), spark.createDataFrame([], "page_id long, unwanted int"), U.rule_table(spark)).first()
    assert (alone.verdict, alone.n_outcomes) == ("allow", 0)
