import random
import re

import duckdb
import pytest

from docfathom.llm import queries, urls

RULES = queries.URL_RULES


def split(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]


def brute_tree(rows, labelled, s=urls.Settings()):
    """template and purity of each shape; rows: urls, labelled: (url, bad)."""
    shape = lambda u: (split(u)[0], tuple(re.sub("[0-9]+", "{n}", x) for x in split(u)[1].split("/") if x))
    stat = {}
    for u in rows:
        stat.setdefault(shape(u), [0, 0, 0])[0] += 1
    for u, bad in labelled:
        if bad is not None:
            own = stat.setdefault(shape(u), [0, 0, 0])
            own[1] += 1
            own[2] += bad
    lab, bad = (sum(x[i] for x in stat.values()) for i in (1, 2))
    out = {}

    def differs(a, b, la, lb):
        if a < s.labels or la <= a or lb <= 0 or la <= lb:
            return False
        return (b * (la - a) - (lb - b) * a) ** 2 * la / (a * (la - a) * lb * (la - lb)) >= s.differs

    def grow(name, own, level, above):
        total = [sum(stat[x][i] for x in own) for i in range(3)]
        rate = (total[2] + s.pseudo * above) / (total[1] + s.pseudo)
        kids = {}
        for x in own:
            if level == s.depth or len(x[1]) <= level:
                out[x] = (name + ("/**" if len(x[1]) > s.depth else ""), 1 - rate)
            else:
                kids.setdefault(x[1][level], []).append(x)
        sums = {c: [sum(stat[x][i] for x in xs) for i in range(3)] for c, xs in kids.items()}
        n, la, lb = (sum(v[i] for v in sums.values()) for i in range(3))
        step = {}
        for c, v in sums.items():
            if len(kids) == 1:
                step[c] = c
            elif (len(kids) >= s.children and 2 * len(kids) > n) or not differs(v[1], v[2], la, lb):
                step[c] = "*"
            else:
                step[c] = "{+}" if v[2] * la > lb * v[1] else "{-}"
        for sign in ("{+}", "{-}"):
            those = [c for c in step if step[c] == sign and len(kids) > 1]
            la2, lb2 = (sum(sums[c][i] for c in those) for i in (1, 2))
            for c in those:
                if len(those) == 1 or differs(sums[c][1], sums[c][2], la2, lb2):
                    step[c] = c
        merged = {}
        for c, xs in kids.items():
            merged.setdefault(step[c], []).extend(xs)
        for c, xs in merged.items():
            grow(f"{name}/{c}", xs, level + 1, rate)

    hosts = {}
    for x in stat:
        hosts.setdefault(x[0], []).append(x)
    for h, xs in hosts.items():
        grow(h, xs, 0, bad / lab if lab else 0.0)
    return {x: out[x] for x in out if stat[x][0]}, shape


def test_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["hot.org"] * 6 + [f"h{i}.org" for i in range(25)]
    url, labelled = [], []
    for _ in range(6000):
        h = rng.choice(hosts)
        a = rng.choice(["en", "de", "tag", "buy", "cheap", "x"])
        u = f"http://{h}/{a}/{rng.choice(['p', 'q', 'r' + str(rng.randrange(3000)), rng.choice('abcdefgh') * rng.randrange(1, 9)])}" + "/t" * rng.randrange(5)
        u += rng.choice(["", "/", "?a=b/c", "#x"])
        url.append(u)
        if rng.random() < 0.4:
            labelled.append((u, int(rng.random() < {"tag": 0.5, "buy": 0.9, "cheap": 0.85}.get(a, 0.1)) if rng.random() < 0.95 else None))
    url += [None, "", "no scheme", "a://", "http://HOT.Org", "http://hot.org?x", "http://hot.org//en///p", "http://u:p@h1.org:80/en/" + "y/" * 3000, "x\n://h1.org/en/a\nb"] * 2
    labelled.append(("http://only-labelled.org/a", 1))
    want, shape = brute_tree(url, labelled)
    df = spark.createDataFrame([(u, "z", 1.0) for u in url], "url string, host string, purity double").repartition(3)
    got = urls.judge(df, spark.createDataFrame(labelled, "url string, bad int"), RULES, carry=("url",)).collect()
    assert sorted(repr(r.carry0) for r in got) == sorted(map(repr, url))
    kinds = set()
    for r in got:
        template, purity = want[shape(r.carry0)]
        assert (r.host, r.path) == split(r.carry0) and r.template == template and abs(r.purity - purity) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if purity < 0.5 else "allow")
        kinds.add(r.verdict)
        kinds |= set(re.findall(r"\{[+-]\}|/\*", r.template))
    assert kinds >= {"allow", "block", "{+}", "/*"}


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://example.com/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/x", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/1", "com/", "allow"),
        ("http://EXAMPLE.COM/EN/1", "com/", "allow"),
        ("http://example.com", None, "allow"),
        ("http://example.com?/en/", None, "allow"),
        ("http://x.net/es/1", "net/es/", "block"),
        ("http://x.net/es", None, "allow"),
        ("http://net/fr/", "net/fr/", "block"),
        ("http://a.com:80/", None, "allow"),
        (None, None, "allow"),
    ],
)
def test_rules(spark, url, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string")
    host, path = urls.parsed(df.url)
    found, said = urls.ruled(host, path, RULES)
    assert tuple(df.select(found, said).first()) == (rule, verdict if rule else None)


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "url string, bad int")
    assert urls.judge(spark.createDataFrame([], "url string"), none).count() == 0
    out = urls.judge(spark.createDataFrame([("http://a/b",), ("http://a/b",)], "url string"), none).collect()
    assert [(r.template, r.purity, r.verdict) for r in out] == [("a/b", 1.0, "allow")] * 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_url_filters"])
    columns = [c[0] for c in want.description]
    out = queries.QUERIES["op12_url_filters"](spark, f"/root/testdata/{sf}").select(*columns)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want.fetchall()))
