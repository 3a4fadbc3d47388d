import random

import pytest
from kinweave.llm import urlfilter as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v == "block", v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p) and (not p or p[0] == "/")]
    best = max(fits, default=(0, None, False, "allow"))
    return host, path, best[1], best[3]


URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x?y#z", "https://a.www.example.com/en/", "http://example.com/EN/", "http://example.com", "http://com/", "http://notexample.com/en/",
    "http://m.example.net/es/1", "net/es/", "http://net/es/", "http://x.net/fr/?q", "http://net:80/fr/", "http://example.org/en/", None, "", "no scheme", "://", "://net/es/", "a://b://net/es/",
    "http://u@net/es/", "http://É.net/es/É", "http://.net/es/", "http://net./es/", "http://" + "a." * 3000 + "net/es/" + "x" * 9000, "http://x.com/a\nb?c", "http://example.com/en/1",
]


def judged(spark, urls, rules, **how):
    pages = spark.createDataFrame([(i, u, f"h{i}", "mine", 7) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, host int")
    out = U.judge(pages, spark.createDataFrame(rules, U.RULES), **how)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}, out


def test_rules_equal_brute_force(spark):
    got, out = judged(spark, URLS, U.LISTED)
    assert got == {i: brute(u, U.LISTED) for i, u in enumerate(URLS)}
    assert set(out.columns) == {"page_id", "url", "html", "host", "path", "rule", "verdict"}


def test_many_rules_need_many_levels(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    hosts = [f"{word(2)}.{word(1)}.com" for _ in range(40)]
    rules = list({(rng.choice([h, h.split(".", 1)[1]]), "/" + word(rng.randint(0, 3)), rng.choice(["block", "allow"])) for h in hosts for _ in range(12)})
    rules += [("", "/", "block"), ("com", "x", "block"), (rules[0][0], rules[0][1], "block"), (rules[0][0], rules[0][1], "allow")]
    urls = [f"http://{rng.choice(['', 'w.', 'abc.'])}{rng.choice(hosts)}/{word(rng.randint(0, 5))}" for _ in range(3000)]
    got, _ = judged(spark, urls, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_a_cascade_is_exact_over_its_universe(spark):
    corpus = spark.range(4000).selectExpr("array(concat('k', id), concat('k', id + 2000)) as keys")
    listed = spark.range(0, 6000, 7).selectExpr("concat('k', id) as key").union(spark.sql("select 'elsewhere' as key"))
    cascade = U.build(listed, corpus, 8000)
    assert len(cascade.levels) > 3 and cascade.levels[1].keys > 0
    asked = spark.range(6000).selectExpr("id", "concat('k', id) as key")
    h, g = U.hashes(asked.key)
    rows = asked.select("id", U.flags(spark, cascade)(U.F.array(h), U.F.array(g))[0].alias("hit")).collect()
    assert {r.id for r in rows if r.hit} == set(range(0, 6000, 7))


def test_the_bound_is_checked_before_building(spark):
    with pytest.raises(ValueError, match="parts of the list"):
        U.build(spark.range(5000).selectExpr("cast(id as string) as key"), spark.range(1).selectExpr("array('a') as keys"), 10**9, most_bytes=1000)


def test_no_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([("a", "http://net/es/")], "page_id string, url string")
    assert [(r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame([], U.RULES)).collect()] == [(None, "allow")]
    assert [tuple(r) for r in U.url_report(pages).collect()] == [("a", "net", "/es/", "net/es/", "block")]
    assert U.url_report(pages.limit(0)).count() == 0
