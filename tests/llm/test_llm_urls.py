import random
from itertools import combinations

from pyspark.sql import functions as F

from tamis.llm import urlrules


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    stop = min([k for k in (tail.find(c) for c in "?#") if k >= 0], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:stop]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urlrules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", "x", 1) for i, u in rows], "page_id long, url string, html string, verdict string, key int")


URLS = ["http://a.net/x", "https://EXAMPLE.net/en/1?x#y", "http://www.example.net/en", "http://net", "http://net/", "http://ornet/", "http://x.example.com/de/?q=http://b.net/",
        "http://b.org/fr/2", "http://b.org/FR/", "ftp://org/fr/", "no scheme", None, "", "://x.net/", "http://É.net/a", "http://a.net?x=/", "http://u@h.net:80/", "a\nb://h.net/z", "http:///net/"]


def test_hosts_paths_and_listed_rules_equal_brute_force(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])]
    got = urlrules.judge(pages(spark, rows)).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(
        ((i, *parts(u), rule(*parts(u))[0], rule(*parts(u))[1] or "allow") for i, u in rows), key=str
    )


def test_mined_rules_equal_counting(spark):
    rng = random.Random(11)
    rows = [(k, f"http://{rng.choice(['spam', 'shop', 'blog'])}{rng.randint(0, 3)}.example.com/{rng.choice(['buy', 'read'])}/{k}") for k in range(300)]
    bad = {k for k, u in rows if "spam" in u and "/buy/" in u and rng.random() < 0.9}
    labels = spark.createDataFrame([(k, 0 if k in bad else 1, 0) for k, _ in rows[:250]], "doc_id long, quality int, toxic int")
    table = pages(spark, rows)
    host, path = urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))
    tokens = {r[0]: set(r[1]) for r in table.select("page_id", urlrules.tokens(host, path, F.col("url"))).collect()}
    labelled = table.where("page_id < 250").withColumn("bad", F.col("page_id").isin(sorted(bad)))
    rules = {tuple(r["tokens"]): (round(r["confidence"], 9), r["key"]) for r in urlrules.mine(labelled, F.col("bad"), support=0.05).collect()}
    expected = {}
    for size in range(1, 8):
        for combo in {c for k in range(250) for c in combinations(sorted(tokens[k]), size)}:
            held = [k for k in range(250) if set(combo) <= tokens[k]]
            hits = len([k for k in held if k in bad])
            if hits >= 0.05 * 250 and hits / len(held) >= 0.6:
                expected[combo] = round(hits / len(held), 9)
    kept = {c: v for c, v in expected.items() if not any(
        expected.get(p, -1) >= v for p in [tuple(x for x in c if x != t) for t in c] + ([(t,) for t in c] if len(c) > 1 else []) if p
    )}
    assert {c: v[0] for c, v in rules.items()} == kept and kept
    verdicts = {r["page_id"]: r for r in urlrules.judge(table, labels, support=0.05).collect()}
    for k, u in rows:
        fits = any(set(c) <= tokens[k] for c in kept)
        assert verdicts[k]["verdict"] == (rule(*parts(u))[1] or ("block" if fits else "allow"))


def test_late_path_parts_and_parameters_are_tokens(spark):
    path = "/".join(f"part{chr(97 + k)}" for k in range(20))
    query = "&".join(f"name{chr(97 + k)}={k}" for k in range(20))
    host = ".".join(f"host{chr(97 + k)}" for k in range(20))
    urls = [f"http://{host}.com/{path}/{'buy' if k % 2 else 'read'}/x?{query}&{'aff' if k % 3 else 'ref'}=1" for k in range(60)]
    bad = [k % 2 == 1 and k % 3 > 0 for k in range(60)]
    table = spark.createDataFrame([(u, b) for u, b in zip(urls, bad)], "url string, bad boolean")
    rules = {tuple(r["tokens"]): (r["confidence"], round(r["support"], 9), r["key"]) for r in urlrules.mine(table, F.col("bad"), support=0.05).collect()}
    assert rules[("path:buy", "query:aff")] == (1.0, round(20 / 60, 9), "path:buy")
    assert not [t for t in rules if len(t) > 2]
    labels = spark.createDataFrame([(k, 0 if b else 1, 0) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    late = pages(spark, list(enumerate(urls)) + [(99, "http://other.com/1/2/a/b/c/d/e/f/g/h/i/j/buy?a&b&c&d&e&f&g&h&i&j&aff=2")])
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in urlrules.judge(late, labels, support=0.05, confidence=0.9).collect()}
    assert got == {k: ("block", "path:buy query:aff") if k == 99 or bad[k] else ("allow", None) for k in got} and len(got) == 61


def test_tokens_of_the_same_urls_each_give_the_rule(spark):
    rows = [(f"http://a.com/{'spam/offer' if k < 20 else 'read'}/{k}", k < 18) for k in range(100)]
    table = spark.createDataFrame(rows, "url string, bad boolean")
    rules = {tuple(r["tokens"]): (r["confidence"], r["support"], r["key"]) for r in urlrules.mine(table, F.col("bad"), support=0.05).collect()}
    assert rules == {("path:spam",): (0.9, 0.18, "path:spam"), ("path:offer",): (0.9, 0.18, "path:offer")}


def test_no_labels_for_the_pages_and_empty_tables(spark):
    table = pages(spark, [(1, "http://b.com/")])
    labels = spark.createDataFrame([(7, 0, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert [r["verdict"] for r in urlrules.judge(table, labels).collect()] == ["allow"]
    assert urlrules.judge(pages(spark, []), labels).count() == 0


def test_a_sample_is_bounded_and_fixed(spark):
    from tamis.llm.common import sampled

    df = spark.range(10_000).select("id")
    some = sampled(df, 1000, "id")
    assert 800 < some.count() < 1200 and some.exceptAll(sampled(df.repartition(5), 1000, "id")).count() == 0
    assert sampled(df, 10_000, "id").count() == 10_000


def test_no_rule_rests_on_a_few_urls_or_on_chance(spark):
    rows = [(i, f"http://h{i}.test/a/{'odd' if i < 3 else 'some' if i < 60 else 'bad' if i < 90 else 'x'}") for i in range(600)]
    bad = lambda i: i < 3 or 60 <= i < 90 or i % 2 == 0  # noqa: E731  half of all are bad, so half of "some" say nothing
    table = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not bad(i)), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r["mined_rule"] for r in urlrules.judge(table, labels, confidence=0.5).collect()}
    assert {i for i, rule in found.items() if rule} == set(range(60, 90)) and set(found.values()) == {None, "path:bad"}
    loose = {r["mined_rule"] for r in urlrules.judge(table, labels, confidence=0.5, least=1, errors=None).collect()}
    assert loose - {None} == {"path:odd", "path:bad", "word:test"}
    assert urlrules.mine(table.limit(5), F.lit(True), least=10).count() == 0
