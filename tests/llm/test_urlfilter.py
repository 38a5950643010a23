import random

from pyspark.sql import functions as F

from quantloom.llm import urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def brute(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    best = max(x[:3] for x in fit)
    return host, path, best[2], max(v for *k, v in fit if tuple(k) == best)


def test_random_urls(spark):
    rnd = random.Random(2)
    labels = ["com", "a", "b", "www", "", "Ex", "é"]
    name = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "a", "b", "//", "é"]) for _ in range(rnd.randint(0, 4)))
    urls = [f"http://{name()}{path()}{rnd.choice(['', '?q=/x', '#f'])}" for _ in range(1500)] + [None, "", "nothing", "http://", "x://y://z", "a\nb://c/d\ne", "http://host.com:80/x", "http://" + "a" * 5000 + "/" * 5000] * 3
    rules = list({(h.lower(), p): (h.lower(), p, v) for h, p, v in ((name(), path(), rnd.choice(["allow", "block"])) for _ in range(150))}.values())
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, rule string, other string").repartition(3)
    r = spark.createDataFrame(rules + [(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlfilter.judged(df, r).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules), u


def test_nothing(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(x.rule, x.verdict) for x in urlfilter.judged(df, none, default="block").collect()] == [(None, "block")]
    assert urlfilter.judged(df.limit(0), none.union(spark.createDataFrame([("a", "/", "block")], none.schema))).count() == 0


def test_rules_that_contradict(spark):
    r = spark.createDataFrame([("a", "/", "allow"), ("A", "/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string").withColumn("page_id", F.lit(3))
    assert urlfilter.judged(df, r).first().verdict == "block"
