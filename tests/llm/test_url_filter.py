import random

import pytest
from pyspark.sql import functions as F

from barquarry.llm import url_filter as u

LOWER = str.maketrans(u.UPPER, u.LOWER)


def plain(url, rules, default="allow"):
    """host, path, rule, verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(LOWER), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, h, p in rules:
        if h is None or p is None or verdict is None:
            continue
        h = h.translate(LOWER)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            found = (len(h + p), h + p, verdict == "block")
            best = found if best is None else max(best, found)
    return host, path, best and best[1], default if best is None else "block" if best[2] else "allow"


def frames(spark, urls, rules):
    pages = spark.createDataFrame([(i, url, "x", 1) for i, url in enumerate(urls)], "page_id long, url string, host string, `_best` int")
    return pages, spark.createDataFrame(rules, "verdict string, host string, path string")


def check(spark, urls, rules, **more):
    rows = u.judged(*frames(spark, urls, rules), **more).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(urls)
    assert got == {i: plain(url, rules) for i, url in enumerate(urls)}


AWKWARD = [None, "", "no scheme/en/", "://", "http://", "http://COM", "http://com/", "HTTP://WWW.Example.COM/en/a?b#c", "x://a.net?/es/", "x://a.net/es/#q",
           "http://a://b/c", "http://...net/fr/", "http://.net/fr/x", "http://notcom/", "http://ÄÖ.com/é", "http://u@h.com:80/p", "http://a.com\n/en/", "http://" + "a." * 3000 + "net/es/" + "p" * 60_000]


def test_registered_rules_on_awkward_urls(spark):
    check(spark, AWKWARD + AWKWARD[:3], u.RULES)


def test_many_rules_several_parts(spark):
    r = random.Random(5)
    names = ["a", "b", "co", "uk", "net", "x1"]
    some_host = lambda: ".".join(r.choice(names) for _ in range(r.randint(1, 4)))
    some_path = lambda: "".join(r.choice(["/", "/p", "/q/", "é"]) for _ in range(r.randint(0, 4)))
    rules = [(r.choice(["allow", "block"]), some_host(), r.choice(["", "/", "/" + some_path()])) for _ in range(150)]
    rules += [("block", None, "/"), ("allow", "a.b", "/"), ("block", "a.b", "/"), (None, "net", "/")]
    urls = [f"http://{some_host()}/{some_path()}?{i}" for i in range(400)] + AWKWARD[:8]
    check(spark, urls, rules)
    check(spark, urls, rules, most_bytes=400)


@pytest.mark.parametrize(("most_hashes", "least_levels"), [(1, 4), (8, 1)])
def test_cascade_is_exact_on_its_universe(spark, most_hashes, least_levels):
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    cascade = u.build(universe, most_hashes=most_hashes)
    assert len(cascade.levels) >= least_levels
    assert universe.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    assert [x["h"] for x in spark.createDataFrame([(None,)], "key string").select(cascade.holds(F.col("key")).alias("h")).collect()] == [False]


def test_nothing_listed_and_all_listed(spark):
    keys = spark.range(50).select(F.col("id").cast("string").alias("key"))
    for listed in (False, True):
        universe = keys.withColumn("listed", F.lit(listed))
        assert universe.where(u.build(universe).holds(F.col("key"))).count() == (50 if listed else 0)
    with pytest.raises(ValueError, match="part the keys"):
        u.build(keys.withColumn("listed", F.lit(True)), most_bytes=4)


def test_empty_tables(spark):
    pages, rules = frames(spark, ["http://a.com/"], u.RULES)
    assert u.judged(pages.limit(0), rules).collect() == []
    (row,) = u.judged(pages, rules.limit(0), default="block").collect()
    assert (row["rule"], row["verdict"]) == (None, "block")


def test_no_python_on_the_path(spark):
    plan = u.judged(*frames(spark, AWKWARD, u.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
