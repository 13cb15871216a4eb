"""The table of sources and effects by dimension."""

import random
import statistics

from pyspark.sql import functions as F

from storyline.operators import metrics, registry

SOURCE = "key string, kind string, url string, tier string, reliability double, interval int, enabled boolean, mandatory boolean, errors int, verified boolean, next_attempt long, last_fetch long"
PATCH = "seq long, key string, kind string, url string, tier string, reliability double, interval int, enabled boolean, confirmed boolean"


def tables(spark):
    sources = [("a", "rss", "https://a.org", "top", 0.9, 10, True, True, 3, True, 500, 100), ("b", "rss", "https://b.org", "blog", 0.5, 10, True, False, 0, True, None, None), ("c", "manual", "", "top", 0.5, 10, True, False, 0, True, None, None)]
    patches = [
        (1, "a", None, None, None, 2.0, None, None, None),
        (2, "a", None, "https://new.org", None, None, None, False, False),  # mandatory: not confirmed
        (3, "b", None, "https://b.org/2", None, 0.6, None, None, None),
        (4, "dd", "atom", "https://d.org", None, None, 30, None, None),
        (5, "E", None, "ftp://e", "x", -1.0, 1, None, None),
        (6, "ff", "manual", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(sources, SOURCE), spark.createDataFrame(patches, PATCH)


def test_upsert_and_rejects(spark):
    out, rejects = registry.upserted(*tables(spark))
    rows = {r.key: r for r in out.collect()}
    assert set(rows) == {"a", "b", "c", "dd", "ff"}
    assert rows["a"].url == "https://a.org" and rows["a"].enabled and rows["a"].errors == 3
    assert (rows["b"].url, rows["b"].reliability, rows["b"].verified, rows["b"].tier) == ("https://b.org/2", 0.6, False, "blog")
    assert (rows["dd"].kind, rows["dd"].interval, rows["dd"].tier, rows["dd"].reliability, rows["dd"].enabled) == ("atom", 30, "quality", 0.7, True)
    assert {r.key: r.reasons for r in rejects.collect()} == {"a": ["mandatory"], "E": ["key", "tier", "reliability", "interval", "url"]}


def test_confirmed_switch_off(spark):
    sources, _ = tables(spark)
    out, rejects = registry.upserted(sources, spark.createDataFrame([(1, "a", None, None, None, None, None, False, True)], PATCH))
    assert not out.filter("key = 'a'").first().enabled and rejects.count() == 0


def test_due_and_backoff(spark):
    sources, _ = tables(spark)
    assert [r.key for r in registry.due(sources, F.lit(400)).collect()] == ["b"]
    assert sorted(r.key for r in registry.due(sources, F.lit(1000)).collect()) == ["a", "b"]
    assert [r.key for r in registry.due(sources, F.lit(699)).filter("key = 'a'").collect()] == []  # ten minutes since the last
    after = {r.key: (r.errors, r.next_attempt, r.last_fetch) for r in registry.failed(sources, F.lit(1000).cast("long")).collect()}
    assert after["a"] == (4, 1000 + 160 * 60, 1000) and after["b"] == (1, 1000 + 20 * 60, 1000)
    many = sources.withColumn("errors", F.lit(50))
    assert {r.next_attempt for r in registry.failed(many, F.lit(0).cast("long")).collect()} == {360 * 60}


def test_delete(spark):
    sources, _ = tables(spark)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "key string")
    out = registry.deleted(sources, keys, spark.createDataFrame([("b",), ("b",)], "key string"))
    assert sorted((r.key, r.enabled) for r in out.collect()) == [("a", True), ("b", False)]


def test_effects_of_all_dimensions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.randrange(3), rng.sample(["p", "q", "r"], rng.randint(0, 2)), rng.random()) for _ in range(200)]
    rows = [(a, b, c, y + (a == "x") + 0.3 * ("p" in c)) for a, b, c, y in rows]
    found = {(r.dimension, r.key): (r.n, round(r.effect, 9), r.confidence) for r in metrics.effects_of_all(spark.createDataFrame(rows, "a string, b int, c array<string>, y double"), ["a", "b"], ["c"], "y").collect()}
    ys = [r[3] for r in rows]
    groups = {}
    for a, b, c, y in rows:
        for key in [("a", a), ("b", str(b)), *(("c", x) for x in c)]:
            groups.setdefault(key, []).append(y)
    plain = {}
    for key, of in groups.items():
        diff, se = statistics.fmean(of) - statistics.fmean(ys), statistics.pstdev(ys) / len(of) ** 0.5
        if abs(diff) >= 0.15 and abs(diff) > 1.5 * se:
            plain[key] = (len(of), round(diff, 9), "high" if abs(diff) > 3 * se else "medium")
    assert found == plain and ("a", "x") in found
