"""Queries over the table of sources (the suppliers, changed by patches from the customers) and effects by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import metrics, registry
from storyline.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

NOW = 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("s"), k.cast("string")).alias("key"),
        F.when(k % 9 == 0, "manual").otherwise("rss").alias("kind"),
        F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.org/feed")).alias("url"),
        F.lit("quality").alias("tier"),
        F.round((F.col("s_acctbal") + 1000) / 11000, 6).cast("double").alias("reliability"),
        (5 + F.col("s_nationkey")).cast("int").alias("interval"),
        (k % 7 != 0).alias("enabled"),
        (k % 10 == 0).alias("mandatory"),
        (k % 5).cast("int").alias("errors"),
        F.lit(True).alias("verified"),
        F.when(k % 5 > 2, NOW + (k % 3 - 1) * 600).cast("long").alias("next_attempt"),
        (NOW - (k % 40) * 60).cast("long").alias("last_fetch"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return c.select(
        k.cast("long").alias("seq"),
        F.concat(F.when(k % 11 == 0, "S").otherwise("s"), (k % 400).cast("string")).alias("key"),
        F.when(k % 13 == 0, "gopher").when(k % 13 == 1, "atom").alias("kind"),
        F.when(k % 3 == 0, F.concat(F.lit("https://c"), (k % 50).cast("string"), F.lit(".example.org"))).when(k % 29 == 0, "ftp:").alias("url"),
        F.when(k % 17 == 0, "best").alias("tier"),
        F.round(F.col("c_acctbal") / 9000, 6).cast("double").alias("reliability"),
        F.when(k % 2 == 0, F.col("c_nationkey")).cast("int").alias("interval"),
        F.when(k % 5 == 0, F.lit(False)).alias("enabled"),
        (k % 4 == 0).alias("confirmed"),
    )


TABLES = """s AS (SELECT 's' || s_suppkey AS key, CASE WHEN s_suppkey % 9 = 0 THEN 'manual' ELSE 'rss' END AS kind, 'https://s' || s_suppkey || '.example.org/feed' AS url, 'quality' AS tier, round((s_acctbal + 1000) / 11000, 6)::DOUBLE AS reliability, (5 + s_nationkey)::INT AS interval,
    s_suppkey % 7 <> 0 AS enabled, s_suppkey % 10 = 0 AS mandatory, (s_suppkey % 5)::INT AS errors, CASE WHEN s_suppkey % 5 > 2 THEN 1000000 + (s_suppkey % 3 - 1) * 600 END AS next_attempt, 1000000 - (s_suppkey % 40) * 60 AS last_fetch FROM supplier),
  p AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN 'S' ELSE 's' END || (c_custkey % 400) AS key, CASE c_custkey % 13 WHEN 0 THEN 'gopher' WHEN 1 THEN 'atom' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'https://c' || (c_custkey % 50) || '.example.org' WHEN c_custkey % 29 = 0 THEN 'ftp:' END AS url,
    CASE WHEN c_custkey % 17 = 0 THEN 'best' END AS tier, round(c_acctbal / 9000, 6)::DOUBLE AS reliability, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END::INT AS interval, CASE WHEN c_custkey % 5 = 0 THEN false END AS enabled, c_custkey % 4 = 0 AS confirmed FROM customer),
  l AS (SELECT p.* FROM p JOIN (SELECT key, max(seq) AS seq FROM p GROUP BY key) USING (key, seq)),
  j AS (SELECT l.*, s.key IS NULL AS creating, coalesce(s.mandatory, false) AS must FROM l LEFT JOIN s USING (key)),
  r AS (SELECT *, list_filter([CASE WHEN creating AND NOT regexp_matches(key, '^[a-z0-9][a-z0-9_-]{1,62}$') THEN 'key' END, CASE WHEN kind = 'gopher' THEN 'kind' END, CASE WHEN tier = 'best' THEN 'tier' END, CASE WHEN reliability NOT BETWEEN 0 AND 1 THEN 'reliability' END, CASE WHEN interval < 5 THEN 'interval' END,
    CASE WHEN coalesce(kind, 'rss') <> 'manual' AND (creating OR url IS NOT NULL) AND NOT coalesce(regexp_matches(url, '^https?://[^/]+'), false) THEN 'url' END, CASE WHEN must AND NOT coalesce(enabled, true) AND NOT confirmed THEN 'mandatory' END], lambda x: x IS NOT NULL) AS reasons FROM j)"""


@query(f"""WITH {TABLES} SELECT coalesce(s.key, g.key) AS key, coalesce(g.kind, s.kind, 'rss') AS kind, coalesce(g.url, s.url, '') AS url, coalesce(g.reliability, s.reliability, 0.7) AS reliability, coalesce(g.interval, s.interval, 15) AS interval, coalesce(g.enabled, s.enabled, true) AS enabled,
  CASE WHEN g.url IS NOT NULL AND g.url IS DISTINCT FROM s.url THEN 0 ELSE coalesce(s.errors, 0) END AS errors FROM s FULL JOIN (SELECT * FROM r WHERE len(reasons) = 0) g ON s.key = g.key""")
def source_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources after the valid last patches of each key."""
    out, _ = registry.upserted(sources(spark, sf_dir), patches(spark, sf_dir))
    return out.select("key", "kind", "url", "reliability", "interval", "enabled", "errors")


@query(f"WITH {TABLES} SELECT key, seq, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def source_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that can't be taken, with all reasons."""
    _, rejects = registry.upserted(sources(spark, sf_dir), patches(spark, sf_dir))
    return rejects.select("key", "seq", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {TABLES}, d AS (SELECT * FROM s WHERE enabled AND kind <> 'manual' AND (next_attempt IS NULL OR next_attempt <= 1000000) AND 1000000 - last_fetch >= interval * 60)
  SELECT key, errors + 1 AS errors, CAST(1000000 + least(interval * pow(2, least(errors + 1, 6)), 360) * 60 AS BIGINT) AS next_attempt FROM d""")
def source_due_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are due, and when each would be tried again if it failed now."""
    return registry.failed(registry.due(sources(spark, sf_dir), F.lit(NOW)), F.lit(NOW)).select("key", "errors", "next_attempt")


@query(f"""WITH {TABLES}, k AS (SELECT DISTINCT key FROM p WHERE seq % 3 = 0), u AS (SELECT DISTINCT 's' || l_suppkey AS key FROM lineitem WHERE l_quantity > 49)
  SELECT key, CASE WHEN key IN (SELECT key FROM k) AND NOT mandatory THEN false ELSE enabled END AS enabled FROM s WHERE key NOT IN (SELECT key FROM k) OR mandatory OR key IN (SELECT key FROM u)""")
def source_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources after a delete: those in use are switched off, mandatory ones stay."""
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key"))
    keys = patches(spark, sf_dir).filter("seq % 3 = 0").select("key")
    return registry.deleted(sources(spark, sf_dir), keys, used).select("key", "enabled")


@query("""WITH b AS (SELECT o_orderkey, ln(o_totalprice) AS y, c_mktsegment AS category, CAST(n_regionkey AS VARCHAR) AS geo, o_orderstatus AS format, o_orderpriority AS platform, CAST(month(o_orderdate) AS VARCHAR) AS hour, CAST(isodow(o_orderdate) AS VARCHAR) AS weekday FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  q AS (SELECT l_orderkey AS o_orderkey, CASE WHEN max(l_discount) > 0.09 THEN 'with' ELSE 'without' END AS numbers, list_distinct(list(l_returnflag)) AS topics FROM lineitem GROUP BY 1), r AS (SELECT b.*, numbers, topics FROM b JOIN q USING (o_orderkey)),
  d AS (UNPIVOT (SELECT y, category, geo, format, platform, hour, weekday, numbers FROM r) ON category, geo, format, platform, hour, weekday, numbers INTO NAME dimension VALUE key),
  a AS (SELECT dimension, key, y FROM d UNION ALL SELECT 'subtopic', unnest(topics), y FROM r), m AS (SELECT avg(y) AS mean, stddev_pop(y) AS sd FROM r),
  g AS (SELECT dimension, key, count(*) AS n, avg(y) - max(mean) AS effect, max(sd) / sqrt(count(*)) AS se FROM a, m GROUP BY ALL)
  SELECT dimension, key, n, round(effect, 6) AS effect, CASE WHEN n >= 12 AND abs(effect) > 3 * se THEN 'high' WHEN n >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM g WHERE n >= 4 AND abs(effect) >= 0.01 AND abs(effect) > 1.5 * se""")
def insights_all_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of seven dimensions and of topics (several a row) whose mean differs from the whole by 1.5 standard errors."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = joined.select("o_orderkey", F.log("o_totalprice").alias("y"), F.col("c_mktsegment").alias("category"), F.col("n_regionkey").alias("geo"), F.col("o_orderstatus").alias("format"), F.col("o_orderpriority").alias("platform"), F.month("o_orderdate").alias("hour"), (F.weekday("o_orderdate") + 1).alias("weekday"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_discount") > 0.09, "with").otherwise("without").alias("numbers"), F.collect_set("l_returnflag").alias("subtopic"))
    found = metrics.effects_of_all(rows.join(items, "o_orderkey"), ["category", "geo", "format", "platform", "hour", "weekday", "numbers"], ["subtopic"], "y", effect=0.01)
    return found.select("dimension", "key", "n", F.round("effect", 6).alias("effect"), "confidence")
