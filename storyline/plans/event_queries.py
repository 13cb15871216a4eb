"""Queries over the event stream, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import events as ev
from storyline.operators import learning, series
from storyline.settings import LearningSettings, TrendSettings
from storyline.sources.tables import latest_second, seconds, story_events, table

DAY = TrendSettings(velocity_window_h=24.0)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


EV = """WITH e AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS story, user_id AS source,
  CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type, value FROM events), c AS (SELECT max(sec) AS now FROM e) """

STATS = EV + """, s AS (SELECT story, count(*) AS n_articles, count(DISTINCT source) AS n_independent, min(sec) AS first_sec, max(sec) AS last_sec,
  count(*) FILTER (sec > now - 86400 AND sec <= now) / 24.0 AS v_now, count(*) FILTER (sec > now - 172800 AND sec <= now - 86400) / 24.0 AS v_prev,
  max(now) AS now FROM e, c GROUP BY story), t AS (SELECT *, (now - first_sec) / 3600.0 AS age_first, (now - last_sec) / 3600.0 AS age_last FROM s),
  f AS (SELECT *, 0.6 * power(0.5, age_first / 14) + 0.4 * power(0.5, age_last / 14) AS freshness,
  CASE WHEN n_independent <= 1 THEN 0 ELSE least(1, 1 - exp(-v_now / 2) + CASE WHEN v_now >= 1 AND v_now >= 1.3 * v_prev AND n_independent >= 3 THEN 0.12 ELSE 0 END) END AS velocity,
  1 - exp(-n_independent / 4.0) AS spread FROM t), p AS (SELECT *, 100 * (0.10 * freshness + 0.14 * velocity + 0.12 * spread) / 0.36 AS score,
  CASE WHEN age_first > 72000 OR freshness < 0.08 THEN 'stale' WHEN n_independent <= 2 AND age_first < 8 THEN 'emerging'
  WHEN v_now >= 1 AND v_now >= 1.2 * v_prev THEN 'rising' WHEN v_now >= 0.4 AND v_now >= 0.6 * v_prev THEN 'peak'
  WHEN n_independent >= 3 AND v_now < v_prev THEN 'fading' WHEN age_last > 18 THEN 'fading' WHEN n_independent >= 4 THEN 'peak' ELSE 'emerging' END AS phase FROM f) """


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = story_events(spark, sf_dir)
    now = F.lit(latest_second(events))
    long_lived = TrendSettings(velocity_window_h=24.0, max_age_h=72_000.0)  # the driver's stories run for a month
    return ev.trend(ev.story_stats(events, now, 86_400), now, long_lived)


@query(STATS + "SELECT story, n_articles, n_independent, round(v_now, 6) AS v_now, round(v_prev, 6) AS v_prev, round(freshness, 6) AS freshness, phase, round(score, 6) AS score FROM p ORDER BY p.score DESC, story LIMIT 20")
def trend_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scored(spark, sf_dir).orderBy(F.desc("score"), "story").limit(20)
    return top.select("story", "n_articles", "n_independent", F.round("v_now", 6).alias("v_now"), F.round("v_prev", 6).alias("v_prev"), F.round("freshness", 6).alias("freshness"), "phase", F.round("score", 6).alias("score"))


@query(STATS + "SELECT story, round(v_now, 6) AS v_now, round(v_prev, 6) AS v_prev FROM p")
def velocity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("story", F.round("v_now", 6).alias("v_now"), F.round("v_prev", 6).alias("v_prev"))


@query(STATS + "SELECT phase, count(*) AS n, round(avg(score), 6) AS mean_score FROM p GROUP BY phase")
def phase_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(EV + """SELECT id, story, count(*) OVER w AS n_so_far, CAST(sum(first) OVER w AS BIGINT) AS independent_so_far FROM
  (SELECT *, CASE WHEN row_number() OVER (PARTITION BY story, source ORDER BY sec, id) = 1 THEN 1 ELSE 0 END AS first FROM e)
  WINDOW w AS (PARTITION BY story ORDER BY sec, id ROWS UNBOUNDED PRECEDING)""")
def timeline_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.timeline(story_events(spark, sf_dir)).select("id", "story", "n_so_far", "independent_so_far")


@query(EV + """SELECT id, story, event_type FROM (SELECT *, lag(event_type) OVER w AS b, lag(sec) OVER w AS a FROM e WINDOW w AS (PARTITION BY story ORDER BY sec, id))
  WHERE a IS NULL OR b <> event_type OR sec - a > 1800""")
def snapshot_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.snapshots_on_change(story_events(spark, sf_dir), "event_type").select("id", "story", "event_type")


@query("""SELECT size, strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, n FROM (
  SELECT 'hour' AS size, date_trunc('hour', ts) AS b, count(*) AS n FROM events GROUP BY ALL UNION ALL
  SELECT 'day', date_trunc('day', ts), count(*) FROM events GROUP BY ALL UNION ALL
  SELECT 'week', date_trunc('week', ts), count(*) FROM events GROUP BY ALL UNION ALL
  SELECT 'month', date_trunc('month', ts), count(*) FROM events GROUP BY ALL)""")
def series_count_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hourly = e.groupBy(series.bucket(F.col("ts"), "hour").alias("b")).agg(F.count("*").alias("n"))  # coarser ones from the hours
    rows = hourly.select(F.explode(F.array(*(F.struct(F.lit(s).alias("size"), series.bucket(F.col("b"), s).alias("bucket")) for s in series.STEPS))).alias("x"), "n")
    return rows.groupBy("x.size", F.date_format("x.bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(F.sum("n").alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id FROM events), cal AS (SELECT unnest(range(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS day FROM events),
  v AS (SELECT user_id, date_trunc('day', ts) AS day, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
  SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS value
  FROM (SELECT * FROM d CROSS JOIN cal) dc LEFT JOIN v USING (user_id, day)""")
def series_forward_fill_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", series.bucket(F.col("ts"), "day"))
    last = e.groupBy("user_id", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    ends = last.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = last.select("user_id").distinct().crossJoin(F.broadcast(ends)).select("user_id", F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("day"))  # one row of ends
    filled = series.forward_filled(days.join(last, ["user_id", "day"], "left"), ["user_id"], "day", "value")
    return filled.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("value", 6).alias("value"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS category, count(*) AS shown, count(*) FILTER (event_type = 'purchase') AS selected,
  count(*) FILTER (event_type = 'error') AS rejected, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS share FROM events GROUP BY category""")
def choice_analysis_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = story_events(spark, sf_dir)
    chosen = F.col("event_type") == "purchase"
    return e.groupBy((F.col("story") % 10).alias("category")).agg(F.count("*").alias("shown"), F.count_if(chosen).alias("selected"), F.count_if(F.col("event_type") == "error").alias("rejected"), F.round(series.share(chosen), 6).alias("share"))


@query(EV + """, r AS (SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN sec < now - 1209600 THEN 'stale' WHEN value < 20 THEN 'low score' WHEN story % 7 = 0 THEN 'blocked' END AS reason FROM e, c)
  SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def funnel_drop_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from storyline.operators.funnel import first_reason

    e = story_events(spark, sf_dir)
    now = latest_second(e)
    rules = [("unknown", F.col("value").isNull()), ("stale", F.col("sec") < now - 1_209_600), ("low score", F.col("value") < 20), ("blocked", F.col("story") % 7 == 0)]
    return e.groupBy(F.coalesce(first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(EV + """, r AS (SELECT story, count(*) AS n_rejected, max(sec) AS last_rejected FROM e, c WHERE event_type = 'error' AND sec >= now - 259200 GROUP BY story),
  s AS (SELECT story, count(DISTINCT source) AS n_independent FROM e GROUP BY story)
  SELECT story, n_rejected, n_independent FROM r JOIN s USING (story)""")
def recently_rejected_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = story_events(spark, sf_dir)
    now = latest_second(e)
    rejected = e.filter((F.col("event_type") == "error") & (F.col("sec") >= now - 259_200)).groupBy("story").agg(F.count("*").alias("n_rejected"))
    return rejected.join(e.groupBy("story").agg(F.count_distinct("source").alias("n_independent")), "story").select("story", "n_rejected", "n_independent")


@query(EV + """SELECT id, count(*) OVER w AS n_prior, round(max(value) OVER w, 6) AS best_prior FROM e
  WINDOW w AS (PARTITION BY story ORDER BY sec RANGE BETWEEN 216000 PRECEDING AND 1 PRECEDING)""")
def prior_member_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.prior_best(story_events(spark, sf_dir), 216_000).select("id", "n_prior", F.round("best_prior", 6).alias("best_prior"))


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour FROM events WHERE hour(ts) >= 22 OR hour(ts) < 7")
def quiet_hours_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("hour"))
    return e.filter(ev.quiet(F.col("hour"), 22, 7))


@query(EV + """SELECT id, n_before, n_before >= 3 AS rejected FROM (SELECT id, count(*) OVER (PARTITION BY source ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n_before FROM e)""")
def rate_limit_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.over_limit(story_events(spark, sf_dir).withColumnRenamed("source", "key"), 3, 86_400).select("id", "n_before", "rejected")


@query(EV + """SELECT id, n_before FROM (SELECT id, event_type, count(*) OVER (PARTITION BY source ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS n_before FROM e WHERE event_type = 'error')""")
def failures_trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = story_events(spark, sf_dir).filter("event_type = 'error'").withColumnRenamed("source", "key")
    return ev.over_limit(failures, 5, 604_800).select("id", "n_before")


@query(EV + """, o AS (SELECT *, CASE WHEN a IS NULL OR sec - a > 43200 THEN 1 ELSE 0 END AS opens FROM (SELECT *, lag(sec) OVER (PARTITION BY source ORDER BY sec, id) AS a FROM e)),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY sec, id ROWS UNBOUNDED PRECEDING) AS session FROM o)
  SELECT source AS user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, CAST(max(sec) - min(sec) AS BIGINT) AS span_s, max(sec) - min(sec) > 604800 AS expired FROM n GROUP BY source, session""")
def session_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.sessions(story_events(spark, sf_dir).withColumnRenamed("source", "key"), 43_200, 604_800)
    return s.select(F.col("key").alias("user_id"), "session", "n_events", (F.col("end_sec") - F.col("start_sec")).alias("span_s"), "expired")


SETS = "WITH a AS (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80), b AS (SELECT user_id FROM events WHERE event_type = 'error' AND value > 80) "


def two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").filter("value > 80")
    return e.filter("event_type = 'purchase'").select("user_id"), e.filter("event_type = 'error'").select("user_id")


@query(SETS + "SELECT user_id FROM a UNION SELECT user_id FROM b")
def set_union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.union(b).distinct()


@query(SETS + "SELECT user_id FROM a INTERSECT SELECT user_id FROM b")
def set_intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.intersect(b)


@query(SETS + "SELECT user_id FROM a EXCEPT SELECT user_id FROM b")
def set_except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.subtract(b)


SIGNALS = EV + """, g AS (SELECT 'story' AS dimension, CAST(story AS VARCHAR) AS key, source, sec,
  CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'click' THEN 0.3 ELSE 0 END AS da, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END AS db FROM e),
  b AS (SELECT dimension, key, sum(da * power(0.5, (now - sec) / 86400.0 / 90)) AS alpha, sum(db * power(0.5, (now - sec) / 86400.0 / 90)) AS beta, count(*) AS n FROM g, c GROUP BY ALL) """


def signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = story_events(spark, sf_dir)
    up = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.3).otherwise(0.0)
    return e.select(F.lit("story").alias("dimension"), F.col("story").cast("string").alias("key"), "source", "sec", up.alias("d_alpha"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("d_beta")), latest_second(e)


@query(SIGNALS + "SELECT dimension, key, round(alpha, 6) AS alpha, round(beta, 6) AS beta, n, round((alpha + 1) / (alpha + beta + 2), 6) AS mean FROM b")
def beta_decay_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, now = signals(spark, sf_dir)
    p = learning.beta_profile(s, F.lit(now), LearningSettings())
    return p.select("dimension", "key", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "n", F.round("mean", 6).alias("mean"))


@query(SIGNALS + """, u AS (SELECT DISTINCT source, key FROM g) SELECT source AS item_id, round(0.5 + least(1, sum(n) / 15.0) * (avg((alpha + 1) / (alpha + beta + 2)) - 0.5), 6) AS affinity, CAST(sum(n) AS BIGINT) AS n
  FROM u JOIN b USING (key) GROUP BY source""")
def posterior_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, now = signals(spark, sf_dir)
    profile = learning.beta_profile(s, F.lit(now), LearningSettings())
    items = s.select(F.col("source").alias("item_id"), "dimension", "key").distinct()
    a = learning.affinity(items, profile, {"story": 1.0}, LearningSettings())
    return a.select("item_id", F.round("affinity", 6).alias("affinity"), "n")


@query("""WITH p AS (SELECT event_id + 1 - (SELECT min(event_id) FROM events) AS id, event_type || ':' || user_id AS payload FROM events),
  l AS (SELECT id, payload, CASE WHEN id % 1000 = 500 THEN 'edited' ELSE sha256(concat_ws('|', CAST(id AS VARCHAR), payload)) END AS hash FROM p)
  SELECT count(*) AS n, min(id) FILTER (hash <> sha256(concat_ws('|', CAST(id AS VARCHAR), payload))) AS first_bad_id, max(id) AS last_id, max(id) - count(DISTINCT id) AS missing FROM l""")
def audit_digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made from the events, some rows edited, verified row by row: digests, gaps, first bad id."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_id")).first()[0] or 0
    rows = e.select((F.col("event_id") + 1 - first).alias("id"), F.concat_ws(":", "event_type", "user_id").alias("payload"))
    digest = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "payload"), 256)
    log = rows.withColumn("hash", F.when(F.col("id") % 1000 == 500, "edited").otherwise(digest))
    return log.agg(F.count("*").alias("n"), F.min(F.when(F.col("hash") != digest, F.col("id"))).alias("first_bad_id"), F.max("id").alias("last_id"), (F.max("id") - F.count_distinct("id")).alias("missing"))
