"""Queries over stories of a run: thirteen-component score, verification, geography, funnel, outcomes.

A run is an eighth of the users, a candidate event a story that they follow. Inputs that the tables lack are stated as
expressions of what they have, the same for both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import lexicon
from storyline.operators import events as ev
from storyline.operators import funnel, learning, publishing, rollup
from storyline.settings import SCORE_WEIGHTS, FunnelSettings, LearningSettings, TrendSettings
from storyline.sources import sinks
from storyline.sources.tables import latest_second, publications, story_events, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TYPES = ("view", "click", "signup", "purchase", "error")

#: Inputs of the rules by counts of a story in a run.
INPUTS = {
    "freshness": "0.6 * power(0.5, age_first / 336.0) + 0.4 * power(0.5, age_last / 14.0)",
    "independent_sources": "1 - exp(-n_independent / 4.0)",
    "velocity": "1 - exp(-n_view / 2.0)",
    "scale": "least(1.0, 0.6 * (1 - exp(-n_purchase / 2.0)) + 0.1 * (1 - exp(-n_independent / 4.0)))",
    "novelty": "0.7 + 0.3 * (1 - exp(-n_signup / 1.5)) - 0.3 * (1 - exp(-n_error / 1.0))",
    "significance": "least(1.0, mean / 40.0)",
    "practical_value": "least(1.0, 0.7 * (1 - exp(-n_click / 2.5)))",
    "audience_interest": "(event_id % 10) / 10.0",
    "discussion": "least(1.0, 0.5 * (1 - exp(-n_error / 2.0)) + 0.15 * least(1.0, n_independent / 6.0))",
    "fact_sufficiency": "least(1.0, 0.7 * least(n_purchase, 4) / 4.0 + 0.2 * least(n_click, 3) / 3.0)",
    "source_quality": "0.5 + (event_id % 5) / 10.0",
    "feasibility": "0.3 + 0.7 * least(n_click, 3) / 3.0",
    "historical": "(event_id % 4) / 4.0",
    "clickbait": "n_error * 1.0 / n_articles",
    "ad": "CASE WHEN event_id % 17 = 0 THEN 0.7 WHEN event_id % 17 = 1 THEN 0.5 ELSE 0.0 END",
    "hedge": "CASE WHEN event_id % 11 = 0 THEN 0.7 ELSE 0.0 END",
    "opinion": "(event_id % 3) / 10.0",
    "injection": "event_id % 23 = 0",
    "repeat_sim": "(event_id % 9) / 8.0",
    "n_contradictions": "CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END",
    "is_primary": "event_id % 3 = 0",
    "is_official": "event_id % 6 = 0",
    "numbers_failed": "event_id % 19 = 0",
    "kz": "(event_id % 10) / 10.0",
    "ca": "(event_id % 7) / 7.0",
    "world": "(event_id % 5) / 5.0",
}

CANDIDATES = f"""WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS story, user_id AS source, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type, value FROM events), c AS (SELECT max(sec) AS now FROM e),
  q AS (SELECT source % 8 AS run_id, story AS event_id, count(*) AS n_articles, count(DISTINCT source) AS n_independent, (max(now) - min(sec)) / 3600.0 AS age_first, (max(now) - max(sec)) / 3600.0 AS age_last, avg(value) AS mean,
  {", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in TYPES)} FROM e, c GROUP BY ALL),
  i AS (SELECT *, {", ".join(f"{x} AS {name}" for name, x in INPUTS.items())} FROM q), """

WEIGHTED = " + ".join(f"{w} * {name}" for name, w in SCORE_WEIGHTS.items())
SCORED = CANDIDATES + f"""t AS (SELECT *, 100 * ({WEIGHTED}) / {sum(SCORE_WEIGHTS.values())} * (1 - 0.45 * clickbait) * (1 - 0.7 * ad) * (1 - 0.25 * hedge) * (1 - 0.15 * opinion) * CASE WHEN injection THEN 0.5 ELSE 1 END
  * CASE WHEN repeat_sim > 0.5 THEN 1 - least(0.5, repeat_sim - 0.5) ELSE 1 END AS score FROM i) """


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = story_events(spark, sf_dir)
    now = F.lit(latest_second(e))
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES]
    q = e.groupBy((F.col("source") % 8).alias("run_id"), F.col("story").alias("event_id")).agg(
        F.count("*").alias("n_articles"), F.count_distinct("source").alias("n_independent"), ((now - F.min("sec")) / 3600.0).alias("age_first"), ((now - F.max("sec")) / 3600.0).alias("age_last"), F.avg("value").alias("mean"), *counts
    )
    doubles = {name: re.sub(r"\b\d+\.\d+\b", r"\g<0>D", x) for name, x in INPUTS.items()}  # plain fractions are decimals here
    return q.selectExpr("*", *(f"{x} AS {name}" for name, x in doubles.items()))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.full_score(candidates(spark, sf_dir), TrendSettings())


@query(SCORED + "SELECT run_id, event_id, round(score + 1e-10, 6) AS trend_score, round(least(1, 0.45 * audience_interest + 0.3 * significance + 0.25 * discussion) + 1e-10, 6) AS interest, round(least(1, 0.6 * practical_value + 0.4 * significance) + 1e-10, 6) AS value FROM t")
def trend_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, interest and value of every candidate from its thirteen components and penalties."""
    return scored(spark, sf_dir).select("run_id", "event_id", *(F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("trend_score", "interest", "value")))  # no ties to round


STATUS = """v AS (SELECT *, CASE WHEN n_contradictions > 0 AND n_independent < 2 THEN 'rejected' WHEN hedge >= 0.6 AND n_independent < 2 AND NOT is_primary THEN 'rejected'
  WHEN numbers_failed OR hedge >= 0.6 THEN 'needs_check' WHEN n_independent >= 2 AND (is_primary OR source_quality >= 0.6) THEN 'multi_confirmed' WHEN is_primary AND is_official THEN 'confirmed'
  WHEN source_quality >= 0.9 AND hedge = 0 AND n_purchase >= 1 THEN 'confirmed' ELSE 'needs_check' END AS status FROM i) """


def verified(df: DataFrame) -> DataFrame:
    return rollup.verification_status(df.selectExpr("run_id", "event_id", "n_independent", "n_contradictions", "hedge AS hedge_share", "is_primary AS primary", "is_official AS official", "source_quality AS reliability", "numbers_failed", "n_purchase AS n_facts", "n_click AS n_quotes"))


@query(CANDIDATES + STATUS + """SELECT run_id, event_id, status, round((0.35 * least(1, n_independent / 3.0) + 0.25 * CAST(is_primary AS INTEGER) + 0.15 * CAST(n_contradictions = 0 AS INTEGER) + 0.10 * (1 - hedge) + 0.10 * source_quality
  + 0.05 * CAST(n_click > 0 AS INTEGER)) * CASE WHEN status = 'rejected' THEN 0.4 ELSE 1 END, 6) AS score FROM v""")
def verification_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(candidates(spark, sf_dir)).select("run_id", "event_id", "status", F.round("score", 6).alias("score"))


@query(CANDIDATES + "g AS (SELECT CASE WHEN kz >= 0.45 AND kz >= 0.75 * world THEN 'kz' WHEN ca >= 0.5 AND ca >= kz THEN 'ca' WHEN kz >= 0.55 THEN 'kz' ELSE 'world' END AS geo FROM i) SELECT geo, count(*) AS n FROM g GROUP BY geo")
def geo_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rollup.geography(F.col("kz"), F.col("ca"), F.col("world"))
    return candidates(spark, sf_dir).select(kind.alias("geo")).groupBy("geo").agg(F.count("*").alias("n"))


SETTINGS = FunnelSettings(score_floor=20.0, stages=(20, 12, 8, 5))
STAGE_ONE = """CASE WHEN event_id % 29 = 0 THEN 'already published' WHEN age_last > 72 THEN 'too old' WHEN score < 20 THEN 'below least score' WHEN ad >= 0.6 THEN 'advertising'
  WHEN event_id % 31 = 0 AND n_independent < 2 * 4 THEN 'recently rejected' WHEN event_id % 37 = 0 THEN 'blocked word' END"""
STAGE_TWO = """CASE WHEN clickbait >= 0.5 THEN 'clickbait' WHEN ad >= 0.4 THEN 'advertising' WHEN hedge >= 0.6 AND n_independent < 2 AND NOT is_official THEN 'rumour' WHEN n_purchase < 2 OR fact_sufficiency < 0.3 THEN 'few facts'
  WHEN greatest(significance, practical_value, discussion) < 0.25 THEN 'weak' WHEN repeat_sim >= 1 THEN 'duplicate' WHEN injection AND n_independent < 2 THEN 'injection' END"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with all columns that the funnel's rules read."""
    kind = rollup.geography(F.col("kz"), F.col("ca"), F.col("world"))
    k = F.col("event_id")
    return scored(spark, sf_dir).withColumns({
        "score": F.col("trend_score"), "published": k % 29 == 0, "new_stage": F.lit(False), "phase": F.lit("rising"), "age_last_h": F.col("age_last"), "ad_share": F.col("ad"), "clickbait_share": F.col("clickbait"), "hedge_share": F.col("hedge"),
        "rejected_independent": F.when(k % 31 == 0, 4), "blocked": k % 37 == 0, "official": F.col("is_official"), "primary": F.col("is_primary"), "reliability": F.col("source_quality"), "n_facts": F.col("n_purchase"), "n_quotes": F.col("n_click"),
        "repeat_kind": F.when(F.col("repeat_sim") >= 1, "duplicate"), "bucket": F.when(kind.isin("kz", "ca"), "KZ").otherwise("WORLD"), "theme": F.concat(F.lit("t"), (k % 4).cast("string")), "category": F.concat(F.lit("c"), (k % 6).cast("string")),
    })


@query(SCORED + f", d AS (SELECT {STAGE_ONE} AS one, {STAGE_TWO} AS two FROM t) SELECT coalesce(one, '') AS stage_one, coalesce(two, '') AS stage_two, count(*) AS n FROM d GROUP BY ALL")
def funnel_stage_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates fall out of the first two stages, by reason."""
    empty = lambda rules: F.coalesce(funnel.first_reason(rules), F.lit(""))
    p = pool(spark, sf_dir).select(empty(funnel.stage_one(SETTINGS)).alias("stage_one"), empty(funnel.stage_two(SETTINGS)).alias("stage_two"))
    return p.groupBy("stage_one", "stage_two").agg(F.count("*").alias("n"))


@query()
def funnel_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log of all runs: stage, decision, place and reason of every candidate."""
    return funnel.run(pool(spark, sf_dir), SETTINGS)


@query("""SELECT o_orderkey AS pub_id, CASE WHEN s = 429 THEN 'rate_limited' WHEN s = 408 OR s >= 500 THEN 'unknown' WHEN s >= 400 THEN 'permanent' ELSE 'ok' END AS outcome FROM (SELECT o_orderkey, 200 + o_orderkey % 400 AS s FROM orders)""")
def publication_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each delivery by its status code."""
    return publications(spark, sf_dir).select("pub_id", publishing.http_outcome(200 + F.col("pub_id") % 400).alias("outcome"))


@query("""SELECT CASE max(CASE WHEN quality = 0 THEN 2 WHEN quality IS NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'down' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status of all components."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 0, "down").when(F.col("quality").isNull(), "degraded").otherwise("ok")
    return publishing.worst(d.select(status.alias("status")), ["ok", "degraded", "down"])


@query("""WITH x AS (SELECT o_custkey AS account, o_orderpriority AS platform, (o_totalprice / 200000.0 - 1) * 0.5 AS x FROM orders), s AS (SELECT platform, count(*) AS n, sum(x) AS total FROM x GROUP BY platform)
  SELECT account, round(0.5 + 0.5 * tanh(2 * sum(s.n * (total / (s.n + 5))) / sum(s.n)), 6) AS historical FROM (SELECT DISTINCT account, platform FROM x) JOIN s USING (platform) GROUP BY account""")
def historical_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk past performance of each account's platforms, between 0 and 1."""
    p = publications(spark, sf_dir).withColumn("x", (F.col("price") / 200000.0 - 1) * 0.5)
    stats = learning.performance_stats(p, ["platform"], "x", F.lit(1.0)).select(F.col("key").alias("platform"), "n", "total")
    rows = p.select("account", "platform").distinct().join(stats, "platform")
    return rows.groupBy("account").agg(F.round(learning.historical(rows, LearningSettings()), 6).alias("historical"))


@query("""SELECT 'documents_chars{component="' || source || '"} ' || CAST(sum(n_chars) AS BIGINT) AS line FROM documents GROUP BY source""")
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge lines for a monitoring system."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").cast("bigint").alias("n"))
    return sinks.exposition(d, "documents_chars", F.col("source"), F.col("n"))


@query(r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(secret|token)\b') AS hit FROM documents""")
def lexicon_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lexicon.any_hit(F.col("text"), ["secret$", "token$"]).alias("hit"))


@query("""WITH m AS (SELECT event_id AS id, story % 5 AS survivor FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS story FROM events)) SELECT survivor AS event_id, count(*) AS n FROM m GROUP BY survivor""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by surviving story, where stories of one remainder were merged."""
    e = story_events(spark, sf_dir).select("id", F.col("story").alias("event_id"))
    merges = e.select("event_id").distinct().filter("event_id >= 5").withColumn("survivor", F.col("event_id") % 5)
    return rollup.follow_merges(e, merges).groupBy("event_id").agg(F.count("*").alias("n"))


#: Events read as a state log of publications.
STATES = {"view": "draft", "click": "awaiting_approval", "signup": "scheduled", "purchase": "publishing", "error": "error"}
ALLOWED = " OR ".join(f"(before = '{a}' AND state IN ({', '.join(repr(x) for x in b)}))" for a, b in publishing.MOVES.items() if b)
STATE_OF = " ".join(f"WHEN '{t}' THEN '{state}'" for t, state in STATES.items())


@query(f"WITH s AS (SELECT event_id, user_id, ts, CASE event_type {STATE_OF} END AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT event_id, before, state FROM l WHERE before IS NOT NULL AND NOT ({ALLOWED})")
def publication_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves that a publication may not make, by the table of moves."""
    names = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("sec"), F.element_at(names, F.col("event_type")).alias("state"))
    return publishing.illegal_moves(e, publishing.MOVES).select(F.col("id").alias("event_id"), "before", "state")
