"""Queries of checks: grounding of numbers and quotations, the rules over versions, evidence of events.

The documents are drafts, one version for each platform; what a draft's source has published before is what it may say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import text
from storyline.operators import checks, similarity
from storyline.plans import cluster_queries as cluster
from storyline.plans.text_queries import GRAMS, REDACTED, plain_words
from storyline.sources.scratch import written
from storyline.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Words that leave something open, by language.
DOUBT = ("maybe", "or", "ou", "oder", "o", "vielleicht")
DOUBT_RX = r"(?:^|[^\p{L}])(" + "|".join(DOUBT) + r")(?:$|[^\p{L}])"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def number_rows(docs: DataFrame) -> DataFrame:
    """draft, group, place, v, unit of the numbers of up to 15 digits."""
    found = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) <= 15)
    each = docs.select(F.col("doc_id").alias("draft"), F.col("source").alias("group"), F.col("doc_id").alias("place"), F.explode(F.array_distinct(found)).alias("x"))
    return each.select("draft", "group", "place", F.col("x").cast("double").alias("v"), F.lit("").alias("unit"))


NUMBERS = """n AS (SELECT DISTINCT doc_id, source, CAST(x AS DOUBLE) AS v FROM (SELECT doc_id, source, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS x FROM documents) WHERE length(x) <= 15),
  g AS (SELECT doc_id, v, bool_or(coalesce(abs(v - kv) <= greatest(1e-9, 0.01 * abs(kv)), false)) AS ok FROM n LEFT JOIN (SELECT doc_id AS since, source, v AS kv FROM n) k ON n.source = k.source AND since < doc_id GROUP BY doc_id, v),
  missing AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT ok) AS missing FROM g GROUP BY doc_id)"""


@query(f"WITH {NUMBERS} SELECT doc_id, n, missing FROM missing")
def grounding_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document, and those that its source has not given before (to a hundredth)."""
    numbers = written(number_rows(drafts(spark, sf_dir)), "numbers")
    return checks.ungrounded_numbers(numbers, numbers.drop("draft")).select(F.col("draft").alias("doc_id"), "n", "missing")


QUOTE = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH q AS (SELECT DISTINCT item_id, {QUOTE.format('x')} AS q FROM (SELECT item_id, unnest(string_split(text, '.')) AS x FROM benchmark)), a AS (SELECT item_id, q FROM q WHERE len(string_split(q, ' ')) >= 4),
  s AS (SELECT DISTINCT {QUOTE.format('x')} AS t FROM (SELECT unnest(string_split(text, '.')) AS x FROM documents)), t AS (SELECT t FROM s WHERE len(string_split(t, ' ')) >= 4),
  f AS (SELECT DISTINCT item_id, q FROM a JOIN t ON contains(t, q) OR contains(q, t))
  SELECT a.item_id, count(*) AS n, count(*) FILTER (f.q IS NULL) AS missing FROM a LEFT JOIN f USING (item_id, q) GROUP BY a.item_id""")
def grounding_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the benchmark texts that no sentence of the documents holds or is held by."""
    parts = lambda df, *more: df.select(*more, F.lit("").alias("group"), F.explode(F.split("text", r"\.")).alias("quote"))
    asked = parts(table(spark, sf_dir, "benchmark"), F.col("item_id").alias("draft"), F.lit(1).alias("place"))
    known = parts(table(spark, sf_dir, "documents"), F.lit(0).alias("place"))
    return checks.ungrounded_quotes(asked, known).select(F.col("draft").alias("item_id"), "n", "missing")


FIRST = "split_part(coalesce(text, ''), chr(10), 1)"


@query(
    GRAMS
    + rf""", {NUMBERS}, m AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM dg JOIN bg USING (gram)), isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS island FROM m),
  runs AS (SELECT doc_id, max(run) AS run FROM (SELECT doc_id, count(*) + 4 AS run FROM isl GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id),
  ratio AS (SELECT doc_id, max(r) AS ratio FROM (SELECT doc_id, count(*) / max(n) AS r FROM dg JOIN (SELECT DISTINCT item_id, gram FROM bg) USING (gram) GROUP BY doc_id, item_id) GROUP BY doc_id),
  heads AS (SELECT {FIRST} AS first, min(doc_id) AS since FROM documents WHERE {FIRST} <> '' GROUP BY 1),
  x AS (SELECT doc_id, lang, coalesce(text, '') AS body, {FIRST} AS first, len(regexp_extract_all(coalesce(text, ''), '#[A-Za-z0-9_]')) AS tags, {REDACTED} <> coalesce(text, '') AS secret,
    len(regexp_extract_all(lower(coalesce(text, '')), 'idiot')) AS forbidden, len(regexp_extract_all(coalesce(text, ''), '<[a-z]')) AS opened, len(regexp_extract_all(coalesce(text, ''), '</[a-z]')) AS closed,
    CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 8 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0.6 THEN 'en' ELSE 'unknown' END AS said FROM documents),
  v AS (SELECT x.*, p.platform, p.lim, length(body) AS n, coalesce(missing, 0) AS missing, coalesce(run, 0) AS run, coalesce(ratio, 0) AS ratio, coalesce(since < x.doc_id, false) AS same_title
    FROM x CROSS JOIN (VALUES ('telegram', 4096), ('instagram', 2200), ('facebook', 63206)) p(platform, lim) LEFT JOIN missing USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN ratio USING (doc_id) LEFT JOIN heads USING (first)),
  r AS (SELECT doc_id, platform, CASE WHEN trim(body) = '' THEN 'fail' END AS not_empty, CASE WHEN n > lim THEN 'fail' ELSE 'pass' END AS length, CASE WHEN platform = 'instagram' AND length(first) > 125 THEN 'warn' END AS ig_first_line,
    CASE WHEN platform = 'instagram' AND tags > 30 THEN 'fail' WHEN tags > CASE platform WHEN 'instagram' THEN 8 ELSE 5 END THEN 'warn' END AS hashtags, CASE WHEN platform = 'telegram' THEN CASE WHEN opened <> closed THEN 'fail' ELSE 'pass' END END AS html,
    CASE WHEN missing > 0 THEN 'fail' ELSE 'pass' END AS numbers, CASE WHEN run >= 10 OR ratio > 0.12 THEN 'fail' WHEN run >= 8 OR ratio > 0.096 THEN 'warn' ELSE 'pass' END AS originality, CASE WHEN same_title THEN 'warn' END AS title,
    CASE WHEN forbidden > 0 THEN 'fail' ELSE 'pass' END AS forbidden, CASE WHEN n >= 80 AND said <> lang THEN 'warn' ELSE 'pass' END AS language, CASE WHEN secret THEN 'fail' ELSE 'pass' END AS secrets FROM v),
  u AS (UNPIVOT r ON not_empty, length, ig_first_line, hashtags, html, numbers, originality, title, forbidden, language, secrets INTO NAME key VALUE status)
  SELECT doc_id, platform, CAST(count(*) FILTER (status = 'fail') AS INTEGER) AS n_fail, CAST(count(*) FILTER (status = 'warn') AS INTEGER) AS n_warn, coalesce(string_agg(key, ',' ORDER BY key) FILTER (status = 'fail'), '') AS failed,
    bool_and(status <> 'fail') AS passed, bool_or(status = 'fail' OR (status = 'warn' AND key IN ('originality', 'title', 'language'))) AS blocks FROM u GROUP BY doc_id, platform"""
)
def version_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over every document as a version for each platform: failures, warnings, whether it may go out alone."""
    docs = drafts(spark, sf_dir)
    numbers = written(number_rows(docs), "numbers")
    missing = checks.ungrounded_numbers(numbers, numbers.drop("draft")).select(F.col("draft").alias("doc_id"), F.col("missing").alias("missing_numbers"))
    words = F.transform(plain_words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("words")
    copies = similarity.copies(docs.select("doc_id", words), table(spark, sf_dir, "benchmark").select("item_id", words), 5)
    first = F.substring_index("text", "\n", 1)
    head = F.when(first != "", F.xxhash64(first))  # the first line may be the whole text
    titles = docs.select("doc_id", head.alias("first")).filter("first IS NOT NULL").groupBy("first")
    titles = titles.agg(F.min("doc_id").alias("since"), F.count("*").alias("texts")).filter("texts > 1").select("first", "since")
    count = lambda rx, c="text": F.regexp_count(c, F.lit(rx))
    inputs = docs.select(
        "doc_id",
        F.col("lang").alias("language"),
        # texts stay where they are: the rules ask for lengths and whether there is any text
        F.when(F.trim("text") == "", "").otherwise("x").alias("body"),
        F.length("text").alias("length"),
        F.length(first).alias("first_line"),
        head.alias("first"),
        count("#[A-Za-z0-9_]").alias("hashtags"),
        F.abs(count("<[a-z]") - count("</[a-z]")).alias("bad_tags"),
        count("idiot", F.lower("text")).alias("forbidden"),
        text.has_secrets(F.col("text")).alias("secrets"),
        text.detect_language(F.col("text")).alias("text_language"),
    )
    joined = inputs.join(missing, "doc_id", "left").join(copies, "doc_id", "left").join(titles, "first", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = joined.withColumns({"missing_numbers": zero("missing_numbers"), "copy_run": zero("copy_run"), "copy_ratio": zero("copy_ratio"), "same_title": F.coalesce(F.col("since") < F.col("doc_id"), F.lit(False))})
    versions = joined.withColumn("platform", F.explode(F.array(*map(F.lit, checks.LIMITS))))
    of = lambda status: F.filter("results", lambda r: r["status"] == status)
    failed = F.array_join(F.sort_array(F.transform(of("fail"), lambda r: r["key"])), ",")
    return checks.checked(versions).select("doc_id", "platform", F.size(of("fail")).alias("n_fail"), F.size(of("warn")).alias("n_warn"), failed.alias("failed"), "passed", "blocks")


@query(
    cluster.COMPONENTS.replace("SELECT id AS doc_id, coalesce(event, id) AS event_id FROM r LEFT JOIN", ", ev0 AS (SELECT id AS doc_id, coalesce(event, id) AS event FROM r LEFT JOIN")
    + rf"""), rel AS (SELECT source, avg(quality) AS reliability FROM documents JOIN labels USING (doc_id) GROUP BY source),
  mem AS (SELECT event, doc_id, source, coalesce(reliability, 0.5) AS reliability, len(regexp_extract_all(lower(coalesce(text, '')), '{DOUBT_RX}')) > 8 AS hedge, row_number() OVER (PARTITION BY event, source ORDER BY doc_id) > 1 AS cited FROM ev0 JOIN documents USING (doc_id) LEFT JOIN rel USING (source)),
  num AS (SELECT DISTINCT event, source, x AS value, CAST(x AS DOUBLE) AS v FROM (SELECT event, source, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS x FROM ev0 JOIN documents USING (doc_id)) WHERE length(x) <= 15),
  con AS (SELECT DISTINCT a.event FROM num a JOIN num b ON a.event = b.event AND a.source <> b.source AND length(a.value) = length(b.value) AND abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-9) > 0.02),
  vals AS (SELECT event, count(*) AS n_numbers, count(*) FILTER (o > 1) AS shared FROM (SELECT event, value, count(DISTINCT source) AS o FROM num GROUP BY ALL) GROUP BY event),
  evd AS (SELECT event, count(*) AS n_articles, count(DISTINCT source) FILTER (NOT cited) AS n_independent, max(reliability) >= 0.8 AS official, avg(reliability) FILTER (NOT cited) AS rel, avg(hedge::INT) AS hedge, CASE WHEN count(*) FILTER (NOT cited) = 1 THEN max(reliability) FILTER (NOT cited) END AS single FROM mem GROUP BY event),
  jud AS (SELECT evd.*, coalesce(n_numbers, 0) AS n_numbers, coalesce(shared, 0) AS shared_numbers, CASE WHEN con.event IS NULL THEN 0 ELSE 1 END AS conflicts FROM evd LEFT JOIN vals USING (event) LEFT JOIN con USING (event)),
  fin AS (SELECT *, CASE WHEN conflicts > 0 AND n_independent < 2 THEN 'rejected' WHEN hedge >= 0.6 AND n_independent < 2 AND NOT official THEN 'rejected' WHEN conflicts > 0 OR hedge >= 0.5 THEN 'needs_check' WHEN n_independent >= 2 AND (official OR rel >= 0.6) THEN 'multi_confirmed' WHEN official THEN 'confirmed' WHEN coalesce(single, 0) >= 0.9 AND hedge = 0 AND n_numbers >= 1 THEN 'confirmed' ELSE 'needs_check' END AS status FROM jud)
  SELECT event AS event_id, n_articles, n_independent, n_numbers, shared_numbers, round(hedge, 6) AS hedge, CAST(conflicts AS BIGINT) AS conflicts, status,
    round((0.35 * least(1.0, n_independent / 3) + 0.25 * official::INT + 0.15 * (conflicts = 0)::INT + 0.10 * (1 - hedge) + 0.10 * rel + 0.05) * CASE WHEN status = 'rejected' THEN 0.4 ELSE 1 END, 6) AS score FROM fin"""
)
def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the events that the documents form, and the decision: independent sources, conflicting and shared
    numbers, doubt, reliability (mean quality label of a source)."""
    events = written(cluster.events(spark, sf_dir, cluster.prepared(spark, sf_dir)).toDF("doc_id", "event"), "components")
    docs = drafts(spark, sf_dir)
    trust = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("trust"))
    firsts = events.join(docs.select("doc_id", "source"), "doc_id").groupBy("event", "source").agg(F.min("doc_id").alias("first"))
    members = events.join(docs, "doc_id").join(firsts, ["event", "source"]).join(trust, "source", "left")
    reliability = F.coalesce("trust", F.lit(0.5))
    doubt = (F.regexp_count(F.lower("text"), F.lit(DOUBT_RX)) > 8).cast("int")
    members = members.select("event", F.col("source").alias("origin"), (F.col("doc_id") > F.col("first")).alias("cited"), (reliability >= 0.8).alias("official"), F.lit(0).alias("markers"), reliability.alias("reliability"), doubt.alias("hedges"), F.lit(0).alias("opinions"), F.lit(False).alias("injection"))
    found = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) <= 15)
    numbers = events.join(docs, "doc_id").select("event", F.col("source").alias("origin"), F.explode(F.array_distinct(found)).alias("value")).distinct()
    conflicts = checks.number_conflicts(numbers.select("event", F.length("value").alias("unit"), F.col("value").cast("double").alias("v"), "origin")).select("event", F.lit(1).cast("long").alias("conflicts")).distinct()
    shared = checks.shared_values(numbers).toDF("event", "n_numbers", "shared_numbers")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = checks.evidence(members).join(conflicts, "event", "left").join(shared, "event", "left")
    joined = joined.select("event", "n_articles", "n_independent", "official", "cited_official", "single_reliability", "avg_reliability", "hedge", zero("conflicts"), zero("n_numbers"), zero("shared_numbers"), F.lit(0).alias("n_quotes"), F.lit(0).alias("shared_quotes"))
    judged = checks.verified(joined.withColumn("n_facts", F.col("n_numbers")))
    return judged.select(F.col("event").alias("event_id"), "n_articles", "n_independent", "n_numbers", "shared_numbers", F.round("hedge", 6).alias("hedge"), "conflicts", "status", "score")
