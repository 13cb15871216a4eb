"""Queries over reports grouped to events: pair scores, components, micro-batches, merging, frequencies by batch.

The documents are the reports. Their tables hold no time of publication: reports follow each other by doc_id, ten minutes
apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import profiles, stories
from storyline.operators.profiles import Packed
from storyline.sources.scratch import TABLES, discard, shared_dir, written
from storyline.sources.tables import table
from storyline.streaming import stories as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

APART_S = 600
BATCHES = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lang, sec and the arrays of a report."""
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, "\n", 1)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)))
    names = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}0-9,;:-] (\p{Lu}\p{Ll}+)"), F.lit(1)), F.lower))
    every = lambda rx, k: F.array_distinct(F.regexp_extract_all(text, F.lit(rx), F.lit(k)))
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0"))))
    found = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "lang",
        (F.col("doc_id") * APART_S).alias("sec"),
        words(first).alias("title"),
        words(text).alias("terms"),
        names(text).alias("entities"),
        names(first).alias("title_entities"),
        F.filter(numbers, lambda x: x != "").alias("numbers"),
        F.transform(every('"([^"]{8,})"', 1), F.lower).alias("quotes"),
        every("[0-9]{4}-[0-9]{2}-[0-9]{2}", 0).alias("dates"),
    )
    return found


def prepared(spark: SparkSession, sf_dir: str) -> Packed:
    """Profiles of all documents, weighted by the frequencies over all of them: a written table."""
    hashed = written(profiles.hashed(reports(spark, sf_dir)), "report-hashes")
    df = written(profiles.frequencies(hashed), "item-frequencies")
    made = profiles.packed(hashed, df, hashed.count(), all_counted=True)
    given = Packed(written(made.rows, "profiles"), made.idf)
    discard(hashed)
    return given


def events(spark: SparkSession, sf_dir: str, given: Packed) -> DataFrame:
    """id, event: components of the attached pairs."""
    links = written(stories.attached_profiles(given).select("v", "p"), "attached")
    return stories.components(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), links)


ITEMS = r"""WITH RECURSIVE r AS (SELECT doc_id AS id, lang, doc_id * 600 AS sec, coalesce(text, '') AS x, split_part(coalesce(text, ''), chr(10), 1) AS first FROM documents),
  ti AS (SELECT DISTINCT id, lang, unnest(regexp_extract_all(lower(first), '\p{L}+')) AS key FROM r),
  te AS (SELECT DISTINCT id, lang, unnest(regexp_extract_all(lower(x), '\p{L}+')) AS key FROM r),
  eti AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(first, '[\p{L}0-9,;:-] (\p{Lu}\p{Ll}+)', 1))) AS key FROM r),
  en AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(x, '[\p{L}0-9,;:-] (\p{Lu}\p{Ll}+)', 1))) AS key FROM r),
  nu AS (SELECT * FROM (SELECT DISTINCT id, ltrim(unnest(regexp_extract_all(x, '[0-9]+')), '0') AS key FROM r) WHERE key <> ''),
  qu AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(x, '"([^"]{8,})"', 1))) AS key FROM r),
  da AS (SELECT DISTINCT id, unnest(regexp_extract_all(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS key FROM r),
  terms AS (SELECT te.id, te.lang, te.key, CASE WHEN ti.key IS NULL THEN 1.0 ELSE 2.0 END AS tf FROM te LEFT JOIN ti USING (id, key)),
  ents AS (SELECT en.id, en.key, CASE WHEN eti.key IS NULL THEN 1.0 ELSE 2.0 END AS w FROM en LEFT JOIN eti USING (id, key)),
  size AS (SELECT count(*) AS n FROM r),
  tdf AS (SELECT lang, key, ln((n + 2.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM terms, size GROUP BY lang, key, n),
  tidf AS (SELECT lang, key, ln((n + 2.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM ti, size GROUP BY lang, key, n),
  tw AS (SELECT id, lang, key, tf * idf AS w, CASE WHEN tf > 1 THEN 1 + ln(tf) ELSE tf END * idf AS u FROM terms JOIN tdf USING (lang, key)),
  tn AS (SELECT id, sum(w * w) AS ww, sum(u * u) AS uu FROM tw GROUP BY id), """
PAIRS = (
    ITEMS
    + r"""dots AS (SELECT v.id AS v, p.id AS p, sum(v.w * p.u) AS dot FROM tw v JOIN tw p ON v.key = p.key AND v.lang = p.lang AND p.id < v.id AND (v.id - p.id) * 600 <= 259200 GROUP BY ALL),
  tis AS (SELECT id, sum(idf) AS s FROM ti JOIN tidf USING (lang, key) GROUP BY id),
  tsh AS (SELECT v.id AS v, p.id AS p, sum(idf) AS title FROM ti v JOIN ti p ON v.key = p.key AND v.lang = p.lang AND p.id < v.id AND (v.id - p.id) * 600 <= 259200 JOIN tidf t ON t.key = v.key AND t.lang = v.lang GROUP BY ALL),
  es AS (SELECT id, sum(w) AS s FROM ents GROUP BY id),
  esh AS (SELECT v.id AS v, p.id AS p, sum(least(v.w, p.w)) AS least, count(*) AS shared_ent FROM ents v JOIN ents p ON v.key = p.key AND p.id < v.id AND (v.id - p.id) * 600 <= 259200 GROUP BY ALL),
  ets AS (SELECT v.id AS v, p.id AS p, count(*) AS shared_title FROM eti v JOIN ents p ON v.key = p.key AND p.id < v.id GROUP BY ALL),
  ns AS (SELECT id, count(*) AS s FROM nu GROUP BY id),
  nsh AS (SELECT v.id AS v, p.id AS p, count(*) AS shared_num, sum(least(1.0, 0.25 + 0.25 * length(rtrim(v.key, '0')))) AS num_w FROM nu v JOIN nu p ON v.key = p.key AND p.id < v.id AND (v.id - p.id) * 600 <= 259200 GROUP BY ALL),
  qsh AS (SELECT DISTINCT v.id AS v, p.id AS p FROM qu v JOIN qu p ON v.key = p.key AND p.id < v.id), dsh AS (SELECT DISTINCT v.id AS v, p.id AS p FROM da v JOIN da p ON v.key = p.key AND p.id < v.id),
  met AS (SELECT v, p FROM dots UNION SELECT v, p FROM esh UNION SELECT v, p FROM nsh),
  s AS (SELECT v, p, rv.lang = rp.lang AS same, CASE WHEN rv.lang = rp.lang THEN coalesce(dot / sqrt(nv.ww * np.uu), 0) ELSE 0 END AS cos,
    CASE WHEN rv.lang = rp.lang THEN coalesce(title / (coalesce(tv.s, 0) + coalesce(tp.s, 0) - title), 0) ELSE 0 END AS title_share,
    coalesce(least / (ev.s + ep.s - least), 0) AS ent, coalesce(shared_ent, 0) AS shared_ent, coalesce(shared_title, 0) AS shared_title, coalesce(shared_num, 0) AS shared_num, coalesce(num_w, 0.0) AS num_w,
    CASE WHEN least(coalesce(xv.s, 0), coalesce(xp.s, 0)) > 0 THEN least(1.0, coalesce(num_w, 0.0) / greatest(1.0, 0.75 * least(xv.s, xp.s))) ELSE 0.0 END AS num,
    CASE WHEN qsh.v IS NULL THEN 0.0 ELSE 1.0 END AS quote, CASE WHEN dsh.v IS NULL THEN 0.0 ELSE 1.0 END AS date,
    CASE WHEN (v - p) * 600 <= 86400 THEN 1.0 ELSE greatest(0.35, 1 - ((v - p) * 600 / 3600.0::DOUBLE - 24) / 70) END AS time
    FROM met JOIN r rv ON rv.id = v JOIN r rp ON rp.id = p LEFT JOIN dots USING (v, p) LEFT JOIN tsh USING (v, p) LEFT JOIN esh USING (v, p) LEFT JOIN ets USING (v, p) LEFT JOIN nsh USING (v, p) LEFT JOIN qsh USING (v, p) LEFT JOIN dsh USING (v, p)
    LEFT JOIN tn nv ON nv.id = v LEFT JOIN tn np ON np.id = p LEFT JOIN tis tv ON tv.id = v LEFT JOIN tis tp ON tp.id = p LEFT JOIN es ev ON ev.id = v LEFT JOIN es ep ON ep.id = p LEFT JOIN ns xv ON xv.id = v LEFT JOIN ns xp ON xp.id = p),
  sc AS (SELECT *, CASE WHEN same THEN (0.44 * cos + 0.14 * title_share + 0.18 * ent + 0.16 * num + 0.06 * quote + CASE WHEN quote > 0 AND shared_ent > 0 THEN 0.10 ELSE 0 END) * (0.75 + 0.25 * time) ELSE 0 END AS lexical,
    (0.40 * ent + 0.35 * num + 0.10 * date + 0.15 * least(1.0, shared_title / 3.0::DOUBLE)) * (0.8 + 0.2 * time) AS by_items FROM s),
  pairs AS (SELECT v, p, greatest(lexical, by_items) AS score, cos, title_share, ent, shared_ent, num, shared_num FROM sc WHERE
    (same AND lexical >= 0.30 AND cos >= 0.15 AND (shared_ent >= 2 OR num_w >= 0.75 OR cos >= 0.5) AND (shared_title >= 1 OR title_share >= 0.15 OR cos >= 0.4 OR num_w >= 1.5))
    OR (by_items >= 0.30 AND ((shared_ent >= 2 AND num_w >= 1.2) OR (shared_ent >= 1 AND num_w >= 1.75) OR (shared_ent >= 3 AND num_w >= 0.75) OR (shared_ent >= 5 AND shared_title >= 1))))
"""
)
#: Components by the reach of the smallest id.
COMPONENTS = (
    PAIRS
    + """, e AS (SELECT v AS a, p AS b FROM pairs UNION SELECT p, v FROM pairs), reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
  SELECT id AS doc_id, coalesce(event, id) AS event_id FROM r LEFT JOIN (SELECT a, min(b) AS event FROM reach GROUP BY a) ON a = id"""
)


@query(PAIRS + "SELECT v, p, round(score, 6) AS score, round(cos, 6) AS cos, round(title_share, 6) AS title_share, round(ent, 6) AS ent, CAST(shared_ent AS BIGINT) AS shared_ent, round(num, 6) AS num, CAST(shared_num AS BIGINT) AS shared_num FROM pairs")
def story_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of reports that attach, scored; all pairs of a horizon are compared."""
    found = stories.attached_profiles(prepared(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("score", "cos", "title_share", "ent", "num")]
    return found.select("v", "p", *rounded, *(F.col(c).cast("long").alias(c) for c in ("shared_ent", "shared_num")))


@query(COMPONENTS)
def story_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as components of the attached pairs of all reports."""
    return events(spark, sf_dir, prepared(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("event").alias("event_id"))


@query(COMPONENTS)
def story_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events by micro-batches of a stream, with frozen frequencies: state by batch, one batch a file."""
    name = f"story-stream-{uuid.uuid4().hex}"
    state = stream.EventState(spark, f"{shared_dir(spark)}/{name}")
    source, folders = stream.arrivals(reports(spark, sf_dir), BATCHES, f"{name}-reports")
    TABLES.extend((state.folder, source, *folders))
    given = spark.read.schema(stream.REPORT).parquet(*folders)
    df, n = written(profiles.frequencies(profiles.hashed(given)), "item-frequencies"), given.count()
    stream.run_available(spark, source, state, parts=True, frozen=(df, n))
    return stream.events_of(state).select(F.col("id").alias("doc_id"), F.col("event").alias("event_id"))


@query()
def story_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after merging: profiles that match strongly are united, again and again until none is left."""
    given = prepared(spark, sf_dir)
    found = stories.merged_profiles(given, written(events(spark, sf_dir, given), "components"))
    return found.select(F.col("id").alias("doc_id"), F.col("event").alias("event_id"))


@query()
def story_best_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the last day and the event of the earlier ones to which each attaches best."""
    given = prepared(spark, sf_dir)
    last = given.rows.agg(F.max("sec")).first()[0] or 0
    new, old = (given.rows.filter(c) for c in (F.col("sec") > last - 86_400, F.col("sec") <= last - 86_400))
    links = written(stories.attached_profiles(Packed(old, given.idf)).select("v", "p"), "attached")
    labels = written(stories.components(old.select("id"), links), "components")
    found = stories.best_event_profiles(given, new.select("id"), labels)
    return found.select(F.col("id").alias("doc_id"), F.col("event").alias("event_id"), F.round("score", 6).alias("score"), F.round("cos", 6).alias("cos"))


@query(r"""WITH d AS (SELECT doc_id, CAST(floor(doc_id * 10 / 1440) AS BIGINT) AS day, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+'))) AS term FROM documents),
  n AS (SELECT day, count(*) AS n FROM (SELECT CAST(floor(doc_id * 10 / 1440) AS BIGINT) AS day FROM documents) GROUP BY day), before AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM n),
  f AS (SELECT day, term, count(*) AS df FROM d GROUP BY ALL), g AS (SELECT *, coalesce(sum(df) OVER (PARTITION BY term ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM f)
  SELECT day, term, CAST(df AS BIGINT) AS df, CAST(known AS BIGINT) AS known, round(ln((seen + 2.0::DOUBLE) / (known + 1)) + 1, 9) AS idf FROM g JOIN before USING (day)""")
def frequencies_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the terms of every day's reports how many earlier reports have them, and the weight that follows."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    given = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") * 10 / 1440).alias("day"), words.alias("terms"))
    return stories.frequencies_before(given).select("day", "term", "df", "known", F.round("idf", 9).alias("idf"))
