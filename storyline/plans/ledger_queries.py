"""Queries of ledgers, repeats, page lists and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators import ledger, repeats
from storyline.sources import markup
from storyline.sources.scratch import written
from storyline.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SIZE = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, payload of the events as entries of a log."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_id")).first()[0] or 0
    return e.select((F.col("event_id") - first).alias("pos"), F.concat_ws(":", "event_type", "user_id").alias("payload"))


@query("""WITH RECURSIVE p AS (SELECT event_id - (SELECT min(event_id) FROM events) AS pos, event_type || ':' || user_id AS payload FROM events),
  c AS (SELECT pos, pos // 64 AS segment, sha256('segment ' || CAST(pos // 64 AS VARCHAR) || '|' || CAST(pos AS VARCHAR) || '|' || payload) AS hash FROM p WHERE pos % 64 = 0
    UNION ALL SELECT p.pos, c.segment, sha256(c.hash || '|' || CAST(p.pos AS VARCHAR) || '|' || p.payload) FROM c JOIN p ON p.pos = c.pos + 1 WHERE p.pos % 64 <> 0)
  SELECT segment, count(*) AS n, max_by(hash, pos) AS head FROM c GROUP BY segment""")
def audit_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the first level of a ledger over all events."""
    log = ledger.ledger(audit_rows(spark, sf_dir), SIZE).filter("level = 0")
    return log.groupBy("segment").agg(F.count("*").alias("n"), F.max_by("hash", "pos").alias("head"))


@query("""WITH p AS (SELECT event_id - (SELECT min(event_id) FROM events) AS pos FROM events), n AS (SELECT count(*) AS n FROM p),
  s AS (SELECT *, pos % 1000 = 500 AS edited, pos % 1000 = 700 OR pos >= n - 3 AS gone, (pos % 1000 = 700) AND (pos % 64 <> 63) AND pos + 1 < n - 3 AS gap FROM p, n)
  SELECT reason, count(*) AS n, CAST(min(pos) AS BIGINT) AS first FROM (
    SELECT 'edited' AS reason, pos FROM s WHERE edited AND NOT gone UNION ALL SELECT 'gap', pos FROM s WHERE gap
    UNION ALL SELECT 'lost', pos // 64 FROM s GROUP BY pos // 64 HAVING bool_and(gone)
    UNION ALL SELECT 'head', pos // 64 FROM s GROUP BY pos // 64 HAVING bool_or(gone) AND NOT bool_and(gone)) GROUP BY reason""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of the ledger finds after rows were edited, rows were removed and the tail was cut."""
    log = written(ledger.ledger(audit_rows(spark, sf_dir), SIZE), "whole-ledger")
    n = log.filter("level = 0").count()
    base = F.col("level") == 0
    kept = log.filter(~(base & ((F.col("pos") % 1000 == 700) | (F.col("pos") >= n - 3))))
    changed = kept.withColumn("payload", F.when(base & (F.col("pos") % 1000 == 500), "edited").otherwise(F.col("payload")))
    return ledger.verified(changed, SIZE).groupBy("reason").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


OPS = "CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN CASE WHEN value > 99.5 THEN 'revoke' END WHEN 'click' THEN 'add' END"


@query(f"""WITH l AS (SELECT event_id AS seq, CAST(user_id AS BIGINT) AS key, {OPS} AS op, CAST(value AS DECIMAL(38, 6)) AS value FROM events WHERE {OPS} IS NOT NULL),
  r AS (SELECT key, min(seq) FILTER (op = 'revoke') AS gone FROM l GROUP BY key), live AS (SELECT l.* FROM l JOIN r USING (key) WHERE gone IS NULL OR seq < gone), s AS (SELECT key, max(seq) AS since, max_by(value, seq) AS value FROM live WHERE op = 'set' GROUP BY key),
  a AS (SELECT live.key, sum(live.value) AS added FROM live LEFT JOIN s USING (key) WHERE op = 'add' AND (since IS NULL OR seq > since) GROUP BY live.key)
  SELECT key, CAST(coalesce(s.value, 0) + coalesce(added, 0) AS DECIMAL(38, 6)) AS value, gone IS NOT NULL AS revoked FROM r LEFT JOIN s USING (key) LEFT JOIN a USING (key)""")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every user after the log's second half over a snapshot taken in its middle; equal to the fold of the whole log."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("long").alias("key"), F.expr(OPS).alias("op"), F.col("value").cast("decimal(38, 6)").alias("value")).filter("op IS NOT NULL")
    since = e.agg(((F.min("event_id") + F.max("event_id")) / 2).cast("long")).first()[0] or 0
    empty = log.limit(0).select("key", "value", F.lit(False).alias("revoked"))
    snapshot = written(ledger.replayed(empty, log.filter(F.col("seq") <= since), -1), "snapshot")
    return ledger.replayed(snapshot, log, since)


@query("""WITH l AS (SELECT event_id AS seq FROM events WHERE event_id % 97 <> 13 AND event_id % 97 <> 14), n AS (SELECT seq, lead(seq) OVER (ORDER BY seq) AS next FROM l)
  SELECT seq + 1 AS first, next - 1 AS last FROM n WHERE next > seq + 1""")
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of numbers that a log lacks."""
    return ledger.missing(table(spark, sf_dir, "events").filter("event_id % 97 <> 13 AND event_id % 97 <> 14").select(F.col("event_id").alias("seq")))


SETS = r"""d AS (SELECT doc_id AS id, lang, list_distinct(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '\p{L}+')) AS title,
    list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}0-9,;:-] (\p{Lu}\p{Ll}+)', 1), lambda x: lower(x))) AS ent, list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{2,}')) AS num, len(regexp_extract_all(coalesce(text, ''), '!')) AS marks FROM documents)"""


@query(rf"""WITH {SETS}, p AS (SELECT d.* FROM d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) q ON q.doc_id = d.id),
  j AS (SELECT a.id, b.id AS previous, round(0.45 * CASE WHEN a.lang = b.lang AND len(a.title) > 0 AND len(b.title) > 0 THEN len(list_intersect(a.title, b.title)) / (len(a.title) + len(b.title) - len(list_intersect(a.title, b.title))) ELSE 0 END
    + 0.35 * CASE WHEN len(a.ent) > 0 AND len(b.ent) > 0 THEN len(list_intersect(a.ent, b.ent)) / (len(a.ent) + len(b.ent) - len(list_intersect(a.ent, b.ent))) ELSE 0 END
    + 0.20 * CASE WHEN len(a.num) > 0 AND len(b.num) > 0 THEN len(list_intersect(a.num, b.num)) / (len(a.num) + len(b.num) - len(list_intersect(a.num, b.num))) ELSE 0 END, 9) AS sim, len(list_filter(a.num, lambda x: NOT list_contains(b.num, x))) > 0 AS newer
    FROM d a JOIN p b ON b.id < a.id),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, previous) AS r FROM j WHERE sim >= 0.449999999) WHERE r = 1)
  SELECT id AS doc_id, previous, round(sim, 6) AS sim, CASE WHEN previous IS NULL THEN 'new' WHEN newer OR marks > 2 THEN 'new_stage' ELSE 'duplicate' END AS verdict FROM d LEFT JOIN m USING (id)""")
def repeat_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the good ones before it: duplicate, new stage or new."""
    text = F.coalesce("text", F.lit(""))
    every = lambda c, rx, k=0: F.array_distinct(F.regexp_extract_all(c, F.lit(rx), F.lit(k)))
    events = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("at"),
        F.array("lang").alias("langs"),
        every(F.lower(F.substring_index(text, "\n", 1)), r"\p{L}+").alias("title"),
        F.array_distinct(F.transform(every(text, r"[\p{L}0-9,;:-] (\p{Lu}\p{Ll}+)", 1), F.lower)).alias("ent"),
        every(text, "[0-9]{2,}").alias("num"),
        F.lit(1).alias("independent"),
        (F.regexp_count(text, F.lit("!")) > 2).alias("followup"),
    )
    events = written(events, "repeat-events")
    published = events.join(table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").drop("followup")
    return repeats.verdicts(events, published).select(F.col("id").alias("doc_id"), "previous", F.round("sim", 6).alias("sim"), "verdict")


@query(r"""WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') AS nav, regexp_replace(url, '^([a-z]+://[^/?#]*).*$', '\1') AS host FROM pages), l AS (SELECT page_id, host, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">[^<]*</a>')) AS x FROM n)
  SELECT page_id, count(*) AS n, CAST(sum(length(host || regexp_extract(x, 'href="([^"]*)"', 1))) AS BIGINT) AS url_chars FROM l WHERE trim(regexp_extract(x, '>([^<]*)</a>', 1)) <> '' GROUP BY page_id""")
def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages' lists by a selector: how many, and the length of their addresses."""
    found = markup.html_list(table(spark, sf_dir, "pages"), "nav li > a")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("url")).alias("url_chars"))


@query(r"""WITH a AS (SELECT alias, max(key) AS key FROM (SELECT item_id AS key, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS alias FROM benchmark) GROUP BY alias),
  t AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g') AS x FROM documents), p AS (SELECT doc_id, x, string_split(x, ' by ') AS parts FROM t),
  w AS (SELECT doc_id, x, unnest(range(1, len(parts))) AS i, parts FROM p), s AS (SELECT doc_id, regexp_replace(x[list_sum(list_transform(parts[1:i], lambda y: length(y))) + 4 * i + 1:][:90], '[.!?] .*$', '') AS win FROM w),
  f AS (SELECT DISTINCT doc_id, key FROM s JOIN a ON contains(win, alias)), k AS (SELECT doc_id, string_agg(CAST(key AS VARCHAR), ',' ORDER BY CAST(key AS VARCHAR)) AS keys FROM f GROUP BY doc_id)
  SELECT doc_id, CAST(len(parts) - 1 AS BIGINT) AS markers, coalesce(keys, '') AS keys FROM p LEFT JOIN k USING (doc_id)""")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (long words of the benchmark texts) that stand behind the word "by" in the documents, by one automaton."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("name")
    sources = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), words)
    aliases = written(markup.alias_index(sources.withColumn("aliases", F.array().cast("array<string>"))), "aliases")
    found = markup.citations(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), aliases, " by ")
    return found.select(F.col("id").alias("doc_id"), "markers", F.array_join("keys", ",").alias("keys"))
