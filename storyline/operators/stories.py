"""Grouping reports to events: pairs inside a horizon of time, weighted scores, components, merging of events.

A report is a set of items: terms and title words (of its language), entities, title entities, numbers, quotes, dates.
An event is the same table over its members: weights of terms add up, those of entities keep the maximum. One scoring
serves both: a report against a report, a report against an event, an event against an event.

Pairs meet by time alone: every report is scored against all of its horizon and of the one before (profiles), so that none
that attaches is lost and no key that many reports share can fill a task.

The earlier of two reports (by time, then id) takes the part of the event. Components of the attached pairs don't depend
on the order of arrival. Merging scores the events' profiles, unites those that match strongly, and goes on with the
profiles of the united ones until no pair is left.

Defined results: a report without items is an event of its own; null texts are empty; reports of one time are ordered by
id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.operators import profiles
from storyline.operators.graph import connected_components
from storyline.operators.profiles import Packed
from storyline.sources.scratch import discard, written

HORIZON = 72 * 3600
#: Thresholds of attaching and merging.
ATTACH, MERGE, MERGE_COS = 0.30, 0.42, 0.30
MERGE_GAP = 60 * 3600
#: Least cosine that attaches without entities or numbers.
COS_ALONE = 0.5

KINDS = ("term", "title", "ent", "title_ent", "num", "quote", "date")
OF_LANGUAGE = ("term", "title")


def report_items(reports: DataFrame) -> DataFrame:
    """id, kind, lang ('' where it doesn't matter), key, tf. reports: id, lang and arrays title, terms, entities,
    title_entities, numbers, quotes, dates. Words of the title count twice."""

    def of(kind: str, values: Column, tf: Column | None = None) -> Column:
        lang = F.col("lang") if kind in OF_LANGUAGE else F.lit("")
        one = lambda x: F.struct(F.lit(kind).alias("kind"), lang.alias("lang"), x.alias("key"), (F.lit(1.0) if tf is None else tf(x)).alias("tf"))
        return F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), one)

    twice = lambda within: lambda x: F.when(F.array_contains(within, x), 2.0).otherwise(1.0)
    parts = [
        of("term", F.array_union("terms", "title"), twice(F.col("title"))),
        of("title", F.col("title")),
        of("ent", F.array_union("entities", "title_entities"), twice(F.col("title_entities"))),
        of("title_ent", F.col("title_entities")),
        of("num", F.col("numbers")),
        of("quote", F.col("quotes")),
        of("date", F.col("dates")),
    ]
    return reports.select("id", F.explode(F.concat(*parts)).alias("i")).select("id", "i.*").filter("key IS NOT NULL")


def heads_of(reports: DataFrame) -> DataFrame:
    """id, lang, sec (first), size of each event or report. reports: id, lang, sec, one row per report."""
    langs = reports.groupBy("id", "lang").agg(F.count("*").alias("n"), F.min("sec").alias("sec"))
    best = F.max_by("lang", F.struct("n", F.col("lang").alias("l"))).alias("lang")
    return langs.groupBy("id").agg(best, F.min("sec").alias("sec"), F.sum("n").alias("size"))


def frequencies(items: DataFrame) -> DataFrame:
    """kind, lang, key, df: how many reports have an item."""
    return items.groupBy("kind", "lang", "key").agg(F.count("*").alias("df"))


def frequencies_before(reports: DataFrame) -> DataFrame:
    """day, term, df of the day, known (reports of earlier days with the term), idf by those. reports: day, terms (distinct).

    Sums by day come first, so that a term's running count takes one row a day. The number of reports before a day takes
    one row per day.
    """
    by_day = reports.groupBy("day").agg(F.count("*").alias("n"))
    past = Window.rowsBetween(Window.unboundedPreceding, -1).orderBy("day")
    seen = by_day.select("day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("seen"))
    df = reports.select("day", F.explode("terms").alias("term")).groupBy("day", "term").agg(F.count("*").alias("df"))
    known = F.coalesce(F.sum("df").over(past.partitionBy("term")), F.lit(0))
    out = df.withColumn("known", known).join(seen, "day")
    return out.withColumn("idf", F.log((F.col("seen") + 2.0) / (F.col("known") + 1)) + 1)


def weighted(items: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """items with df, idf, w (weight as the report of a pair), u (as its event)."""
    term = F.col("kind").isin(*OF_LANGUAGE)
    known = F.coalesce("df", F.lit(0))
    idf = F.log(F.lit(n + 2.0) / (known + 1)) + 1
    out = items.join(df, ["kind", "lang", "key"], "left").withColumn("df", known).withColumn("idf", F.when(term, idf).otherwise(1.0))
    w = F.when(F.col("kind") == "term", F.least("tf", F.lit(2.0)) * F.col("idf")).otherwise(F.col("tf"))
    u = F.when(F.col("kind") == "term", F.when(F.col("tf") > 1, 1 + F.log("tf")).otherwise(F.col("tf")) * F.col("idf")).otherwise(F.col("tf"))
    return out.select("id", "kind", "lang", "key", "df", "idf", w.alias("w"), u.alias("u"))


def rules(same: np.ndarray, cos: np.ndarray, title: np.ndarray, ent: np.ndarray, num: np.ndarray, quote: np.ndarray, date: np.ndarray, gap_h: np.ndarray, shared_ent: np.ndarray, shared_title: np.ndarray, num_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score, and whether a pair attaches, from its shares."""
    time = np.where(gap_h <= 24, 1.0, np.maximum(0.35, 1 - (gap_h - 24) / 70))
    quoted = np.where(quote & (shared_ent > 0), 0.10, 0.0)
    lexical = np.where(same, (0.44 * cos + 0.14 * title + 0.18 * ent + 0.16 * num + 0.06 * quote + quoted) * (0.75 + 0.25 * time), 0.0)
    by_items = (0.40 * ent + 0.35 * num + 0.10 * date + 0.15 * np.minimum(1.0, shared_title / 3)) * (0.8 + 0.2 * time)
    # fixed values: the two rules of attaching
    near = (shared_ent >= 2) | (num_w >= 0.75) | (cos >= COS_ALONE)
    about = (shared_title >= 1) | (title >= 0.15) | (cos >= 0.4) | (num_w >= 1.5)
    first = same & (lexical >= ATTACH) & (cos >= 0.15) & near & about
    few = ((shared_ent >= 2) & (num_w >= 1.2)) | ((shared_ent >= 1) & (num_w >= 1.75))
    many = ((shared_ent >= 3) & (num_w >= 0.75)) | ((shared_ent >= 5) & (shared_title >= 1))
    return np.maximum(lexical, by_items), first | ((by_items >= ATTACH) & (few | many))


def attached(heads: DataFrame, items: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """All pairs of reports that attach, with their scores. items: weighted."""
    # of a report min(tf, 2) is tf
    counted = items.withColumn("tf", F.when(F.col("kind") == "term", F.col("w") / F.col("idf")).otherwise(F.col("w")))
    return attached_profiles(profiles.of_items(counted, heads), horizon)


def attached_profiles(given: Packed, horizon: int = HORIZON) -> DataFrame:
    """All pairs of reports that attach, with their scores."""
    return profiles.attaching(given, rules, horizon)


def plain_profiles(items: DataFrame, heads: DataFrame, df: DataFrame, n: int) -> Packed:
    """Profiles of plain items, a written table."""
    weights = weighted(items, df, n).select("id", "kind", "lang", "key", "idf")
    made = profiles.of_items(items.join(weights, ["id", "kind", "lang", "key"]), heads)
    return Packed(written(made.rows, "profiles"), made.idf)


def best_event(reports: DataFrame, new: DataFrame, items: DataFrame, labels: DataFrame, df: DataFrame, n: int, horizon: int = HORIZON) -> DataFrame:
    """best_event_profiles of reports given by their plain items. reports: id, lang, sec."""
    heads = reports.select("id", "lang", "sec", F.lit(1).cast("long").alias("size"))
    return best_event_profiles(plain_profiles(items, heads, df, n), new, labels, horizon)


def best_event_profiles(given: Packed, new: DataFrame, labels: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """id, event, score, cos of the event to which each new report attaches best (by score, then the smaller event).

    given: profiles of all reports; new: ids of the reports to attach; labels: id, event of others.
    An event takes reports from its first one on, up to a horizon later.
    """
    heads = heads_of(given.rows.join(labels, "id").select(F.col("event").alias("id"), "lang", "sec"))
    events = profiles.regrouped(given.rows.join(labels.select("id"), "id", "left_semi"), labels, heads)
    mine = given.rows.join(new, "id", "left_semi")
    both = Packed(written(events.unionByName(mine), "event-profiles"), given.idf)
    found = profiles.attaching(both, rules, horizon, new.select("id"), "to_old")
    best = F.max_by(F.struct("p", "score", "cos"), F.struct("score", (-F.col("p")).alias("least"))).alias("b")
    return found.groupBy(F.col("v").alias("id")).agg(best).select("id", F.col("b.p").alias("event"), "b.score", "b.cos")


def components(heads: DataFrame, links: DataFrame) -> DataFrame:
    """id, event: the smallest id reachable over links (v, p), for every report."""
    found = connected_components(links.select(F.col("v").alias("a"), F.col("p").alias("b")))
    return heads.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("event"))


def merged(reports: DataFrame, items: DataFrame, labels: DataFrame, df: DataFrame, n: int, max_rounds: int = 30) -> DataFrame:
    """merged_profiles of reports given by their plain items. reports: id, lang, sec."""
    heads = reports.select("id", "lang", "sec", F.lit(1).cast("long").alias("size"))
    return merged_profiles(plain_profiles(items, heads, df, n), labels, max_rounds)


def merged_profiles(given: Packed, labels: DataFrame, max_rounds: int = 30) -> DataFrame:
    """labels (id, event) with events united that match strongly. given: profiles of the reports, a written table.

    Every round scores the profiles as they are after the round before, from the second on only pairs of which one has
    changed. The event of fewer reports takes the part of the report (of two equal ones the later).
    """
    reports = given.rows.select("id", "lang", "sec")
    labels, changed = written(labels, "events"), None
    for _ in range(max_rounds):
        heads = written(heads_of(reports.join(labels, "id").select(F.col("event").alias("id"), "lang", "sec")), "event-heads")
        events = Packed(written(profiles.regrouped(given.rows, labels, heads), "event-profiles"), given.idf)
        strong = profiles.attaching(events, rules, MERGE_GAP, changed, by_size=True).filter((F.col("score") >= MERGE) & ((F.col("cos") >= MERGE_COS) | F.col("cross_lang")))
        links = written(strong.select("v", "p"), "merges")
        discard(events.rows, heads, changed)
        if links.isEmpty():
            discard(links)
            return labels
        united = written(connected_components(links.select(F.col("v").alias("a"), F.col("p").alias("b"))).toDF("event", "into"), "united")
        before, labels = labels, written(labels.join(united, "event", "left").select("id", F.coalesce("into", "event").alias("event")), "events")
        changed = written(united.select(F.col("into").alias("id")).distinct(), "changed")
        discard(before, links, united)
    raise RuntimeError(f"events have not settled after {max_rounds} rounds")
