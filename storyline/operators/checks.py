"""Checks of drafts before they go out: rules as data over one pass, grounding in sources, media, evidence.

A rule names a check, when it applies, when it fails or warns, and whether a warning keeps a draft from going out on its
own. All rules become one expression over a row of inputs: no rule costs a scan, a join or a shuffle. Inputs that need
other tables (grounding, copies, media) are joined before, once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "array<struct<key:string,status:string,blocks:boolean>>"


@dataclass(frozen=True)
class Rule:
    """Conditions are SQL over the inputs; the first of fail, warn that holds decides, else the draft passes. A null
    condition doesn't hold."""

    key: str
    fail: str = "false"
    warn: str = "false"
    blocks: str = "false"  # whether a warning blocks
    when: str = "true"  # where the rule gives a result at all


#: Limits of texts by platform.
LIMITS = {"telegram": 4096, "instagram": 2200, "facebook": 63206}
HASHTAGS = {"telegram": 3, "instagram": 30, "facebook": 3}
SOFT_HASHTAGS, FIRST_LINE, CAROUSEL = 8, 125, 10
MAX_RUN, MAX_RATIO = 10, 0.12
RIGHTS = ("own", "generated", "official_free", "licensed")
LEAST_RATIO, MOST_RATIO, MOST_BYTES = 0.8, 1.91, 8 * 1024 * 1024

RULES = (
    Rule("not_empty", fail="trim(body) = ''", when="trim(body) = ''"),
    Rule("length", fail="length > text_limit"),
    Rule("ig_first_line", warn=f"first_line > {FIRST_LINE}", when=f"platform = 'instagram' AND first_line > {FIRST_LINE}"),
    Rule(
        "hashtags",
        fail="platform = 'instagram' AND hashtags > hashtag_limit",
        warn=f"hashtags > IF(platform = 'instagram', {SOFT_HASHTAGS}, hashtag_limit + 2)",
        when=f"hashtags > IF(platform = 'instagram', {SOFT_HASHTAGS}, hashtag_limit + 2)",
    ),
    Rule("html", fail="bad_tags > 0", when="platform = 'telegram'"),
    Rule("numbers", fail="missing_numbers > 0"),
    Rule("quotes", fail="missing_quotes > 0"),
    Rule("urls", fail="missing_urls > 0 OR shorteners > 0"),
    Rule("originality", fail=f"copy_run >= {MAX_RUN} OR copy_ratio > {MAX_RATIO}", warn=f"copy_run >= 0.8 * {MAX_RUN} OR copy_ratio > 0.8 * {MAX_RATIO}", blocks="true", when="copy_run IS NOT NULL"),
    Rule("title", warn="same_title", blocks="true", when="same_title"),
    Rule("attribution", warn="needs_attribution AND NOT attributed", blocks="true"),
    Rule("sources_listed", warn="NOT sources_listed", blocks="true"),
    Rule("own_opinion", warn="opinions > 0 AND attributions > 0", blocks="true"),
    Rule("politics", fail="agitation > 0", warn="political", blocks="true"),
    Rule("sensitive", warn="sensitive > 0", blocks="true", when="sensitive > 0"),
    Rule("forbidden", fail="forbidden > 0"),
    Rule("language", warn="length >= 80 AND text_language <> language", blocks="true"),
    Rule("secrets", fail="secrets"),
    Rule("disclosure", fail="disclosure_on AND NOT disclosed", warn="NOT disclosure_on", blocks="true"),
    Rule("media", fail="media_problems > 0", warn="media_warnings > 0", blocks="true"),
    Rule("verification", fail="verification = 'rejected'", warn="coalesce(verification, '') NOT IN ('confirmed', 'multi_confirmed')", blocks="true", when="verification IS NOT NULL"),
    Rule("injection", warn="injection", blocks="true", when="injection"),
    Rule("repeat", warn="repeats = 'duplicate'", blocks="true", when="repeats = 'duplicate'"),
    Rule("generator", warn="heuristic AND model_required", blocks="true", when="heuristic AND model_required"),
)

#: What an input is where a table has no column of its name.
INPUTS = {
    "platform": "'facebook'", "body": "''", "length": "length(body)", "first_line": "length(substring_index(body, '\n', 1))", "hashtags": "0", "bad_tags": "0", "missing_numbers": "0", "missing_quotes": "0", "missing_urls": "0",
    "shorteners": "0", "copy_run": "CAST(NULL AS INT)", "copy_ratio": "0.0", "same_title": "false", "needs_attribution": "false", "attributed": "true", "sources_listed": "true", "opinions": "0", "attributions": "0", "agitation": "0",
    "political": "false", "sensitive": "0", "forbidden": "0", "language": "''", "text_language": "language", "secrets": "false", "disclosure_on": "true", "disclosed": "true", "media_problems": "0", "media_warnings": "0",
    "verification": "CAST(NULL AS STRING)", "injection": "false", "repeats": "''", "heuristic": "false", "model_required": "false",
}


def checked(drafts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """drafts with results (array of key, status, blocks, in the rules' order), passed (no failure) and blocks."""
    df = drafts
    for name, default in INPUTS.items():  # projections: Spark folds them into one
        if name not in df.columns:
            df = df.withColumn(name, F.expr(default))
    by_platform = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("platform"))
    df = df.withColumns({"text_limit": by_platform(LIMITS), "hashtag_limit": by_platform(HASHTAGS)})

    def result(rule: Rule) -> Column:
        status = F.when(F.expr(rule.fail), "fail").when(F.expr(rule.warn), "warn").otherwise("pass")
        blocks = F.expr(rule.fail) | (F.expr(rule.warn) & F.expr(rule.blocks))
        return F.when(F.expr(rule.when), F.struct(F.lit(rule.key).alias("key"), status.alias("status"), F.coalesce(blocks, F.lit(False)).alias("blocks")))

    results = F.filter(F.array(*map(result, rules)), lambda r: r.isNotNull())
    out = df.withColumn("results", results)
    passed = ~F.exists("results", lambda r: r["status"] == "fail")
    return out.withColumns({"passed": passed, "blocks": F.exists("results", lambda r: r["blocks"])}).select(*drafts.columns, "results", "passed", "blocks")


def media_findings(assets: DataFrame) -> DataFrame:
    """draft, media_problems, media_warnings of drafts with assets. assets: draft, platform, format, rights, attribution,
    ai, ai_label, kind, mime, width, height, bytes."""
    instagram = F.col("platform") == "instagram"
    ratio = F.try_divide("width", "height")
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    problems = (
        yes(~F.coalesce("rights", F.lit("")).isin(*RIGHTS))
        + yes(F.col("ai") & ~F.coalesce("ai_label", F.lit(False)))
        + yes(instagram & F.col("kind").isin("image", "card") & (F.coalesce("mime", F.lit("")) != "image/jpeg"))
        + yes(instagram & ~ratio.between(LEAST_RATIO, MOST_RATIO))
        + yes(instagram & (F.col("bytes") > MOST_BYTES))
    )
    warnings = yes(F.col("rights").isin("official_free", "licensed") & (F.coalesce("attribution", F.lit("")) == ""))
    found = assets.groupBy("draft").agg(F.sum(problems).alias("media_problems"), F.sum(warnings).alias("media_warnings"), F.max(instagram & (F.col("format") == "carousel")).alias("carousel"), F.count("*").alias("n"))
    return found.select("draft", (F.col("media_problems") + yes(F.col("carousel") & (F.col("n") > CAROUSEL))).alias("media_problems"), "media_warnings")


# ---- grounding ------------------------------------------------------------------------------------------------------

#: Two numbers are one if they differ by a hundredth of the known one at most.
TOLERANCE = 0.01


#: Below this size numbers are compared by their difference (1e-9) instead of their ratio.
SMALL = 2e-7


def log_bucket(v: Column) -> Column:
    """Steps of twice the tolerance: numbers that count as one lie in the same or in neighbouring ones."""
    return F.floor(F.log(F.abs(v)) / F.log(F.lit(1 + 2 * TOLERANCE))).cast("long")


def even_bucket(v: Column) -> Column:
    """Steps of 2e-9, apart from all others."""
    return F.floor(v / 2e-9).cast("long") - F.lit(2**40)


def buckets_near(v: Column) -> Column:
    """Buckets of all numbers that count as a known one."""
    around = lambda b: F.array(*(b + k for k in (-1, 0, 1)))
    none = F.array().cast("array<bigint>")
    return F.concat(F.when(F.abs(v) < 1.5 * SMALL, around(even_bucket(v))).otherwise(none), F.when(F.abs(v) > 0.5 * SMALL, around(log_bucket(v))).otherwise(none))


def ungrounded_numbers(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """draft, n (numbers), missing: numbers that no source of the draft's group up to its place has, to a hundredth.

    drafts: draft, group, place, v, unit; sources: group, place, v, unit. A source counts for drafts of later places; an
    empty unit fits any. Of a group's equal numbers only the first place is kept, so that a group's size doesn't matter.
    """
    known = sources.groupBy("group", "v", "unit").agg(F.min("place").alias("since"))
    near = known.select("group", F.col("v").alias("kv"), F.col("unit").alias("ku"), "since", F.explode(buckets_near(F.col("v"))).alias("bucket"))
    asked = drafts.withColumn("bucket", F.when(F.abs("v") < SMALL, even_bucket(F.col("v"))).otherwise(log_bucket(F.col("v"))))
    fits = (F.abs(F.col("v") - F.col("kv")) <= F.greatest(F.lit(1e-9), TOLERANCE * F.abs(F.col("kv")))) & ((F.col("unit") == F.col("ku")) | (F.col("unit") == "") | (F.col("ku") == ""))
    found = asked.join(near, ["group", "bucket"]).filter(fits & (F.col("since") < F.col("place"))).select("draft", "v", "unit").distinct()
    judged = drafts.select("draft", "v", "unit").distinct().join(found.withColumn("ok", F.lit(1)), ["draft", "v", "unit"], "left")
    return judged.groupBy("draft").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok").isNull(), 1)).alias("missing"))


def plain_quote(c: Column) -> Column:
    """Lower case, words and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"\s+", " "))


def ungrounded_quotes(drafts: DataFrame, sources: DataFrame, words: int = 4) -> DataFrame:
    """draft, n (quotations of `words` words or more), missing: those that hold no quotation of the sources and are held
    by none. drafts: draft, group, place, quote; sources: group, place, quote.

    If one quotation holds the other, the longer one has the first `words` words of the shorter one: they meet on those.
    """
    cut = lambda df, *more: df.select(*more, "group", "place", plain_quote(F.col("quote")).alias("q")).withColumn("w", F.split("q", " ")).filter(F.size("w") >= words)
    gram = lambda at: F.array_join(F.slice("w", at, F.lit(words)), " ")
    all_grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.array_join(F.slice("w", i, F.lit(words)), " ")))
    mine, theirs = cut(drafts, "draft"), cut(sources).groupBy("group", "q", "w").agg(F.min("place").alias("place"))
    sides = []
    for a, b in ((F.array(gram(F.lit(1))), all_grams), (all_grams, F.array(gram(F.lit(1))))):
        left = mine.select("draft", "group", "place", F.col("q").alias("mine"), F.explode(a).alias("gram"))
        right = theirs.select("group", F.col("place").alias("since"), F.col("q").alias("theirs"), F.explode(b).alias("gram"))
        sides.append(left.join(right, ["group", "gram"]).filter(F.col("since") < F.col("place")).filter(F.contains("mine", "theirs") | F.contains("theirs", "mine")).select("draft", F.col("mine").alias("q")))
    found = sides[0].unionByName(sides[1]).distinct().withColumn("ok", F.lit(1))
    judged = mine.select("draft", "q").distinct().join(found, ["draft", "q"], "left")
    return judged.groupBy("draft").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok").isNull(), 1)).alias("missing"))


def ungrounded_urls(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """draft, n, missing: addresses of a draft that are none of its group's sources. drafts: draft, group, url; sources: group, url."""
    asked = drafts.select("draft", "group", F.rtrim(F.col("url"), F.lit(".,)")).alias("url")).distinct()
    judged = asked.join(sources.select("group", "url").distinct().withColumn("ok", F.lit(1)), ["group", "url"], "left")
    return judged.groupBy("draft").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok").isNull(), 1)).alias("missing"))


# ---- evidence of an event -------------------------------------------------------------------------------------------


def evidence(members: DataFrame) -> DataFrame:
    """event, n_articles, n_independent, official, cited_official, single_reliability, avg_reliability, hedge, opinion,
    injection: one row per event. members: event, origin, cited (reports of others), official, markers, reliability,
    hedges, opinions, injection."""
    direct = ~F.col("cited")
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    own = F.count_distinct(F.when(direct, F.col("origin")))
    return members.groupBy("event").agg(
        F.count("*").alias("n_articles"),
        F.when(own > 0, own).otherwise(F.count_distinct("origin")).alias("n_independent"),
        F.max("official").alias("official"),
        F.count(F.when(direct & (F.col("markers") > 0), 1)).alias("cited_official"),
        F.when(F.count(F.when(direct, 1)) == 1, F.max(F.when(direct, F.col("reliability")))).alias("single_reliability"),
        F.coalesce(F.avg(F.when(direct, F.col("reliability"))), F.lit(0.0)).alias("avg_reliability"),
        share("hedges").alias("hedge"),
        share("opinions").alias("opinion"),
        F.max(F.col("injection")).alias("injection"),
    )


def number_conflicts(numbers: DataFrame, apart: float = 0.02) -> DataFrame:
    """event, unit of numbers of one unit that different origins give more than `apart` apart.

    numbers: event, unit, v, origin. Two values conflict if and only if the extremes of two origins do; of one event and
    unit the least and greatest value of the leading origin and of the others say so.
    """
    by_origin = numbers.groupBy("event", "unit", "origin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    tops = by_origin.groupBy("event", "unit").agg(
        F.min(F.struct("lo", "origin")).alias("least"), F.max(F.struct("hi", "origin")).alias("most"), F.count("*").alias("origins")
    )
    both = by_origin.join(tops.filter("origins > 1"), ["event", "unit"])
    # the least value against the greatest of another origin, and the greatest against the least of another
    up = F.when(F.col("origin") != F.col("least.origin"), _far(F.col("least.lo"), F.col("hi"), apart))
    down = F.when(F.col("origin") != F.col("most.origin"), _far(F.col("lo"), F.col("most.hi"), apart))
    return both.filter(F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False))).select("event", "unit").distinct()


def _far(a: Column, b: Column, apart: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) > apart


def shared_values(values: DataFrame) -> DataFrame:
    """event, n (different values), n_shared (values that two or more origins give). values: event, value, origin."""
    each = values.groupBy("event", "value").agg(F.count_distinct("origin").alias("origins"))
    return each.groupBy("event").agg(F.count("*").alias("n"), F.count(F.when(F.col("origins") > 1, 1)).alias("n_shared"))


def supported_facts(facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """event, fact, support: origins that have all numbers of a fact (1 at least). facts: event, fact, values (array);
    numbers: event, origin, value. Containment by counting: an origin supports a fact if it has as many of its numbers as
    there are."""
    asked = facts.select("event", "fact", F.size(F.array_distinct("values")).alias("n"), F.explode_outer(F.array_distinct("values")).alias("value"))
    met = asked.filter("value IS NOT NULL").join(numbers.select("event", "origin", "value").distinct(), ["event", "value"])
    full = met.groupBy("event", "fact", "n", "origin").agg(F.count("*").alias("k")).filter("k = n").groupBy("event", "fact").agg(F.count("*").alias("support"))
    return facts.select("event", "fact").join(full, ["event", "fact"], "left").select("event", "fact", F.greatest(F.lit(1), F.coalesce("support", F.lit(0))).alias("support"))


def verified(found: DataFrame) -> DataFrame:
    """found (evidence, with n_numbers, shared_numbers, n_quotes, shared_quotes, n_facts, conflicts) with status and
    score. Fixed values: the rules and weights."""
    c = F.col
    primary = c("official") | (c("cited_official") >= 2)
    document = c("official")
    many = c("n_independent") >= 2
    status = (
        F.when((c("conflicts") > 0) & ~many, "rejected")
        .when((c("hedge") >= 0.6) & ~many & ~document, "rejected")
        .when((c("conflicts") > 0) | (c("hedge") >= 0.5), "needs_check")
        .when(many & (document | (c("avg_reliability") >= 0.6)), "multi_confirmed")
        .when(document, "confirmed")
        .when((F.coalesce("single_reliability", F.lit(0.0)) >= 0.9) & (c("hedge") == 0) & (c("n_facts") >= 1), "confirmed")
        .otherwise("needs_check")
    )
    quotes = F.when((c("n_quotes") == 0) | (c("shared_quotes") > 0), 1.0).otherwise(0.5)
    score = (
        0.35 * F.least(F.lit(1.0), c("n_independent") / 3)
        + 0.25 * document.cast("double")
        + 0.15 * (c("conflicts") == 0).cast("double")
        + 0.10 * (1 - c("hedge"))
        + 0.10 * c("avg_reliability")
        + 0.05 * quotes
    )
    out = found.withColumns({"status": status, "primary": F.when(document, "official").when(primary, "cited_official").otherwise("none")})
    return out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * F.when(F.col("status") == "rejected", 0.4).otherwise(1.0), 6))
