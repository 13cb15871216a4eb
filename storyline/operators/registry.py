"""The table of sources: validation with reasons, keyed upserts, soft and hard deletes, due sources and back-off.

Changes come as a table of patches; all operators give a new table, which a caller writes as the next version.

Defined results: of several patches of one key the one of the highest seq counts, and where that is rejected no earlier
one; null fields of a patch keep what is there; a patch without a known key creates a source if it is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds and levels of sources, bounds of their fields.
KINDS = ("rss", "atom", "json", "sitemap", "html_list", "manual")
TIERS = ("top", "quality", "regional", "niche", "blog")
KEY = "^[a-z0-9][a-z0-9_-]{1,62}$"
LEAST_INTERVAL, MOST_DELAY, MOST_DOUBLINGS = 5, 360, 6
FIELDS = ("kind", "url", "tier", "reliability", "interval", "enabled")


def problems(creating: Column) -> Column:
    """Reasons why a patch (key, kind, url, tier, reliability, interval) can't be taken; empty: none."""
    rules = {
        "key": creating & ~F.coalesce(F.col("key").rlike(KEY), F.lit(False)),
        "kind": F.col("kind").isNotNull() & ~F.col("kind").isin(*KINDS),
        "tier": F.col("tier").isNotNull() & ~F.col("tier").isin(*TIERS),
        "reliability": F.col("reliability").isNotNull() & ~F.col("reliability").between(0, 1),
        "interval": F.col("interval").isNotNull() & (F.col("interval") < LEAST_INTERVAL),
        "url": (F.coalesce("kind", F.lit("rss")) != "manual") & (creating | F.col("url").isNotNull()) & ~F.coalesce(F.col("url").rlike("^https?://[^/]+"), F.lit(False)),
    }
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda r: r.isNotNull())


def latest(patches: DataFrame) -> DataFrame:
    """The last patch of each key."""
    names = [c for c in patches.columns if c != "key"]
    return patches.groupBy("key").agg(F.max_by(F.struct(*names), "seq").alias("p")).select("key", "p.*")


def upserted(sources: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources after the patches, and rejects (key, seq, reasons).

    sources: key, FIELDS, mandatory, errors, verified, next_attempt, last_fetch. patches: seq, key, FIELDS, confirmed. A new
    address makes a source unverified and forgets its errors. A mandatory source is switched off only by a confirmed patch.
    """
    known = sources.select("key", F.col("mandatory").alias("_mandatory"), F.lit(True).alias("_known"))
    judged = latest(patches).join(known, "key", "left")
    creating = F.col("_known").isNull()
    forced = F.coalesce("_mandatory", F.lit(False)) & ~F.coalesce("enabled", F.lit(True)) & ~F.coalesce("confirmed", F.lit(False))
    judged = judged.withColumn("reasons", F.concat(problems(creating), F.when(forced, F.array(F.lit("mandatory"))).otherwise(F.array().cast("array<string>"))))
    good = judged.filter(F.size("reasons") == 0).select("key", *(F.col(f).alias(f"new_{f}") for f in FIELDS))
    both = sources.join(good, "key", "full")
    defaults = {"kind": F.lit("rss"), "url": F.lit(""), "tier": F.lit("quality"), "reliability": F.lit(0.7), "interval": F.lit(15), "enabled": F.lit(True)}
    moved = F.col("new_url").isNotNull() & ~F.col("new_url").eqNullSafe(F.col("url"))
    none = F.lit(None)
    out = both.select(
        "key",
        *(F.coalesce(f"new_{f}", f, defaults[f]).alias(f) for f in FIELDS),
        F.coalesce("mandatory", F.lit(False)).alias("mandatory"),
        F.when(moved, 0).otherwise(F.coalesce("errors", F.lit(0))).alias("errors"),
        F.when(moved, False).otherwise(F.coalesce("verified", F.lit(False))).alias("verified"),
        F.when(moved, none).otherwise(F.col("next_attempt")).alias("next_attempt"),
        "last_fetch",
    )
    return out, judged.filter(F.size("reasons") > 0).select("key", "seq", "reasons")


def deleted(sources: DataFrame, keys: DataFrame, used: DataFrame) -> DataFrame:
    """The sources without those of keys (key): ones that reports name (used: key) are switched off, mandatory ones stay."""
    gone = sources.join(keys.select("key").distinct().withColumn("_gone", F.lit(True)), "key", "left").join(used.select("key").distinct().withColumn("_used", F.lit(True)), "key", "left")
    asked = F.coalesce("_gone", F.lit(False)) & ~F.col("mandatory")
    kept = gone.filter(~asked | F.coalesce("_used", F.lit(False)))
    return kept.withColumn("enabled", F.when(asked, False).otherwise(F.col("enabled"))).select(*sources.columns)


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources to fetch at `now` (seconds): enabled ones with an address whose wait and interval are over."""
    waited = F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)
    rested = F.col("last_fetch").isNull() | (now - F.col("last_fetch") >= F.col("interval") * 60)
    return sources.filter(F.col("enabled") & (F.col("kind") != "manual") & (F.coalesce("url", F.lit("")) != "") & waited & rested)


def failed(sources: DataFrame, now: Column) -> DataFrame:
    """Sources after a failed fetch at `now`: one more error, a wait that doubles up to MOST_DELAY minutes."""
    errors = F.col("errors") + 1
    delay = F.least(F.col("interval") * F.pow(F.lit(2), F.least(errors, F.lit(MOST_DOUBLINGS))), F.lit(float(MOST_DELAY)))
    return sources.withColumns({"last_fetch": now, "next_attempt": (now + delay * 60).cast("long"), "errors": errors})
