"""Publications: allowed moves, versions, retries, outcomes, slots, health of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moves that a publication may make.
MOVES = {
    "draft": ("awaiting_approval", "needs_review", "scheduled", "cancelled"),
    "awaiting_approval": ("scheduled", "needs_review", "cancelled", "draft"),
    "needs_review": ("awaiting_approval", "cancelled", "draft"),
    "scheduled": ("publishing", "awaiting_approval", "needs_review", "cancelled"),
    "publishing": ("published", "error", "scheduled", "needs_review", "awaiting_approval", "cancelled"),
    "error": ("scheduled", "needs_review", "cancelled", "published", "awaiting_approval"),
    "published": (),
    "cancelled": (),
}


def allowed(before: Column, after: Column, moves: dict[str, tuple]) -> Column:
    return reduce(lambda c, m: c | ((before == m[0]) & after.isin(*m[1])), moves.items(), F.lit(False))


def illegal_moves(log: DataFrame, moves: dict[str, tuple]) -> DataFrame:
    """Rows of a state log (key, sec, id, state) whose move from the key's row before is not allowed."""
    before = F.lag("state").over(Window.partitionBy("key").orderBy("sec", "id"))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & ~allowed(F.col("before"), F.col("state"), moves))


def versions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds version (from 1), is_current and valid_to (the next version's first order column, else null)."""
    by = Window.partitionBy(key).orderBy(*order)
    following = F.lead(order[0]).over(by)
    return rows.withColumns({"version": F.row_number().over(by), "valid_to": following}).withColumn("is_current", F.col("valid_to").isNull())


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def http_outcome(status: Column) -> Column:
    """rate_limited, permanent, unknown or ok by HTTP status."""
    return F.when(status == 429, "rate_limited").when((status == 408) | (status >= 500), "unknown").when(status >= 400, "permanent").otherwise("ok")


def source_status(enabled: Column, kind: Column, errors: Column, tier: Column, silent_h: Column, stale_h: float = 12.0) -> Column:
    """Health of a source: primary ones may be silent four times as long."""
    limit = F.when(tier == "primary", 4 * stale_h).otherwise(stale_h)
    return F.when(~enabled, "disabled").when(kind == "manual", "manual").when(errors >= 3, "failing").when(silent_h.isNull(), "never_polled").when(silent_h > limit, "stale").otherwise("ok")


def worst(statuses: DataFrame, ranks: list[str]) -> DataFrame:
    """Overall status: the worst of a column status, ranks from good to bad."""
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(ranks) for x in (r, i)))
    return statuses.agg(F.max_by("status", rank[F.col("status")]).alias("status"), F.count("*").alias("n"))


def free_slots(wanted: DataFrame, taken: DataFrame, gap_s: int) -> DataFrame:
    """Wanted slots (key, sec, rank) at least gap_s from all taken ones (key, sec); the best per key.

    Both sides meet on blocks of gap_s seconds and their neighbours, so the join is one on equal keys.
    """
    blocks = wanted.withColumn("_block", F.explode(F.array(*(F.floor(F.col("sec") / gap_s) + d for d in (-1, 0, 1)))))
    busy = taken.select("key", F.floor(F.col("sec") / gap_s).alias("_block"), F.col("sec").alias("_taken"))
    hit = blocks.join(busy, ["key", "_block"]).filter(F.abs(F.col("sec") - F.col("_taken")) < gap_s).select("key", "sec").distinct()
    open_ = wanted.join(hit, ["key", "sec"], "left_anti")
    return open_.groupBy("key").agg(F.min_by("sec", F.struct("rank", "sec")).alias("sec"))


def scope_match(items: DataFrame, switches: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """items with the smallest id of an active switch whose scope fits them (scope_type, scope_value; `system` fits all).

    Each item asks for its values of all scopes: an equi-join, no theta join.
    """
    asks = F.array(F.struct(F.lit("system").alias("scope_type"), F.lit("").alias("scope_value")), *(F.struct(F.lit(k).alias("scope_type"), v.cast("string").alias("scope_value")) for k, v in scopes.items()))
    asked = items.select("item_id", F.inline(asks))
    active = switches.filter("released_at IS NULL").select("scope_type", F.coalesce("scope_value", F.lit("")).alias("scope_value"), F.col("id").alias("switch_id"))
    hit = asked.join(active, ["scope_type", "scope_value"]).groupBy("item_id").agg(F.min("switch_id").alias("switch_id"))
    return items.join(hit, "item_id", "left")
