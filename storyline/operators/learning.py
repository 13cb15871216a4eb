"""Preferences from signals: decayed Beta counts, posteriors, affinity, sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.settings import LearningSettings


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def posterior(alpha: Column, beta: Column) -> Column:
    return (alpha + 1) / (alpha + beta + 2)


def beta_profile(signals: DataFrame, now: Column, settings: LearningSettings) -> DataFrame:
    """alpha, beta, n and mean per (dimension, key) at `now`.

    Decay between signals and again at reading multiplies to one power of each signal's age, so the fold over the log
    is a plain sum. Columns dimension, key, d_alpha, d_beta, sec.
    """
    w = decay((now - F.col("sec")) / 86400.0, settings.half_life_days)
    sums = signals.groupBy("dimension", "key").agg(F.sum(F.col("d_alpha") * w).alias("alpha"), F.sum(F.col("d_beta") * w).alias("beta"), F.count("*").alias("n"))
    return sums.withColumn("mean", posterior(F.col("alpha"), F.col("beta")))


def affinity(items: DataFrame, profile: DataFrame, weights: dict[str, float], settings: LearningSettings) -> DataFrame:
    """item_id, affinity: weighted posterior means of an item's features, drawn to 0.5 by min(1, n / 15).

    items: item_id, dimension, key. Features that the profile doesn't know count with 0.5 and no signals.
    """
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("dimension")]
    known = items.join(profile.select("dimension", "key", "mean", "n"), ["dimension", "key"], "left")
    known = known.select("item_id", weight.alias("w"), F.coalesce("mean", F.lit(0.5)).alias("m"), F.coalesce("n", F.lit(0)).alias("n")).filter("w IS NOT NULL")
    sums = known.groupBy("item_id").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("raw"), F.sum("n").alias("n"))
    trust = F.least(F.lit(1.0), F.col("n") / settings.shrink_n)
    return sums.select("item_id", (0.5 + trust * (F.col("raw") - 0.5)).alias("affinity"), "n")


def performance_stats(df: DataFrame, dimensions: list[str], value: str, confidence: Column) -> DataFrame:
    """n, sum and sum of squares of value * confidence per (dimension, key): what means and variances need."""
    x = F.col(value) * confidence
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions))
    return df.select(F.explode(pairs).alias("d"), x.alias("x")).groupBy("d.dimension", "d.key").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("total_sq"))


def historical(stats: DataFrame, settings: LearningSettings) -> Column:
    """0.5 + 0.5 tanh(2x) of the shrunk mean, as an aggregate over the rows of an item's features."""
    mean = F.col("total") / F.col("n") * F.col("n") / (F.col("n") + settings.history_shrink)
    return 0.5 + 0.5 * F.tanh(2 * F.sum(F.col("n") * mean) / F.sum("n"))
