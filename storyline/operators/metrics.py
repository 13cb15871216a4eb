"""Metrics of publications: primary value, baselines, forecasts, effects of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def primary_value(views: Column, reach: Column, likes: Column, comments: Column, shares: Column, saves: Column) -> Column:
    """Views, else reach, else weighted reactions; zero counts as missing."""
    zero = F.lit(0)
    weighted = F.coalesce(likes, zero) + 2 * F.coalesce(comments, zero) + 3 * F.coalesce(shares, zero) + F.coalesce(saves, zero)
    return F.coalesce(F.nullif(views, zero), F.nullif(reach, zero), F.nullif(weighted, zero))


def engagement_rate(views: Column, reach: Column, likes: Column, comments: Column, shares: Column, saves: Column) -> Column:
    """Reactions by reach (or views), null without a base."""
    zero = F.lit(0)
    total = F.coalesce(likes, zero) + F.coalesce(comments, zero) + F.coalesce(shares, zero) + F.coalesce(saves, zero)
    return F.round(F.try_divide(total, F.coalesce(F.nullif(reach, zero), F.nullif(views, zero))), 4)


def trailing_median(posts: DataFrame, keys: list[str], order: list[str], value: str, n: int = 30, least: int = 5) -> DataFrame:
    """Adds baseline: median of the n posts of the keys before, null with fewer than `least`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    before = F.filter(F.collect_list(value).over(w), lambda v: v.isNotNull())
    ordered = F.sort_array(F.col("_before"))
    size = F.size("_before")
    middle = (F.get(ordered, F.floor((size - 1) / 2).cast("int")) + F.get(ordered, F.floor(size / 2).cast("int"))) / 2
    out = posts.withColumn("_before", before).withColumn("n_baseline", F.size("_before"))
    return out.withColumn("baseline", F.when(F.col("n_baseline") >= least, middle)).drop("_before")


def calibration(records: DataFrame, interest: str, log_ratio: str, prior: float = 0.5, least: int = 6) -> DataFrame:
    """OLS of log ratio on (interest - 0.5) * 2: slope shrunk to the prior by n / (n + 6), intercept by the raw slope."""
    x = (F.col(interest) - 0.5) * 2
    sums = records.select(x.alias("x"), F.col(log_ratio).alias("y")).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("raw"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"))
    usable = (F.col("n") >= least) & (F.col("vx") >= 1e-6)
    w = F.col("n") / (F.col("n") + 6)
    slope = F.when(usable, w * F.col("raw") + (1 - w) * prior).otherwise(prior)
    return sums.select("n", slope.alias("slope"), F.when(usable, F.col("my") - F.col("raw") * F.col("mx")).otherwise(0.0).alias("intercept"))


def accuracy(records: DataFrame, predicted: str, actual: str) -> DataFrame:
    """n, mean absolute error, bias and correlation (null where a side does not vary)."""
    error = F.col(predicted) - F.col(actual)
    sums = records.agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.corr(predicted, actual).alias("r"), F.stddev_pop(predicted).alias("sp"), F.stddev_pop(actual).alias("sa"))
    return sums.select("n", "mae", "bias", F.when((F.col("n") >= 4) & (F.col("sp") > 1e-6) & (F.col("sa") > 1e-6), F.col("r")).alias("corr"))


def shrunk_effect(df: DataFrame, dimension: str, value: str, shrink: float) -> DataFrame:
    """Mean of a value less the overall mean, per key of a dimension, times n / (n + shrink)."""
    overall = df.agg(F.avg(value).alias("_all"))
    groups = df.groupBy(dimension).agg(F.count("*").alias("n"), F.avg(value).alias("_mean")).crossJoin(F.broadcast(overall))  # one row
    return groups.select(dimension, "n", ((F.col("_mean") - F.col("_all")) * F.col("n") / (F.col("n") + shrink)).alias("effect"))


def dimension_effects(df: DataFrame, dimensions: list[str], value: str, least: int = 4, effect: float = 0.15, sigmas: float = 1.5, top: int = 10) -> DataFrame:
    """Keys of the dimensions whose mean differs from the overall mean by `effect` and over `sigmas` standard errors.

    One pass: every row is unpivoted to its dimensions and summed up per (dimension, key).
    """
    long = df.select(value, F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions))).alias("d")).select("d.*", value)
    overall = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    groups = long.filter(F.col("key").isNotNull()).groupBy("dimension", "key").agg(F.count("*").alias("n"), F.avg(value).alias("_own")).crossJoin(F.broadcast(overall))  # one row
    groups = groups.withColumn("effect", F.col("_own") - F.col("_mean"))
    strong = (F.col("n") >= least) & (F.abs("effect") >= effect) & (F.abs("effect") > sigmas * F.col("_sd") / F.sqrt("n"))
    return groups.filter(strong).select("dimension", "key", "n", "effect", F.exp("effect").alias("ratio")).orderBy(F.desc(F.abs("effect")), "dimension", "key").limit(top)


def effects_of_all(df: DataFrame, dimensions: list[str], several: list[str], value: str, least: int = 4, effect: float = 0.15, sigmas: float = 1.5) -> DataFrame:
    """dimension, key, n, effect, confidence: keys whose mean differs from the overall mean; dimensions with one key a row,
    and ones with several (arrays). Rows go to their keys in one pass and are summed before they are shuffled."""
    one = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions))
    many = [_keyed(d) for d in several]
    long = df.select(value, F.explode(F.concat(one, *many)).alias("d")).select("d.*", value).filter("key IS NOT NULL")
    overall = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    groups = long.groupBy("dimension", "key").agg(F.count("*").alias("n"), F.avg(value).alias("_own")).crossJoin(F.broadcast(overall))  # one row
    size, error = F.abs(F.col("_own") - F.col("_mean")), F.col("_sd") / F.sqrt("n")
    strong = groups.filter((F.col("n") >= least) & (size >= effect) & (size > sigmas * error))
    confidence = F.when((F.col("n") >= 12) & (size > 3 * error), "high").when(F.col("n") >= 6, "medium").otherwise("low")
    return strong.select("dimension", "key", "n", (F.col("_own") - F.col("_mean")).alias("effect"), confidence.alias("confidence"))


def _keyed(dimension: str) -> Column:
    keys = F.array_distinct(F.coalesce(dimension, F.array().cast("array<string>")))
    return F.transform(keys, lambda x: F.struct(F.lit(dimension).alias("dimension"), x.cast("string").alias("key")))
