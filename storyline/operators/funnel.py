"""Funnel: rule chains with reasons, gates, balanced and diversified selection.

Selection is sequential by nature. It runs per run_id on the best `look_ahead` candidates only (a bound of the rule
itself), after a ranking window, so a group holds at most that many rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.operators.rollup import verification_status
from storyline.settings import FunnelSettings
from storyline.sources.scratch import written


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else null."""
    return F.coalesce(*(F.when(condition, name) for name, condition in rules))


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in their order; empty: passed."""
    return F.filter(F.array(*(F.when(condition, name) for name, condition in rules)), lambda r: r.isNotNull())


def stage_one(settings: FunnelSettings) -> list[tuple[str, Column]]:
    """Reasons to drop an event from the pool; columns as named."""
    return [
        ("already published", F.col("published") & ~F.col("new_stage")),
        ("too old", (F.col("phase") == "stale") | (F.col("age_last_h") > 72)),
        ("below least score", F.col("score") < settings.score_floor),
        ("advertising", F.col("ad_share") >= 0.6),
        ("recently rejected", F.col("rejected_independent").isNotNull() & (F.col("n_independent") < 2 * F.col("rejected_independent"))),
        ("blocked word", F.col("blocked")),
    ]


def stage_two(settings: FunnelSettings) -> list[tuple[str, Column]]:
    weak = F.greatest("significance", "practical_value", "discussion") < 0.25
    return [
        ("clickbait", F.col("clickbait_share") >= 0.5),
        ("advertising", F.col("ad_share") >= 0.4),
        ("rumour", (F.col("hedge_share") >= 0.6) & (F.col("n_independent") < 2) & ~F.col("official")),
        ("few facts", (F.col("n_facts") < settings.min_facts) | (F.col("fact_sufficiency") < 0.3)),
        ("weak", weak),
        ("duplicate", F.col("repeat_kind") == "duplicate"),
        ("injection", F.col("injection") & (F.col("n_independent") < 2)),
    ]


def balanced(rows: list[tuple[float, str]], n: int, target: dict[str, float], strength: float, look_ahead: int = 80) -> list[int]:
    """Places picked one by one: score * (1 + strength * (target share - share so far)), earlier ones on ties."""
    chosen: list[int] = []
    counts: Counter = Counter()
    for _ in range(min(n, len(rows))):
        best, best_value = -1, -1.0
        for i, (score, bucket) in enumerate(rows[:look_ahead]):
            if i in chosen:
                continue
            share = counts[bucket] / len(chosen) if chosen else target.get(bucket, 0.0)
            value = score * (1 + strength * (target.get(bucket, 0.0) - share))
            if value > best_value:
                best, best_value = i, value
        if best < 0:
            break
        chosen.append(best)
        counts[rows[best][1]] += 1
    return chosen


def diversified(rows: list[tuple[float, str, str]], n: int, per_category: int = 2) -> list[int]:
    """Best candidate of each theme, rarest themes first, then the best of the rest with a bound by category."""
    themes = Counter(t for _, t, _ in rows if t)
    chosen: list[int] = []
    for theme, _ in sorted(themes.items(), key=lambda x: (x[1], x[0])):
        if len(chosen) < n:
            free = [i for i, r in enumerate(rows) if r[1] == theme and i not in chosen]
            if free:
                chosen.append(max(free, key=lambda i: (rows[i][0], -i)))
    categories = Counter(rows[i][2] for i in chosen)
    for i, (_, _, category) in sorted(enumerate(rows), key=lambda x: (-x[1][0], x[0])):
        if len(chosen) >= n:
            break
        if i not in chosen and categories[category] < per_category:
            chosen.append(i)
            categories[category] += 1
    return chosen


def select_balanced(candidates: DataFrame, n: int, settings: FunnelSettings) -> DataFrame:
    """run_id, event_id, position of the picked candidates. Columns run_id, event_id, score, bucket (KZ or WORLD)."""
    target = {"KZ": settings.geo_target, "WORLD": 1 - settings.geo_target}
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "event_id"))
    best = candidates.select("run_id", "event_id", "score", "bucket").withColumn("_rank", rank).filter(F.col("_rank") <= settings.look_ahead)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank").reset_index(drop=True)
        places = balanced(list(zip(pdf.score, pdf.bucket)), n, target, settings.geo_strength, settings.look_ahead)
        return pd.DataFrame({"run_id": pdf.run_id[places].to_numpy(), "event_id": pdf.event_id[places].to_numpy(), "position": range(1, len(places) + 1)})

    types = dict(candidates.dtypes)
    return best.groupBy("run_id").applyInPandas(pick, f"run_id {types['run_id']}, event_id {types['event_id']}, position int")


def pick_final(candidates: DataFrame, n: int, look_ahead: int = 80) -> DataFrame:
    """run_id, event_id, position by diversified(). Columns run_id, event_id, score, theme, category."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "event_id"))
    best = candidates.select("run_id", "event_id", "score", "theme", "category").withColumn("_rank", rank).filter(F.col("_rank") <= look_ahead)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank").reset_index(drop=True)
        places = diversified(list(zip(pdf.score, pdf.theme, pdf.category)), n)
        return pd.DataFrame({"run_id": pdf.run_id[places].to_numpy(), "event_id": pdf.event_id[places].to_numpy(), "position": range(1, len(places) + 1)})

    types = dict(candidates.dtypes)
    return best.groupBy("run_id").applyInPandas(pick, f"run_id {types['run_id']}, event_id {types['event_id']}, position int")


#: What a verification leaves of a score.
VERIFIED = {"multi_confirmed": 1.0, "confirmed": 0.97, "needs_check": 0.8, "rejected": 0.0}


def run(pool: DataFrame, settings: FunnelSettings) -> DataFrame:
    """The four stages as a decision log: run_id, event_id, stage, decision, position (of kept ones), reason.

    pool: run_id, event_id, score, bucket, theme, category and the columns of the stages' rules and of the
    verification. Each stage reads what the one before kept: at most stages[i] rows of a run, written once.
    """
    first, second, third, final = settings.stages
    log = []

    def note(df: DataFrame, stage: str, decision: str, reason: Column, position: Column | None = None) -> None:
        place = position if position is not None else F.lit(None).cast("int")
        log.append(df.select("run_id", "event_id", F.lit(stage).alias("stage"), F.lit(decision).alias("decision"), place.alias("position"), reason.alias("reason")))

    def stage(df: DataFrame, name: str, rules: list[tuple[str, Column]], n: int, too_low: str) -> DataFrame:
        judged = written(df.withColumn("why", first_reason(rules) if rules else F.lit(None).cast("string")), f"funnel-{name}")
        note(judged.filter("why IS NOT NULL"), name, "dropped", F.col("why"))
        good = judged.filter("why IS NULL").drop("why")
        kept = written(select_balanced(good, n, settings), f"funnel-{name}-kept")
        note(kept, name, "kept", F.lit(None).cast("string"), F.col("position"))
        note(good.join(kept, ["run_id", "event_id"], "left_anti"), name, "dropped", F.lit(too_low))
        return good.join(kept.select("run_id", "event_id"), ["run_id", "event_id"])

    s1 = stage(pool, "s50", stage_one(settings), first, "not among the best")
    s2 = stage(s1, "s15", stage_two(settings), second, "not among the strongest")
    status = verification_status(s2.drop("score")).select("run_id", "event_id", "status")
    checked = s2.join(status, ["run_id", "event_id"])
    nth = F.row_number().over(Window.partitionBy("run_id", "status").orderBy(F.desc("score"), "event_id"))
    factor = F.create_map(*(F.lit(x) for kv in VERIFIED.items() for x in kv))
    checked = checked.withColumn("nth", nth).withColumn("score", F.round(F.col("score") * F.element_at(factor, F.col("status")), 2))
    rules = [("rejected by verification", F.col("status") == "rejected"), ("needs a check", (F.col("status") == "needs_check") & (F.col("nth") > settings.max_unverified))]
    s3 = written(stage(checked, "s10", rules, third, "not among the verified"), "funnel-s10-rows")
    chosen = written(pick_final(s3.filter(F.col("score") >= settings.score_floor), final), "funnel-s5")
    note(chosen, "s5", "kept", F.lit(None).cast("string"), F.col("position"))
    note(s3.join(chosen, ["run_id", "event_id"], "left_anti"), "s5", "dropped", F.lit("kept in reserve"))
    return reduce(DataFrame.unionByName, log)
