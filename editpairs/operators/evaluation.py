"""Checkpoint evaluation: grids, comparison with a baseline, best and worst examples, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(prompts: DataFrame, checkpoints: DataFrame, base_seed: int, variants: int) -> DataFrame:
    """Every prompt with every seed and checkpoint; prompts and checkpoints are lists by definition, which Spark broadcasts if they are small."""
    seeds = prompts.withColumn("seed", F.explode(F.sequence(F.lit(base_seed), F.lit(base_seed + variants - 1))))
    return seeds.crossJoin(checkpoints)


def versus(candidate: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Metrics of the candidate and the baseline side by side, by example."""
    name = lambda df, s: df.select(key, *(F.col(c).alias(f"{c}_{s}") for c in ("lpips", "clip")))
    return name(candidate, "trained").join(name(baseline, "base"), key)


def report(details: DataFrame, *by: str) -> DataFrame:
    """Means and improvements; positive is better for both."""
    means = {f"{m}_{s}": F.avg(f"{m}_{s}") for m in ("lpips", "clip") for s in ("trained", "base")}
    out = details.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in means.items()))
    return out.withColumns({"lpips_improvement": F.col("lpips_base") - F.col("lpips_trained"), "clip_improvement": F.col("clip_trained") - F.col("clip_base")})


def extremes(details: DataFrame, key: str, k: int) -> DataFrame:
    """The k strongest and the k weakest examples by improvement."""
    gain = (F.col("lpips_base") - F.col("lpips_trained")).alias("gain")
    rows = details.select(key, gain).filter("gain IS NOT NULL")
    best = rows.orderBy(F.desc("gain"), key).limit(k).withColumn("side", F.lit("strongest"))
    return best.union(rows.orderBy("gain", key).limit(k).withColumn("side", F.lit("weakest")))


def passes(reference_lpips: Column, reference_clip: Column, least_clip: float = 0.25, slack: float = 0.005) -> Column:
    return F.coalesce((F.col("lpips") < reference_lpips) & (F.col("clip") >= least_clip) & (F.col("clip") >= reference_clip - slack), F.lit(False))


def select_checkpoint(reports: DataFrame, reference: str, least_clip: float = 0.25, slack: float = 0.005) -> DataFrame:
    """Every checkpoint with `passes` and `chosen`: the best passing one by lpips, or the reference if none passes.

    reports: checkpoint, lpips, clip; a row a checkpoint.
    """
    base = reports.filter(F.col("checkpoint") == reference).select(F.col("lpips").alias("_lpips"), F.col("clip").alias("_clip"))
    rows = reports.join(F.broadcast(base), how="left").withColumn("passes", passes(F.col("_lpips"), F.col("_clip"), least_clip, slack) & (F.col("checkpoint") != reference))
    best = rows.filter("passes").agg(F.min_by("checkpoint", F.struct("lpips", "checkpoint")).alias("_best"))  # one row
    rows = rows.join(F.broadcast(best), how="left")
    return rows.select("checkpoint", "lpips", "clip", "passes", (F.col("checkpoint") == F.coalesce("_best", F.lit(reference))).alias("chosen"))
