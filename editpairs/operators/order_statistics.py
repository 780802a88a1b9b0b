"""Exact percentiles of whole populations, by group, where no task sees a group.

A percentile is one or two order statistics. Each is narrowed down in passes over the rows: its interval of
values is cut into BINS bins, the rows of each bin are counted (combined before the shuffle), and the bin that
holds the wanted rank is the next interval, from its least value to its largest. When an interval holds few
rows, or one value, its values are counted and the rank is looked up among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.sources.shared import written

#: Bins of a pass; rows of an interval that are looked up one by one.
BINS, FEW = 1024, 10_000


def _long(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, column, value: a row for each finite value."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    rows = df.select(F.col(group).alias("group"), F.inline(cells))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def _within(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows in the intervals of state, once for each target; the table of targets is small or the groups are."""
    on = rows["group"].eqNullSafe(state["group"]) & (rows["column"] == state["column"])
    joined = rows.join(state, on).select(state["group"], state["column"], "target", "rank", "low", "high", "below", "value")
    return joined.filter("value >= low AND value <= high")


def _bin() -> Column:
    share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, which can't overflow
    return F.when(F.col("low") == F.col("high"), 0).otherwise(F.least(F.lit(BINS - 1), F.floor(share * BINS)))


TARGET = ["group", "column", "target", "rank"]


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state with each interval cut down to the bin that holds its rank."""
    bins = _within(rows, state).groupBy(*TARGET, "below", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*TARGET).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("below", F.col("below") + before)
    return bins.filter("below <= rank AND rank < below + n").select(*TARGET, "low", "high", "below", "n")


def exact_percentiles(df: DataFrame, group: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """group and a column for each entry (name -> column, share from 0 to 1), between two values linear.

    Nulls, NaN and infinities are left out; a group without a value has null; a null group is a group.
    """
    rows = _long(df, group, sorted({c for c, _ in wanted.values()}))
    ends = rows.groupBy("group", "column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    targets = []
    for name, (column, share) in wanted.items():
        place = (F.col("n") - 1) * F.lit(float(share))
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            targets.append(F.struct(F.lit(column).alias("of"), F.lit(f"{side}|{name}").alias("target"), rank.alias("rank"), (place - F.floor(place)).alias("part")))
    state = ends.select("*", F.inline(F.array(*targets))).filter(F.col("of") == F.col("column"))
    state = written(state.select(*TARGET, "part", "low", "high", F.lit(0).cast("long").alias("below"), "n"), "order-statistics")
    parts = state.select(*TARGET, "part")
    while state.filter((F.col("n") > FEW) & (F.col("low") < F.col("high"))).limit(1).count():
        state = written(_narrowed(rows, state), "order-statistics")
    counted = _within(rows, state).groupBy(*TARGET, "below", "value").agg(F.count(F.lit(1)).alias("n"))  # FEW values of a target at most
    upto = F.col("below") + F.sum("n").over(W.partitionBy(*TARGET).orderBy("value"))
    found = counted.withColumn("upto", upto).filter("upto - n <= rank AND rank < upto").select("group", "target", "value")
    shares = parts.select(F.col("group").alias("g"), F.col("target").alias("t"), "part")
    found = found.join(shares, F.col("group").eqNullSafe(F.col("g")) & (F.col("target") == F.col("t")))
    of = lambda side, name: F.max(F.when(F.col("target") == f"{side}|{name}", F.col("value")))
    part = lambda name: F.max(F.when(F.col("target") == f"low|{name}", F.col("part")))
    between = lambda name: of("low", name) * (1 - part(name)) + of("high", name) * part(name)
    values = found.groupBy("group").agg(*(between(name).alias(name) for name in wanted))
    groups = df.select(F.col(group)).distinct()
    return groups.join(values, F.col(group).eqNullSafe(F.col("group") if group != "group" else values["group"]), "left").select(groups[group], *wanted)
