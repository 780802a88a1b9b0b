"""Seeded exact samples and orders.

The order is that of an MD5 of seed and key, so a sample depends on neither partitions nor row order. A
stratum may hold most rows: within 256 slices of a stratum the first rows are cut first, in parallel, and
only those meet in the stratum's own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.functions.hashing import seeded_key

SLICES = 256


def stratified(df: DataFrame, stratum: str, key: str, targets: DataFrame, seed: int) -> DataFrame:
    """Per stratum `target` rows, or all where target is null or more; strata not in targets give none.

    targets: (stratum, target), a configuration table. Spark broadcasts it if it is small.
    """
    targets = targets.select(F.col(stratum).alias("_stratum"), F.col("target").alias("_given"))
    rows = df.join(targets, F.col(stratum) == F.col("_stratum")).drop("_stratum")
    return up_to(rows, stratum, key, F.col("_given"), seed).select(*df.columns)


def up_to(df: DataFrame, stratum: str, key: str, target: Column, seed: int) -> DataFrame:
    """Per stratum `target` rows, one number for all of a stratum's rows, or all where it is null or more."""
    rows = df.withColumn("_target", target).filter("_target IS NULL OR _target > 0").withColumn("_order", seeded_key(seed, key))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(SLICES)))
    # one scan: strata that are taken whole stay in slices, the others meet after the first cut
    for by in (F.col("_slice"), F.when(F.col("_target").isNull(), F.col("_slice"))):
        rank = F.row_number().over(W.partitionBy(stratum, by).orderBy("_order", key))
        rows = rows.withColumn("_rank", rank).filter("_target IS NULL OR _rank <= _target").drop("_rank")
    return rows.select(*df.columns)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows: a top-k, not a sort of all."""
    return df.orderBy(*order).limit(n)


#: Rows that a top-k holds in every task; larger samples are cut bucket by bucket.
TOP = 100_000


def capped(df: DataFrame, most: int, key: str, seed: int) -> DataFrame:
    """All rows, or `most` at random if there are more."""
    rows = df.withColumn("_order", seeded_key(seed, key))
    if most <= TOP:
        return rows.orderBy("_order", key).limit(most).drop("_order")
    rows = rows.withColumn("_bucket", F.substring("_order", 1, 4))  # 65,536 at most, of about one size
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).filter(F.col("_before") < most)
    rows = rows.join(F.broadcast(sizes), "_bucket")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_order", key))
    whole, edge = rows.filter(F.col("_before") + F.col("_n") <= most), rows.filter(F.col("_before") + F.col("_n") > most)
    edge = edge.withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= most)
    return whole.select(*df.columns).union(edge.select(*df.columns))


def random_subset(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows at random; more than there are is an error."""
    if (rows := df.count()) < n:
        raise ValueError(f"{n} rows asked for, there are {rows}")
    return capped(df, n, key, seed)


def with_shuffle_key(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return df.withColumn("shuffle_key", seeded_key(seed, *key))


def shuffled(df: DataFrame, seed: int, *key: str, partitions: int | None = None) -> DataFrame:
    """Rows in a seeded random order over all partitions: one range exchange, to be written as it is."""
    df = with_shuffle_key(df, seed, *key)
    spread = df.repartitionByRange(partitions, "shuffle_key") if partitions else df.repartitionByRange("shuffle_key")
    return spread.sortWithinPartitions("shuffle_key")


def first_of_each(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the first in order; partial aggregation cuts copies before the shuffle."""
    values = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*values), F.struct(*order)) if values else F.count(F.lit(1))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))


def dedup_turns(pairs: DataFrame, *order: str) -> DataFrame:
    """The first source without repeated (img_id, turn_index)."""
    rows = pairs.filter(F.col("face_id").isNull()) if "face_id" in pairs.columns else pairs
    return first_of_each(rows, ["img_id", "turn_index"], *order)


def by_number(df: DataFrame, key: str) -> DataFrame:
    """Order of ids that are numbers in text."""
    return df.orderBy(F.try_to_number(F.col(key), F.lit("999999999999999999")).cast("long"), key)
