"""Oversampling, unions, splits and the statistics that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpairs.functions.text import action, mentions_person


def normalize_split(df: DataFrame) -> DataFrame:
    """`dev` becomes `validation`; where a `validation` exists, `dev` goes."""
    has = df.filter(F.col("split") == "validation").limit(1).count() > 0
    rows = df.filter(F.coalesce(F.col("split") != "dev", F.lit(True))) if has else df
    return rows.withColumn("split", F.when(F.col("split") == "dev", "validation").otherwise(F.col("split")))


def oversample(df: DataFrame, condition: Column, repeat: int) -> DataFrame:
    """Rows of the condition `repeat` times in all, numbered by `copy` from 1: no union, one scan."""
    if repeat < 1:
        raise ValueError("repeat must be 1 or more")
    times = F.when(F.coalesce(condition, F.lit(False)), repeat).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def concatenate(*sources: DataFrame) -> DataFrame:
    """Rows of all, missing columns null."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def fraction(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def oversample_stats(df: DataFrame, prompt: str, repeat: int, has_strip: Column | None = None, validation: DataFrame | None = None) -> DataFrame:
    """Counts of a mix of df's rows, those without a strip if has_strip is given; with dropped_corner_strips and validation, 0 if not given."""
    strip = F.lit(False) if has_strip is None else F.coalesce(has_strip, F.lit(False))
    person = mentions_person(F.col(prompt))
    counts = df.agg(F.count_if(strip).alias("dropped_corner_strips"), F.count_if(~strip).alias("original"), F.count_if(~strip & person).alias("person_examples"))
    held = (df.filter("false") if validation is None else validation).agg(F.count(F.lit(1)).alias("validation"))
    return counts.crossJoin(held).select(  # one row each
        "dropped_corner_strips", "validation", "original", "person_examples", fraction(F.col("person_examples"), F.col("original")).alias("person_fraction"),
        F.lit(repeat).alias("person_repeat"), (F.col("original") + (repeat - 1) * F.col("person_examples")).alias("mixed"),
    )


def split_stats(df: DataFrame, *extra: Column) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("valid"), *extra)


def drop_reason_stats(reasoned: DataFrame) -> DataFrame:
    """Counts of each reason, of dropped rows, and mean scores over all rows."""
    has = lambda r: F.count_if(F.array_contains("drop_reasons", r))
    out = reasoned.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("drop_reasons") > 0).alias("dropped"), has("low_change").alias("low_change"),
        has("low_adherence").alias("low_adherence"), has("generic_prompt").alias("generic_prompt"),
        F.coalesce(F.avg("lpips"), F.lit(0.0)).alias("mean_lpips"), F.coalesce(F.avg("clip"), F.lit(0.0)).alias("mean_clip"),
    )
    return out.withColumn("dropped_fraction", fraction(F.col("dropped"), F.col("total")))


def provenance_counts(mix: DataFrame) -> DataFrame:
    """Rows by source and attribute."""
    source = F.when(F.col("face_id").isNull(), "first").otherwise("second")
    return mix.groupBy(source.alias("provenance"), "attribute").agg(F.count(F.lit(1)).alias("n"))


def action_person_cube(df: DataFrame, prompt: str) -> DataFrame:
    """Rows by action and person word with all subtotals, and shares of all rows and of the same person column."""
    rows = df.select(action(F.col(prompt)).alias("action"), mentions_person(F.col(prompt)).alias("is_person"))
    cube = rows.cube("action", "is_person").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    whole = rows.agg(F.count(F.lit(1)).alias("_all"), F.count_if("is_person").alias("_persons"))  # one row
    out = cube.join(F.broadcast(whole))
    return out.select("action", "is_person", "level", "n", fraction(100.0 * F.col("n"), F.col("_all")).alias("pct_all"),
                      F.when(F.col("is_person"), fraction(100.0 * F.col("n"), F.col("_persons"))).alias("pct_persons"))


def attribute_availability(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """What there is of each attribute, what is wanted (null: all) and what can be taken."""
    have = pairs.groupBy("attribute").agg(F.count(F.lit(1)).alias("available"))
    out = have.join(targets, "attribute", "full").withColumn("available", F.coalesce("available", F.lit(0)))
    listed = targets.select("attribute").withColumn("_listed", F.lit(True))
    out = out.join(F.broadcast(listed), "attribute", "left")
    taken = F.when(F.col("_listed").isNull(), 0).otherwise(F.least("available", F.coalesce("target", "available")))
    return out.select("attribute", "available", "target", taken.alias("taken"))


#: Buckets of rows whose fingerprints are held against each other.
BUCKETS = 1 << 14


def fingerprints(df: DataFrame) -> DataFrame:
    """_bucket, n, total, folded: of the rows of each bucket, whatever their order, their number and two sums of 64-bit hashes."""
    one, two = F.xxhash64(*df.columns), F.xxhash64(*df.columns, F.lit("second"))
    rows = df.select(F.pmod(one, F.lit(BUCKETS)).cast("int").alias("_bucket"), one.alias("_one"), two.alias("_two"))
    return rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_one").cast("decimal(38,0)")).alias("total"), F.bit_xor("_two").alias("folded"), F.sum(F.col("_two").cast("decimal(38,0)")).alias("second"))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """_bucket of those whose fingerprints differ: BUCKETS rows at most, whatever the tables' size. Equal tables have none, and shuffle no row."""
    a, b = fingerprints(a), fingerprints(b)
    both = a.join(b.select(F.col("_bucket").alias("_other"), F.struct("n", "total", "folded", "second").alias("_theirs")), F.col("_bucket") == F.col("_other"), "full")
    same = F.struct("n", "total", "folded", "second").eqNullSafe(F.col("_theirs"))
    return both.filter(F.col("_bucket").isNull() | F.col("_other").isNull() | ~same).select(F.coalesce("_bucket", "_other").alias("_bucket"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with copies: none if they are equal.

    Only rows of buckets whose fingerprints differ are shuffled and compared; the others are equal but for a
    chance of 2^-128 a bucket. Columns are matched by name.
    """
    b = b.select(*a.columns)
    buckets = F.broadcast(differing_buckets(a, b).withColumnRenamed("_bucket", "_differs"))  # BUCKETS rows at most
    bucket = F.pmod(F.xxhash64(*a.columns), F.lit(BUCKETS)).cast("int")
    a, b = (x.withColumn("_b", bucket).join(buckets, F.col("_b") == F.col("_differs"), "left_semi").drop("_b") for x in (a, b))
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def equal_tables(a: DataFrame, b: DataFrame) -> bool:
    """Do two tables hold the same rows, with copies, whatever their order?"""
    return set(a.columns) == set(b.columns) and differing_buckets(a, b.select(*a.columns)).isEmpty()
