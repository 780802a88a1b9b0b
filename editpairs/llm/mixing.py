"""Mixing sources to target weights by hierarchical budgets (operator 9).

A tree of domain, language and source carries weights at each level. The budget is divided top down, level by
level, as joins and windows over the tree's tables: at a node, children that can't use their share get what
they have (all their tokens, up to the most epochs), and the shortage goes to their siblings by weight; only
what a whole family can't use reaches its ancestors. A leaf's budget is a number of whole epochs and a
token-prefix of one more, each epoch in an order of its own, seeded by hash. Tokens are a tokenizer's ids.

A leaf may hold a third of all rows, so its prefix is found in two steps: tokens are summed by 4096 ranges
of the order's hash, and only the rows of the one range where the budget ends are put in order.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editpairs.llm.common import written
from editpairs.llm.near import row_key
from editpairs.llm.tokens import encoder, tokenizer_path

LEVELS = ["domain", "language", "source_name"]
RANGE_BITS = 12
MAX_EPOCHS = 3
SEED = 20240229

#: Target weights, whole numbers; a name that isn't listed weighs 1. A domain is made of the sources whose numbers leave its remainder by 4.
DOMAINS = {"web": 4, "books": 3, "code": 2, "forum": 1}
LANGUAGES = {"en": 5, "de": 2, "fr": 2, "es": 1}
WEIGHTS = {"domain": DOMAINS, "language": LANGUAGES, "source_name": {}}


def with_tree(docs: DataFrame, tokenizer: str, spaces: str = "drop") -> DataFrame:
    """doc (all columns of docs), the tree's levels (null counts as `none`), key (a hash of id and text) and n_tokens of every row of docs (doc_id, text, lang, source)."""
    number = F.coalesce(F.try_element_at(F.regexp_extract_all("source", F.lit(r"(\d{1,9})$"), F.lit(1)), F.lit(1)).cast("long"), F.lit(0))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int"))
    rows = docs.select(F.struct("*").alias("doc"), domain.alias("domain"), F.coalesce("lang", F.lit("none")).alias("language"), F.coalesce("source", F.lit("none")).alias("source_name"), row_key("doc_id", "text").alias("key"))

    def count(batches):
        for batch in batches:
            text = pa.compute.fill_null(batch.column(0).field("text"), "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoder(tokenizer, spaces).counts(text))], names=[*batch.schema.names, "n_tokens"])

    return rows.mapInArrow(count, T.StructType([*rows.schema, T.StructField("n_tokens", T.LongType())]))


WHOLE = "decimal(19,0)"


def shares(children: DataFrame, parent: list[str], weights: dict[str, int]) -> DataFrame:
    """children with `budget`: its parent's `given`, divided by weight under the children's caps; what exceeds all caps is lost.

    children: parent's columns, name, cap, given. In order of cap by weight, those whose cap is at most their
    share of what is left are full, and the others share the rest; each share is rounded down.
    """
    weight = F.lit(1)
    if weights:
        weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("name")), F.lit(1))
    by = W.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("weight"), "name")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast(WHOLE)
    out = children.withColumn("weight", weight.cast(WHOLE))
    out = out.withColumns({"before": total("cap", order.rowsBetween(W.unboundedPreceding, -1)), "open": total("weight", order.rowsBetween(W.currentRow, W.unboundedFollowing))})
    out = out.withColumn("full", F.col("cap") * F.col("open") <= (F.col("given") - F.col("before")) * F.col("weight"))
    left = F.col("given") - total(F.when(F.col("full"), F.col("cap")), by)
    out = out.withColumns({"left": left.cast(WHOLE), "wanting": total(F.when(~F.col("full"), F.col("weight")), by)})
    budget = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * weight) div wanting")).cast(WHOLE)
    return out.select(*children.columns, budget.alias("budget"))


def budgets(leaves: DataFrame, total: int | None, weights: dict[str, dict], epochs: int) -> DataFrame:
    """LEVELS, n and budget (tokens) of each leaf; leaves: LEVELS and n, the tokens it has; total: None for as many as they have."""
    caps = leaves.withColumn("cap", (F.col("n") * epochs).cast(WHOLE))
    given = None
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").cast(WHOLE).alias("cap"), F.sum("n").alias("n")).withColumn("name", F.col(level))
        if given is None:
            all_of = F.sum("n").over(W.partitionBy()) if total is None else F.lit(total)  # over the domains
            nodes = nodes.withColumn("given", all_of.cast(WHOLE))
        else:
            nodes = nodes.join(given, path[:-1])
        given = shares(nodes, path[:-1], weights.get(level, {})).select(*path, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), LEVELS).withColumn("budget", F.col("budget").cast("long"))


def order_key(epoch, seed: int):
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("key"))


def mix(docs: DataFrame, total: int | None = None, weights: dict[str, dict] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of docs (of with_tree(), written) and epoch (from 0), as often as the budgets say; total: tokens, or None for as many as docs has.

    In each epoch's order (hash of seed, epoch and row, then id, then n_tokens) a prefix of rows whose tokens
    sum up to no more than the leaf's budget is taken. Rows without a token are never taken; rows that repeat
    id and text lie next to each other in the order and count each; an empty table gives no row.
    """
    columns = docs.columns
    docs = docs.filter("n_tokens > 0")
    leaves = written(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")), "leaves")
    plan = budgets(leaves, total, weights, epochs)
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.expr("budget div n").alias("_whole"), F.expr("budget % n").alias("_rest"))
    at_leaf = functools.reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in LEVELS])
    # a written table of known size: Spark broadcasts it if it is small, and else splits a hot leaf's partitions
    rows = docs.join(written(plan, "budgets"), at_leaf).drop(*(f"_{c}" for c in LEVELS))
    rows = rows.withColumn("_key", order_key(F.col("_whole"), seed)).withColumn("_range", F.shiftright("_key", 64 - RANGE_BITS))

    sums = rows.groupBy(*LEVELS, "_range", "_rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("_range"))  # at most 4096 rows a leaf
    ends = sums.withColumn("_upto", upto).filter("_upto > _rest")
    ends = ends.groupBy(*LEVELS).agg(F.min(F.struct("_range", (F.col("_rest") - F.col("_upto") + F.col("n")).alias("left"))).alias("_end"))
    ends = ends.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("_end._range").alias("_end"), F.col("_end.left").alias("_left"))
    rows = rows.join(written(ends, "leaf-ends"), at_leaf).drop(*(f"_{c}" for c in LEVELS))  # every leaf has an end: _rest is less than its tokens

    here = W.partitionBy(*LEVELS).orderBy("_key", "doc.doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.filter("_range = _end").withColumn("_in", F.sum("n_tokens").over(here) <= F.col("_left"))
    rows = rows.filter("_range <> _end").withColumn("_in", F.col("_range") < F.col("_end")).unionByName(edge)
    count = F.col("_whole") + F.col("_in").cast("long")
    return rows.filter(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), count.cast("int") - 1))).select(*columns, "epoch")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = with_tree(docs, tokenizer_path("word_bpe_49k.json")).select(F.struct("doc.doc_id").alias("doc"), *LEVELS, "key", "n_tokens")
    return mix(written(docs, "token-counts")).select("doc.doc_id", *LEVELS, "n_tokens", "epoch")
