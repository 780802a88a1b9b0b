"""Exact dedup against a persistent digest index, bucketed and sorted by hash (operator 4).

The index is a Parquet table, bucketed and sorted by the SHA-256 of the normalised text. A batch is
aggregated to one row per digest, sort-merge anti-joined with the index, whose buckets need no shuffle,
and what is new is appended. The table's files stay; another session opens them by path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.llm.common import join_hot, partitions, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: str) -> Column:
    """SHA-256 of the UTF-8 of text with A-Z lower-cased and nothing else; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), 256))


class DigestIndex:
    """The texts seen so far: digest, keep_id (the row that stayed), group_size (rows of its batch), batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Append docs' new texts; one row per row of docs: doc_id, keep_id, group_size, kept, digest.

        Of equal texts new to the index the row with the largest id stays (a null id counts as the
        smallest; of rows that also repeat the id, one). A text that the index had is dropped, with the id
        that stayed then. Only ids and 32-byte digests are shuffled.
        """
        batch = uuid.uuid4().hex
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"))
        each = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        # from the rows themselves, and written, so that a group's rows are summed before they are dealt by
        # digest: else the anti-join would be pushed below the aggregation
        texts = written(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digests")
        new = texts.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest")
        new.select("digest", "keep_id", "group_size", "batch").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        known = self.rows().withColumn("new", F.col("batch") == batch).drop("batch")
        total = known.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        away = F.concat("digest", F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary"))
        out = join_hot(each, known, "digest", "group_size", total, away)
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decisions for every row of docs against `index`, or a new one in the shared folder.

    Null and empty texts are equal to each other; extra columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, shared_dir(spark, "digest-index"), partitions(spark))
    return index.add(docs)


def without_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; the texts are shuffled once, by digest and id."""
    key = lambda digest, doc_id: F.concat(digest, F.coalesce(doc_id.cast("long").cast("string"), F.lit("none")).cast("binary"))
    kept = exact_dedup(docs, index).filter("kept").select(key(F.col("digest"), F.col("doc_id")).alias("key"))
    rows = docs.select(F.struct("*").alias("doc"), key(text_digest("text"), F.col("doc_id")).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
