"""Substring dedup by paragraph MinHash banding (operator 7).

Paragraphs have bounds chosen by content (see passages): what occurs elsewhere too, wherever it lies in a
line or across lines, cut at line ends. All text is looked at, and only text without a run of WINDOW +
REACH - 1 words that occurs again, which no similar paragraph is, makes none. Each paragraph gets MinHash
values of its word 5-grams in BANDS bands of ROWS, as many as the recall at a Jaccard similarity of 0.8
asks for; paragraphs that collide in a band are verified exactly, and of each component of similar
paragraphs one stays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.llm.common import BASE, blocks_of, discard, mix64, written
from editpairs.llm.near import SIMILARITY, minima, near_classes, with_row
from editpairs.llm.passages import paragraphs, repeated_windows

#: Five values a band: with three, unrelated paragraphs of one kind of text chain into components that grow faster than the data.
ROWS, RECALL = 5, 0.998
#: Bands that give two paragraphs of a similarity of 0.8 this chance to collide.
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - float(SIMILARITY) ** ROWS))


def banded(docs: DataFrame) -> DataFrame:
    """row, doc_id, no, start, end, text, size (bytes of shingles), unit, keys (one a band) of the paragraphs of docs (row, doc_id, text, at, n)."""

    def each(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at, n = (np.split(c.flatten().to_numpy(), np.diff(c.offsets.to_numpy()).cumsum()[:-1]) for c in batch.columns[3:])
            for a, b in blocks_of(texts):
                found = [(i, k, s, e) for i in range(a, b) for k, (s, e) in enumerate(paragraphs(texts[i], at[i], n[i]))]
                if not found:
                    continue
                part = [texts[i][s:e] for i, _, s, e in found]
                some, unit, least, size = minima(part, BANDS * ROWS)
                keys = np.zeros((len(some), BANDS), dtype=np.uint64)
                for k in range(BANDS * ROWS):
                    keys[:, k // ROWS] = mix64(keys[:, k // ROWS] * np.uint64(BASE) + least[:, k].astype(np.uint64) + np.uint64(1))
                of, no, start, end = np.array(found)[some].T
                yield pa.RecordBatch.from_pydict({
                    "row": batch.column(0).take(pa.array(of)), "doc_id": batch.column(1).take(pa.array(of)), "no": no, "start": start, "end": end,
                    "text": pa.array([part[k] for k in some.tolist()], pa.string()), "size": size, "unit": pa.array(unit, pa.binary()),
                    "keys": pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * BANDS, keys.view(np.int64).ravel()),
                })

    out = docs.select("row", "doc_id", "text", "at", "n").mapInArrow(each, "row long, doc_id long, no long, start long, end long, text string, size long, unit binary, keys array<long>")
    return written(out, "paragraphs", compression="zstd")


def collisions(units: DataFrame) -> DataFrame:
    """Edges (a, b) from each unit to the least one of every band's bucket it is in; units: unit, keys."""
    entry = units.select("unit", F.posexplode("keys").alias("band", "key"))
    bucket = entry.groupBy("band", "key").agg(F.min("unit").alias("least"), F.max("unit").alias("most")).filter("least <> most")
    return entry.join(bucket.drop("most"), ["band", "key"]).select(F.col("unit").alias("a"), F.col("least").alias("b"))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, row, repeated: array of its repeated paragraphs, by start, as
    (start, end, class_doc_id, class_size, removed); empty if none.

    A paragraph is repeated if one of another place is equal to it or has a similarity of 0.8 or more. Of the
    paragraphs connected by such links the one of the least (doc_id, hash of the text, place) stays, the others
    are removed; a null id counts as the least. Rows that repeat id and text are one place with two rows:
    their paragraphs count twice and fare alike. Paragraphs of a text may overlap. Null and empty texts have no paragraph, nor have texts of
    fewer than LEAST_RUN words; extra columns are ignored; an empty table gives no row.
    """
    docs = with_row(docs)
    items = banded(docs.join(repeated_windows(docs), "row"))
    units = items.groupBy("unit").agg(F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"), F.first("text").alias("text"), F.first("size").alias("size"), F.min(F.struct("doc_id", "row", "no")).alias("first"))
    units = written(units, "paragraph-units", compression="zstd")
    places = written(items.select("row", "no", "start", "end", "unit"), "paragraph-places")
    discard(items)  # texts and keys stay once a unit
    near = near_classes(units, collisions(units), lambda wanted: wanted)
    units = units.select("unit", "weight", "first").join(near, "unit", "left").filter("weight > 1 OR links > 0").withColumn("component", F.coalesce("component", "unit"))
    units = written(units, "repeated-paragraphs")
    stays = units.groupBy("component").agg(F.min("first").alias("stays"), F.sum("weight").alias("class_size"))
    units = units.join(stays, "component").select("unit", "stays", "class_size")
    removed = (F.col("row") != F.col("stays.row")) | (F.col("no") != F.col("stays.no"))
    found = places.join(units, "unit").select("row", F.struct("start", "end", F.col("stays.doc_id").alias("class_doc_id"), "class_size", removed.alias("removed")).alias("found"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_set("found")).alias("repeated"))
    none = F.array().cast(found.schema["repeated"].dataType)
    return docs.select("doc_id", "row").join(found, "row", "left").select("doc_id", "row", F.coalesce("repeated", none).alias("repeated"))


def united(spans: Column) -> Column:
    """(start, end) of spans as ranges that don't overlap, by start."""
    last = lambda out: F.try_element_at(out, F.lit(-1))

    def add(out, x):
        longer = F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], x["end"]).alias("end"))
        apart = (F.size(out) == 0) | (x["start"] >= last(out)["end"])
        return F.when(apart, F.concat(out, F.array(x))).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer)))

    places = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.aggregate(F.sort_array(places), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = out.withColumn("removed", united(F.filter("repeated", lambda x: x["removed"])))
    place = lambda x: F.concat_ws(":", x["start"], x["end"])
    return out.select(
        "doc_id",
        F.size("repeated").cast("long").alias("n_repeated"),
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("chars_removed"),
        F.array_join(F.transform("removed", place), ",").alias("removed_spans"),
        F.array_sort(F.array_distinct(F.transform("repeated", lambda x: x["class_doc_id"]))).alias("class_doc_ids"),
    )
