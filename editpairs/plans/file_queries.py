"""Queries over files: each writes a tree, splits, reports or a mix from the given tables, and reads it back."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.functions import png
from editpairs.operators import mixing, pairing, quality
from editpairs.plans import jobs
from editpairs.plans.queries import AUDIT_SQL, METRICS_SQL, PAIRS_SQL, PERSON, PIXELS_SQL, SQL, images, key_sql, metrics, pairs, query, resized_sql, rounded, second, table
from editpairs.sources import files, io
from editpairs.sources.shared import shared_dir

# ---- pixels of a second source, from a tree of files


def as_png(image: Column) -> Column:
    """The file of an IMAGE struct."""

    @F.pandas_udf("binary")
    def encoded(frame):
        import numpy as np

        known = {}  # equal images are encoded once a batch
        rows = list(zip(frame["height"], frame["width"], frame["channels"], frame["data"]))
        for h, w, c, data in rows:
            if (h, w, c, data) not in known:
                known[h, w, c, data] = png.encode(np.frombuffer(data, dtype=np.uint8).reshape(h, w, c))
        return pd.Series([known[r] for r in rows], dtype=object)

    return encoded(image)


def local(path: str) -> str:
    """A path as executors name it: without the scheme of local files."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with orig/<part>.png and, for each part, train/<ATTRIBUTE>/<part>/ with instructions and an edited image.

    One original in 150 is missing, one edited image in 13 is broken.
    """
    root = local(shared_dir(spark, "tree"))
    id_ = F.col("pair_id").cast("string")
    folder = F.concat(F.lit(f"{root}/set/instruct_dataset/train/ATTR"), (F.col("pair_id") % 5).cast("string"), F.lit("/"), id_, F.lit("/"))
    file = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    original = F.when(F.col("pair_id") % 150 != 7, file(F.concat(F.lit(f"{root}/orig/"), id_, F.lit(".png")), as_png(F.col("original_image"))))
    edited = F.when(F.col("pair_id") % 13 == 5, F.lit("no image").cast("binary")).otherwise(as_png(F.col("edited_image")))
    entry = F.when(F.col("pair_id") % 2 == 0, F.to_json(F.create_map(F.lit("add"), F.lit("add a hat")))).otherwise(F.lit('{"add": {"prompt": "", "text": " add a hat "}, "none": "no such file"}'))
    made = F.array(original, file(F.concat(folder, id_, F.lit("_add.png")), edited), file(F.concat(folder, F.lit("instruct.json")), entry.cast("binary")))
    rows = images(spark, sf_dir).select(made.alias("made")).select(F.inline(F.array_compact("made")))  # a part's files in one pass, in one task
    files.write_files(rows, "path", "content", linked=True)  # few contents and very many names: a disk has no inode for each
    return root


@query(f"""WITH {PIXELS_SQL}, {resized_sql('8', '8', value='a')}, {resized_sql('8', '8', value='b')},
  o AS (SELECT id, md5(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY y, x, c)) AS original FROM out_a GROUP BY id), e AS (SELECT id, md5(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY y, x, c)) AS edited FROM out_b GROUP BY id)
  SELECT CAST(id AS VARCHAR) AS face_id, 'attr' || id % 5 AS attribute, 'add a hat' AS edit_prompt, original, edited FROM o JOIN e USING (id) WHERE id % 150 <> 7 AND id % 13 <> 5""")
def second_source_pixels(spark, sf_dir):
    root = written_tree(spark, sf_dir)
    found = jobs.discover_pairs(spark, f"{root}/set")
    targets = found.select("attribute").distinct().withColumn("target", F.lit(None).cast("int"))
    chosen = jobs.prepare_second_source(found, files.list_tree(spark, f"{root}/orig"), targets, 10**9, 1)
    loaded = jobs.load_second_source(chosen, side=8, decoder=lambda: png.decode)
    digest = lambda c: F.md5(F.hex(f"{c}.data").cast("binary"))
    return loaded.select("face_id", "attribute", "edit_prompt", digest("original_image").alias("original"), digest("edited_image").alias("edited"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'orig' AS dir, k || '.png' AS name FROM p WHERE k % 150 <> 7
  UNION ALL SELECT 'set/instruct_dataset/train/ATTR' || k % 5 || '/' || k, k || '_add.png' FROM p UNION ALL SELECT 'set/instruct_dataset/train/ATTR' || k % 5 || '/' || k, 'instruct.json' FROM p""")
def tree_listing(spark, sf_dir):
    root = written_tree(spark, sf_dir)
    return files.list_tree(spark, root).select(F.substring(F.col("dir"), F.lit(len(root) + 2), F.length("dir")).alias("dir"), "name")


@query("SELECT 'attr' || p_partkey % 5 AS attribute, count(*) AS n, sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS instructions FROM part GROUP BY 1")
def instruction_tree(spark, sf_dir):
    root = io.tree_root(spark, written_tree(spark, sf_dir))
    found = pairing.path_parts(io.read_instruction_tree(spark, root), "json_path", root)
    entries = pairing.instructions(found, "json").groupBy("attribute", "face_id").agg(F.count(F.lit(1)).alias("k"))
    return entries.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("instructions"))


@query(f"WITH {PIXELS_SQL} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 13 <> 5 THEN md5(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY y, x, c)) END AS pixels FROM px GROUP BY id")
def images_by_path(spark, sf_dir):
    root = written_tree(spark, sf_dir)
    paths = files.list_tree(spark, f"{root}/set").filter("name LIKE '%_add.png'")
    rows = files.load_images(paths, decoder=lambda: png.decode)
    return rows.select(F.regexp_extract("path", "([0-9]+)_add.png$", 1).alias("id"), F.md5(F.hex("image.data").cast("binary")).alias("pixels"))


@query(f"WITH {PIXELS_SQL} SELECT p_name AS caption, md5(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY y, x, c)) AS pixels FROM px JOIN part ON id = p_partkey WHERE id % 4 = 1 GROUP BY id, p_name")
def image_folder(spark, sf_dir):
    root = local(shared_dir(spark, "image-folder"))
    chosen = "p_partkey % 4 = 1"
    drawn = images(spark, sf_dir, chosen).select(F.concat(F.lit(f"{root}/"), F.col("pair_id").cast("string"), F.lit(".png")).alias("path"), as_png(F.col("edited_image")).alias("content"))
    files.write_files(drawn, "path", "content")
    captions = table(spark, sf_dir, "part").filter(chosen)
    captions.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("file_name"), F.col("p_name").alias("caption")).write.json(f"{root}/metadata.jsonl")
    return io.read_image_folder(spark, root).select("caption", F.md5(F.hex("image.data").cast("binary")).alias("pixels"))


# ---- splits, prepared tables, configuration, reports


@query(f"WITH {PAIRS_SQL} SELECT pair_id, edit_prompt, split FROM pairs")
def pair_splits(spark, sf_dir):
    root = shared_dir(spark, "raw-pairs")
    rows = pairs(spark, sf_dir).select("pair_id", "edit_prompt", "split")
    for split in ("train", "dev"):
        rows.filter(F.col("split") == split).drop("split").write.parquet(f"{root}/data/{split}")
    return io.read_pairs(spark, root).select("pair_id", "edit_prompt", "split")


@query(f"WITH {PAIRS_SQL}, v AS (SELECT pair_id, CASE WHEN split = 'dev' THEN 'validation' ELSE split END AS split FROM pairs) SELECT pair_id, split, count(*) OVER (PARTITION BY split) AS valid FROM v")
def prepared_pairs(spark, sf_dir):
    path = shared_dir(spark, "prepared")
    rows = mixing.normalize_split(pairs(spark, sf_dir)).select("pair_id", "split")
    io.write_prepared(rows, path, mixing.split_stats(rows))
    return io.read_prepared(spark, path).join(spark.read.json(f"{path}_stats"), "split").select("pair_id", "split", "valid")


@query("""WITH h AS (SELECT source AS attribute, CAST(count(*) AS INTEGER) AS target FROM documents GROUP BY source), d AS (SELECT * FROM (VALUES ('src0', 10), ('src1', NULL), ('none', 5)) v(attribute, target))
  SELECT coalesce(h.attribute, d.attribute) AS attribute, CASE WHEN h.attribute IS NOT NULL THEN h.target ELSE d.target END AS target FROM h FULL JOIN d ON h.attribute = d.attribute""")
def weight_override(spark, sf_dir):
    path = shared_dir(spark, "weights")
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # configuration: an entry a source
    counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "n")))).alias("value")).write.text(path)
    return io.merged_weights(spark, {"src0": 10, "src1": None, "none": 5}, path)


@query("""SELECT event_type AS checkpoint, event_id AS idx, user_id || ' "{[' || event_type AS prompt, value AS lpips_trained FROM events""")
def report_details(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    item = F.struct(F.col("event_id").alias("idx"), F.concat(F.col("user_id").cast("string"), F.lit(' "{['), "event_type").alias("prompt"), F.col("value").alias("lpips_trained"))
    rows = events.select(F.col("event_type").alias("checkpoint"), F.to_json(item).alias("detail"), "event_id")
    root = local(shared_dir(spark, "reports"))
    reports = rows.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("num_samples"), F.array_join(F.collect_list("detail"), ",\n  ").alias("details"))  # a report is one document
    text = F.concat(F.lit('{"num_samples": '), F.col("num_samples").cast("string"), F.lit(', "details": [\n  '), "details", F.lit("\n], \"lpips_improvement\": 0.5}\n"))
    files.write_files(reports.select(F.concat(F.lit(f"{root}/"), "checkpoint", F.lit(".json")).alias("path"), text.alias("content")), "path", "content")
    return io.read_report_details(spark, root, "idx long, prompt string, lpips_trained double").select("checkpoint", "idx", "prompt", "lpips_trained")


# ---- populations, and mixes as they are written


@query(f"WITH {METRICS_SQL}, {AUDIT_SQL} SELECT * FROM audit")
def audit_population(spark, sf_dir):
    return rounded(quality.audit_population(metrics(spark, sf_dir)))


@query(SQL["mix_funnel"])
def written_mix(spark, sf_dir):
    return jobs.write_mix(pairs(spark, sf_dir), second(spark, sf_dir), shared_dir(spark, "mix"), 2, 42, "strip")


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT pair_id, '' AS face_id, split, unnest(range(1, CASE WHEN {PERSON.format('edit_prompt')} THEN 3 ELSE 2 END)) AS copy FROM pairs WHERE split = 'train' AND NOT strip AND NOT (face_orig AND NOT face_edited)),
  m AS (SELECT pair_id, face_id, split, copy FROM f UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), 'train', 1 FROM documents UNION ALL SELECT pair_id, '', 'validation', 1 FROM pairs WHERE split = 'dev'),
  k AS (SELECT split, {key_sql(42, 'pair_id', 'copy', 'face_id')} AS key FROM m)
  SELECT split, CAST(floor(CAST('0x' || substr(key, 1, 8) AS BIGINT) * 8 / 4294967296.0::DOUBLE) AS INTEGER) AS file, count(*) AS n, min(key) AS first, max(key) AS last, 0::BIGINT AS misplaced FROM k GROUP BY 1, 2""")
def written_order(spark, sf_dir):
    from pyspark.sql import Window

    path = shared_dir(spark, "mix")
    jobs.write_mix(pairs(spark, sf_dir), second(spark, sf_dir), path, 2, 42, "strip", tasks=8)
    rows = io.read_prepared(spark, path).select("split", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("place"), "shuffle_key")
    before = F.lag("shuffle_key").over(Window.partitionBy("split", "file").orderBy("place"))
    rows = rows.withColumn("wrong", F.coalesce(before > F.col("shuffle_key"), F.lit(False)))
    return rows.groupBy("split", "file").agg(F.count(F.lit(1)).alias("n"), F.min("shuffle_key").alias("first"), F.max("shuffle_key").alias("last"), F.count_if("wrong").alias("misplaced"))
