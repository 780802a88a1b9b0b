"""Readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editpairs.functions.image_ops import from_bgr
from editpairs.functions.text import slug
from editpairs.schema import IMAGE, require
from editpairs.sources import files
from editpairs.sources.shared import written

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is it a folder) of what lies in a folder of any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pair files with a split column: <root>/data/<split>/*.parquet, or <root>/data/*.parquet as one split `train`."""
    data = f"{root.rstrip('/')}/data"
    folders = [n for n, is_folder in _children(spark, data) if is_folder]
    splits = [n for n in folders if any(f.endswith(".parquet") for f, _ in _children(spark, f"{data}/{n}"))]
    if splits:
        rows = spark.read.parquet(*(f"{data}/{n}/*.parquet" for n in splits))
        return rows.withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
    return spark.read.parquet(f"{data}/*.parquet").withColumn("split", F.lit("train"))


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """A table written by write_prepared()."""
    return spark.read.parquet(path)


def write_prepared(pairs: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """Pairs by split, and their statistics as one JSON file beside them."""
    require(pairs, "split").write.mode("overwrite").partitionBy("split").parquet(path)
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_stats")


def write_ordered(df: DataFrame, path: str, key: str, tasks: int | None = None) -> None:
    """df by split, each split's files, by name, in the order of key, a hash in hex: one exchange and one sort, folded into the write.

    A hash is evenly spread, so a row's task follows from its first 32 bits; nothing is sampled beforehand, and
    what comes before the exchange runs once.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * tasks / F.lit(1 << 32)).cast("int")
    rows = require(df, "split", key).repartitionById(tasks, task).sortWithinPartitions("split", key)
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def tree_root(spark: SparkSession, path: str) -> str:
    """The folder with train/: <path>/instruct_dataset, path itself, a nested instruct_dataset, or else path."""
    path = path.rstrip("/")
    for candidate in (f"{path}/instruct_dataset", path):
        if _exists(spark, f"{candidate}/train"):
            return candidate
    for level in files.walk(spark, path):  # folders only matter here, level by level, until one holds it
        nested = level.filter("is_folder AND name = 'instruct_dataset'").select("path")
        if found := files.children(nested).filter("is_folder AND name = 'train'").agg(F.min("dir")).first()[0]:
            return found
    return path


def read_instruction_tree(spark: SparkSession, root: str) -> DataFrame:
    """json_path and json of every instruct.json below root, of all splits."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "instruct.json").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return rows.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("json_path"), F.col("value").alias("json"))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """dir, name, path of all files below root; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path")


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    """file_inventory() of the images."""
    return file_inventory(spark, root).filter(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(*IMAGE_SUFFIXES))


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """path and image (RGB) of image files; what can't be decoded has a null image."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(list(paths))
    return rows.select(F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))).alias("path"), from_bgr(F.col("image")).alias("image"))


def read_chosen_images(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path and image of just these files (path). Their names pass the driver, as in every listing of files; a sample's cap bounds them."""
    exact = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in paths.select("path").distinct().toLocalIterator()]
    if not exact:
        return spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType()), T.StructField("image", IMAGE)]))
    return read_images(spark, *exact)


def decode(files: DataFrame, decoder) -> DataFrame:
    """path and image of binaryFile rows by a plug-in: a vectorised function bytes -> IMAGE struct, null if it fails."""
    return files.select("path", decoder("content").alias("image"))


#: Files that Spark's image source opens by their names; where there are more, it goes through their folder.
FEW = 1000


def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """Rows of metadata.jsonl (file_name, a path below root, and captions) with their images; null for what can't be decoded. Rows without a file go.

    Executors open the named files where their rows lie: no folder is listed and no pixel shuffled. What they can't
    decode there (files are looked at by their first bytes) is left to Spark's image source, and so is all of a
    folder in a store that Spark alone reaches.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    root = re.sub("^file:/*", "/", place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    captions = spark.read.json(f"{root}/metadata.jsonl").filter("file_name IS NOT NULL")
    columns = ["file_name", *(c for c in captions.columns if c != "file_name"), "image"]
    try:
        files.store_of(root)
    except (OSError, ValueError, NotImplementedError):
        return captions.join(_below(read_images(spark, root), root), "file_name").select(columns)
    rows = captions.filter(~F.col("file_name").rlike(r"(^|/)\.\.(/|$)")).withColumn("_path", F.concat(F.lit(f"{root}/"), "file_name"))
    dealt = lambda r: r.repartition(4 * spark.sparkContext.defaultParallelism)  # noqa: E731  a caption is narrow, its image is not
    opened = lambda r: files.with_images(dealt(r), "_path", missing=False).select(columns)
    other = written(files.unread(dealt(rows.select(F.col("_path").alias("path")))), "unread").distinct()
    some = other.limit(FEW + 1).count()
    if not some:
        return opened(rows)
    images = (read_chosen_images(spark, other) if some <= FEW else read_images(spark, root)).withColumnRenamed("path", "_path")
    other = other.withColumnRenamed("path", "_path")
    rest = rows.join(other, "_path", "left_semi").join(images, "_path", "left")
    return opened(rows.join(other, "_path", "left_anti")).union(rest.select(columns))


def _below(images: DataFrame, root: str) -> DataFrame:
    """file_name, a path below root, in place of path."""
    return images.withColumn("file_name", F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))).drop("path")


def prompt_suite(df: DataFrame, json: str) -> DataFrame:
    """id, category, prompt, notes of suites in JSON: an array, or an object with `prompts`, of texts or objects."""
    body = F.when(F.startswith(F.ltrim(F.col(json)), F.lit("[")), F.col(json)).otherwise(F.get_json_object(F.col(json), "$.prompts"))
    item = F.col("_item")
    nested = F.startswith(item, F.lit("{"))
    field = lambda n: F.when(nested, F.get_json_object(item, f"$.{n}"))
    rows = df.select(F.explode(F.from_json(body, "array<string>")).alias("_item"))
    rows = rows.select(field("id").alias("id"), field("category").alias("category"), F.when(nested, field("prompt")).otherwise(item).alias("prompt"), field("notes").alias("notes"))
    return rows.withColumn("id", F.coalesce("id", slug(F.col("prompt"))))


def read_prompt_suite(spark: SparkSession, path: str) -> DataFrame:
    return prompt_suite(spark.read.text(path, wholetext=True), "value")


def merged_weights(spark: SparkSession, defaults: dict[str, int | None], override_json: str | None = None) -> DataFrame:
    """attribute and target: the defaults, with a JSON object's entries in their place."""
    rows = spark.createDataFrame([(k, v, 0) for k, v in defaults.items()], "attribute string, target int, rank int")
    if override_json is not None:
        text = spark.read.text(override_json, wholetext=True)
        more = text.select(F.explode(F.from_json("value", "map<string,int>")).alias("attribute", "target"), F.lit(1).alias("rank"))
        rows = rows.union(more)
    return rows.groupBy("attribute").agg(F.max_by(F.struct("target"), "rank").alias("_t")).select("attribute", "_t.target")


def write_report(report: DataFrame, details: DataFrame, path: str) -> None:
    """One report as JSON, and its details beside it, a row an example, in as many files as they need."""
    report.coalesce(1).write.mode("overwrite").json(path)
    details.write.mode("overwrite").json(f"{path.rstrip('/')}_details")


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Reports of several checkpoints, named by the folder or file that they lie in."""
    rows = spark.read.option("multiLine", "true").json(list(paths))
    return rows.withColumn("checkpoint", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_details(spark: SparkSession, *paths: str) -> DataFrame:
    """Details of the reports at these paths, named as in read_reports()."""
    rows = spark.read.json([f"{p.rstrip('/')}_details" for p in paths])
    return rows.withColumn("checkpoint", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_details/[^/]+$", 1))


#: A whole text, a bracket, or the beginning of a text that has no end yet.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]"]', re.DOTALL)


def _details(chunks, array: str):
    """JSON texts of the objects in the array of this name at a document's top, from the document in chunks; one is held at a time."""
    buffer, at, begin, depth, key, inside = "", 0, None, 0, None, False
    for chunk in chunks:
        buffer += chunk
        while (found := TOKEN.search(buffer, at)) is not None and found.group() != '"':
            token, at = found.group(), found.end()
            if token[0] == '"':
                key = token if depth == 1 else key
            elif token in "{[":
                depth += 1
                if depth == 2 and token == "[" and key == f'"{array}"':
                    inside = True
                elif inside and depth == 3 and token == "{":
                    begin = found.start()
            else:
                depth -= 1
                if begin is not None and depth == 2:
                    yield buffer[begin:at]
                    begin = None
                elif depth == 1:
                    inside = False
        at = len(buffer) if found is None else found.start()
        cut = at if begin is None else begin
        buffer, at, begin = buffer[cut:], at - cut, None if begin is None else 0


def read_report_details(spark: SparkSession, root: str, schema: str, array: str = "details", chunk: int = 1 << 20) -> DataFrame:
    """schema and `checkpoint` (the file's name) of the objects in each report's array below root, whatever the reports' size.

    A report is one JSON document. It is read in chunks and taken apart object by object in the task that its
    path lies in; objects are parsed by Spark.
    """

    def read(batches):
        import codecs

        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = files.store_of(path)
                with store.open_input_stream(name) as f:
                    text = codecs.getincrementaldecoder("utf-8")()
                    pieces = (text.decode(data) for data in iter(lambda: f.read(chunk), b""))
                    held, size = [], 0
                    for one in _details(pieces, array):
                        held.append(one)
                        size += len(one)
                        if size >= chunk:
                            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(held), pa.string()), "json": pa.array(held, pa.string())})
                            held, size = [], 0
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(held), pa.string()), "json": pa.array(held, pa.string())})

    paths = files.list_tree(spark, root).filter("name LIKE '%.json'").select("path")
    rows = paths.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(read, "path string, json string")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("checkpoint"), F.from_json("json", schema).alias("_d")).select("checkpoint", "_d.*")
