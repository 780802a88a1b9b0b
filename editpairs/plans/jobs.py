"""Whole jobs: each takes tables and returns tables; nothing but gates brings a number to the driver."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions.text import mentions_person
from editpairs.operators import filters, mixing, pairing, plugins, quality, sampling
from editpairs.sources import files, io
from editpairs.sources.shared import written

# How many pairs of each attribute are taken; null is all, 0 none.
ATTRIBUTE_TARGETS = {"glasses": None, "beard": None, "eyes": None, "hair": 5000, "age": 3000, "gender": 2000, "expression": 2000, "skin": 1000, "anime": 0}
# The given columns of raw pairs, and their names here.
RAW_NAMES = {"source_img": "original_image", "target_img": "edited_image", "instruction": "edit_prompt"}


def prepare_first_source(raw: DataFrame, most_side: int = 512) -> tuple[DataFrame, DataFrame]:
    """(valid pairs, statistics by split) of raw pair rows."""
    pairs = filters.valid_pairs(filters.rename_present(raw, RAW_NAMES), I.bounded(most_side))
    return pairs, mixing.split_stats(pairs, F.lit(most_side).alias("resolution"))


def discover_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Edit pairs of an instruction tree, with the path of each edited file."""
    root = io.tree_root(spark, path)
    entries = pairing.instructions(pairing.path_parts(io.read_instruction_tree(spark, root), "json_path", root), "json").drop("json")
    entries = entries.withColumn("entry", F.md5(F.concat_ws("|", "json_path", F.coalesce("edited_file", F.lit("")), "prompt").cast("binary")))
    inventory = files.list_tree(spark, root)  # a named file may have any suffix
    found = pairing.resolve_named(entries, inventory, "entry").unionByName(pairing.resolve_unnamed(entries, inventory, "entry"))
    return found.select("face_id", "attribute", "prompt", "edited_path", "json_path", "entry")


def prepare_second_source(pairs: DataFrame, originals: DataFrame, targets: DataFrame, most: int, seed: int) -> DataFrame:
    """Sampled pairs with the path of each original: narrow rows, before any pixel is read."""
    chosen = sampling.capped(sampling.stratified(pairs, "attribute", "entry", targets, seed), most, "entry", seed + 1)
    chosen = written(chosen, "chosen-pairs")  # narrow rows, read by the check and by each join
    originals = pairing.originals_by_key(originals)
    pairing.check_originals(chosen, originals)
    return pairing.pair_by_key(chosen, pairing.needed_only(originals, chosen))


def load_second_source(chosen: DataFrame, side: int = 512, face_loader=None, decoder=None, opener=None) -> DataFrame:
    """Pixels of the chosen pairs, originals square, edited images at their size, both with a face.

    Executors open the files of chosen pairs and no others, an original once for its edits; pairs with a file that
    is missing or broken go. Paths don't pass the driver and pixels no exchange.
    """
    rows = files.load_pairs(chosen, "original_path", "edited_path", side, decoder, opener).filter("original_image IS NOT NULL AND edited_image IS NOT NULL")
    rows = rows.withColumns({"face_orig": plugins.shows_face(F.col("original_image"), face_loader), "face_edited": plugins.shows_face(F.col("edited_image"), face_loader)})
    return filters.require_faces(rows).select("original_image", "edited_image", F.col("prompt").alias("edit_prompt"), "face_id", "attribute")


def second_source_stats(pairs: DataFrame, originals: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """records, distinct originals, missing originals, num_selected (rows of chosen, or of pairs), and records by attribute as a map."""
    counts = pairs.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))
    by = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "n")))).alias("per_attribute"))  # a row an attribute
    totals = pairs.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("face_id").alias("originals"))
    missing = pairing.missing_originals(pairs, originals).select("missing", "needed")
    selected = (pairs if chosen is None else chosen).agg(F.count(F.lit(1)).alias("num_selected"))
    return totals.crossJoin(missing).crossJoin(selected).crossJoin(by)  # rows of totals, one each


def _flagged(first: DataFrame, strip_column: str | None) -> tuple[DataFrame, DataFrame]:
    """(train rows with _strip, _lost and _person, validation rows)"""
    first = mixing.normalize_split(first)
    strip = F.coalesce(F.col(strip_column), F.lit(False)) if strip_column else I.corner_strip()(F.col("edited_image")) if "edited_image" in first.columns else F.lit(False)
    lost = filters.face_lost(F.col("face_orig"), F.col("face_edited")) if "face_orig" in first.columns else F.lit(False)
    train = first.filter("split = 'train'").withColumns({"_strip": strip, "_lost": lost, "_person": mentions_person(F.col("edit_prompt"))})
    return train, first.filter("split = 'validation'")


def _mixed(train: DataFrame, validation: DataFrame, second: DataFrame | None, repeat: int, seed: int) -> DataFrame:
    """Rows of the mix with their shuffle_key."""
    kept = train.filter(~F.col("_strip") & ~F.col("_lost"))
    mix = mixing.oversample(kept, F.col("_person"), repeat).drop("_strip", "_lost", "_person")
    if second is not None:
        mix = mixing.concatenate(mix, second.withColumns({"split": F.lit("train"), "copy": F.lit(1)}))
    keys = [c for c in ("pair_id", "copy", "face_id") if c in mix.columns]
    return sampling.with_shuffle_key(mix.unionByName(validation.withColumn("copy", F.lit(1)), allowMissingColumns=True), seed, *keys)


def _counts() -> list:
    """What the funnel says of the train rows, as sums that can be taken while they pass."""
    count = lambda c: F.count(F.when(c, 1))
    strip, lost = F.col("_strip"), F.col("_lost")
    return [F.count(F.lit(1)).alias("input"), count(strip).alias("dropped_strips"), count(~strip & lost).alias("face_filtered"), count(~strip & ~lost & F.col("_person")).alias("person_examples"), count(~strip & ~lost).alias("kept")]


def build_mix(first: DataFrame, second: DataFrame | None, repeat: int, seed: int, strip_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, funnel) of the train rows: strips and lost faces go, persons are repeated, the second source is added, order is seeded.

    Validation rows pass unchanged. first: pair_id, edit_prompt, split and what the filters need. These are two
    plans, each of which reads first; where flags come from pixels, write_mix() makes both in one pass.
    """
    train, validation = _flagged(first, strip_column)
    added = second.agg(F.count(F.lit(1)).alias("second_source")) if second is not None else train.sparkSession.range(1).select(F.lit(0).cast("long").alias("second_source"))
    held = validation.agg(F.count(F.lit(1)).alias("validation"))
    funnel = train.agg(*_counts()).crossJoin(added).crossJoin(held).withColumn("person_repeat", F.lit(repeat))
    funnel = funnel.withColumn("final", F.col("kept") + (repeat - 1) * F.col("person_examples") + F.col("second_source")).drop("kept")
    return _mixed(train, validation, second, repeat, seed), funnel


def _observed(seen: Observation) -> dict[str, int]:
    """What was counted; nothing where Spark knew beforehand that there is no row, and so left the count out."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def write_mix(first: DataFrame, second: DataFrame | None, path: str, repeat: int, seed: int, strip_column: str | None = None, tasks: int | None = None) -> DataFrame:
    """build_mix() written by split in its seeded order; the funnel, counted while the rows passed, which is also written beside it.

    Pixels are looked at once and shuffled once. Reading a split's files in the order of their names gives the
    order of shuffle_key.
    """
    train, validation = _flagged(first, strip_column)
    seen = {"train": Observation(), "second": Observation(), "validation": Observation()}
    train, validation = train.observe(seen["train"], *_counts()), validation.observe(seen["validation"], F.count(F.lit(1)).alias("n"))
    if second is not None:
        second = second.observe(seen["second"], F.count(F.lit(1)).alias("n"))
    io.write_ordered(_mixed(train, validation, second, repeat, seed), path, "shuffle_key", tasks)
    n = {k: _observed(v) for k, v in seen.items() if k != "second" or second is not None}
    added, held = (n.get(k, {}).get("n", 0) for k in ("second", "validation"))
    counts = [n["train"].get(k, 0) for k in ("input", "dropped_strips", "face_filtered", "person_examples")]
    row = (*counts, added, held, repeat, n["train"].get("kept", 0) + (repeat - 1) * counts[-1] + added)
    kind = "input long, dropped_strips long, face_filtered long, person_examples long, second_source long, validation long, person_repeat int, final long"
    funnel = first.sparkSession.createDataFrame([row], kind)
    funnel.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_stats")
    return funnel


def pair_features(pairs: DataFrame) -> DataFrame:
    """All pixel features of a pair in one pass: colour delta, border share, strip, squared error. Keep this table, not the pixels."""
    original, edited = F.col("original_image"), F.col("edited_image")
    return pairs.withColumns({
        "delta": quality.color_delta("original_image", "edited_image"), "border": I.border_anomaly(edited), "strip": I.corner_strip()(edited), "lpips": I.squared_error(original, edited),
    }).drop("original_image", "edited_image", "mask_img")
