"""From an instruction tree to keyed pairs: paths, instructions, edited files, originals. Narrow rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpairs.functions.text import strip

# Names under which instructions and files are stored, and suffixes in order of preference.
PROMPT_FIELDS = ["instruction", "prompt", "edit_prompt", "text", "output"]
FILE_FIELDS = ["edited_file", "output_file", "image", "file"]
SUFFIXES = [".jpg", ".jpeg", ".png"]


def path_parts(df: DataFrame, path: str, root: str = "") -> DataFrame:
    """dir, face_id and attribute of .../<attribute>/<face_id>/<file>; rows with fewer than three parts below root go."""
    below = F.substring(F.col(path), F.lit(len(root) + 1), F.length(path))
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    rows = df.withColumn("_parts", parts).filter((F.size("_parts") >= 3) & F.startswith(F.col(path), F.lit(root)))
    return rows.withColumns({
        "dir": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "face_id": F.try_element_at("_parts", F.lit(-2)),
        "attribute": F.lower(F.try_element_at("_parts", F.lit(-3))),
    }).drop("_parts")


#: JSON values that count as missing: empty, false, null and any zero.
FALSY = r'^(""|false|null|\[\]|\{\}|-?0(\.0*)?([eE][+-]?[0-9]+)?)$'


def _truthy(item: Column, fields: list[str]) -> Column:
    """The first of a struct's fields, JSON values, that is not empty, zero, false or null, as text."""
    return F.coalesce(*(F.when(~F.to_json(item[f]).rlike(FALSY), F.try_variant_get(item[f], "$", "string")) for f in fields))


def instructions(df: DataFrame, json: str) -> DataFrame:
    """prompt and edited_file (null: not named) for each entry of instruction documents of any shape.

    Objects map file names to a prompt or to an object of fields; arrays hold prompts or such objects. Plain
    prompts stay as they are, fields are stripped; entries without a prompt go, as do other shapes. A document
    is parsed once; its entries come from the parsed value, as rows of a table function.
    """
    rows = df.withColumn("_document", F.try_parse_json(F.col(json)))
    entries = df.sparkSession.tvf.variant_explode(F.col("_document").outer())  # pos, key, value; no row for other shapes
    rows = rows.lateralJoin(entries.select(F.col("key").alias("_key"), F.col("value").alias("_value"))).drop("_document")
    names = dict.fromkeys(PROMPT_FIELDS + FILE_FIELDS)
    item = F.try_variant_get("_value", "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")  # all fields in one walk
    rows = rows.withColumns({"_kind": F.schema_of_variant("_value"), "_item": item})
    nested, plain, key = F.startswith("_kind", F.lit("OBJECT")), F.col("_kind") == "STRING", F.col("_key")
    prompt = F.when(nested, strip(_truthy(F.col("_item"), PROMPT_FIELDS))).when(plain, F.try_variant_get("_value", "$", "string"))
    file = F.when(nested, F.coalesce(_truthy(F.col("_item"), FILE_FIELDS), key)).otherwise(key)
    found = F.array(F.struct(prompt.alias("prompt"), F.nullif(file, F.lit("")).alias("edited_file")))
    # filtered within the generator: a filter behind it would be pushed down, and make all of this once more
    return rows.select(*df.columns, F.inline(F.filter(found, lambda e: e["prompt"].isNotNull() & (e["prompt"] != ""))))


def candidate_names(file: Column, face_id: Column) -> Column:
    """Names under which an edited file may lie, the preferred first."""
    own = F.concat(face_id, F.lit("_"), file)
    return F.array(file, *(F.concat(file, F.lit(s)) for s in SUFFIXES), *(F.concat(own, F.lit(s)) for s in SUFFIXES))


def resolve_named(pairs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """pairs with edited_path: the first candidate name that files (dir, name, path) has in the pair's dir; others go.

    The match is a minimum over the candidates' places, which is combined before the shuffle.
    """
    wanted = pairs.filter("edited_file IS NOT NULL").select(key, "dir", F.posexplode(candidate_names(F.col("edited_file"), F.col("face_id"))).alias("_place", "name"))
    found = wanted.join(files.select("dir", "name", "path"), ["dir", "name"])
    best = found.groupBy(key).agg(F.min_by("path", "_place").alias("edited_path"))
    return pairs.join(best, key)


def resolve_unnamed(pairs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """pairs without a file name, with edited_path: a directory's only image; else the first whose name holds the
    face_id and not `original`; else the first. Directories without an image go."""
    wanted = pairs.filter("edited_file IS NULL")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    images = files.filter(suffix.isin(*SUFFIXES)).select("dir", "name", "path")
    # directories first: a row for each that a pair asks for, and one for each face_id in it
    first = images.groupBy("dir").agg(F.min_by("path", "name").alias("_first"))
    asked = wanted.select("dir", "face_id").distinct()
    named = images.filter(~F.contains(F.lower("name"), F.lit("original"))).join(asked, "dir").filter(F.contains("name", "face_id"))
    named = named.groupBy("dir", "face_id").agg(F.min_by("path", "name").alias("_named"))
    best = asked.join(first, "dir").join(named, ["dir", "face_id"], "left").select("dir", "face_id", F.coalesce("_named", "_first").alias("edited_path"))
    return wanted.join(best, ["dir", "face_id"]).select(*pairs.columns, "edited_path")


def originals_by_key(files: DataFrame) -> DataFrame:
    """face_id and original_path: <face_id>.jpg before .jpeg before .png."""
    id_, suffix = F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 1), F.regexp_extract("name", r"^(.*)(\.[^.]*)$", 2)
    rows = files.select(id_.alias("face_id"), F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix).alias("_place"), "path").filter("_place > 0")
    return rows.groupBy("face_id").agg(F.min_by("path", "_place").alias("original_path"))


def pair_by_key(pairs: DataFrame, originals: DataFrame, key: str = "face_id") -> DataFrame:
    """Each edit with the original of its key, never by position; edits without one go."""
    return pairs.join(originals, key)


def missing_originals(pairs: DataFrame, originals: DataFrame, key: str = "face_id") -> DataFrame:
    """needed and missing: distinct keys of pairs, and those without an original; one row."""
    needed = pairs.select(key).distinct()
    found = originals.select(key).distinct().withColumn("_found", F.lit(True))
    out = needed.join(found, key, "left").agg(F.count(F.lit(1)).alias("needed"), F.count_if(F.col("_found").isNull()).alias("missing"))
    return out.withColumn("missing_fraction", F.when(F.col("needed") > 0, F.col("missing") / F.col("needed")).otherwise(0.0))


def check_originals(pairs: DataFrame, originals: DataFrame, most: float = 0.01, key: str = "face_id") -> None:
    """An error if there is no pair, or if more than this share of the needed originals is missing."""
    row = missing_originals(pairs, originals, key).first()
    if not row["needed"]:
        raise ValueError("no pair was found")
    if row["missing_fraction"] > most:
        raise ValueError(f"{row['missing']} of {row['needed']} originals are missing")


def needed_only(originals: DataFrame, pairs: DataFrame, key: str = "face_id") -> DataFrame:
    """Originals that some pair needs, before pixels are read."""
    return originals.join(pairs.select(key).distinct(), key, "left_semi")

