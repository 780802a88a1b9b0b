"""Registered queries over the edit-pair operators, each with SQL for the same rows where SQL can express it.

The given tables stand in for pairs: a conversation's turn is a pair with a prompt, a document a pair of the
second source, an order or line item an edit of a customer's or order's original, an event a metric record;
images are derived from parts, a few hundred pixels each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions import text as X
from editpairs.functions.hashing import seeded_uniform
from editpairs.functions.vectors import cosine
from editpairs.operators import evaluation, feed, filters, mixing, pairing, quality, sampling
from editpairs.plans import jobs
from editpairs.schema import IMAGE
from editpairs.sources import io
from editpairs.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- pairs out of the tables, and the same in SQL

PAIRS_SQL = """pairs AS (
  SELECT conv_id * 1000 + turn AS pair_id, CAST(conv_id AS VARCHAR) AS img_id, turn AS turn_index, text AS edit_prompt,
         (length(text) % 97) / 1000.0::DOUBLE AS lpips, 0.1::DOUBLE + (length(text) % 53) / 250.0::DOUBLE AS clip,
         conv_id % 3 = 0 AS face_orig, turn % 2 = 0 AS face_edited, conv_id % 7 = 0 AS strip,
         CASE WHEN conv_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split
  FROM conversations)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("conv_id").cast("string").alias("img_id"), F.col("turn").alias("turn_index"),
        F.col("text").alias("edit_prompt"), ((n % 97) / F.lit(1000.0)).alias("lpips"), (F.lit(0.1) + (n % 53) / F.lit(250.0)).alias("clip"),
        (F.col("conv_id") % 3 == 0).alias("face_orig"), (F.col("turn") % 2 == 0).alias("face_edited"), (F.col("conv_id") % 7 == 0).alias("strip"),
        F.when(F.col("conv_id") % 10 == 0, "dev").otherwise("train").alias("split"),
    )


SECOND_SQL = "second AS (SELECT doc_id AS pair_id, text AS edit_prompt, CAST(doc_id AS VARCHAR) AS face_id, source AS attribute FROM documents)"


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("edit_prompt"), F.col("doc_id").cast("string").alias("face_id"), F.col("source").alias("attribute"))


def _or(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
PERSON = "regexp_matches({}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(" + "|".join(X.PERSON_WORDS) + ")([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"
ACTION = f"CASE WHEN contains(lower({{0}}), 'remove') THEN 'remove' WHEN contains(lower({{0}}), 'replace') THEN 'replace' WHEN {_or('lower({0})', ['change', 'make'])} THEN 'change' ELSE 'other' END"


def generic_sql(column: str, words: int) -> str:
    text = f"lower({STRIP.format(column)})"
    count = f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+')))"
    return f"({_or(text, X.GENERIC_PHRASES)} OR ({count} <= {words} AND NOT {_or(text, X.ACTION_VERBS)}))"


def key_sql(seed, *columns: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || CAST({c} AS VARCHAR)" for c in columns) + ")"


# ---- prompts


@query(f"WITH {PAIRS_SQL} SELECT pair_id, {STRIP.format('edit_prompt')} AS prompt FROM pairs WHERE {STRIP.format('edit_prompt')} <> ''")
def prompt_normalize(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", X.normalize_prompt(F.col("edit_prompt")).alias("prompt")).filter("prompt IS NOT NULL")


@query(f"SELECT doc_id, {PERSON.format('text')} AS is_person FROM documents")
def person_predicate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.mentions_person(F.col("text")).alias("is_person"))


@query(f"WITH {PAIRS_SQL} SELECT pair_id, {_or('lower(edit_prompt)', X.KEEP_WORDS)} AS keeps FROM pairs")
def keep_predicate(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", X.keeps_intent(F.col("edit_prompt")).alias("keeps"))


@query(f"WITH p AS (SELECT p_partkey AS id, p_name AS t FROM part UNION ALL SELECT conv_id * 1000 + turn + 100000000, text FROM conversations) SELECT id, {generic_sql('t', 3)} AS is_generic FROM p")
def generic_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"))
    rows = rows.union(table(spark, sf_dir, "conversations").select(F.col("conv_id") * 1000 + F.col("turn") + 100000000, "text"))
    return rows.select("id", X.is_generic(F.col("t"), 3).alias("is_generic"))


def slug_sql(column: str) -> str:
    kept = "regexp_replace(" + column + ", '[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}-]', '', 'g')"
    return f"left(regexp_replace(lower({STRIP.format(kept)}), '[-\\s\\p{{Z}}]+', '_', 'g'), 40)"


@query(f"SELECT item_id, {slug_sql('text')} AS slug, '20240101_' || item_id || '_' || {slug_sql('text')} || '_seed42.png' AS output_name FROM benchmark")
def prompt_slug(spark, sf_dir):
    name = X.output_name(F.lit("20240101"), F.col("item_id").cast("string"), F.col("text"), F.lit(42))
    return table(spark, sf_dir, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug"), name.alias("output_name"))


@query("WITH i AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)) AS ids FROM conversations) SELECT conv_id, turn, CAST(list_concat(ids[1:16], list_transform(range(greatest(0, 16 - len(ids))), lambda k: 0)) AS VARCHAR) AS ids FROM i")
def token_pad(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    ids = X.fixed_length(F.transform(words, lambda w: F.length(w)), 16, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("ids"))


# the texts have no hyphens, at which SQL's regular expressions can't break them; tests hold those against the standard library
CAPTION_SQL = """CASE WHEN length(t) <= 90 THEN t ELSE left(t, coalesce(list_max(list_filter(list_transform(range(1, len(string_split(t, ' ')) + 1), lambda k: length(array_to_string(string_split(t, ' ')[1:k], ' '))), lambda n: n <= 89)), 0)) || '…' END"""


COLLAPSED = STRIP.format("regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')")


@query(f"WITH c AS (SELECT conv_id, turn, {COLLAPSED} AS t FROM conversations) SELECT conv_id, turn, {CAPTION_SQL} AS caption FROM c")
def caption_shorten(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.shorten_caption(F.col("text")).alias("caption"))


# ---- noise, mixing

REASONS_SQL = f"""reasons AS (SELECT *, lpips < 0.03 AND NOT {_or('lower(edit_prompt)', X.KEEP_WORDS)} AS low_change, clip < 0.18 AS low_adherence,
  {generic_sql('edit_prompt', 3)} AS generic_prompt FROM pairs)"""


@query(f"WITH {PAIRS_SQL}, {REASONS_SQL} SELECT pair_id, lpips, clip FROM reasons WHERE NOT (low_change OR low_adherence OR generic_prompt)")
def noisy_pair_filter(spark, sf_dir):
    return filters.without_noise(pairs(spark, sf_dir)).select("pair_id", "lpips", "clip")


@query(f"""WITH {PAIRS_SQL}, {REASONS_SQL} SELECT count(*) AS total, count(*) FILTER (low_change OR low_adherence OR generic_prompt) AS dropped,
  count(*) FILTER (low_change) AS low_change, count(*) FILTER (low_adherence) AS low_adherence, count(*) FILTER (generic_prompt) AS generic_prompt,
  round(avg(lpips), 6) AS mean_lpips, round(avg(clip), 6) AS mean_clip, count(*) FILTER (low_change OR low_adherence OR generic_prompt) / count(*)::DOUBLE AS dropped_fraction FROM reasons""")
def drop_reason_stats(spark, sf_dir):
    out = mixing.drop_reason_stats(filters.with_drop_reasons(pairs(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_lpips", "mean_clip")})


@query(f"WITH {PAIRS_SQL} SELECT pair_id, CAST(unnest(range(1, CASE WHEN {PERSON.format('edit_prompt')} THEN 3 ELSE 2 END)) AS INTEGER) AS copy FROM pairs")
def oversample_persons(spark, sf_dir):
    return mixing.oversample(pairs(spark, sf_dir), X.mentions_person(F.col("edit_prompt")), 2).select("pair_id", "copy")


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT *, {PERSON.format('edit_prompt')} AS person FROM pairs WHERE split = 'train'), c AS (SELECT count(*) FILTER (strip) AS dropped_corner_strips, count(*) FILTER (NOT strip) AS original, count(*) FILTER (NOT strip AND person) AS p FROM t)
  SELECT dropped_corner_strips, (SELECT count(*) FROM pairs WHERE split = 'dev') AS validation, original, p AS person_examples, p / original::DOUBLE AS person_fraction, 2 AS person_repeat, original + p AS mixed FROM c""")
def mix_stats(spark, sf_dir):
    rows = mixing.normalize_split(pairs(spark, sf_dir))
    return mixing.oversample_stats(rows.filter("split = 'train'"), "edit_prompt", 2, F.col("strip"), rows.filter("split = 'validation'"))


RAW_SQL = """raw AS (SELECT conv_id * 1000 + turn AS pair_id, CASE WHEN turn % 5 = 1 THEN '  ' ELSE ' ' || text || ' ' END AS instruction,
  CASE WHEN conv_id % 6 <> 0 THEN role END AS source_img, CASE WHEN turn % 3 <> 0 THEN text END AS target_img FROM conversations)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.when(F.col("turn") % 5 == 1, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("instruction"),
        F.when(F.col("conv_id") % 6 != 0, F.col("role")).alias("source_img"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("target_img"),
    )


@query(f"WITH {RAW_SQL} SELECT pair_id, {STRIP.format('instruction')} AS edit_prompt, source_img AS original_image, target_img AS edited_image FROM raw WHERE {STRIP.format('instruction')} <> '' AND source_img IS NOT NULL AND target_img IS NOT NULL")
def valid_pairs(spark, sf_dir):
    return filters.valid_pairs(filters.rename_present(raw(spark, sf_dir), jobs.RAW_NAMES)).select("pair_id", "edit_prompt", "original_image", "edited_image")


@query(f"WITH {RAW_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {STRIP.format('instruction')} = '' THEN 'empty_prompt' WHEN source_img IS NULL THEN 'no_original' WHEN target_img IS NULL THEN 'no_edited' ELSE 'valid' END AS reason FROM raw) GROUP BY reason")
def invalid_reasons(spark, sf_dir):
    rows = filters.rename_present(raw(spark, sf_dir), jobs.RAW_NAMES)
    reason = filters.drop_reason(F.col("edit_prompt"), F.col("original_image"), F.col("edited_image"))
    return rows.select(F.coalesce(reason, F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS_SQL} SELECT pair_id FROM pairs WHERE NOT strip")
def strip_filter(spark, sf_dir):
    return filters.without_strips(pairs(spark, sf_dir), F.col("strip")).select("pair_id")


@query("""WITH n AS (SELECT DISTINCT o_custkey FROM orders), f AS (SELECT count(*) AS needed, count(*) - count(c_custkey) AS missing FROM n LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 90 <> 1) ON o_custkey = c_custkey),
  t AS (SELECT count(*) AS records, count(DISTINCT o_custkey) AS originals, count(*) FILTER (o_orderpriority = '1-URGENT') AS num_selected FROM orders)
  SELECT records, originals, missing, needed, num_selected, a.attribute, a.n FROM t, f, (SELECT o_orderpriority AS attribute, count(*) AS n FROM orders GROUP BY o_orderpriority) a""")
def second_source_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("face_id"), F.col("o_orderpriority").alias("attribute"))
    originals = table(spark, sf_dir, "customer").filter("c_custkey % 90 <> 1").select(F.col("c_custkey").alias("face_id"))
    out = jobs.second_source_stats(orders, originals, orders.filter("attribute = '1-URGENT'"))
    return out.select("records", "originals", "missing", "needed", "num_selected", F.explode("per_attribute").alias("attribute", "n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def numeric_order(spark, sf_dir):
    rows = sampling.by_number(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id")), "id")
    # places from the sorted partitions' sizes, so that no single task sees all rows; written, so that both readers see one order
    rows = written(rows.select("id", F.monotonically_increasing_id().alias("at")), "sorted-ids")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return rows.join(before, part == F.col("part")).select("id", (F.col("before") + F.col("at") % (1 << 33) + 1).alias("place"))


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT *, face_orig AND NOT face_edited AS lost, {PERSON.format('edit_prompt')} AS person FROM pairs WHERE split = 'train')
  SELECT count(*) AS input, count(*) FILTER (strip) AS dropped_strips, count(*) FILTER (NOT strip AND lost) AS face_filtered,
    count(*) FILTER (NOT strip AND NOT lost AND person) AS person_examples, (SELECT count(*) FROM documents) AS second_source,
    (SELECT count(*) FROM pairs WHERE split = 'dev') AS validation, 2 AS person_repeat,
    count(*) FILTER (NOT strip AND NOT lost) + count(*) FILTER (NOT strip AND NOT lost AND person) + (SELECT count(*) FROM documents) AS final FROM t""")
def mix_funnel(spark, sf_dir):
    return jobs.build_mix(pairs(spark, sf_dir), second(spark, sf_dir), 2, 42, "strip")[1]


@query(f"""WITH {PAIRS_SQL}, {SECOND_SQL}, f AS (SELECT pair_id, NULL AS face_id, split, unnest(range(1, CASE WHEN {PERSON.format('edit_prompt')} THEN 3 ELSE 2 END)) AS copy
    FROM pairs WHERE split = 'train' AND NOT strip AND NOT (face_orig AND NOT face_edited))
  SELECT pair_id, face_id, split, CAST(copy AS INTEGER) AS copy FROM f UNION ALL SELECT pair_id, face_id, 'train', 1 FROM second
  UNION ALL SELECT pair_id, NULL, 'validation', 1 FROM pairs WHERE split = 'dev'""")
def mix_rows(spark, sf_dir):
    return jobs.build_mix(pairs(spark, sf_dir), second(spark, sf_dir), 2, 42, "strip")[0].select("pair_id", "face_id", "split", "copy")


@query(f"""WITH c AS (SELECT {ACTION.format('text')} AS action, {PERSON.format('text')} AS is_person FROM conversations), w AS (SELECT count(*) AS a, count(*) FILTER (is_person) AS p FROM c)
  SELECT action, is_person, CAST(grouping(action, is_person) AS BIGINT) AS level, count(*) AS n, round(100.0 * count(*) / any_value(a), 6)::DOUBLE AS pct_all,
    round(CASE WHEN is_person THEN 100.0 * count(*) / any_value(p) END, 6)::DOUBLE AS pct_persons FROM c, w GROUP BY CUBE (action, is_person)""")
def action_person_cube(spark, sf_dir):
    out = mixing.action_person_cube(table(spark, sf_dir, "conversations"), "text")
    return out.withColumns({"pct_all": F.round("pct_all", 6), "pct_persons": F.round("pct_persons", 6)})


@query(f"WITH {PAIRS_SQL} SELECT split, count(*) AS valid, 512 AS resolution FROM (SELECT CASE WHEN split = 'dev' THEN 'validation' ELSE split END AS split FROM pairs WHERE {STRIP.format('edit_prompt')} <> '') GROUP BY split")
def split_normalize(spark, sf_dir):
    rows = mixing.normalize_split(pairs(spark, sf_dir)).filter(X.normalize_prompt(F.col("edit_prompt")).isNotNull())
    return mixing.split_stats(rows, F.lit(512).alias("resolution"))


@query(f"WITH {PAIRS_SQL}, o AS (SELECT img_id, turn_index % 2 AS turn_index, min_by(pair_id, pair_id) AS pair_id FROM (SELECT * FROM pairs UNION ALL SELECT * FROM pairs) GROUP BY 1, 2) SELECT img_id, turn_index, pair_id FROM o")
def dedup_turns(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("turn_index", F.col("turn_index") % 2)
    return sampling.dedup_turns(rows.union(rows), "pair_id").select("img_id", "turn_index", "pair_id")


@query(f"WITH {PAIRS_SQL} SELECT pair_id, {key_sql(42, 'pair_id')} AS shuffle_key FROM pairs")
def seeded_shuffle(spark, sf_dir):
    return sampling.shuffled(pairs(spark, sf_dir), 42, "pair_id").select("pair_id", "shuffle_key")


@query(f"SELECT doc_id FROM documents ORDER BY {key_sql(42, 'doc_id')}, doc_id LIMIT 100")
def random_subset(spark, sf_dir):
    return sampling.random_subset(table(spark, sf_dir, "documents"), 100, "doc_id", 42).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 64")
def first_rows(spark, sf_dir):
    return sampling.first_rows(table(spark, sf_dir, "documents"), 64, "doc_id").select("doc_id")


@query(f"WITH {PAIRS_SQL}, {SECOND_SQL} SELECT pair_id, img_id, face_id, attribute FROM (SELECT pair_id, img_id, NULL AS face_id, NULL AS attribute FROM pairs UNION ALL SELECT pair_id, NULL, face_id, attribute FROM second)")
def union_sources(spark, sf_dir):
    return mixing.concatenate(pairs(spark, sf_dir), second(spark, sf_dir)).select("pair_id", "img_id", "face_id", "attribute")


@query("SELECT 'first' AS provenance, NULL AS attribute, count(*) AS n FROM conversations UNION ALL SELECT 'second', source, count(*) FROM documents GROUP BY source")
def provenance_counts(spark, sf_dir):
    return mixing.provenance_counts(mixing.concatenate(pairs(spark, sf_dir), second(spark, sf_dir)))


@query("WITH a AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 50 = 7 THEN text || '!' ELSE text END) AS h FROM documents) SELECT *, 'left' AS only_in FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT ALL FROM a)")
def split_equality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    digest = lambda c: F.md5(c.cast("binary")).alias("h")
    changed = F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return mixing.differences(docs.select("doc_id", digest(F.col("text"))), docs.select("doc_id", digest(changed)))


# ---- sampling

TARGETS = [("A", 500), ("N", None), ("R", 0)]


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under a key: repeated (order, line) pairs count once."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("attribute"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "attribute")


ITEMS_SQL = "items AS (SELECT l_orderkey * 10 + l_linenumber AS item, min(l_returnflag) AS attribute FROM lineitem GROUP BY l_orderkey, l_linenumber)"
SAMPLE_SQL = f"""{ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY {key_sql(7, 'item')}, item) AS rn FROM items),
  s AS (SELECT item, attribute FROM r WHERE attribute = 'N' OR (attribute = 'A' AND rn <= 500))"""


@query(f"WITH {SAMPLE_SQL} SELECT item, attribute FROM s")
def stratified_sample(spark, sf_dir):
    targets = spark.createDataFrame(TARGETS, "attribute string, target int")
    return sampling.stratified(line_items(spark, sf_dir), "attribute", "item", targets, 7)


@query(f"WITH {SAMPLE_SQL} SELECT item, attribute FROM s ORDER BY {key_sql(8, 'item')}, item LIMIT 2000")
def capped_sample(spark, sf_dir):
    return sampling.capped(stratified_sample(spark, sf_dir), 2000, "item", 8)


@query("""WITH h AS (SELECT source AS attribute, count(*) AS available FROM documents GROUP BY source), t AS (SELECT * FROM (VALUES ('src0', 10), ('src1', NULL), ('src2', 0), ('none', 5)) v(attribute, target))
  SELECT coalesce(h.attribute, t.attribute) AS attribute, coalesce(available, 0) AS available, coalesce(target, -1) AS target,
    CASE WHEN t.attribute IS NULL THEN 0 ELSE least(coalesce(available, 0), coalesce(target, coalesce(available, 0))) END AS taken FROM h FULL JOIN t ON h.attribute = t.attribute""")
def attribute_targets(spark, sf_dir):
    targets = spark.createDataFrame([("src0", 10), ("src1", None), ("src2", 0), ("none", 5)], "attribute string, target int")
    return mixing.attribute_availability(second(spark, sf_dir), targets).withColumn("target", F.coalesce("target", F.lit(-1)))


# ---- pairing

EDITS_SQL = "edits AS (SELECT o_orderkey AS entry, 'd' || o_custkey % 50 AS dir, CAST(o_custkey % 100 AS VARCHAR) AS face_id, 'f' || o_orderkey % 7 AS edited_file FROM orders)"
FILES_SQL = """files AS (SELECT dir, name, dir || '/' || name AS path FROM (SELECT DISTINCT 'd' || l_suppkey % 50 AS dir,
  CASE (l_linenumber + l_suppkey) % 4 WHEN 0 THEN 'f' || l_partkey % 7 WHEN 1 THEN 'f' || l_partkey % 7 || '.jpeg' WHEN 2 THEN l_suppkey % 100 || '_f' || l_partkey % 7 || '.png' ELSE l_suppkey % 100 || '_original' || l_partkey % 3 || '.JPG' END AS name
  FROM lineitem))"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda c, n: (F.col(c) % n).cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.concat(F.lit("d"), k("o_custkey", 50)).alias("dir"), k("o_custkey", 100).alias("face_id"), F.concat(F.lit("f"), k("o_orderkey", 7)).alias("edited_file"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda c, n: (F.col(c) % n).cast("string")
    line, part = (F.col("l_linenumber") + F.col("l_suppkey")) % 4, F.concat(F.lit("f"), k("l_partkey", 7))
    name = F.when(line == 0, part).when(line == 1, F.concat(part, F.lit(".jpeg"))).when(line == 2, F.concat(k("l_suppkey", 100), F.lit("_"), part, F.lit(".png")))
    name = name.otherwise(F.concat(k("l_suppkey", 100), F.lit("_original"), k("l_partkey", 3), F.lit(".JPG")))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), k("l_suppkey", 50)).alias("dir"), name.alias("name")).distinct()
    return rows.withColumn("path", F.concat("dir", F.lit("/"), "name"))


@query(f"""WITH {EDITS_SQL}, {FILES_SQL}, c AS (SELECT entry, face_id, dir, edited_file, unnest([edited_file, edited_file || '.jpg', edited_file || '.jpeg', edited_file || '.png', face_id || '_' || edited_file || '.jpg',
    face_id || '_' || edited_file || '.jpeg', face_id || '_' || edited_file || '.png']) AS name, unnest(range(7)) AS place FROM edits)
  SELECT entry, min_by(path, place) AS edited_path FROM c JOIN files USING (dir, name) GROUP BY entry""")
def resolve_edited_file(spark, sf_dir):
    return pairing.resolve_named(edits(spark, sf_dir), files(spark, sf_dir), "entry").select("entry", "edited_path")


@query(f"""WITH {EDITS_SQL}, {FILES_SQL}, i AS (SELECT * FROM files WHERE regexp_matches(lower(name), '\\.(jpg|jpeg|png)$')),
  r AS (SELECT entry, path, row_number() OVER (PARTITION BY entry ORDER BY NOT (contains(name, face_id) AND NOT contains(lower(name), 'original')), name) AS rn FROM edits JOIN i USING (dir))
  SELECT entry, path AS edited_path FROM r WHERE rn = 1""")
def resolve_unnamed_file(spark, sf_dir):
    unnamed = edits(spark, sf_dir).withColumn("edited_file", F.lit(None).cast("string"))
    return pairing.resolve_unnamed(unnamed, files(spark, sf_dir), "entry").select("entry", "edited_path")


@query("""WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS face_id, CASE c_custkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.jpeg' END AS s FROM customer WHERE c_custkey % 11 <> 0
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), '.png' FROM customer WHERE c_custkey % 4 = 0),
  o AS (SELECT face_id, min_by('orig/' || face_id || s, CASE s WHEN '.jpg' THEN 1 WHEN '.jpeg' THEN 2 ELSE 3 END) AS original_path FROM f GROUP BY face_id)
  SELECT o_orderkey AS entry, face_id, original_path FROM orders JOIN o ON CAST(o_custkey AS VARCHAR) = face_id""")
def pair_by_key(spark, sf_dir):
    id_, n = F.col("c_custkey").cast("string"), F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    suffix = F.when(n % 3 == 0, ".jpg").when(n % 3 == 1, ".png").otherwise(".jpeg")
    names = customers.filter(n % 11 != 0).select(F.concat(id_, suffix).alias("name")).union(customers.filter(n % 4 == 0).select(F.concat(id_, F.lit(".png"))))
    originals = pairing.originals_by_key(names.withColumn("path", F.concat(F.lit("orig/"), "name")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_custkey").cast("string").alias("face_id"))
    return pairing.pair_by_key(orders, originals).select("entry", "face_id", "original_path")


@query("""WITH n AS (SELECT DISTINCT o_custkey FROM orders), f AS (SELECT o_custkey, c_custkey FROM n LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 90 <> 1) ON o_custkey = c_custkey)
  SELECT count(*) AS needed, count(*) - count(c_custkey) AS missing, round((count(*) - count(c_custkey)) / count(*)::DOUBLE, 6) AS missing_fraction FROM f""")
def missing_originals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("face_id"))
    originals = table(spark, sf_dir, "customer").filter("c_custkey % 90 <> 1").select(F.col("c_custkey").alias("face_id"))
    return pairing.missing_originals(orders, originals).withColumn("missing_fraction", F.round("missing_fraction", 6))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def needed_originals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return pairing.needed_only(table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("""SELECT event_id, 'a.jpg' AS edited_file, trim(event_type) AS prompt FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, 'b' || user_id, event_type || ' it' FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 4 = 2
  UNION ALL SELECT event_id, 'x.png', event_type FROM events WHERE event_id % 4 = 2""")
def instruction_json_parse(spark, sf_dir):
    e, kind = F.col("event_type"), F.col("event_id") % 4
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    plain = F.concat(F.lit('{"a.jpg": '), q(e), F.lit(', "empty": "", "n": 3}'))
    fields = F.concat(F.lit('{"k": {"instruction": "", "prompt": 0, "text": '), q(F.concat(F.lit("  "), e, F.lit(" it "))), F.lit(', "edited_file": "b'), F.col("user_id").cast("string"), F.lit('"}}'))
    listed = F.concat(F.lit("["), q(e), F.lit(', {"prompt": '), q(e), F.lit(', "file": "x.png"}, 7, null]'))
    json = F.when(kind == 0, plain).when(kind == 1, fields).when(kind == 2, listed).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", json.alias("json"))
    return pairing.instructions(rows, "json").select("event_id", "edited_file", "prompt")


@query("SELECT 'set/train/ATTR' || o_custkey % 9 || '/' || o_orderkey AS dir, CAST(o_orderkey AS VARCHAR) AS face_id, 'attr' || o_custkey % 9 AS attribute FROM orders WHERE o_orderkey % 10 <> 0")
def path_parse(spark, sf_dir):
    long = F.concat(F.lit("set/train/ATTR"), (F.col("o_custkey") % 9).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/instruct.json"))
    path = F.when(F.col("o_orderkey") % 10 == 0, "set/1/instruct.json").otherwise(long)
    return pairing.path_parts(table(spark, sf_dir, "orders").select(path.alias("path")), "path", "set").select("dir", "face_id", "attribute")


# ---- quality

METRICS_SQL = """metrics AS (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'control' ELSE event_type END AS audit_group, 1 - (event_id % 61) / 100.0::DOUBLE AS pair_sim, (event_id % 37) / 100.0::DOUBLE AS text_sim,
  (event_id % 53) / 100.0::DOUBLE AS lpips, event_id % 2 = 0 AS face_orig, event_id % 3 <> 0 AS face_edited FROM events)"""
AUDIT_SQL = """audit AS (SELECT audit_group, count(*) AS n, round(avg(pair_sim), 6) AS pair_sim_mean, round(quantile_cont(pair_sim, 0.1), 6) AS pair_sim_p10, round(avg(text_sim), 6) AS text_sim_mean,
  round(avg(lpips), 6) AS lpips_mean, round(quantile_cont(lpips, 0.9), 6) AS lpips_p90, count(*) FILTER (pair_sim < 0.70) AS low_pair_sim_count, count(*) FILTER (lpips > 0.35) AS high_lpips_count,
  count(*) FILTER (text_sim < 0.18) AS low_text_sim_count, count(*) FILTER (face_orig AND NOT face_edited) AS face_lost_count, round(count(*) FILTER (pair_sim < 0.70) / count(*)::DOUBLE, 6) AS low_pair_sim_fraction,
  round(count(*) FILTER (lpips > 0.35) / count(*)::DOUBLE, 6) AS high_lpips_fraction, round(count(*) FILTER (text_sim < 0.18) / count(*)::DOUBLE, 6) AS low_text_sim_fraction,
  round(count(*) FILTER (face_orig AND NOT face_edited) / count(*)::DOUBLE, 6) AS face_lost_fraction FROM metrics GROUP BY audit_group)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 4 == 0, "control").otherwise(F.col("event_type")).alias("audit_group"), (1 - (e % 61) / F.lit(100.0)).alias("pair_sim"),
        ((e % 37) / F.lit(100.0)).alias("text_sim"), ((e % 53) / F.lit(100.0)).alias("lpips"), (e % 2 == 0).alias("face_orig"), (e % 3 != 0).alias("face_edited"),
    )


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


@query(f"WITH {METRICS_SQL}, {AUDIT_SQL} SELECT * FROM audit")
def audit_by_attribute(spark, sf_dir):
    return rounded(quality.audit(metrics(spark, sf_dir)))


@query(f"""WITH {METRICS_SQL}, {AUDIT_SQL}, c AS (SELECT pair_sim_mean AS control_mean FROM audit WHERE audit_group = 'control')
  SELECT audit_group, low_pair_sim_fraction, pair_sim_mean, control_mean, coalesce(low_pair_sim_fraction < 0.5 AND abs(pair_sim_mean - control_mean) <= 0.1, false) OR audit_group = 'error' AS passes FROM audit LEFT JOIN c ON true WHERE audit_group <> 'control'""")
def audit_gate(spark, sf_dir):
    return rounded(quality.gate(quality.audit(metrics(spark, sf_dir)), most_suspicious=0.5, exempt=("error",)))


@query(f"""WITH p AS (SELECT pair_id, face_id, attribute FROM (SELECT conv_id * 1000 + turn AS pair_id, NULL AS face_id, NULL AS attribute FROM conversations UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), source FROM documents)),
  r AS (SELECT pair_id, coalesce(CASE WHEN face_id IS NULL THEN 'control' END, attribute) AS audit_group, row_number() OVER (PARTITION BY CASE WHEN face_id IS NULL THEN 'control' ELSE attribute END ORDER BY {key_sql(5, 'pair_id')}, pair_id) AS rn FROM p)
  SELECT pair_id, audit_group FROM r WHERE rn <= CASE WHEN audit_group = 'control' THEN 200 ELSE 30 END""")
def audit_sample(spark, sf_dir):
    mix = mixing.concatenate(pairs(spark, sf_dir).select("pair_id"), second(spark, sf_dir))
    return quality.audit_sample(mix, 30, 200, 5, "pair_id").select("pair_id", "audit_group")


@query(f"""WITH r AS (SELECT source AS attribute, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
  k AS (SELECT * FROM r WHERE place <= 12) SELECT attribute, doc_id, CAST(place AS INTEGER) AS place, CAST(34 + (place - 1) * 258 AS INTEGER) AS top, 464 AS sheet_width, 34 + count(*) OVER (PARTITION BY attribute) * 258 AS sheet_height FROM k""")
def contact_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "attribute")
    return quality.contact_manifest(docs, "attribute", "doc_id", "text").drop("caption")


@query("""WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id), lambda x: x::DOUBLE) AS b FROM embeddings)
  SELECT vec_id, label, round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS pair_sim FROM p WHERE b IS NOT NULL""")
def pair_similarity(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings")
    # successors are found on ids alone; the vectors are joined by id
    after = rows.select("vec_id", "label", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("after")).filter("after IS NOT NULL")
    vectors = rows.select("vec_id", "embedding")
    rows = after.join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("after"), F.col("embedding").alias("next")), "after")
    return rows.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("pair_sim"))


VAGUE_SQL = f"v AS (SELECT role AS attribute, conv_id * 1000 + turn AS pair_id, {generic_sql('text', 60)} AS vague, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+')) AS words FROM conversations)"


@query(f"WITH {VAGUE_SQL} SELECT attribute, count(*) AS n, count(*) FILTER (vague) AS vague, CAST(min(words) AS INTEGER) AS least_words, round(avg(words), 6) AS mean_words, CAST(max(words) AS INTEGER) AS most_words, round(count(*) FILTER (vague) / count(*)::DOUBLE, 6) AS vague_fraction FROM v GROUP BY attribute")
def prompt_vagueness(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("attribute"), F.col("text").alias("edit_prompt"))
    return rounded(quality.prompt_vagueness(rows, words=60))


@query(f"WITH {VAGUE_SQL} SELECT attribute, pair_id FROM v WHERE vague QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY {key_sql(6, 'pair_id')}, pair_id) <= 20")
def vague_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("role").alias("attribute"), F.col("text").alias("edit_prompt"))
    return quality.vague_prompts(rows, 20, 6, "pair_id", words=60).select("attribute", "pair_id")


@query(f"WITH {PAIRS_SQL} SELECT pair_id FROM pairs WHERE NOT (face_orig AND NOT face_edited)")
def face_loss_filter(spark, sf_dir):
    return filters.keep_faces(pairs(spark, sf_dir)).select("pair_id")


@query(f"WITH {PAIRS_SQL} SELECT pair_id FROM pairs WHERE face_orig AND face_edited")
def face_required_filter(spark, sf_dir):
    return filters.require_faces(pairs(spark, sf_dir)).select("pair_id")


# ---- evaluation

DETAILS_SQL = """d AS (SELECT t.event_id AS idx, t.event_type AS checkpoint, (t.event_id % 71) / 200.0::DOUBLE AS lpips_trained, (t.event_id % 83) / 200.0::DOUBLE AS lpips_base,
  0.2::DOUBLE + (t.event_id % 29) / 300.0::DOUBLE AS clip_trained, 0.2::DOUBLE + (t.event_id % 31) / 300.0::DOUBLE AS clip_base FROM events t)"""


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    metric = lambda a, b: rows.select(e.alias("idx"), ((e % a) / F.lit(200.0)).alias("lpips"), (F.lit(0.2) + (e % b) / F.lit(300.0)).alias("clip"))
    return evaluation.versus(metric(71, 29), metric(83, 31), "idx").join(rows.select(e.alias("idx"), F.col("event_type").alias("checkpoint")), "idx")


REPORT_SQL = """SELECT checkpoint, count(*) AS n, round(avg(lpips_trained), 6) AS lpips_trained, round(avg(lpips_base), 6) AS lpips_base, round(avg(clip_trained), 6) AS clip_trained, round(avg(clip_base), 6) AS clip_base,
  round(avg(lpips_base) - avg(lpips_trained), 6) AS lpips_improvement, round(avg(clip_trained) - avg(clip_base), 6) AS clip_improvement FROM d GROUP BY checkpoint"""


@query(f"WITH {DETAILS_SQL} {REPORT_SQL}")
def eval_compare(spark, sf_dir):
    return rounded(evaluation.report(details(spark, sf_dir), "checkpoint"))


@query(f"""WITH {DETAILS_SQL}, g AS (SELECT idx, lpips_base - lpips_trained AS gain FROM d)
  (SELECT idx, round(gain, 6) AS gain, 'strongest' AS side FROM g ORDER BY g.gain DESC, idx LIMIT 10) UNION ALL (SELECT idx, round(gain, 6), 'weakest' FROM g ORDER BY g.gain, idx LIMIT 10)""")
def eval_topk(spark, sf_dir):
    return rounded(evaluation.extremes(details(spark, sf_dir), "idx", 10))


@query(f"""WITH {DETAILS_SQL}, r AS (SELECT checkpoint, round(avg(lpips_trained), 6) AS lpips, round(avg(clip_trained), 6) AS clip FROM d GROUP BY checkpoint), v AS (SELECT lpips AS vl, clip AS vc FROM r WHERE checkpoint = 'view'),
  p AS (SELECT checkpoint, lpips, clip, coalesce(lpips < vl AND clip >= 0.2 AND clip >= vc - 0.005, false) AND checkpoint <> 'view' AS passes FROM r LEFT JOIN v ON true)
  SELECT checkpoint, lpips, clip, passes, checkpoint = coalesce((SELECT min_by(checkpoint, lpips) FROM p WHERE passes), 'view') AS chosen FROM p""")
def checkpoint_select(spark, sf_dir):
    reports = rounded(evaluation.report(details(spark, sf_dir), "checkpoint")).select("checkpoint", F.col("lpips_trained").alias("lpips"), F.col("clip_trained").alias("clip"))
    return evaluation.select_checkpoint(reports, "view", least_clip=0.2)


@query("SELECT item_id, CAST(s AS INTEGER) AS seed, source AS checkpoint FROM benchmark, range(42, 45) t(s), (SELECT DISTINCT source FROM documents)")
def eval_grid(spark, sf_dir):
    checkpoints = table(spark, sf_dir, "documents").select(F.col("source").alias("checkpoint")).distinct()
    return evaluation.grid(table(spark, sf_dir, "benchmark").select("item_id"), checkpoints, 42, 3)


@query("""SELECT 'p' || conv_id || '_' || turn AS id, 'user' AS category, text AS prompt FROM conversations WHERE role = 'user'""")
def prompt_suite(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    item = F.struct(F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("category"), F.col("text").alias("prompt"))
    as_list, as_object = F.to_json(F.array(item)), F.to_json(F.struct(F.array(item).alias("prompts")))
    suite = rows.select(F.when(F.col("conv_id") % 2 == 0, as_list).otherwise(as_object).alias("json"))
    return io.prompt_suite(suite, "json").drop("notes")


# ---- what a trainer reads


def uniform_sql(seed: str, column: str) -> str:
    return f"CAST('0x' || substr({key_sql(seed, column)}, 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0"


@query(f"WITH r AS (SELECT o_orderkey, {uniform_sql('3|1', 'o_orderkey')} AS r FROM orders) SELECT o_orderkey, r < 0.1 AS drop_prompt, r >= 0.05 AND r < 0.15 AS drop_image FROM r")
def dropout_masks(spark, sf_dir):
    return feed.dropout_masks(table(spark, sf_dir, "orders").select("o_orderkey"), 0.05, 3, 1, "o_orderkey")


@query(f"SELECT o_orderkey, round({uniform_sql('9', 'o_orderkey')}, 9) AS r FROM orders")
def seeded_draws(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(seeded_uniform(9, "o_orderkey"), 9).alias("r"))


# ---- pixels: image k of a part is 12 + p_size % 7 wide and 10 high; a part in five has vivid corners

WIDE, HIGH = "(12 + p_size % 7)", 10
PIXELS_SQL = f"""px AS (SELECT p_partkey AS id, {WIDE} AS w, x, y, c, (p_partkey * 31 + y * 13 + x * 7 + c * 101) % 256 AS a, (p_partkey * 31 + y * 13 + x * 7 + c * 101 + (p_partkey % 3) * 40) % 256 AS b
  FROM part, range({HIGH}) ty(y), range(18) tx(x), range(3) tc(c) WHERE x < {WIDE})"""


def picture_bytes(start: np.ndarray, wide: np.ndarray) -> pa.Array:
    """Bytes of images by their first sample and width: a sample more a row, column and channel as in PIXELS_SQL, images of one width at a time."""
    parts, places = [], []
    for w in np.unique(wide):
        y, x, c = np.ogrid[:HIGH, :w, :3]
        at = np.flatnonzero(wide == w)
        values = (start[at, None] + (y * 13 + x * 7 + c * 101).reshape(1, -1).astype(np.int16)).astype(np.int16)
        rest = np.fmod(values, 256)
        data = np.where(rest < 0, 255, rest).astype(np.uint8) if (values < 0).any() else values.astype(np.uint8)
        ends = np.arange(len(at) + 1, dtype=np.int32) * data.shape[1]
        parts.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        places.append(at)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))


def images(spark: SparkSession, sf_dir: str, chosen: str = "true") -> DataFrame:
    """pair_id, edit_prompt and two images of each of the chosen parts."""
    part = table(spark, sf_dir, "part").filter(chosen).select(F.col("p_partkey").alias("pair_id"), (12 + F.col("p_size") % 7).cast("int").alias("w"), F.col("p_name").alias("edit_prompt"))
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pair_id")  # narrow rows are dealt out before they become pixels

    def first(shift: Column) -> Column:
        at = F.col("pair_id") * 31 + shift
        return F.when(at >= 0, at % 256).when(at >= -512, at).otherwise(at % 256 - 512).cast("int")  # what is far below zero stays below it

    def draw(batches):
        for batch in batches:
            pair_id, prompt, wide, *firsts = batch.columns
            out = [pair_id, prompt]
            for start in firsts:
                there = wide.is_valid().to_numpy(zero_copy_only=False) & start.is_valid().to_numpy(zero_copy_only=False)
                data = pa.nulls(len(wide), pa.binary())
                if there.any():
                    drawn = picture_bytes(start.filter(pa.array(there)).to_numpy(), wide.filter(pa.array(there)).to_numpy())
                    data = drawn.take(pa.array(np.cumsum(there) - 1, mask=~there))
                side = lambda n: pa.array(np.full(len(wide), n, dtype=np.int32))
                out.append(pa.StructArray.from_arrays([side(HIGH), wide, side(3), data], names=IMAGE.names))
            yield pa.RecordBatch.from_arrays(out, names=["pair_id", "edit_prompt", "original_image", "edited_image"])

    kind = F.lit(None).cast(IMAGE)
    schema = part.select("pair_id", "edit_prompt", kind.alias("original_image"), kind.alias("edited_image")).schema
    return part.select("pair_id", "edit_prompt", "w", first(F.lit(0)), first(F.col("pair_id") % 3 * 40)).mapInArrow(draw, schema)


@query(f"WITH {PIXELS_SQL} SELECT id AS pair_id, round(avg(pow(a / 255.0::DOUBLE - b / 255.0::DOUBLE, 2)), 9) AS mse FROM px GROUP BY id")
def pair_mse(spark, sf_dir):
    return images(spark, sf_dir).select("pair_id", F.round(I.squared_error("original_image", "edited_image"), 9).alias("mse"))


@query(f"""WITH {PIXELS_SQL}, p AS (SELECT id, w, x, y, max(b) AS hi, min(b) AS lo FROM px GROUP BY id, w, x, y)
  SELECT id AS pair_id, round(avg(CASE WHEN hi > 0 AND floor((hi - lo) / hi::DOUBLE * 255) / 255 > 0.8 AND hi / 255.0::DOUBLE > 0.5 THEN 1 ELSE 0 END), 9) AS border FROM p
  WHERE x < 5 OR y < 5 OR x >= w - 5 OR y >= {HIGH} - 5 GROUP BY id""")
def border_anomaly(spark, sf_dir):
    return images(spark, sf_dir).select("pair_id", F.round(I.border_anomaly("edited_image"), 9).alias("border"))


HUES_SQL = f"""p AS (SELECT id, w, x, y, max(b) FILTER (c = 0) AS r, max(b) FILTER (c = 1) AS g, max(b) FILTER (c = 2) AS bl, max(b) AS hi, max(b) - min(b) AS span FROM px GROUP BY id, w, x, y),
  n AS (SELECT *, ((hi - r)::FLOAT / span::FLOAT)::DOUBLE AS rc, ((hi - g)::FLOAT / span::FLOAT)::DOUBLE AS gc, ((hi - bl)::FLOAT / span::FLOAT)::DOUBLE AS bc FROM p WHERE span > 0 AND hi / 255.0::DOUBLE > 0.5 AND floor((span::FLOAT / hi::FLOAT)::DOUBLE * 255) / 255 > 0.8),
  hues AS (SELECT id, w, x, y, 2 * pi() * floor((((CASE WHEN r = hi THEN bc - gc WHEN g = hi THEN 2 + rc - bc ELSE 4 + gc - rc END)::FLOAT::DOUBLE / 6 + 1) % 1)::FLOAT::DOUBLE * 255) / 255 AS hue FROM n)"""


@query(f"""WITH {PIXELS_SQL}, {HUES_SQL}, k AS (SELECT id, count(*) >= 5 AND 1 - sqrt(pow(avg(cos(hue)), 2) + pow(avg(sin(hue)), 2)) > 0.15 AS hit FROM hues WHERE (x < 5 OR x >= w - 5) AND (y < 5 OR y >= {HIGH} - 5) GROUP BY id, x < 5, y < 5)
  SELECT p_partkey AS pair_id, coalesce(bool_or(hit), false) AS strip FROM part LEFT JOIN k ON id = p_partkey GROUP BY p_partkey""")
def corner_strip(spark, sf_dir):
    return images(spark, sf_dir).select("pair_id", I.corner_strip(5, 5)("edited_image").alias("strip"))


@query(f"""WITH {PIXELS_SQL}, g AS (SELECT id, w, x, y, (sum(b * CASE c WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) >> 16 AS l FROM px GROUP BY id, w, x, y),
  k AS (SELECT id, coalesce(min(x) FILTER (l < 60), 0) AS x0, coalesce(max(x) FILTER (l < 60), any_value(w) - 1) AS x1, coalesce(min(y) FILTER (l < 60), 0) AS y0, coalesce(max(y) FILTER (l < 60), {HIGH} - 1) AS y1 FROM g GROUP BY id)
  SELECT id AS pair_id, CAST(x1 - x0 + 1 AS INTEGER) AS width, CAST(y1 - y0 + 1 AS INTEGER) AS height, md5(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY y, x, c)) AS pixels
  FROM px JOIN k USING (id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id, x0, x1, y0, y1""")
def trim_border(spark, sf_dir):
    rows = images(spark, sf_dir).select("pair_id", I.trimmed(60)(F.col("edited_image")).alias("i"))
    return rows.select("pair_id", "i.width", "i.height", F.md5(F.hex("i.data").cast("binary")).alias("pixels"))


@query(f"""WITH {PIXELS_SQL} SELECT id AS pair_id, CAST(any_value(w) - 6 AS INTEGER) AS width, {HIGH} - 6 AS height, md5(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY y, x, c)) AS pixels FROM px
  WHERE x >= 3 AND x < w - 3 AND y >= 3 AND y < {HIGH} - 3 GROUP BY id""")
def crop_border(spark, sf_dir):
    rows = images(spark, sf_dir).select("pair_id", I.cropped(3)(F.col("edited_image")).alias("i"))
    return rows.select("pair_id", "i.width", "i.height", F.md5(F.hex("i.data").cast("binary")).alias("pixels"))


LANCZOS = 3, "CASE WHEN abs(d) >= 3 THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END"
BICUBIC = 2, "CASE WHEN abs(d) < 1 THEN (1.5::DOUBLE * abs(d) - 2.5::DOUBLE) * d * d + 1 WHEN abs(d) < 2 THEN (((abs(d) - 5) * abs(d) + 8) * abs(d) - 4) * -0.5::DOUBLE ELSE 0 END"


def resized_sql(width: str, height: str, kernel: tuple[int, str] = LANCZOS, value: str = "b") -> str:
    """CTEs from px to `out_<value>` (id, w, x, y, c, v): an image at width x height (of w) by a kernel, rounded after each direction."""
    lobes, weight = kernel

    def weights(size: str, to: str) -> str:
        scale, wide = "size / n::DOUBLE", "greatest(size / n::DOUBLE, 1)"
        return f"""SELECT size, n, i, j, f / sum(f) OVER (PARTITION BY size, n, i) AS f FROM (SELECT size, n, i, j, {weight} AS f
      FROM (SELECT size, n, i, j, (j + 0.5 - (i + 0.5) * {scale}) / {wide} AS d FROM (SELECT DISTINCT {size} AS size, {to} AS n FROM px), range(64) ti(i), range(18) tj(j)
        WHERE i < n AND j < size AND j >= floor((i + 0.5) * {scale} - {lobes} * {wide} + 0.5) AND j < floor((i + 0.5) * {scale} + {lobes} * {wide} + 0.5)))"""

    return f"""across_{value} AS ({weights('w', width)}), down_{value} AS ({weights(str(HIGH), height)}),
  wide_{value} AS (SELECT id, w, i AS x, y, c, least(255, greatest(0, floor(round(sum(f * {value}), 9) + 0.5))) AS v FROM px JOIN across_{value} ON size = w AND j = x GROUP BY id, w, i, y, c),
  out_{value} AS (SELECT id, w, x, i AS y, c, CAST(least(255, greatest(0, floor(round(sum(f * v), 9) + 0.5))) AS INTEGER) AS v FROM wide_{value} JOIN down_{value} ON n = {height} AND j = y GROUP BY id, w, x, i, c)"""


BYTES_SQL = "md5(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY y, x, c)) AS pixels"
BOUNDED = ("CAST(CASE WHEN w > 14 THEN 14 ELSE w END AS INTEGER)", f"CAST(CASE WHEN w > 14 THEN floor({HIGH} * 14 / w::DOUBLE) ELSE {HIGH} END AS INTEGER)")


@query(f"WITH {PIXELS_SQL}, {resized_sql(*BOUNDED)} SELECT id AS pair_id, {BOUNDED[0]} AS width, {BOUNDED[1]} AS height, {BYTES_SQL} FROM out_b GROUP BY id, w")
def bounded_size(spark, sf_dir):
    rows = images(spark, sf_dir).select("pair_id", I.bounded(14)(F.col("edited_image")).alias("i"))
    return rows.select("pair_id", "i.width", "i.height", F.md5(F.hex("i.data").cast("binary")).alias("pixels"))


@query(f"WITH {PIXELS_SQL}, {resized_sql('8', '8')} SELECT id AS pair_id, 8 AS width, 8 AS height, {BYTES_SQL} FROM out_b GROUP BY id")
def lanczos_resize(spark, sf_dir):
    rows = images(spark, sf_dir).select("pair_id", I.squared(8)(F.col("edited_image")).alias("i"))
    return rows.select("pair_id", "i.width", "i.height", F.md5(F.hex("i.data").cast("binary")).alias("pixels"))


BORDER_SQL = f"""border AS (SELECT id, avg(CASE WHEN hi > 0 AND floor((hi - lo) / hi::DOUBLE * 255) / 255 > 0.8 AND hi / 255.0::DOUBLE > 0.5 THEN 1 ELSE 0 END) AS border
  FROM (SELECT id, w, x, y, max(b) AS hi, min(b) AS lo FROM px GROUP BY id, w, x, y) WHERE x < 5 OR y < 5 OR x >= w - 5 OR y >= {HIGH} - 5 GROUP BY id)"""


@query(f"""WITH {PIXELS_SQL}, {resized_sql('64', '64', BICUBIC, 'a')}, {resized_sql('64', '64', BICUBIC, 'b')}, {BORDER_SQL},
  ma AS (SELECT id, c, avg(v) AS m FROM out_a GROUP BY id, c), mb AS (SELECT id, c, avg(v) AS m FROM out_b GROUP BY id, c),
  d AS (SELECT id, max(mb.m - ma.m) FILTER (c = 0) AS r, max(mb.m - ma.m) FILTER (c = 1) AS g, max(mb.m - ma.m) FILTER (c = 2) AS b FROM ma JOIN mb USING (id, c) GROUP BY id),
  f AS (SELECT r, g, b, border, {PERSON.format('p_name')} AS person FROM d JOIN border USING (id) JOIN part ON id = p_partkey)
  SELECT count(*) AS n, round(avg(r), 2) AS delta_r, round(avg(g), 2) AS delta_g, round(avg(b), 2) AS delta_b, round(count(*) FILTER (r > 2 AND b > 2 AND g < 0) / count(*)::DOUBLE, 4) AS magenta_fraction,
    round(count(*) FILTER (border > 0.01) / count(*)::DOUBLE, 4) AS border_fraction, count(*) FILTER (person) AS persons, round(count(*) FILTER (person) / count(*)::DOUBLE, 4) AS person_fraction FROM f""")
def color_audit(spark, sf_dir):
    return quality.global_audit(jobs.pair_features(images(spark, sf_dir)))
