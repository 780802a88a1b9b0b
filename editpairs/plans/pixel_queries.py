"""More queries over pixels and plug-ins, each against SQL over the same pixels, a row a sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions import png
from editpairs.functions import text as X
from editpairs.functions.image_ops import _arrays, _structs
from editpairs.functions.vectors import cosine
from editpairs.operators import feed, filters, plugins, quality
from editpairs.plans.file_queries import as_png
from editpairs.plans.queries import BICUBIC, BYTES_SQL, HIGH, HUES_SQL, PAIRS_SQL, PIXELS_SQL, images, pairs, query, resized_sql, table, uniform_sql
from editpairs.schema import IMAGE
from editpairs.sources import io

STRIP_SQL = f"k AS (SELECT id, count(*) >= 5 AND 1 - sqrt(pow(avg(cos(hue)), 2) + pow(avg(sin(hue)), 2)) > 0.15 AS hit FROM hues WHERE (x < 5 OR x >= w - 5) AND (y < 5 OR y >= {HIGH} - 5) GROUP BY id, x < 5, y < 5)"


def with_digest(rows: DataFrame, image: str = "i") -> DataFrame:
    """pair_id, width, height and MD5 of an image's bytes in hex."""
    return rows.select("pair_id", f"{image}.width", f"{image}.height", F.md5(F.hex(f"{image}.data").cast("binary")).alias("pixels"))


@query(f"WITH {PIXELS_SQL}, {HUES_SQL}, {STRIP_SQL} SELECT p_partkey AS pair_id FROM part LEFT JOIN k ON id = p_partkey GROUP BY p_partkey HAVING NOT coalesce(bool_or(hit), false)")
def strip_filter_pixels(spark, sf_dir):
    return filters.without_strips(images(spark, sf_dir), I.corner_strip(5, 5)("edited_image")).select("pair_id")


SCALED = "CAST(CASE WHEN 14 / w::DOUBLE >= 1 THEN w ELSE floor(w * (14 / w::DOUBLE)) END AS INTEGER)", f"CAST(CASE WHEN 14 / w::DOUBLE >= 1 THEN {HIGH} ELSE floor({HIGH} * (14 / w::DOUBLE)) END AS INTEGER)"


@query(f"WITH {PIXELS_SQL}, {resized_sql(*SCALED)} SELECT id AS pair_id, {SCALED[0]} AS width, {SCALED[1]} AS height, {BYTES_SQL} FROM out_b GROUP BY id, w")
def scaled_size(spark, sf_dir):
    return with_digest(images(spark, sf_dir).select("pair_id", I.scaled(14)(F.col("edited_image")).alias("i")))


LIKE = "CAST(w - 6 AS INTEGER)", f"CAST({HIGH} - 6 AS INTEGER)"


@query(f"WITH {PIXELS_SQL}, {resized_sql(*LIKE)} SELECT id AS pair_id, {LIKE[0]} AS width, {LIKE[1]} AS height, {BYTES_SQL} FROM out_b GROUP BY id, w")
def resized_like(spark, sf_dir):
    smaller = I.cropped(3)(F.col("original_image"))
    return with_digest(images(spark, sf_dir).select("pair_id", I.resize_like(F.col("edited_image"), smaller).alias("i")))


@query(f"""WITH {PIXELS_SQL}, s AS (SELECT id, w, x, y, c AS k, b AS v FROM px WHERE id % 2 = 0 UNION ALL SELECT id, w, x, y, tk.k, b FROM px, range(3) tk(k) WHERE id % 2 = 1 AND c = 0)
  SELECT id AS pair_id, CAST(any_value(w) AS INTEGER) AS width, {HIGH} AS height, md5(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY y, x, k)) AS pixels FROM s GROUP BY id""")
def rgb_of_other_modes(spark, sf_dir):
    @F.pandas_udf(IMAGE)
    def other(frame: pd.DataFrame, pair_id: pd.Series) -> pd.DataFrame:
        """With an alpha channel, or the red one alone."""
        alike = zip(_arrays(frame), pair_id)
        return _structs([x[:, :, :1] if k % 2 else np.concatenate((x, np.full((*x.shape[:2], 1), 77, np.uint8)), axis=2) for x, k in alike])

    return with_digest(images(spark, sf_dir).select("pair_id", I.to_rgb(other("edited_image", "pair_id")).alias("i")))


@query(f"""WITH {PIXELS_SQL}, o AS (SELECT *, id % 10 AS o, CAST(w - 1 - x AS INTEGER) AS rx, {HIGH} - 1 - y AS ry FROM px),
  m AS (SELECT id, o, w, c, b AS v, CASE WHEN o IN (2, 3) THEN rx WHEN o = 4 THEN x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN ry ELSE x END AS x,
    CASE WHEN o IN (3, 4) THEN ry WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN rx ELSE y END AS y FROM o)
  SELECT id AS pair_id, CAST(CASE WHEN o BETWEEN 5 AND 8 THEN {HIGH} ELSE any_value(w) END AS INTEGER) AS width, CAST(CASE WHEN o BETWEEN 5 AND 8 THEN any_value(w) ELSE {HIGH} END AS INTEGER) AS height, {BYTES_SQL} FROM m GROUP BY id, o""")
def upright(spark, sf_dir):
    return with_digest(images(spark, sf_dir).select("pair_id", I.oriented(F.col("edited_image"), (F.col("pair_id") % 10).cast("int")).alias("i")))


@query(f"""WITH {PIXELS_SQL}, {resized_sql('8', '8', BICUBIC, 'a')}, {resized_sql('8', '8', BICUBIC, 'b')},
  f AS (SELECT p_partkey AS id, {uniform_sql('flip|3|1', 'p_partkey')} < 0.5 AS flipped FROM part),
  t AS (SELECT id, 0 AS side, x, y, c, v FROM out_a UNION ALL SELECT id, 1, x, y, c, v FROM out_b)
  SELECT id AS pair_id, flipped, md5(string_agg(lpad(hex(v), 2, '0'), '' ORDER BY side, c, y, CASE WHEN flipped THEN -x ELSE x END)) AS samples FROM t JOIN f USING (id) GROUP BY id, flipped""")
def paired_transform(spark, sf_dir):
    @F.pandas_udf("string")
    def samples(tensors: pd.Series) -> pd.Series:
        return tensors.map(lambda t: np.round((np.frombuffer(t, "<f4").astype(np.float64) + 1) * 127.5).astype(np.uint8).tobytes().hex().upper())

    out = feed.training_tensors(images(spark, sf_dir), 8, 3, 1, "pair_id")
    return out.select("pair_id", "flipped", F.md5(samples("tensor").cast("binary")).alias("samples"))


MASK = "(x < 3 + id % 3 AND y < 2 + id % 2)"
LUMA = "(sum({0} * CASE c WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) >> 16"
WINDOW = f"OVER (PARTITION BY id, {{0}} ORDER BY {{1}} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


def boxed(*terms: str) -> str:
    """Sums of terms over 7 x 7 windows that end at each pixel."""
    rows = ", ".join(f"sum({t}) {WINDOW.format('y', 'x')} AS r{k}" for k, t in enumerate(terms))
    both = ", ".join(f"sum(r{k}) {WINDOW.format('x', 'y')} AS s{k}" for k in range(len(terms)))
    return f"SELECT id, x, y, {both} FROM (SELECT id, x, y, {rows} FROM g)"


@query(f"""WITH {PIXELS_SQL}, e AS (SELECT id, avg(pow(a / 255.0::DOUBLE - b / 255.0::DOUBLE, 2)) FILTER (NOT {MASK}) AS mse, avg(CASE WHEN {MASK} THEN 0 ELSE 1 END) AS free FROM px GROUP BY id),
  g AS (SELECT id, x, y, {LUMA.format('a')} AS u, {LUMA.format('b')} AS v, CASE WHEN {MASK} THEN 0 ELSE 1 END AS f FROM px GROUP BY id, x, y), s AS ({boxed('f', 'u', 'v', 'u * u', 'v * v', 'u * v')}),
  m AS (SELECT id, s1 / 49.0::DOUBLE AS a, s2 / 49.0::DOUBLE AS b, s3 / 49.0::DOUBLE AS aa, s4 / 49.0::DOUBLE AS bb, s5 / 49.0::DOUBLE AS ab FROM s WHERE s0 = 49 AND x >= 6 AND y >= 6),
  q AS (SELECT id, avg((2 * a * b + 6.5025::DOUBLE) * (2 * (ab - a * b) + 58.5225::DOUBLE) / ((a * a + b * b + 6.5025::DOUBLE) * (aa - a * a + bb - b * b + 58.5225::DOUBLE))) AS ssim FROM m GROUP BY id)
  SELECT e.id AS pair_id, round(mse, 9) AS mse, round(ssim, 6) AS ssim, round(free, 9) AS free FROM e LEFT JOIN q USING (id)""")
def outside_mask(spark, sf_dir):
    rows = images(spark, sf_dir)
    w, k = F.col("edited_image.width"), F.col("pair_id")
    at = F.sequence(F.lit(0), w * HIGH - 1)
    inside = lambda i: (i % w < 3 + k % 3) & (F.floor(i / w) < 2 + k % 2)
    data = F.unhex(F.array_join(F.transform(at, lambda i: F.when(inside(i), "FF").otherwise("00")), ""))
    mask = F.struct(F.lit(HIGH).alias("height"), w.alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    found = rows.select("pair_id", I.outside_mask("original_image", "edited_image", mask).alias("o"))
    return found.select("pair_id", F.round("o.mse", 9).alias("mse"), F.round("o.ssim", 6).alias("ssim"), F.round("o.free", 9).alias("free"))


@query(f"""WITH {PIXELS_SQL}, {resized_sql('8', '8', value='a')}, {resized_sql('8', '8', value='b')},
  n AS (SELECT p_partkey AS id, 'g' || p_partkey % 5 AS attribute, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS k FROM part QUALIFY k < 3),
  s AS (SELECT attribute, 3 + k * 11 + y AS y, x, c, v FROM out_a JOIN n USING (id) UNION ALL SELECT attribute, 3 + k * 11 + y, x + 10, c, v FROM out_b JOIN n USING (id)),
  z AS (SELECT attribute, 3 + count(*) * 11 AS high FROM n GROUP BY attribute),
  p AS (SELECT z.attribute, high, ty.y, tx.x, tc.c, coalesce(s.v, 255) AS v FROM z, range(40) ty(y), range(18) tx(x), range(3) tc(c) LEFT JOIN s ON s.attribute = z.attribute AND s.y = ty.y AND s.x = tx.x AND s.c = tc.c WHERE ty.y < high)
  SELECT attribute, 18 AS width, CAST(high AS INTEGER) AS height, {BYTES_SQL} FROM p GROUP BY attribute, high""")
def contact_sheets(spark, sf_dir):
    rows = images(spark, sf_dir).withColumn("attribute", F.concat(F.lit("g"), (F.col("pair_id") % 5).cast("string")))
    out = quality.contact_sheets(rows, "attribute", "pair_id", per_group=3, thumb=8, caption=3, gap=2)
    return out.select("attribute", "sheet.width", "sheet.height", F.md5(F.hex("sheet.data").cast("binary")).alias("pixels"))


# ---- plug-ins, with stand-ins for models


def lengths():
    return lambda texts: [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


def brightness():
    return lambda pictures: [[float(x[..., 0].sum()), float(x[..., 1].sum()), 1.0] for x in pictures]


@query("""WITH v AS (SELECT conv_id, turn, length(text)::DOUBLE AS n, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM conversations)
  SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(e AS INTEGER) AS e, round((n * 3 + e + 1) / (sqrt(n * n + e * e + 1) * sqrt(11.0::DOUBLE)), 6) AS text_sim FROM v""")
def text_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", plugins.text_embedding(F.col("text"), lengths).alias("v"))
    fixed = F.array(*map(F.lit, (3.0, 1.0, 1.0)))
    return rows.select("conv_id", "turn", F.get("v", F.lit(0)).cast("int").alias("n"), F.get("v", F.lit(1)).cast("int").alias("e"), F.round(cosine(F.col("v"), fixed), 6).alias("text_sim"))


@query(f"WITH {PIXELS_SQL} SELECT id AS pair_id, CAST(sum(b) FILTER (c = 0) AS INTEGER) AS red, CAST(sum(b) FILTER (c = 1) AS INTEGER) AS green FROM px GROUP BY id")
def picture_embedding(spark, sf_dir):
    rows = images(spark, sf_dir).select("pair_id", plugins.image_embedding(F.col("edited_image"), brightness).alias("v"))
    return rows.select("pair_id", F.get("v", F.lit(0)).cast("int").alias("red"), F.get("v", F.lit(1)).cast("int").alias("green"))


def bright():
    return lambda pictures: [int(x[..., 0].sum()) * 2 > 255 * x.shape[0] * x.shape[1] for x in pictures]


@query(f"WITH {PIXELS_SQL}, f AS (SELECT id, sum(a) FILTER (c = 0) * 2 > 255 * count(*) / 3 AS o, sum(b) FILTER (c = 0) * 2 > 255 * count(*) / 3 AS e FROM px GROUP BY id) SELECT id AS pair_id, o AS face_orig, e AS face_edited FROM f WHERE NOT (o AND NOT e)")
def detected_faces(spark, sf_dir):
    rows = images(spark, sf_dir)
    flags = {"face_orig": plugins.shows_face(F.col("original_image"), bright), "face_edited": plugins.shows_face(F.col("edited_image"), bright)}
    return filters.keep_faces(rows.select("pair_id", *(c.alias(n) for n, c in flags.items())))


def word_sizes():
    return lambda texts: [[len(w) for w in t.split(" ") if w] for t in texts]


@query("WITH i AS (SELECT item_id, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)) AS ids FROM benchmark) SELECT item_id, array_to_string(list_concat(ids[1:77], list_transform(range(greatest(0, 77 - len(ids))), lambda k: 0)), ' ') AS ids FROM i")
def tokenizer_ids(spark, sf_dir):
    ids = X.fixed_length(plugins.token_ids(F.col("text"), word_sizes), 77, 0)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query(f"WITH {PIXELS_SQL} SELECT id AS pair_id, CASE WHEN id % 6 <> 1 THEN CAST(any_value(w) AS INTEGER) ELSE -1 END AS width, CASE WHEN id % 6 <> 1 THEN {HIGH} ELSE -1 END AS height, CASE WHEN id % 6 <> 1 THEN md5(string_agg(lpad(hex(b), 2, '0'), '' ORDER BY y, x, c)) END AS pixels FROM px GROUP BY id")
def decoded_files(spark, sf_dir):
    @F.pandas_udf(IMAGE)
    def decoder(content: pd.Series) -> pd.DataFrame:
        def one(data: bytes):
            try:
                return png.decode(data)
            except ValueError:
                return None

        return _structs([one(d) for d in content])

    content: Column = F.when(F.col("pair_id") % 6 == 1, F.lit("junk").cast("binary")).otherwise(as_png(F.col("edited_image")))
    rows = images(spark, sf_dir).select(F.col("pair_id").cast("string").alias("path"), content.alias("content"))
    found = with_digest(io.decode(rows, decoder).select(F.col("path").cast("long").alias("pair_id"), "image"), "image")
    return found.fillna(-1, ["width", "height"])


@query(f"WITH {PAIRS_SQL} SELECT pair_id AS original, edit_prompt AS prompt, lpips AS edited FROM pairs")
def trainer_columns(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("pair_id", "edit_prompt", "clip", "lpips")
    found = feed.resolve_columns(rows.columns, edited="lpips")
    return rows.select(*(F.col(name).alias(role) for role, name in found.items()))
