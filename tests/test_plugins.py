"""Plug-ins with small models of their own, image columns, and the decoder of files."""

import numpy as np
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions.text import fixed_length
from editpairs.functions.vectors import cosine
from editpairs.operators import filters, plugins
from editpairs.schema import IMAGE
from editpairs.sources import io


def struct(x):
    return (x.shape[0], x.shape[1], x.shape[2], x.tobytes())


def ramp(h, w):
    return np.arange(h * w * 3, dtype=np.uint8).reshape(h, w, 3)


def test_embedders_in_batches(spark):
    df = spark.createDataFrame([(1, "ab", struct(ramp(2, 2))), (2, "ccc", struct(ramp(1, 4))), (3, "", struct(ramp(3, 1)))], f"id int, prompt string, image {IMAGE.simpleString()}")

    def texts():
        def model(items):
            assert len(items) <= 2
            return [[float(len(t)), 1.0] for t in items]

        return model

    def pictures():
        return lambda items: [[float(x.shape[1]), 1.0] for x in items]

    rows = df.select("id", plugins.text_embedding(F.col("prompt"), texts, 2).alias("t"), plugins.image_embedding(F.col("image"), pictures, 2).alias("i"))
    got = {r.id: (r.t, r.i, r.c) for r in rows.withColumn("c", F.round(cosine(F.col("t"), F.col("i")), 6)).collect()}
    assert got[1] == ([2.0, 1.0], [2.0, 1.0], 1.0) and got[2][:2] == ([3.0, 1.0], [4.0, 1.0]) and got[3][:2] == ([0.0, 1.0], [1.0, 1.0])


def test_tokenizer(spark):
    df = spark.createDataFrame([(1, "a bb ccc"), (2, None), (3, "dd")], "id int, prompt string")
    ids = fixed_length(plugins.token_ids(F.col("prompt"), lambda: lambda items: [[len(w) for w in t.split()] for t in items]), 2, 9)
    assert {r.id: r.ids for r in df.select("id", ids.alias("ids")).collect()} == {1: [1, 2], 2: [9, 9], 3: [2, 9]}


def test_distance_and_faces(spark):
    df = spark.createDataFrame([(struct(ramp(2, 2)), struct(ramp(2, 3)))], f"a {IMAGE.simpleString()}, b {IMAGE.simpleString()}")
    model = lambda: lambda xs, ys: [float(x.shape[1] + 10 * y.shape[1]) for x, y in zip(xs, ys)]
    wide = lambda: lambda xs: [x.shape[1] > 2 for x in xs]
    row = df.select(plugins.perceptual_distance(F.col("a"), F.col("b"), model).alias("d"), plugins.shows_face(F.col("a"), wide).alias("x"), plugins.shows_face(F.col("b"), wide).alias("y")).first()
    assert tuple(row) == (32.0, False, True)


def test_faces_are_looked_for_once_where_rows_are_dealt_out(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def loader():
        import uuid

        def model(items):
            (log / uuid.uuid4().hex).write_text(str(len(items)))
            return [x.shape[1] > 2 for x in items]

        return model

    pairs = [(k, struct(ramp(2, 2 + k % 3)), struct(ramp(2, 2 + k % 2))) for k in range(40)]
    df = spark.createDataFrame(pairs, f"id int, a {IMAGE.simpleString()}, b {IMAGE.simpleString()}").repartition(4, "id")
    rows = filters.keep_faces(df.select("id", plugins.shows_face(F.col("a"), loader).alias("face_orig"), plugins.shows_face(F.col("b"), loader).alias("face_edited")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("detect(") < plan.index("Exchange")
    assert {r.id: (r.face_orig, r.face_edited) for r in rows.collect()} == {k: (k % 3 > 0, k % 2 > 0) for k in range(40) if k % 3 == 0 or k % 2 > 0}
    assert sum(int(f.read_text()) for f in log.iterdir()) == 2 * len(pairs)


def test_decoder_of_files(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes([2, 1]) + bytes(range(6)))
    (tmp_path / "b.raw").write_bytes(b"?")

    @F.pandas_udf(IMAGE)
    def decoder(content):
        import pandas as pd

        return pd.DataFrame([[x[1], x[0], 3, x[2:]] if len(x) > 2 else [None] * 4 for x in content], columns=IMAGE.names).astype({c: "Int32" for c in IMAGE.names[:3]})

    rows = io.decode(spark.read.format("binaryFile").load(f"{tmp_path}/*.raw"), decoder)
    got = {r.path.rpartition("/")[2]: (r.image.width, r.image.height, r.image.data) for r in rows.collect()}
    assert got == {"a.raw": (2, 1, bytes(range(6))), "b.raw": (None, None, None)}


def test_scaled_and_oriented_columns(spark):
    df = spark.createDataFrame([(6, struct(ramp(4, 8))), (1, struct(ramp(4, 8)))], f"tag int, image {IMAGE.simpleString()}")
    got = {r.tag: r for r in df.select("tag", I.scaled(4)(F.col("image")).alias("s"), I.oriented(F.col("image"), F.col("tag")).alias("o")).collect()}
    assert (got[6].s.width, got[6].s.height) == (4, 2) and (got[6].o.width, got[6].o.height) == (4, 8) and (got[1].o.width, got[1].o.height) == (8, 4)
    assert got[6].o.data == np.ascontiguousarray(np.rot90(ramp(4, 8), -1)).tobytes()


def test_rename_present(spark):
    df = spark.createDataFrame([(1, 2)], "source_img int, other int")
    assert filters.rename_present(df, {"source_img": "original_image", "absent": "x"}).columns == ["original_image", "other"]
