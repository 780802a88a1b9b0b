import numpy as np
import pytest
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions import pixels as P
from editpairs.operators import feed, filters, plugins
from editpairs.plans import jobs
from editpairs.schema import IMAGE


def flat(w, h, color):
    return np.full((h, w, 3), color, dtype=np.uint8)


def struct(x):
    return None if x is None else (x.shape[0], x.shape[1], x.shape[2], x.tobytes())


@pytest.mark.parametrize("size, most, want", [((1024, 512), 256, (256, 128)), ((200, 100), 512, (200, 100)), ((300, 300), 128, (128, 128)), ((1000, 1), 10, (10, 0)), ((333, 1000), 512, (170, 512))])
def test_bounded_size(size, most, want):
    assert P.bounded_size(*size, most) == want


def test_scaled_size():
    assert P.scaled_size(1024, 512, 512) == (512, 256) and P.scaled_size(400, 300, 512) == (400, 300)


@pytest.mark.parametrize("kernel", ["lanczos", "bicubic"])
def test_resample(kernel):
    assert (P.resize(flat(50, 30, (7, 99, 250)), 13, 21, kernel) == (7, 99, 250)).all()
    ramp = np.repeat(np.arange(0, 256, 4, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(8, axis=0)
    small = P.resize(ramp, 16, 8, kernel)[0, :, 0].astype(int)
    assert (np.diff(small) > 0).all() and np.abs(small[2:-2] - (np.arange(16) * 16 + 6)[2:-2]).max() <= 1
    with pytest.raises(ValueError):
        P.resize(ramp, 0, 3)


def test_hsv():
    x = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128], [0, 0, 0], [255, 128, 0]]], dtype=np.uint8)
    got = np.round(P.hsv(x)[0] * 255).astype(int).tolist()
    assert got == [[0, 255, 255], [85, 255, 255], [170, 255, 255], [0, 0, 128], [0, 0, 0], [21, 255, 255]]


def test_strips_and_borders():
    gray = flat(64, 64, 128)
    strip = gray.copy()
    for k, c in enumerate([(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]):
        strip[52:, 48 + 4 * k : 52 + 4 * k] = c
    assert P.corner_strip(strip) and not P.corner_strip(gray) and not P.corner_strip(flat(64, 64, (255, 0, 0)))
    assert P.corner_strip(np.ascontiguousarray(strip[::-1, ::-1])) and not P.corner_strip(flat(1, 9, (255, 0, 0)))
    red = gray.copy()
    red[:8] = (255, 0, 0)
    assert P.border_anomaly(red) == pytest.approx(64 * 8 / (64 * 64 - 48 * 48)) and P.border_anomaly(flat(1, 5, (255, 0, 0))) == 0.0


def test_trim_crop_orient():
    x = flat(200, 200, 255)
    x[50:150, 50:150] = 0
    assert P.trim_light(x).shape == (100, 100, 3) and P.trim_light(flat(9, 9, 255)).shape == (9, 9, 3)
    assert P.crop_edges(flat(20, 17, 1)).shape == (1, 4, 3) and P.crop_edges(flat(16, 30, 1)).shape == (30, 16, 3)
    y = np.arange(6, dtype=np.uint8).reshape(2, 3, 1).repeat(3, axis=2)
    assert P.oriented(y, 6)[..., 0].tolist() == [[3, 0], [4, 1], [5, 2]] and P.oriented(y, 3)[..., 0].tolist() == [[5, 4, 3], [2, 1, 0]] and P.oriented(y, 9) is y
    assert P.rgb(np.zeros((2, 2, 4), np.uint8)).shape == (2, 2, 3) and P.rgb(np.zeros((2, 2), np.uint8)).shape == (2, 2, 3)


def images(spark, *arrays):
    return spark.createDataFrame([(i, struct(a)) for i, a in enumerate(arrays)], "id int, i struct<height:int,width:int,channels:int,data:binary>")


def test_columns(spark):
    df = images(spark, flat(1024, 512, 3), None, flat(1000, 1, 3), np.zeros((4, 4, 4), np.uint8))
    got = [r.x and (r.x.width, r.x.height, r.x.channels) for r in df.select(I.bounded(256)(F.col("i")).alias("x"), "id").orderBy("id").collect()]
    assert got == [(256, 128, 3), None, None, (4, 4, 3)]
    broken = spark.createDataFrame([((2, 2, 3, bytes(5)),)], "i struct<height:int,width:int,channels:int,data:binary>")
    assert broken.select(I.to_rgb(F.col("i")).alias("x")).first().x is None
    pair = spark.createDataFrame([(struct(flat(8, 8, 255)), struct(flat(4, 4, 0)))], "a struct<height:int,width:int,channels:int,data:binary>, b struct<height:int,width:int,channels:int,data:binary>")
    row = pair.select(I.squared_error("a", "b").alias("e"), I.resize_like(F.col("b"), F.col("a")).alias("r"), plugins.perceptual_distance(F.col("a"), F.col("b"), lambda: lambda a, b: [7.0] * len(a)).alias("p"), plugins.shows_face(F.col("a"), lambda: lambda x: [True] * len(x)).alias("f")).first()
    assert row.e == 1.0 and row.r.width == 8 and row.p == 7.0 and row.f


def test_valid_pairs(spark):
    ok = struct(flat(256, 256, 1))
    rows = [("  Add a Hat  ", ok, ok, (2, 2, 3, b"")), ("   ", ok, ok, None), ("x", ok, None, None), (None, ok, ok, None)]
    kind = "struct<height:int,width:int,channels:int,data:binary>"
    got = filters.valid_pairs(spark.createDataFrame(rows, f"edit_prompt string, original_image {kind}, edited_image {kind}, mask_img {kind}"), I.bounded(128)).collect()
    assert [(r.edit_prompt, r.original_image.width, r.mask_img) for r in got] == [("Add a Hat", 128, None)]


def test_training_tensors(spark):
    rows = [(i, struct(flat(9, 7, 0)), struct(flat(9, 7, 255))) for i in range(20)]
    kind = "struct<height:int,width:int,channels:int,data:binary>"
    df = spark.createDataFrame(rows, f"id int, original_image {kind}, edited_image {kind}")
    got = feed.training_tensors(df, 4, 1, 0, "id").collect()
    x = np.frombuffer(got[0].tensor, "<f4").reshape(2, 3, 4, 4)
    assert (x[0] == -1).all() and (x[1] == 1).all() and len({r.flipped for r in got}) == 2


def test_features_and_mix(spark):
    strip = flat(64, 64, 128)
    for k, c in enumerate([(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]):
        strip[52:, 48 + 4 * k : 52 + 4 * k] = c
    plain = struct(flat(64, 64, 128))
    rows = [(i, "a man" if i % 2 == 0 else "a car", "train", plain, struct(strip) if i == 3 else plain) for i in range(4)] + [(10 + i, "a man", "dev", plain, plain) for i in range(4)]
    kind = "struct<height:int,width:int,channels:int,data:binary>"
    first = spark.createDataFrame(rows, f"pair_id int, edit_prompt string, split string, original_image {kind}, edited_image {kind}")
    second = spark.createDataFrame([(100, "x", "7", "hair"), (101, "y", "8", "eyes")], "pair_id int, edit_prompt string, face_id string, attribute string")
    mix, funnel = jobs.build_mix(first, second, 2, 1)
    f = funnel.first()
    assert (f.input, f.dropped_strips, f.person_examples, f.second_source, f.final, f.validation) == (4, 1, 2, 2, 7, 4)
    assert {r.split: r["count"] for r in mix.groupBy("split").count().collect()} == {"train": 7, "validation": 4}
    unfiltered, funnel = jobs.build_mix(first.drop("edited_image"), second, 1, 1)
    assert funnel.first().final == 6 and unfiltered.filter("split = 'train'").count() == 6
    got = {r.pair_id: r for r in jobs.pair_features(first).collect()}
    assert got[3].strip and not got[0].strip and got[0].lpips == 0.0 and got[0].delta == [0.0, 0.0, 0.0]


def test_schema():
    assert IMAGE.names == ["height", "width", "channels", "data"]


def test_batches_equal_single_images():
    rng = np.random.default_rng(4)
    xs = [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in [(9, 7), (9, 7), (5, 12), (9, 7), (64, 64), (1, 1), (5, 12)]]
    sizes = [(4, 3), (20, 30), (4, 3), (4, 3), (64, 64), (6, 2), (0, 3)]
    for kernel in ("lanczos", "bicubic"):
        got = P.resize_many(xs, sizes, kernel)
        assert got[-1] is None and all((g == P.resize(x, *size, kernel)).all() for g, x, size in zip(got[:-1], xs, sizes))
    P.TOGETHER, kept = 1, P.TOGETHER
    try:
        assert all((a == b).all() for a, b in zip(P.resize_many(xs[:6], sizes[:6]), [P.resize(x, *size) for x, size in zip(xs, sizes[:6])]))
    finally:
        P.TOGETHER = kept
    assert P.squared_error([xs[0]], [xs[1]]) == pytest.approx([np.mean((xs[0] / 255.0 - xs[1] / 255.0) ** 2)])


def test_outside_mask():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (16, 20, 3)).astype(np.uint8)
    b, mask = a.copy(), np.zeros((16, 20, 3), np.uint8)
    b[:8, :8] = 0
    mask[:8, :8] = 255
    error, similarity, free = P.outside_mask(a, b, mask)
    assert (error, similarity) == (0.0, pytest.approx(1.0)) and free == 1 - 64 / 320
    b[10:] ^= 128
    error, similarity, _ = P.outside_mask(a, b, mask)
    assert error > 0.1 and similarity < 0.9
    assert P.outside_mask(a, b, flat(20, 16, 255)) == (None, None, 0.0) and P.outside_mask(a[:5], b[:5], flat(20, 5, 0))[1] is None
    x = rng.integers(0, 9, (6, 7))
    assert (P.window_sums(x, 3) == [[x[r : r + 3, c : c + 3].sum() for c in range(5)] for r in range(4)]).all()


def test_contact_sheets(spark):
    from editpairs.operators import quality

    kind = IMAGE.simpleString()
    rows = [(g, k, struct(flat(5, 5, 10 * k)), None if (g, k) == ("a", 1) else struct(flat(2, 9, 100))) for g in ("a", "b") for k in range(4 if g == "a" else 1)] + [(None, 7, struct(flat(3, 3, 1)), None)]
    got = {r.g: r.sheet for r in quality.contact_sheets(spark.createDataFrame(rows, f"g string, k int, original_image {kind}, edited_image {kind}"), "g", "k", 3, 4, 2, 1).collect()}
    assert got.keys() == {"a", "b", None} and (got["a"].height, got["a"].width, got["b"].height) == (2 + 3 * 6, 9, 8)
    x = np.frombuffer(got["a"].data, np.uint8).reshape(20, 9, 3)
    assert (x[:2] == 255).all() and (x[2:6, :4] == 0).all() and (x[2:6, 5:] == 100).all() and (x[8:12, :4] == 10).all() and (x[8:12, 4:] == 255).all() and (x[14:18, :4] == 20).all() and (x[:, 4] == 255).all()


def test_pictures_of_parts_by_their_definition(spark, tmp_path):
    from editpairs.plans import queries

    parts = [(k, s, f"p{k}") for k, s in [(0, 1), (7, 50), (8, 6), (-3, 2), (-700, -4), (1 << 50, 3)]] + [(1, None, "x"), (None, 4, "y")]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.edit_prompt: r for r in queries.images(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and got["x"].original_image.data is None and got["y"].edited_image.data is None
    for k, size, name in parts[:6]:
        w = 12 + int(np.fmod(size, 7))
        for image, shift in ((got[name].original_image, 0), (got[name].edited_image, int(np.fmod(k, 3)) * 40)):
            samples = [int(np.fmod(k * 31 + y * 13 + x * 7 + c * 101 + shift, 256)) for y in range(10) for x in range(w) for c in range(3)]
            assert (image.height, image.width, image.channels) == (10, w, 3) and list(image.data) == [v if v >= 0 else 255 for v in samples]
    assert [r.pair_id for r in queries.images(spark, str(tmp_path), "p_partkey = 7").collect()] == [7]
