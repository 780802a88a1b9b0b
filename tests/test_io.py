import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from editpairs.operators import mixing
from editpairs.plans import jobs
from editpairs.sources import io
from editpairs.streaming import pairs as stream


def png(path, w, h, color):
    row = b"\0" + bytes(color) * w
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(row * h)) + chunk(b"IEND", b""))


def test_pairs_by_split_and_flat(spark, tmp_path):
    for s in ("train", "dev"):
        spark.createDataFrame([(s,)], "x string").write.parquet(f"{tmp_path}/a/data/{s}")
    assert {(r.x, r.split) for r in io.read_pairs(spark, f"{tmp_path}/a").collect()} == {("train", "train"), ("dev", "dev")}
    spark.createDataFrame([("f",)], "x string").coalesce(1).write.parquet(f"{tmp_path}/flat")
    (tmp_path / "b/data").mkdir(parents=True)
    for f in (tmp_path / "flat").glob("*.parquet"):
        f.rename(tmp_path / "b/data" / f.name)
    assert [(r.x, r.split) for r in io.read_pairs(spark, f"{tmp_path}/b").collect()] == [("f", "train")]


def test_prepared_and_stats(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "validation")], "id int, split string")
    io.write_prepared(df, f"{tmp_path}/out", mixing.split_stats(df))
    assert io.read_prepared(spark, f"{tmp_path}/out").count() == 2 and spark.read.json(f"{tmp_path}/out_stats").count() == 2
    with pytest.raises(ValueError):
        io.write_prepared(df.drop("split"), f"{tmp_path}/no")


def test_tree_to_loaded_pairs(spark, tmp_path):
    base = tmp_path / "dataset/instruct_dataset/train/Glasses/42"
    for name, color in (("42_addglasses.png", (255, 0, 0)), ("42_removeglasses.png", (0, 255, 0)), ("other.png", (9, 9, 9))):
        png(base / name, 6, 4, color)
    (base / "plain.webp").write_bytes(b"no format that is read here")
    (base / "instruct.json").write_text(json.dumps({"addglasses": "add glasses", "removeglasses": "remove glasses", "absent": "nothing", "plain.webp": "any suffix"}))
    png(tmp_path / "orig/43.png", 8, 8, (0, 0, 255))
    png(tmp_path / "orig/42.png", 8, 8, (0, 0, 255))
    assert io.tree_root(spark, str(tmp_path / "dataset")).endswith("dataset/instruct_dataset") and io.tree_root(spark, str(tmp_path)).endswith("dataset/instruct_dataset")
    found = jobs.discover_pairs(spark, str(tmp_path / "dataset"))
    rows = found.collect()
    assert len(rows) == 3 and {(r.face_id, r.attribute) for r in rows} == {("42", "glasses")}
    assert any(r.edited_path.endswith("/plain.webp") for r in rows)
    nested = tmp_path / "a/b/c/d/e/f/instruct_dataset/train"
    nested.mkdir(parents=True)
    assert io.tree_root(spark, str(tmp_path / "a")).endswith("f/instruct_dataset")
    targets = io.merged_weights(spark, jobs.ATTRIBUTE_TARGETS)
    chosen = jobs.prepare_second_source(found, io.image_inventory(spark, str(tmp_path / "orig")), targets, 10, 1)
    loaded = jobs.load_second_source(chosen, side=5).collect()
    assert {(r.original_image.width, r.edited_image.width, r.edited_image.data[:3]) for r in loaded} == {(5, 5, bytes([255, 0, 0])), (5, 5, bytes([0, 255, 0]))}
    read = io.read_chosen_images(spark, chosen.select(F.col("original_path").alias("path"))).collect()
    assert [r.path.rpartition("/")[2] for r in read] == ["42.png"]  # no other file of the folder is decoded
    from editpairs.operators.pairing import originals_by_key

    stats = jobs.second_source_stats(found, originals_by_key(io.image_inventory(spark, str(tmp_path / "orig")))).first()
    assert (stats.records, stats.originals, stats.missing, stats.num_selected, stats.per_attribute) == (3, 1, 0, 3, {"glasses": 3})


def test_image_folder_and_broken_image(spark, tmp_path):
    png(tmp_path / "a.png", 3, 2, (1, 2, 3))
    (tmp_path / "b.png").write_bytes(b"junk")
    (tmp_path / "metadata.jsonl").write_text('{"file_name": "a.png", "text": "one"}\n{"file_name": "b.png", "text": "two"}\n')
    got = {r.text: r.image for r in io.read_image_folder(spark, str(tmp_path)).collect()}
    assert got["one"].data[:3] == bytes([1, 2, 3]) and got["two"] is None


@pytest.mark.parametrize("few", [1000, 1])
def test_image_folder_of_many_kinds(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(io, "FEW", few)
    root = tmp_path / "a folder"
    names = ["a.png", "sub/b c+d.png", "_hidden.png", "no suffix"]
    for k, name in enumerate(names):
        png(root / name, 3 + k, 2, (k, 2, 3))
    png(tmp_path / "outside.png", 1, 1, (0, 0, 0))
    java = spark._jvm
    drawn = java.java.awt.image.BufferedImage(5, 4, 1)
    for x in range(5):
        for y in range(4):
            drawn.setRGB(x, y, 0xC08040)
    for kind in ("jpg", "bmp", "gif"):
        assert java.javax.imageio.ImageIO.write(drawn, kind, java.java.io.File(f"{root}/x+ {kind}.{kind}"))
    whole = (root / "a.png").read_bytes()
    (root / "cut.png").write_bytes(whole[:-20])
    (root / "empty.png").write_bytes(b"")
    (root / "junk.jpg").write_bytes(b"junk")
    other = [f"x+ {kind}.{kind}" for kind in ("jpg", "bmp", "gif")]
    broken, gone = ["cut.png", "empty.png", "junk.jpg"], ["absent.png", "absent.jpg", "sub", "a.png/b.png", "../outside.png", None]
    lines = [{"text": f"t{k}", "file_name": n} for k, n in enumerate([*names, "a.png", *other, *broken, *gone])]
    (root / "metadata.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = io.read_image_folder(spark, f"file:{root}/")
    assert rows.columns == ["file_name", "text", "image"]
    got = {r.text: (r.file_name, r.image) for r in rows.collect()}
    assert len(got) == 5 + 3 + 3 and {n for n, _ in got.values()} == {*names, *other, *broken}
    for k in range(5):
        name, image = got[f"t{k}"]
        assert (image.width, image.height, image.channels) == (3 + k % 4, 2, 3) and image.data == bytes([k % 4, 2, 3]) * (2 * (3 + k % 4))
    for k in range(5, 8):
        image = got[f"t{k}"][1]
        assert (image.width, image.height) == (5, 4) and all(abs(v - w) <= 3 for v, w in zip(image.data, bytes([0xC0, 0x80, 0x40]) * 20, strict=True))
    assert all(got[f"t{k}"][1] is None for k in range(8, 11))


def test_image_folder_lists_no_folder_and_shuffles_no_pixel(spark, tmp_path):
    for k in range(40):
        png(tmp_path / f"{k}.png", 3, 2, (k, 2, 3))
    (tmp_path / "metadata.jsonl").write_text("\n".join(json.dumps({"file_name": f"{k}.png", "text": str(k)}) for k in range(40)))
    rows = io.read_image_folder(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FileScan image" not in plan and plan.index("MapInArrow") < plan.index("Exchange")  # pixels are made above the exchange
    assert {r.text: r.image.data[0] for r in rows.collect()} == {str(k): k for k in range(40)}


def test_prompt_suites_and_weights(spark, tmp_path):
    (tmp_path / "l.json").write_text('["Make it Red!", {"id": "x", "prompt": "p", "category": "c"}]')
    (tmp_path / "o.json").write_text('{"prompts": [{"prompt": "q q"}]}')
    got = io.read_prompt_suite(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r.id, r.category or "", r.prompt) for r in got) == [("make_it_red", "", "Make it Red!"), ("q_q", "", "q q"), ("x", "c", "p")]
    (tmp_path / "w").write_text('{"hair": null, "anime": 5}')
    got = {r.attribute: r.target for r in io.merged_weights(spark, {"hair": 10, "anime": 0, "age": 3}, f"{tmp_path}/w").collect()}
    assert got == {"hair": None, "anime": 5, "age": 3}


def test_reports(spark, tmp_path):
    details = spark.createDataFrame([(1, 0.1), (2, 0.2)], "idx int, lpips_trained double")
    for name in ("v1", "v2"):
        io.write_report(details.agg(F.count(F.lit(1)).alias("n")), details, f"{tmp_path}/{name}")
    assert {(r.checkpoint, r.n) for r in io.read_reports(spark, f"{tmp_path}/v1", f"{tmp_path}/v2").collect()} == {("v1", 2), ("v2", 2)}
    back = io.read_details(spark, f"{tmp_path}/v1", f"{tmp_path}/v2")
    assert back.groupBy("checkpoint").count().orderBy("checkpoint").collect() == [("v1", 2), ("v2", 2)]


def test_stream_equals_batch(spark, tmp_path):
    kind = "pair_id long, edit_prompt string, lpips double, clip double, original_image string, edited_image string"
    rows = [(1, " add a hat to the red cat ", 0.2, 0.3, "a", "b"), (2, " ", 0.2, 0.3, "a", "b"), (3, "fix it", 0.01, 0.1, "a", "b"), (4, "x", 0.2, 0.3, None, "b")]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in")
    source = spark.read.parquet(f"{tmp_path}/in")
    stream.write_screened(stream.read_pair_stream(spark, f"{tmp_path}/in", source.schema), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, stream.screened(source).collect()))
