import json
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from editpairs.functions import image_ops as I
from editpairs.functions import png
from editpairs.operators import mixing, quality
from editpairs.operators import order_statistics as O
from editpairs.plans import jobs
from editpairs.sources import files, io


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_round_trip(samples):
    x = np.random.default_rng(samples).integers(0, 256, (7, 5, samples)).astype(np.uint8)
    assert (png.decode(png.encode(x)) == x).all()


def filtered(x, kinds):
    """A file whose rows use these filters, by the standard's definition, a byte at a time."""
    h, w, s = x.shape
    flat, out = x.reshape(h, -1).astype(int), b""
    for y, kind in zip(range(h), kinds):
        line = []
        for i in range(w * s):
            a, b, c = flat[y, i - s] if i >= s else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - s] if y and i >= s else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((flat[y, i] - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[s], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 3, 4])
def test_png_filters_and_broken_files(samples):
    x = np.random.default_rng(9).integers(0, 256, (10, 6, samples)).astype(np.uint8)
    data = filtered(x, [0, 1, 2, 3, 4] * 2)
    assert (png.decode(data) == x).all()
    for bad in (b"", data[:-3], data[:60], data[:40] + b"x" + data[41:], b"\xff\xd8\xff"):
        with pytest.raises(ValueError):
            png.decode(bad)
    with pytest.raises(LookupError):
        files.decoded(b"\xff\xd8\xff\xe0", files.default_decoder()) if not _pillow() else (_ for _ in ()).throw(LookupError)


def _pillow():
    try:
        import PIL  # noqa: F401
    except ImportError:
        return False
    return True


def test_deep_and_wide_trees(spark, tmp_path):
    deep = tmp_path / "/".join(f"d{k}" for k in range(5))
    deep.mkdir(parents=True)
    (deep / "x y.txt").write_text("1")
    for k in range(300):
        (tmp_path / f"w{k}").mkdir()
        (tmp_path / f"w{k}/f%20{k}").write_text("ab")
    (tmp_path / ".hidden").write_text("")
    got = files.list_tree(spark, str(tmp_path)).collect()
    assert len(got) == 301 and {r.n_bytes for r in got} == {1, 2} and {r.path for r in got} >= {str(deep / "x y.txt"), f"{tmp_path}/w7/f%207"}
    assert files.list_tree(spark, str(tmp_path), folders=True).count() == 305
    assert files.list_tree(spark, f"{tmp_path}/absent").count() == 0


def test_listing_leaves_in_batches_of_one_size(tmp_path):
    (tmp_path / "wide").mkdir()
    for k in range(50):
        (tmp_path / f"wide/f{k}").write_text("abc")
        (tmp_path / f"n{k}").mkdir()
        (tmp_path / f"n{k}/f").write_text("a")
    (tmp_path / "wide/nothing").symlink_to(tmp_path / "absent")
    (tmp_path / "wide/folder").symlink_to(tmp_path / "n1")
    asked = []

    def folders():
        for name in ("wide", "absent", *(f"n{k}" for k in range(50))):
            asked.append(name)
            yield f"{tmp_path}/{name}"

    found = files.listing(folders(), 20)
    sizes = [next(found).num_rows]
    assert sizes == [20] and asked == ["wide"]
    batches = list(found)
    assert sizes + [b.num_rows for b in batches] == [20, 20, 20, 20, 20, 1] and len(asked) == 52
    rows = [r for b in batches for r in b.to_pylist()]
    assert {(r["name"], r["is_folder"], r["n_bytes"]) for r in rows} >= {("f", False, 1)} and {r["path"] for r in rows} >= {f"{tmp_path}/n{k}/f" for k in range(50)}
    wide = [r for b in files.listing(iter([f"{tmp_path}/wide"])) for r in b.to_pylist()]
    assert len(wide) == 51 and [(r["name"], r["n_bytes"]) for r in wide if r["is_folder"]] == [("folder", None)] and {r["dir"] for r in wide} == {f"{tmp_path}/wide"}


def test_equal_files_take_one_inode(spark, tmp_path, monkeypatch):
    import os

    rows = spark.range(0, 60, 1, 2).select(F.format_string(f"{tmp_path}/t/d%d/f%d", F.col("id") % 3, "id").alias("p"), F.concat(F.lit("c"), F.col("id") % 5).alias("c"))
    for _ in range(2):  # a task that is repeated finds its files there
        assert files.write_files(rows, "p", "c", linked=True) == 60
    found = {p: p.stat().st_ino for p in (tmp_path / "t").rglob("f*")}
    assert len(found) == 60 and len(set(found.values())) <= 10 and all(p.read_text() == f"c{int(p.name[1:]) % 5}" for p in found)
    files.write_files(rows.filter("id = 7").withColumn("c", F.lit("new")), "p", "c", linked=True)
    assert sum(p.read_text() == "new" for p in found) == 1
    files.write_files(rows.select(F.concat("p", F.lit("x")).alias("p"), "c"), "p", "c")
    assert len({p.stat().st_ino for p in (tmp_path / "t").rglob("f*x")}) == 60
    a, b = tmp_path / "t/d0/f0", tmp_path / "t/deep/er/f0"
    assert files.named_too(str(a), str(b)) and files.named_too(str(a), str(b)) and b.samefile(a) and not files.named_too(f"{tmp_path}/absent", f"{tmp_path}/y")
    monkeypatch.setattr(os, "link", lambda *_: (_ for _ in ()).throw(OSError(31, "too many links")))
    assert not files.named_too(str(a), f"{tmp_path}/z")


def test_a_tree_has_no_inode_for_each_file(spark):
    import os

    from editpairs.plans import file_queries

    paths = [r.path for r in files.list_tree(spark, file_queries.written_tree(spark, "/root/testdata/sf0.001")).collect()]
    assert len(paths) > 500 and len({os.stat(p).st_ino for p in paths}) < 0.8 * len(paths)


def counted_opener(log):
    def opener():
        import uuid

        def read(path):
            (log / uuid.uuid4().hex).write_text(path)
            return files.read_bytes(path)

        return read

    return opener


def test_chosen_files_are_opened_once_where_they_are_needed(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = []
    for face in range(6):
        (tmp_path / f"{face}.png").write_bytes(png.encode(np.full((9, 9, 3), 40 * face, np.uint8)) if face != 4 else b"broken")
        for k in range(20):
            path = tmp_path / f"{face}_{k}.png"
            path.write_bytes(png.encode(np.full((3, 4, 3), k, np.uint8)) if k != 7 else b"broken")
            rows.append((str(face), "hair", "p", str(tmp_path / f"{face}.png"), str(path)))
    rows += [("9", "hair", "p", str(tmp_path / "absent.png"), rows[0][4]), ("0", "hair", "p", rows[0][3], str(tmp_path / "absent.png"))]
    (tmp_path / "other.png").write_bytes(b"never asked for")
    chosen = spark.createDataFrame(rows, "face_id string, attribute string, prompt string, original_path string, edited_path string")
    loaded = jobs.load_second_source(chosen, side=5, decoder=lambda: png.decode, opener=counted_opener(log))
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.index("MapInArrow") < plan.index("Exchange rangepartitioning")  # pixels are made above the exchange
    got = loaded.collect()
    assert len(got) == 5 * 19 and {(r.original_image.width, r.edited_image.height) for r in got} == {(5, 5)}
    assert {(r.face_id, r.original_image.data[0]) for r in got} == {(str(f), 40 * f) for f in (0, 1, 2, 3, 5)}
    opened = [p.read_text() for p in log.iterdir()]
    tasks = 4
    assert sum("_" not in p.rpartition("/")[2] for p in opened) <= 7 + tasks and len([p for p in opened if "_" in p.rpartition("/")[2]]) == 5 * 20 and not any("other" in p for p in opened)
    images = {r.path: r.image for r in files.load_images(chosen.select(F.col("original_path").alias("path")), decoder=lambda: png.decode).collect()}
    assert len(images) == 7 and images[f"{tmp_path}/4.png"] is None and images[f"{tmp_path}/absent.png"] is None and images[f"{tmp_path}/1.png"].data[0] == 40


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_details_of_reports(spark, tmp_path, chunk):
    details = [{"idx": k, "prompt": text, "more": {"details": [1, {"a": []}]}} for k, text in enumerate(['a "quoted" {one', "]}\\", "é \n", "", 'x\\"'])]
    documents = {
        "v1": {"n": 2, "other": [{"idx": 9}], "note": "details", "details": details, "last": {"details": [{"idx": 8}]}},
        "v2": {"details": []}, "v3": {"details": details[:1], "z": 1}, "v4": {"n": 1},
    }
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document, ensure_ascii=False, indent=2 if name == "v1" else None))
    got = io.read_report_details(spark, str(tmp_path), "idx int, prompt string", chunk=chunk).collect()
    assert sorted((r.checkpoint, r.idx, r.prompt) for r in got) == [*(("v1", d["idx"], d["prompt"]) for d in details), ("v3", 0, details[0]["prompt"])]


@pytest.mark.parametrize("few, bins", [(10_000, 1024), (2, 16)])
def test_exact_percentiles(spark, monkeypatch, few, bins):
    monkeypatch.setattr(O, "FEW", few)
    monkeypatch.setattr(O, "BINS", bins)
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y)) for x, y in zip(rng.normal(size=200), np.exp(rng.normal(size=200) * 20))]
    rows += [("b", 1.0, 5.0)] * 90 + [("b", 2.0, 7.0)] * 10 + [("one", -3.5, None), (None, 1.0, 2.0), (None, 3.0, 2.5), ("empty", None, None), ("huge", 1.7e308, -1.7e308), ("huge", -1.7e308, 1.0), ("nan", float("nan"), float("inf")), ("nan", 4.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    got = {r.g: (r.p, r.q, r.m) for r in O.exact_percentiles(df, "g", {"p": ("x", 0.1), "q": ("y", 0.9), "m": ("x", 0.5)}).collect()}
    finite = df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("x", "y")})
    want = {r.g: (r.p, r.q, r.m) for r in finite.groupBy("g").agg(F.percentile("x", 0.1).alias("p"), F.percentile("y", 0.9).alias("q"), F.percentile("x", 0.5).alias("m")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert [v is None for v in got[g]] == [v is None for v in want[g]]
        assert [v for v in got[g] if v is not None] == pytest.approx([v for v in want[g] if v is not None], rel=1e-12), g
    assert O.exact_percentiles(df.filter("false"), "g", {"p": ("x", 0.1)}).count() == 0


def test_audit_population_equals_audit(spark):
    rows = [(f"g{i % 3}", (i * 37 % 101) / 100, 0.2, (i * 53 % 97) / 100, i % 2 == 0, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "audit_group string, pair_sim double, text_sim double, lpips double, face_orig boolean, face_edited boolean")
    a, b = ({r.audit_group: r.asDict() for r in f(df).collect()} for f in (quality.audit, quality.audit_population))
    assert a.keys() == b.keys()
    for g in a:
        assert a[g] == pytest.approx(b[g])


def test_mix_is_written_in_order_in_one_pass(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()

    @F.pandas_udf("boolean")
    def strip(ids):
        import uuid

        (log / uuid.uuid4().hex).write_text(" ".join(map(str, ids)))
        return ids % 7 == 3

    monkeypatch.setattr(I, "corner_strip", lambda *a: lambda image: strip(F.col("pair_id")))
    rows = [(i, "a man" if i % 2 == 0 else "a car", "train" if i % 5 else "dev", i % 3 == 0, i % 4 == 0, "pixels") for i in range(400)]
    first = spark.createDataFrame(rows, "pair_id int, edit_prompt string, split string, face_orig boolean, face_edited boolean, edited_image string")
    second = spark.createDataFrame([(1000 + i, "x", str(i), "hair") for i in range(50)], "pair_id int, edit_prompt string, face_id string, attribute string")
    funnel = jobs.write_mix(first, second, f"{tmp_path}/mix", 3, 5, tasks=6)
    looked = sorted(int(k) for f in log.iterdir() for k in f.read_text().split())
    assert looked == [r[0] for r in rows if r[2] == "train"]  # each image once
    monkeypatch.undo()
    mix, two_plans = jobs.build_mix(first.withColumn("strip", F.col("pair_id") % 7 == 3), second, 3, 5, "strip")
    a, b = funnel.first().asDict(), two_plans.first().asDict()
    assert a == b and a["final"] == mix.filter("split = 'train'").count() and a == spark.read.json(f"{tmp_path}/mix_stats").select(*a).first().asDict()
    for split in ("train", "validation"):
        found = sorted((tmp_path / f"mix/split={split}").glob("*.parquet"))
        keys = [k for f in found for k in pq.ParquetFile(f).read(columns=["shuffle_key"])["shuffle_key"].to_pylist()]
        assert len(found) > 3 and keys == sorted(keys) and len(keys) == mix.filter(F.col("split") == split).count()
    alone = jobs.write_mix(first.drop("edited_image"), None, f"{tmp_path}/alone", 1, 5).first()
    assert (alone.second_source, alone.dropped_strips) == (0, 0)
    none = jobs.write_mix(first.filter("false"), None, f"{tmp_path}/none", 1, 5).first()
    assert none.final == 0


def test_equal_tables_and_differences(spark):
    rows = [(i, f"t{i % 50}", None if i % 9 == 0 else i / 3) for i in range(1000)]
    kind = "id int, t string, x double"
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(rows[::-1], kind).repartition(5)
    assert mixing.equal_tables(a, b.select("x", "id", "t")) and mixing.differences(a, b.select("x", "id", "t")).count() == 0
    assert not mixing.equal_tables(a, b.drop("x")) and not mixing.equal_tables(a, b.union(b.limit(1)))
    changed = spark.createDataFrame([*rows[1:], (5, "t5", 5 / 3), (0, "t0", 0.0)], kind)  # one gone, one twice, one changed
    got = sorted((r.id, r.only_in, r.x is None) for r in mixing.differences(a, changed).collect())
    assert got == [(0, "left", True), (0, "right", False), (5, "right", False)]
    assert mixing.differing_buckets(a, changed).count() <= 3 and mixing.equal_tables(a.filter("false"), b.filter("false"))


def test_large_samples_are_cut_bucket_by_bucket(spark, monkeypatch):
    from editpairs.operators import sampling

    df = spark.range(3000).withColumn("x", F.col("id") * 2)
    want = {n: sorted(r.id for r in sampling.capped(df, n, "id", 4).collect()) for n in (0, 1, 1700, 2999, 3000, 5000)}
    monkeypatch.setattr(sampling, "TOP", -1)
    for n, ids in want.items():
        got = sampling.capped(df, n, "id", 4)
        assert got.columns == df.columns and sorted(r.id for r in got.collect()) == ids and len(ids) == min(n, 3000)
