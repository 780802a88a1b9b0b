import pytest
from pyspark.sql import functions as F

from editpairs.functions.text import mentions_person
from editpairs.operators import evaluation, feed, filters, mixing, pairing, quality, sampling


def test_noisy_pairs(spark):
    nan = float("nan")
    rows = [
        (1, "add a red hat to the cat", 0.2, 0.3), (2, "add a red hat to the cat", 0.02, 0.3), (3, "keep all of it as it was", 0.02, 0.3), (4, "add a red hat to the cat", 0.2, 0.1),
        (5, "fix it", 0.01, 0.1), (6, "add a red hat to the cat", nan, nan), (7, "add a red hat to the cat", None, None), (8, "add a red hat to the cat", 0.03, 0.18),
    ]
    got = filters.with_drop_reasons(spark.createDataFrame(rows, "pair_id long, edit_prompt string, lpips double, clip double"))
    reasons = {r.pair_id: r.drop_reasons for r in got.collect()}
    assert reasons == {1: [], 2: ["low_change"], 3: [], 4: ["low_adherence"], 5: ["low_change", "low_adherence", "generic_prompt"], 6: [], 7: [], 8: []}
    stats = mixing.drop_reason_stats(got.filter("pair_id < 6")).first()
    assert (stats.total, stats.dropped, stats.low_change, stats.low_adherence, stats.generic_prompt, stats.dropped_fraction) == (5, 3, 2, 2, 1, 0.6)
    empty = mixing.drop_reason_stats(got.filter("false")).first()
    assert (empty.total, empty.dropped_fraction, empty.mean_lpips) == (0, 0.0, 0.0)


def test_face_rules(spark):
    faces = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, False, False), (5, None, None)], "id int, face_orig boolean, face_edited boolean")
    assert [r.id for r in filters.keep_faces(faces).orderBy("id").collect()] == [1, 3, 4, 5]
    assert [r.id for r in filters.require_faces(faces).orderBy("id").collect()] == [1, 5]
    assert filters.require_faces(faces.select("id")).count() == 5


def test_oversample(spark):
    df = spark.createDataFrame([(1, "a man"), (2, "a car"), (3, "she"), (4, "sky")], "id int, p string")
    assert sorted(r.id for r in mixing.oversample(df, mentions_person(F.col("p")), 2).collect()) == [1, 1, 2, 3, 3, 4]
    with pytest.raises(ValueError):
        mixing.oversample(df, F.lit(True), 0)
    assert mixing.oversample_stats(df, "p", 2).first().mixed == 6
    assert mixing.oversample_stats(df.filter("false"), "p", 2).first().person_fraction == 0.0


def test_splits(spark):
    df = spark.createDataFrame([("train",), ("dev",)], "split string")
    assert {r.split for r in mixing.normalize_split(df).collect()} == {"train", "validation"}
    both = df.union(spark.createDataFrame([("validation",)], "split string"))
    assert sorted(r.split for r in mixing.normalize_split(both).collect()) == ["train", "validation"]


def test_stratified_sample_is_exact_and_stable(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "all").otherwise("none").alias("s"))
    targets = spark.createDataFrame([("big", 300), ("all", None), ("zero", 0), ("absent", 4)], "s string, target int")
    a = sampling.stratified(df, "s", "id", targets, 1)
    assert {r.s: r["count"] for r in a.groupBy("s").count().collect()} == {"big": 300, "all": 300}
    b = sampling.stratified(df.repartition(13), "s", "id", targets, 1)
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}
    assert {r.id for r in a.collect()} != {r.id for r in sampling.stratified(df, "s", "id", targets, 2).collect()}


def test_sample_of_unequal_strata(spark):
    rows = [("1", "glasses"), ("2", "glasses"), ("3", "hair"), ("4", "hair"), ("5", "anime")]
    pairs = spark.createDataFrame(rows, "entry string, attribute string")
    targets = spark.createDataFrame([("glasses", None), ("hair", 1), ("anime", 0)], "attribute string, target int")
    got = sampling.capped(sampling.stratified(pairs, "attribute", "entry", targets, 0), 10, "entry", 1)
    assert got.count() == 3 and {r.attribute for r in got.collect()} == {"glasses", "hair"}


def test_subset_cap_dedup_order(spark):
    df = spark.range(50)
    assert sampling.random_subset(df, 7, "id", 1).count() == 7 and sampling.capped(df, 100, "id", 1).count() == 50
    with pytest.raises(ValueError):
        sampling.random_subset(df, 51, "id", 1)
    turns = spark.createDataFrame([("a", 1, 5, None), ("a", 1, 3, None), ("a", 2, 9, None), ("a", 1, 1, "f")], "img_id string, turn_index int, pair_id int, face_id string")
    assert sorted(r.pair_id for r in sampling.dedup_turns(turns, "pair_id").collect()) == [3, 9]
    ids = spark.createDataFrame([("10",), ("9",), ("100",)], "id string")
    assert [r.id for r in sampling.by_number(ids, "id").collect()] == ["9", "10", "100"]
    keys = [r.shuffle_key for r in sampling.shuffled(df, 3, "id").collect()]
    assert keys == sorted(keys)


def test_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert mixing.differences(a, a).count() == 0
    assert sorted((r.id, r.only_in) for r in mixing.differences(a, spark.createDataFrame([(1,), (3,), (2,)], "id int")).collect()) == [(1, "left"), (3, "right")]


def test_instruction_shapes(spark):
    rows = [
        (1, '{"a.jpg": "  plain ", "b.jpg": {"instruction": "", "prompt": " p ", "edited_file": "c.jpg"}, "n": 3, "l": ["x"], "e": ""}'),
        (2, '["one", {"text": "two"}, {"output": "three", "image": "i.png"}, 4, {"file": "only"}, ""]'), (3, '"text"'), (4, "7"), (5, "not json"), (6, None), (7, "{}"),
        (8, '{"k": {"instruction": 0, "prompt": false, "edit_prompt": null, "text": "0"}}'),
    ]
    got = pairing.instructions(spark.createDataFrame(rows, "id int, json string"), "json").collect()
    assert sorted((r.id, r.edited_file or "", r.prompt) for r in got) == [
        (1, "a.jpg", "  plain "), (1, "c.jpg", "p"), (2, "", "one"), (2, "", "two"), (2, "i.png", "three"), (8, "k", "0"),
    ]


def test_file_resolution(spark):
    files = spark.createDataFrame([(d, n, f"{d}/{n}") for d, n in [("d", "f.jpg"), ("d", "42_f.jpg"), ("e", "x.PNG"), ("g", "original_42.jpg"), ("g", "z_42.jpg"), ("g", "a.jpg"), ("h", "b.jpg"), ("h", "a.jpg"), ("k", "no.txt")]], "dir string, name string, path string")
    pairs = spark.createDataFrame([(1, "d", "42", "f"), (2, "d", "42", "g"), (3, "e", "42", None), (4, "g", "42", None), (5, "h", "42", None), (6, "k", "42", None), (7, "d", "7", "f.jpg")], "entry int, dir string, face_id string, edited_file string")
    assert {r.entry: r.edited_path for r in pairing.resolve_named(pairs, files, "entry").collect()} == {1: "d/f.jpg", 7: "d/f.jpg"}
    assert {r.entry: r.edited_path for r in pairing.resolve_unnamed(pairs, files, "entry").collect()} == {3: "e/x.PNG", 4: "g/z_42.jpg", 5: "h/a.jpg"}
    originals = spark.createDataFrame([("1.png", "o/1.png"), ("1.jpg", "o/1.jpg"), ("2.jpeg", "o/2.jpeg"), ("3.gif", "o/3.gif")], "name string, path string")
    assert {r.face_id: r.original_path for r in pairing.originals_by_key(originals).collect()} == {"1": "o/1.jpg", "2": "o/2.jpeg"}


@pytest.mark.parametrize("missing, fails", [(0, False), (1, False), (2, True)])
def test_missing_originals(spark, missing, fails):
    pairs = spark.range(100).select(F.col("id").cast("string").alias("face_id"))
    originals = pairs.filter(F.col("face_id").cast("int") >= missing)
    if fails:
        with pytest.raises(ValueError):
            pairing.check_originals(pairs, originals)
    else:
        pairing.check_originals(pairs, originals)
    with pytest.raises(ValueError):
        pairing.check_originals(pairs.filter("false"), originals)


def test_audit_flags_gate_and_sheet(spark):
    rows = [("g", 0.9, 0.3, 0.1, True, True), ("g", 0.5, 0.3, 0.1, True, True), ("g", 0.9, 0.3, 0.5, True, True), ("g", 0.9, 0.1, 0.1, True, True), ("g", 0.9, 0.3, 0.1, True, False), ("none", 0.9, 0.3, 0.1, False, False), ("control", 0.94, 0.3, 0.1, True, True)]
    summary = quality.audit(spark.createDataFrame(rows, "audit_group string, pair_sim double, text_sim double, lpips double, face_orig boolean, face_edited boolean"))
    r = {x.audit_group: x for x in summary.collect()}
    assert [r["g"][f"{k}_count"] for k in ("low_pair_sim", "high_lpips", "low_text_sim", "face_lost")] == [1] * 4 and r["g"].face_lost_fraction == 0.2
    assert r["none"].face_lost_count == 0
    assert {x.audit_group: x.passes for x in quality.gate(summary).collect()} == {"g": False, "none": True}
    assert {x.audit_group: x.passes for x in quality.gate(summary, exempt=("g",)).collect()}["g"]
    sheet = quality.contact_manifest(spark.createDataFrame([(i, "g", "add glasses") for i in range(3)], "id int, a string, p string"), "a", "id", "p").collect()
    assert {(s.sheet_width, s.sheet_height) for s in sheet} == {(464, 34 + 3 * 258)} and sorted(s.top for s in sheet) == [34, 292, 550]


def test_evaluation(spark):
    ck = spark.createDataFrame([("v2", 0.24, 0.251), ("a", 0.23, 0.252), ("b", 0.22, 0.2), ("c", 0.23, 0.26)], "checkpoint string, lpips double, clip double")
    got = {r.checkpoint: (r.passes, r.chosen) for r in evaluation.select_checkpoint(ck, "v2").collect()}
    assert got == {"v2": (False, False), "a": (True, True), "b": (False, False), "c": (True, False)}
    back = evaluation.select_checkpoint(ck.filter("checkpoint IN ('v2', 'b')"), "v2").filter("chosen").first()
    assert back.checkpoint == "v2"
    m = lambda rows: spark.createDataFrame(rows, "idx int, lpips double, clip double")
    d = evaluation.versus(m([(1, 0.1, 0.3), (2, 0.3, 0.3)]), m([(1, 0.2, 0.25), (2, 0.2, 0.25)]), "idx")
    r = evaluation.report(d).first()
    assert r.n == 2 and abs(r.lpips_improvement) < 1e-9 and abs(r.clip_improvement - 0.05) < 1e-9
    assert [(x.side, x.idx) for x in evaluation.extremes(d, "idx", 1).collect()] == [("strongest", 1), ("weakest", 2)]
    assert evaluation.grid(spark.range(2), spark.createDataFrame([("a",), ("b",)], "checkpoint string"), 42, 3).count() == 12


def test_feed(spark):
    cols = ["img", "text", "out"]
    assert feed.resolve_columns(cols) == {"original": "img", "prompt": "text", "edited": "out"}
    assert feed.resolve_columns(cols, original="out")["original"] == "out"
    assert feed.resolve_columns(["text", "a", "b"], {"original": "a", "prompt": "text", "edited": "b"})["edited"] == "b"
    with pytest.raises(ValueError):
        feed.resolve_columns(cols, prompt="absent")
    ids = spark.range(4000)
    m = feed.dropout_masks(ids, 0.05, 1, 0, "id").agg(F.avg(F.col("drop_prompt").cast("int")).alias("p"), F.avg(F.col("drop_image").cast("int")).alias("i"), F.avg((F.col("drop_prompt") & F.col("drop_image")).cast("int")).alias("b")).first()
    assert abs(m.p - 0.1) < 0.03 and abs(m.i - 0.1) < 0.03 and abs(m.b - 0.05) < 0.02
    assert feed.dropout_masks(ids, None, 1, 0, "id").filter("drop_prompt OR drop_image").count() == 0
