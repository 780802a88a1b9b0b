import pytest
from pyspark.sql import functions as F

from editpairs.functions import text as X
from editpairs.functions.hashing import seeded_key, seeded_uniform
from editpairs.functions.vectors import cosine, cosine_batch


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "p string").select(function(F.col("p")).alias("x")).first().x


@pytest.mark.parametrize("prompt, expected", [
    ("add a hat to the man", True), ("make the Woman smile", True), ("SHE waves", True), ("a selfie, please", True), ("the facet of a statue", False), ("then there", False),
    ("give her a hat", False), ("éhe", False), ("human", False), ("face-lift", True), (None, False), ("", False),
])
def test_person(spark, prompt, expected):
    assert one(spark, prompt, X.mentions_person) is expected


@pytest.mark.parametrize("prompt, words, expected", [
    ("Make it better", 3, True), ("an enhanced photo of three red cats", 3, True), ("red car", 3, True), ("add car", 3, False), ("red car there now", 3, False),
    ("", 3, True), ("enhance", 0, False), (None, 3, False), ("é ü", 3, True),
])
def test_generic(spark, prompt, words, expected):
    assert one(spark, prompt, lambda c: X.is_generic(c, words)) is expected


def test_normalize_keep_action_slug(spark):
    assert one(spark, " \t Add a Hat \n", X.normalize_prompt) == "Add a Hat"
    assert one(spark, "  ", X.normalize_prompt) is None and one(spark, None, X.normalize_prompt) is None
    assert one(spark, "the keeper", X.keeps_intent) and not one(spark, "turn it", X.keeps_intent) and one(spark, None, X.keeps_intent) is False
    assert [one(spark, p, X.action) for p in ("Remove and replace", "replace it", "MAKE it", "add")] == ["remove", "replace", "change", "other"]
    assert one(spark, "  Añade: un  sombrero -- rojo!  ", X.slug) == "añade_un_sombrero_rojo"
    assert len(one(spark, "word " * 30, X.slug)) == 40


def test_fixed_length_and_caption(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "ids array<int>")
    assert [r.x for r in df.select(X.fixed_length(F.col("ids"), 2, 0).alias("x")).collect()] == [[1, 2], [0, 0], [0, 0]]
    short = spark.createDataFrame([("a  b\n" + "word " * 40,), (None,)], "p string").select(X.shorten_caption("p").alias("x")).collect()
    assert len(short[0].x) <= 90 and short[0].x.startswith("a b word") and short[0].x.endswith("…") and short[1].x is None


def test_seeds_do_not_depend_on_partitions(spark):
    ids = spark.range(100)
    a = {r.id: (r.k, r.u) for r in ids.select("id", seeded_key(1, "id").alias("k"), seeded_uniform(1, "id").alias("u")).collect()}
    b = {r.id: (r.k, r.u) for r in ids.repartition(7).select("id", seeded_key(1, "id").alias("k"), seeded_uniform(1, "id").alias("u")).collect()}
    assert a == b and all(0 <= u < 1 for _, u in a.values())


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine_batch("a", "b").alias("y")).collect()
    assert abs(got[0].x - 2**-0.5) < 1e-9 and abs(got[0].y - 2**-0.5) < 1e-9 and got[1].x is None and got[2].x is None


def test_captions_equal_the_standard_library(spark):
    import random
    import textwrap

    rng = random.Random(1)
    parts = ["a", "wörd", "well-known", "state-of-the-art", "--", "em--dash", "x-1", "1-2-3", "-", "'tis-it", "e-mail", "…", "  ", "\t\n", " ", "　", "longer", "it's--so", "a-b", "über-groß", "(so-called)", "9-to-5", "z" * 30, "-" * 12]
    texts = ["", " ", "short", "x" * 90, "x" * 91, "y" * 200, "a " * 60, "w " + "x" * 300, "ab-" + "x" * 300, "q " * 20 + "zz-yy-" + "x" * 200, "-" * 200, "--" + "x" * 300, "a" * 50 + "-" + "b" * 39, None]
    texts += [rng.choice(["", " "]) + rng.choice([" ", "  ", ""]).join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(10, 40))) for _ in range(600)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.shorten_caption(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.c == (None if texts[r.k] is None else textwrap.shorten(texts[r.k], width=90, placeholder="…")), repr(texts[r.k])
