import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from editpairs.llm import mixing as M
from editpairs.llm.common import written
from editpairs.llm.paragraphs import op7_paragraph_dedup, repeated_paragraphs
from editpairs.llm.tokens import tokenizer_path

VOCABULARY = ["".join(random.Random(k).choice("abcdefghé") for _ in range(5)) for k in range(900)]


def paragraph(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def docs_with_repeats():
    rng = random.Random(8)
    passages = [paragraph(rng, 90) for _ in range(3)]
    rows = []
    for i in range(30):
        parts = [paragraph(rng, rng.choice([10, 60, 120])) for _ in range(3)]
        if i % 3 == 0:
            words = passages[i % 9 // 3].split()
            if i % 2:
                words[5] = "changed"
            parts.insert(1, " ".join(words))
        rows.append((i, "\n".join(parts)))
    return rows + [(50, None), (51, ""), (52, "short\n\n short"), (53, passages[0].upper()), (53, passages[0].upper()), (None, passages[1])]


def test_repeated_paragraphs(spark, tmp_path):
    rows = docs_with_repeats()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, unit string")
    got = repeated_paragraphs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        covered = {k for x in r.repeated for k in range(x.start, x.end)}
        if r.doc_id is None or r.doc_id == 53 or r.doc_id < 30 and r.doc_id % 3 == 0:
            assert 0.7 * 90 * 6 < len(covered) <= 92 * 6, r.doc_id
        else:
            assert not covered
    classes = {}
    for r in got:
        for x in r.repeated:
            classes.setdefault(x.class_doc_id, []).append(x.removed)
    assert all(False in flags and True in flags for flags in classes.values())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op7_paragraph_dedup(spark, str(tmp_path)).collect()}
    assert out[1].n_repeated == 0 and out[1].removed_spans == "" and out[50].n_removed == 0
    assert repeated_paragraphs(docs.filter("false")).count() == 0


def brute_budgets(leaves, total, weights, epochs):
    """Water poured into the tree until no child takes more: by bisection on the level, node by node."""

    def pour(budget, paths, depth):
        if depth == 3:
            return {paths[0]: budget}
        children = {}
        for p in paths:
            children.setdefault(p[depth], []).append(p)
        cap = {c: Fraction(epochs * sum(leaves[p] for p in f)) for c, f in children.items()}
        weight = {c: Fraction(weights.get(M.LEVELS[depth], {}).get(c, 1)) for c in children}
        low, high = Fraction(0), max(cap[c] / weight[c] for c in children)
        for _ in range(60):  # the level at which min(cap, weight * level) sums to the budget
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(cap[c], weight[c] * mid) for c in children) <= budget else (low, mid)
        return {p: b for c, f in children.items() for p, b in pour(min(cap[c], weight[c] * high), f, depth + 1).items()}

    return pour(Fraction(total), sorted(leaves), 0) if leaves else {}


def budgets(spark, leaves, total, weights, epochs):
    frame = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, language string, source_name string, n long")
    return {(r.domain, r.language, r.source_name): r.budget for r in M.budgets(frame, total, weights, epochs).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, lang, s): rng.randrange(1, 500) for d in "ab" for lang in ("en", "fr") for s in ("s", "t", "u") if rng.random() < 0.8}
    weights = {"domain": {"a": 3}, "language": {"en": 2}, "source_name": {"t": 5}}
    total = rng.choice([10, 500, 5000, 10**6])
    got, want = budgets(spark, leaves, total, weights, 2), brute_budgets(leaves, total, weights, 2)
    assert got.keys() == want.keys() and all(-3.01 <= got[p] - want[p] <= 0.01 for p in got)


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("a", "en", "s"): 10, ("a", "en", "t"): 1000, ("b", "en", "s"): 1000}
    assert budgets(spark, leaves, 400, {}, 1) == {("a", "en", "s"): 10, ("a", "en", "t"): 190, ("b", "en", "s"): 200}
    assert budgets(spark, leaves, None, {}, 1) == {("a", "en", "s"): 10, ("a", "en", "t"): 1000, ("b", "en", "s"): 1000}
    assert budgets(spark, {("a", "b", "c"): 10**15}, 10**16, {"domain": {"a": 1000}}, 3) == {("a", "b", "c"): 3 * 10**15}


@pytest.mark.parametrize("total", [None, 300, 9000])
def test_prefixes_of_seeded_epochs(spark, total):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 9))), rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", "src4", "x", None])) for i in range(400)] + [(900, None, "en", "src0"), (901, "", "en", "src0")]
    frame = spark.createDataFrame([(*r, 7, "d", 3, "k") for r in rows], "doc_id long, text string, lang string, source string, epoch int, domain string, n_tokens int, key string")
    docs = written(M.with_tree(frame, tokenizer_path("word_bpe_49k.json")), "tree")
    got = M.mix(docs, total).collect()
    assert {(r.doc.epoch, r.doc.domain, r.doc.n_tokens, r.doc.key) for r in got} == {(7, "d", 3, "k")}
    base = docs.filter("n_tokens > 0").collect()
    assert all(r.n_tokens == len(r.doc.text.split()) for r in base)
    leaves = {}
    for r in base:
        leaves.setdefault((r["domain"], r["language"], r["source_name"]), []).append(r)
    sums = {p: sum(r["n_tokens"] for r in g) for p, g in leaves.items()}
    budget = brute_budgets(sums, sum(sums.values()) if total is None else total, M.WEIGHTS, M.MAX_EPOCHS)
    keys = {(r.doc_id, e): r[f"k{e}"] for r in docs.select("doc.doc_id", *(M.order_key(F.lit(e), M.SEED).alias(f"k{e}") for e in range(4))).collect() for e in range(4)}
    taken = {}
    for r in got:
        taken.setdefault((r.domain, r.language, r.source_name), []).append((r.doc.doc_id, r.epoch))
    for p, g in leaves.items():
        def chosen(b):
            whole, rest = divmod(b, sums[p])
            out, n = [(r.doc.doc_id, e) for r in g for e in range(whole)], 0
            for r in sorted(g, key=lambda r: (keys[r.doc.doc_id, whole], r.doc.doc_id, r["n_tokens"])):
                n += r["n_tokens"]
                if n > rest:
                    break
                out.append((r.doc.doc_id, whole))
            return sorted(out)

        assert sorted(taken.get(p, [])) in [chosen(max(0, int(budget[p]) + k)) for k in (-3, -2, -1, 0)]  # shares are rounded down level by level


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert M.mix(M.with_tree(docs, tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    letters = {"en": "abcdefghij", "fr": "éàklmnopqr"}
    words = {lang: ["".join(rng.choice(x) for _ in range(6)) for _ in range(500)] for lang, x in letters.items()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(120)), lang, f"src{i % 5}") for i in range(60) for lang in [rng.choice(["en", "fr"])]]
    near = rows[7][1].split()
    near[60] = "zzzz"
    rows += [(100, rows[3][1].upper().replace("É", "é").replace("À", "à"), rows[3][2], "src1"), (101, " ".join(near), rows[7][2], "src2"), (102, None, "en", "src0"), (103, "12 34", "en", "src0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = [
        set(range(60)) | {100, 101},
        (set(range(60)) | {100, 101}) - {3},
        (set(range(60)) | {100}) - {3},
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"} and {r.doc_id for r in docs.collect()} == want, name
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert set(mixed.columns) == set(docs.columns) and mixed.count() > 0
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    assert sum(n < 2048 for n in sizes.values()) == 1 and max(sizes.values()) == 2048
    assert np.sum([p.length for p in pieces]) > 0


def test_pipeline_edges(spark, tmp_path):
    """Null ids, langs and sources, repeated rows and columns of any name pass; what a stage keeps is as it was; an empty table stays one."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(100))
    rows = [(i, text(), "en", f"src{i % 3}") for i in range(30)]
    rows += [(None, text(), None, None), (None, text(), "en", "src1"), rows[4], rows[4], (50, "", "en", "src1"), (51, "a", None, "src1")]
    mine = {"epoch": "e", "score": "s", "key": "k", "doc": "d", "row": "r", "n_tokens": "n", "rejected": "j", "_row": "_", "held_out": "h"}
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in mine)
    docs = start = spark.createDataFrame([(*r, *mine.values()) for r in rows], schema)
    texts = {(r[0], r[1]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in start.schema], name
        got = docs.collect()
        assert got and all((r.doc_id, r.text) in texts and {c: r[c] for c in mine} == mine for r in got), name
        assert sum(r.doc_id == 4 for r in got) == (3 if name == "language_id" else 1) or name == "mixing", name
        assert name == "mixing" or sum(r.doc_id is None for r in got) == 2, name
    pieces = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, start.filter("false"), str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == start.columns), name
