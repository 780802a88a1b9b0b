import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from editpairs.llm import language_id as L
from editpairs.llm.exact_dedup import DigestIndex, exact_dedup, without_copies


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x"), (7, "x"), (None, "n"), (None, "n"), (8, "Abc")] + [(100 + i, "HOT") for i in range(50)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    out = [(i, keep[fold(t)], len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows]
    return sorted(map(str, out)), len(groups)


def test_exact_dedup(spark):
    docs = spark.createDataFrame([(*r, b"x", "k") for r in ROWS], "doc_id long, text string, digest binary, keep_id string")
    got = exact_dedup(docs).collect()
    want, texts = brute(ROWS)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.digest.hex())) for r in got) == want
    assert sum(r.kept for r in got) == texts and all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = without_copies(docs)
    assert stay.columns == docs.columns and stay.count() == texts
    assert exact_dedup(docs.filter("false")).count() == 0


def test_index_persists_between_batches(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    DigestIndex(spark, f"file://{tmp_path}/index", 4).add(frame([(1, "a"), (2, "b")]))
    again = DigestIndex(spark, f"file://{tmp_path}/index", 4)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(frame([(9, "A"), (10, "c"), (11, "c")])).collect()}
    assert got == {9: (1, False), 10: (11, False), 11: (11, True)}
    assert again.rows().count() == 3


def vocabulary(seed, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(300)]


def corpus(n=240):
    rng = random.Random(9)
    words = {"aa": vocabulary(1, "abcdefghij"), "bb": vocabulary(2, "fghijklmnop"), "cc": vocabulary(3, "éàüabcxyz")}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([5, 40, 200]))), lang) for i in range(n) for lang in [rng.choice(list(words))]]


def test_language_accuracy_and_rejection(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "жщъ ыэю яшщ чцх " * 30, None), (1004, "a", None), (None, "éàü xyz", None)]
    docs = spark.createDataFrame([(*r, "s", 0.5, "mine", True) for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string, held_out boolean")
    got = {r.doc.doc_id: r for r in L.identify(docs, ["doc_id", "text", "lang"]).collect()}
    known = [got[i] for i, _, _ in corpus() if got[i].held_out]
    assert len(known) > 40 and np.mean([r.doc.lang == r.lang_pred for r in known]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[1004].lang_pred != "und" and got[None].lang_pred == "cc"  # unlabelled texts loosen no limit
    assert np.mean([got[i].rejected for i, _, _ in corpus()]) <= 0.01
    kept = L.known_language(docs)
    assert kept.schema == docs.schema and {(r.score, r.lang_pred, r.held_out) for r in kept.collect()} == {(0.5, "mine", True)}


def test_rejection_of_noise_and_of_a_language_left_out(spark):
    """Limits calibrated on the languages that are known refuse a language that isn't, and noise; both rates are held."""
    rng = random.Random(4)
    words = {lang: vocabulary(k, x) for k, (lang, x) in enumerate({"aa": "abcdefghij", "bb": "aefghijklm", "cc": "aeiouklmnop", "dd": "eioustrbcd"}.items())}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.choice([30, 60, 200])))
    rows = [(i, text(lang), lang) for i in range(900) for lang in [rng.choice(["aa", "bb", "cc"])]]
    rows += [(2000 + i, text("dd"), None) for i in range(100)]
    rows += [(3000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)), None) for i in range(100)]
    got = {r.doc.doc_id: r.rejected for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert np.mean([got[i] for i in range(900)]) <= 0.01
    assert np.mean([got[2000 + i] for i in range(100)]) >= 0.95 and np.mean([got[3000 + i] for i in range(100)]) >= 0.95


def test_a_sample_bounds_what_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LEARN_CHARS", 20_000)
    rows = spark.createDataFrame(corpus(2000), "doc_id long, text string, lang string")
    n = {r.lang: r.n for r in L.sample(rows).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert len(n) == 3 and all(8_000 < x < 40_000 for x in n.values())
    got = L.identify(rows, ["lang"]).filter("held_out").collect()
    assert np.mean([r.doc.lang == r.lang_pred for r in got]) > 0.95


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(docs, ["doc_id"]).collect()] == [("und", 0.0)]
    assert L.identify(docs.filter("false"), ["doc_id"]).count() == 0


def brute_kneser_ney(texts, symbols):
    """Interpolated probabilities by the textbook, gram by gram."""
    from collections import Counter

    level = Counter()
    for t in texts:
        s = [0, 0, 0] + [ord(c) for c in t]
        level.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    levels = {4: level}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / symbols
        counts = levels[k]
        n1, n2 = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(counts.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


def test_probabilities_are_kneser_ney(spark):
    texts = ["abab cab", "bca abc", "cc"]
    model = L.train(spark.createDataFrame([("x", t) for t in texts] + [("y", "qq aq")], "lang string, text string"))
    p = brute_kneser_ney(texts, len({c for t in texts + ["qq aq"] for c in t}) + 1)
    for gram in ("abab", "zzzz", "ab c", "caba", "\0\0\0a", "\0cc ", "bcaz"):
        key = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(gram))], dtype=np.uint64)
        got = float(np.exp(model.log_probability(key)[0, 0]))
        assert got == pytest.approx(p(tuple(map(ord, gram))), rel=1e-4)


def test_decision_and_score_by_brute_force(spark):
    texts = {"x": ["abab cab", "bca abc", "cc ab"], "y": ["qq aq", "zq qa qaz"]}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])], "doc_id long, text string, lang string")
    symbols = len({c for ts in texts.values() for t in ts for c in t}) + 1
    p = {lang: brute_kneser_ney(ts, symbols) for lang, ts in texts.items()}
    model = L.train(docs)
    asked = ["abc", "qaq!! qa", "cab qq", "z", "k"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "no long, text string")
    for r in L.scored(rows, model).collect():
        s = "\0\0\0" + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in asked[r.no]))
        h = {lang: -sum(math.log(p[lang](tuple(map(ord, s[i - 3 : i + 1])))) for i in range(3, len(s))) / (len(s) - 3) for lang in p}
        best = min(h, key=h.get)
        odds = sum(math.exp((h[best] - x) * min(len(s) - 3, L.SCORE_CHARS)) for x in h.values())
        assert r.lang_pred == best and r.score == pytest.approx(1 / odds, rel=1e-3) and r.cross_entropy == pytest.approx(h[best], rel=1e-4)
        assert r.next_entropy == pytest.approx(max(h.values()), rel=1e-4)


def test_fold_is_crc32(spark):
    import zlib

    got = {r.id: r.f for r in spark.range(50).select("id", L.fold("id").alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}
    assert spark.range(1).select(F.lit(1)).count() == 1
