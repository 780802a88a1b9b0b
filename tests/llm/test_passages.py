import random
import re

import numpy as np

from editpairs.llm import passages as P
from editpairs.llm.paragraphs import op7_paragraph_dedup, repeated_paragraphs


def vocabulary(rng, n=3000):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_passages_in_long_lines_and_after_shifted_lines(spark, tmp_path):
    rng = random.Random(5)
    words = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, short, changed, thin, leftover = text(55), [text(9) for _ in range(7)], text(90), text(20), text(52)
    near = changed.split()
    near[45] = "zzzz"
    signs = "\n".join(" - ".join(leftover.split()[k : k + 26]) for k in (0, 26))
    put = {
        1: ("İ " + text(1200) + " ", long, " " + text(1200)), 2: (text(30) + " ", long, " " + text(700)),
        3: (text(8) + "\n", "\n".join(short), "\n" + text(8)), 4: (text(20) + "\n" + text(11) + "\n", "\n".join(short), "\n" + text(5)),
        5: (text(300) + " ", changed, " " + text(80)), 6: (text(70) + " ", " ".join(near), " " + text(400)),
        7: (text(100) + " ", thin, " " + text(100)), 8: (text(90) + " ", thin, " " + text(110)),
        9: (text(60) + "\n", leftover, ""), 10: (text(80) + "\n" + text(12) + "\n", signs, "\n" + text(9)),
        11: ("", text(500), ""),
    }
    docs = spark.createDataFrame([(i, "".join(x), 1, "k") for i, x in put.items()] + [(12, None, 1, "k"), (13, "", 1, "k")], "doc_id long, text string, row int, keys string")
    got = {r.doc_id: r.repeated for r in repeated_paragraphs(docs).collect()}
    assert len(got) == 13
    for i in (7, 8, 11, 12, 13):
        assert not got[i]
    for keep, gone in ((1, 2), (3, 4), (5, 6), (9, 10)):
        for i in (keep, gone):
            before, passage, _ = put[i]
            covered = {k for x in got[i] for k in range(x.start, x.end)}
            assert covered <= set(range(len(before), len(before) + len(passage))), i
            assert len(covered) >= 0.55 * len(passage), i
            assert {x.class_doc_id for x in got[i]} == {keep}
        assert not any(x.removed for x in got[keep]) and all(x.removed for x in got[gone])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in op7_paragraph_dedup(spark, str(tmp_path)).collect() if r.n_removed} == {2, 4, 6, 10}
    assert repeated_paragraphs(docs.filter("false")).count() == 0


def test_recall_of_passages_at_shifting_offsets(spark):
    """Passages of 51 to 120 words in 2 to 30 documents each, among them copied documents: nine in ten places and more are found, and no other."""
    rng = random.Random(6)
    words = vocabulary(rng, 5000)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, planted, clean = [], [], []
    for n in [2, 2, 2, 2, 3, 3, 3, 4, 5, 8, 30]:
        passage = text(rng.choice([51, 52, 60, 120]))
        for _ in range(n):
            before, after = text(rng.randrange(200)), text(rng.randrange(400))
            planted.append(len(rows))
            rows.append(before + passage + after)
            if rng.random() < 0.3:
                copy = list(rows[-1])
                copy[rng.randrange(len(copy))] = "changed"
                planted.append(len(rows))
                rows.append(copy)
    for _ in range(60):
        clean.append(len(rows))
        rows.append(text(rng.randrange(300)))
    lines = lambda t: re.sub(r"(\w+ ){7}", lambda m: m[0].rstrip() + "\n", " ".join(t)) if rng.random() < 0.5 else " ".join(t)
    docs = spark.createDataFrame([(i, lines(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    hit = {r.doc_id for r in repeated_paragraphs(docs).collect() if r.repeated}
    assert len(hit & set(planted)) >= 0.95 * len(planted) and not hit & set(clean)


def test_every_long_repeated_run_has_a_common_window():
    rng = random.Random(2)
    words = vocabulary(rng, 800)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for _ in range(200):
        run = text(P.WINDOW + P.REACH - 1)
        _, _, one = P.chosen_windows(["x", text(rng.randrange(30)) + " " + run + " " + text(rng.randrange(30)), "y"])
        _, _, two = P.chosen_windows([text(rng.randrange(30)) + " " + run + " " + text(rng.randrange(30))])
        assert set(one.tolist()) & set(two.tolist())


def test_runs_and_cuts():
    at, n = np.array([0, 9, 18, 27, 60, 70, 200, 208, 216]), np.array([2, 2, 9, 9, 2, 2, 30, 33, 20])
    assert P.runs(at, n) == [(0, 25), (0, 86), (18, 43), (60, 86), (200, 224), (200, 232)]
    assert P.cut(0, 130, np.array([20, 55, 90, 110])) == [(0, 55), (55, 130)] and P.cut(3, 30, np.array([10])) == [(3, 30)]
    text = "İ b\nc"
    start, end = P.word_places(text)
    assert [text[s:e] for s, e in zip(start, end)] == ["İ", "b", "c"]


def test_result_against_brute_force(spark):
    """Spans, classes and removals of whole texts against a plain version: windows counted in a dictionary, all pairs of paragraphs compared."""
    from collections import Counter

    from editpairs.llm.near import with_row

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [[word() for _ in range(n)] for n in (40, 60, 90, 200)]
    texts = []
    for i in range(40):
        lines = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 4))]
        for passage in rng.sample(shared, rng.randint(0, 2)):
            words = list(passage)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = word()
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        texts.append("\n".join(lines))
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (None, texts[0]), (100, texts[0]), (3, "one two three")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, unit string, start int, n int")
    key = {(r.doc_id, r.text): r.row for r in with_row(docs).collect()}

    chosen = [(*w, k) for k, (_, t) in enumerate(rows) for w in zip(*P.chosen_windows([t or ""])[1:])]
    count = Counter(w for _, w, _ in chosen)
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(re.findall(r"[^\W_]+", t.lower()))
    places = []  # (doc_id, row, number, start, end, shingles, index of the row of docs)
    for k, (doc_id, t) in enumerate(rows):
        found = sorted({at for at, w, j in chosen if j == k and count[w] > 1})
        if found:
            n = {at: count[w] for at, w, j in chosen if j == k}
            for no, (s, e) in enumerate(P.paragraphs(t, np.array(found), np.array([n[a] for a in found]))):
                places.append((doc_id, key[doc_id, t or ""], no, s, e, grams(t[s:e]), k))
    label = list(range(len(places)))
    near = [[j for j in range(len(places)) if j != i and 5 * len(places[i][5] & places[j][5]) >= 4 * len(places[i][5] | places[j][5])] for i in range(len(places))]
    for _ in places:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(places))]
    want: dict[int, set] = {k: set() for k in range(len(rows))}
    for i, (_, row, no, s, e, _, k) in enumerate(places):
        if near[i]:
            group = [places[j] for j in range(len(places)) if label[j] == label[i]]
            first = min(group, key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2]))
            want[k].add((s, e, first[0], len(group), (row, no) != (first[1], first[2])))
    got = [(r.doc_id, r.row, [tuple(x) for x in r.repeated]) for r in repeated_paragraphs(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((d, key[d, t or ""], sorted(want[k]))) for k, (d, t) in enumerate(rows))
    assert sum(len(x) for x in want.values()) > 20 and any(x[4] for v in want.values() for x in v)
