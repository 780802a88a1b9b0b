import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from editpairs.llm import repeated_substrings as R
from editpairs.llm.suffix_array import common_prefixes, suffix_array


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + 200] for _, t in data for s in range(len(t) - 199))
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = [True] * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def text(rng, n, alphabet="abcdefgh é\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("hot", [1000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT_SEGMENTS", hot)
    rng = random.Random(5)
    passage, long = text(rng, 400), text(rng, 3000)
    rows = [(i, text(rng, 100) + passage[rng.randrange(120) :] + text(rng, 300)) for i in range(12)]
    rows += [(20, long), (21, long), (21, long), (22, long[:1500] + "X" + long[1500:]), (23, long[1000:1199]), (24, long[1000:1200])]
    rows += [(30, "a" * 1000), (31, "ab" * 300), (32, None), (33, ""), (None, passage), (34, text(rng, 5000)), (35, "z" * 200)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 700)
    monkeypatch.setattr(R, "SORTED", 2000)
    rng = random.Random(6)
    long = text(rng, 6000)
    rows = [(1, long), (2, text(rng, 333) + long[500:5000]), (3, long[:300] + text(rng, 90) + long[200:500]), (4, text(rng, 200))]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("symbols", [b"banana", b"mississippi", b"aaaaaaa", b"", b"\0\0b\0", bytes(range(50)) * 3, b"abcabcabcab\0abcabd\0"])
def test_suffix_array(symbols):
    x = np.frombuffer(symbols, dtype=np.uint8)
    order = suffix_array(x, 1000)
    assert order.tolist() == sorted(range(len(x)), key=lambda i: symbols[i:])

    def shared(a, b):
        n = 0
        while max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        return n

    assert common_prefixes(x, order, 9).tolist() == [min(9, shared(a, b)) for a, b in zip(order[:-1], order[1:])]
