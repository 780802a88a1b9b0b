import math

import numpy as np
import pytest

from editpairs.llm import bit_sliced as B


def brute(rows, k, every):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(q)) for i, q in sound if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("rows, bits", [(8192, 5), (40, 2), (40, 12)])
def test_against_brute_force(spark, monkeypatch, rows, bits):
    monkeypatch.setattr(B, "ROWS", rows)
    monkeypatch.setattr(B, "BITS", bits)
    rng = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 3)]) for i in range(150)]
    data += [(i, [0.5, 0.0, -0.5, 0.25, 0.0, 1.0]) for i in range(150, 200)]  # ties
    data += [(201, None), (None, [1.0] * 6), (202, [float("nan")] * 6), (203, [1.0, None]), (204, [float("inf")]), (205, [1.0, 2.0]), (206, []), (5, data[7][1]), (7, data[7][1])]
    got = B.top_k(spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, rank int"), lambda i: i % 10 == 0)
    data = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    assert sorted(tuple(r) for r in got.collect()) == brute(data, 10, 10)


def test_few_rows_and_none(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = B.top_k(frame([(0, [1.0]), (1, [2.0]), (100, [-1.0])]), lambda i: i % 100 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2048 * 1024), (0, 2, 100, -1024 * 1024), (100, 1, 0, -1024 * 1024), (100, 2, 1, -2048 * 1024)]
    assert B.top_k(frame([]), lambda i: i % 100 == 0).count() == 0
