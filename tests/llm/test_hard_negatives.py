import math

import numpy as np
import pytest

from editpairs.llm import hard_negatives as H

KIND = "vec_id long, label int, embedding array<float>, rank int"


def brute(rows, every, positives=5, negatives=3):
    sound = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, q) in enumerate(sound):
        if i % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, v)), j, b) for b, (j, _, v) in enumerate(sound) if b != a)
        for score, positive, _ in [f for f in found if sound[f[2]][1] == label][:positives]:
            fits = [(s, j) for s, j, b in found if sound[b][1] != label and 50 * -score <= 100 * -s <= 95 * -score]
            out += [(i, positive, r + 1, j, -score, -s) for r, (s, j) in enumerate(fits[:negatives])]
    return sorted(out)


def exact(rows):
    return [(i, l, v and [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]


@pytest.mark.parametrize("tile, pack, chunk, big", [(32768, 4096, 64, 1), (64, 8, 5, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, tile, pack, chunk, big):
    for name, value in (("TILE", tile), ("PACK", pack), ("CHUNK", chunk)):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) * big for x in np.round(rng.normal(size=6), 3)]) for i in range(200)]
    rows += [(i, i % 2, [0.5 * big, 0.0, -0.5, 0.25, 0.0, 1.0]) for i in range(200, 260)]  # ties, and one vector of many rows
    rows += [(300, 1, None), (None, 1, [1.0] * 6), (301, None, [1.0] * 6), (310, 0, [float("nan")] * 6), (320, 1, [1.0, None]), (330, 1, [float("inf")])]
    rows += [(340, 2, [1.0, 2.0]), (350, 1, []), (360, 2, [0.0] * 6), (10, rows[10][1], rows[17][2]), rows[20], (-30, 1, rows[3][2])]
    got = H.hard_negatives(spark.createDataFrame([(*r, 1) for r in rows], KIND), lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(exact(rows), 10)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_zero_scores_and_few_rows(spark):
    # a positive's score of zero: its window is zero alone, and negatives of smaller ids fit too
    rows = [(0, 1, [1.0, 0.0]), (9, 1, [0.0, 1.0]), (3, 2, [0.0, 2.0]), (12, 2, [0.0, -2.0])]
    got = H.hard_negatives(spark.createDataFrame([(*r, 1) for r in rows], KIND), lambda i: i == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 9, 1, 3, 0, 0), (0, 9, 2, 12, 0, 0)]
    alone = spark.createDataFrame([(0, 1, [1.0], 1), (1, 2, [1.0], 1)], KIND)
    assert H.hard_negatives(alone, lambda i: i == 0).count() == 0
    assert H.hard_negatives(spark.createDataFrame([], KIND), lambda i: i == 0).count() == 0
    below = spark.createDataFrame([(0, 1, [1.0], 1), (1, 1, [-1.0], 1), (2, 2, [-0.7], 1)], KIND)
    assert H.hard_negatives(below, lambda i: i == 0).count() == 0


def test_streaming_iterator_keeps_open_windows_alone():
    import pyarrow as pa

    def keys(rows):
        out = np.zeros(len(rows), dtype=H.KEY)
        for k, (anchor, score, kind, id_) in enumerate(rows):
            out[k] = (anchor, np.uint64(anchor) ^ H.SIGN, ~(np.array([score], np.int64).astype(np.uint64)[0] ^ H.SIGN), kind, np.uint64(id_) ^ H.SIGN, 0)
        return [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in part], pa.binary())], names=["key"]) for part in (out[:3], out[:0], out[3:])]

    rows = [(1, 100, 0, 5), (1, 96, 1, 6), (1, 90, 1, 7), (1, 80, 0, 8), (1, 78, 1, 9), (1, 50, 1, 2), (1, 49, 1, 3), (2, 70, 1, 4), (2, 60, 0, 6), (2, 57, 1, 8)]
    got = [tuple(r.values()) for b in H.streamed(iter(keys(rows)), 5, 3, (50, 100), (95, 100)) for r in b.to_pylist()]
    assert got == [(1, 5, 1, 7, 100, 90), (1, 5, 2, 9, 100, 78), (1, 5, 3, 2, 100, 50), (1, 8, 1, 2, 80, 50), (1, 8, 2, 3, 80, 49), (2, 6, 1, 8, 60, 57)]
    assert H.window_of(-10, (50, 100), (95, 100)) == (-5, -10) and H.window_of(7, (50, 100), (95, 100)) == (4, 6)


def test_query_against_sql(spark):
    import duckdb

    duckdb.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = duckdb.execute(H.OP11_SQL).fetchall()
    assert want and sorted(map(tuple, H.op11_hard_negatives(spark, "/root/testdata/sf0.001").collect())) == sorted(want)
