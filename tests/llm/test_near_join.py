import random
import re

import pytest

from editpairs.llm import near
from editpairs.llm.components import components
from editpairs.llm.near_join import jaccard_join, one_of_each


def grams(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    near_ = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(near_):
            m = min([label[i], *(label[j] for j in n)])
            changed |= m != label[i]
            label[i] = m
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None, len(near_[i])))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(4)) for _ in range(400)]
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 7
    return rows + [(3, None), (4, ""), (5, "?!"), (None, rows[0][1]), (rows[1][0], rows[1][1]), (6, rows[2][1].upper() + " !")]


@pytest.mark.parametrize("block, small, size", [(1024, 24, 1 << 24), (3, 5, 1 << 24), (1024, 24, 3000)])
def test_against_brute_force(spark, monkeypatch, block, small, size):
    """With large components, many blocks, and bins and blocks that bytes bound."""
    for name, value in (("BLOCK", block), ("SMALL", small), ("BIN_BYTES", size), ("BLOCK_BYTES", size)):
        monkeypatch.setattr(near, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, row int")
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect()]
    assert sorted(got, key=str) == brute(rows)
    if block > 3 and size > 3000:
        stay = one_of_each(docs)
        assert stay.columns == docs.columns
        assert stay.select("doc_id").distinct().count() >= len({c for _, c, _ in brute(rows)}) - 1


def test_classes_with_null_and_reused_ids_stay_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100))
    a, b, c, d = (text() for _ in range(4))
    rows = [(None, a), (None, a + " x"), (None, b), (None, b + " x"), (5, c), (6, c + " x"), (5, d), (7, d + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = [(r.doc_id, r.text) for r in one_of_each(docs).collect()]
    assert len(stay) == 4 and {(5, c), (5, d)} <= set(stay)
    assert all(sum(t.startswith(x) for _, t in stay) == 1 for x in (a, b, c, d))
    keys = {}
    for r in jaccard_join(docs).collect():
        keys.setdefault(bytes(r.component), []).append(r.doc_id)
    assert sorted((sorted(v, key=str) for v in keys.values()), key=str) == [[5, 6], [5, 7], [None, None], [None, None]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (200, 100)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in (100, 101, 103, 200)) and all(got[i] == 300 for i in range(300, 340))


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def leaves_of(rng, n, values=2):
    import numpy as np

    from editpairs.llm import near_join as N

    return sorted((rng.randrange(2), np.array([rng.randrange(values) for _ in range(N.DEPTH)], dtype=">u4").tobytes(), bytes([k % 256, k // 256])) for k in range(n))


def climb(leaves, cuts):
    import pyarrow as pa

    from editpairs.llm import near_join as N

    batch = lambda rows: pa.RecordBatch.from_pydict({"tree": pa.array([r[0] for r in rows], pa.int32()), "path": pa.array([r[1] for r in rows], pa.binary()), "unit": pa.array([r[2] for r in rows], pa.binary())})
    return [r for part, (a, b) in enumerate(cuts) for x in N.climbed([batch(leaves[a : (a + b) // 2]), batch(leaves[(a + b) // 2 : b])], part) for r in x.to_pylist()], batch


def common(x, y):
    import numpy as np

    same = [p == q for p, q in zip(np.frombuffer(x[1], ">u4"), np.frombuffer(y[1], ">u4"))]
    return (same + [False]).index(False) if x[0] == y[0] else 0


def test_forest_over_partitions():
    """Neighbours with a common prefix are linked wherever the partitions are cut."""
    from editpairs.llm import near_join as N

    leaves = leaves_of(random.Random(3), 200)
    out, batch = climb(leaves, [(0, 1), (1, 70), (70, 70), (70, 150), (150, 200)])
    ends = sorted((r for r in out if r["b"] is None), key=lambda r: (r["part"], r["at"]))
    out += [r for x in N.climbed([batch([(r["tree"], r["path"], r["a"]) for r in ends])], 0) for r in x.to_pylist()]
    got = {(r["a"], r["b"]): r["depth"] for r in out if r["b"] is not None and r["a"] != r["b"]}
    want = {(y[2], x[2]): common(x, y) for x, y in zip(leaves, leaves[1:]) if common(x, y) >= N.LEAST}
    assert got == want and N.LEAST < N.FLOOR < N.DEPTH


def test_crowds_and_opened_nodes_against_brute_force():
    import pyarrow as pa

    from editpairs.llm import near_join as N

    rng = random.Random(8)
    leaves = leaves_of(rng, 400)
    out, _ = climb(leaves, [(0, 400)])
    table = pa.Table.from_pylist(out)
    node = {(x[2], level): {y[2] for y in leaves if common(x, y) >= level} for x in leaves for level in range(N.LEAST, N.DEPTH + 1)}
    for r in N.crowds(table).to_pylist():
        tree, *sizes = r["sizes"]
        assert all(s == len(node[r["unit"], level]) or s == 1 for level, s in zip(range(N.LEAST, 11), sizes))
    best = {}
    for r in N.crowds(table).to_pylist():
        best[r["unit"]] = [max(p) for p in zip(best.get(r["unit"], [1] * 6), r["sizes"][1:])]
    assert all(sizes == [len(node[u, level]) for level in range(N.LEAST, 11)] for u, sizes in best.items())
    chosen = {x[2]: rng.randint(N.LEAST, N.DEPTH) for x in leaves}
    rows = [r | {"for_a": chosen[r["a"]], "for_b": r["b"] and chosen[r["b"]]} for r in out]
    edges = {(r["a"], r["b"]) for r in N.opened(pa.Table.from_pylist(rows)).to_pylist()}
    # each unit reaches all of its node by edges that lie in the node
    for u, length in chosen.items():
        members, reached, front = node[u, length], {u}, [u]
        while front:
            x = front.pop()
            for a, b in edges:
                y = b if a == x else a if b == x else None
                if y in members and y not in reached:
                    reached.add(y)
                    front.append(y)
        assert reached == members
    # and no edge is there without a unit that asked for it, but at the partition's ends
    first, last = leaves[0], leaves[-1]
    for a, b in edges:
        x, y = (next(r for r in leaves if r[2] == k) for k in (a, b))
        depth = common(x, y)
        asked = any(chosen[v] <= depth and v in node[a, max(chosen[v], N.LEAST)] for v in node[a, N.LEAST])
        assert asked or any(common(x, e) >= N.FLOOR for e in (first, last))


def test_prefixes_are_shortened_until_the_recall_is_reached():
    import numpy as np

    from editpairs.llm import near_join as N

    rng = np.random.default_rng(2)
    sizes = np.ones((300, N.TREES, 1 + N.DEPTH - N.LEAST), dtype=np.int32)
    crowded = rng.random((300, N.TREES)) < np.arange(300)[:, None] / 300
    sizes[crowded] = np.sort(rng.integers(100, 10**6, (int(crowded.sum()), sizes.shape[2])), axis=1)[:, ::-1]
    few = rng.random(sizes.shape) < 0.3  # a few similar texts make no crowd
    sizes = np.where(few & (sizes == 1), rng.integers(2, N.CROWD, sizes.shape), sizes)
    length = N.shortened(sizes)
    missed = np.prod(1 - 0.8**length.astype(float), axis=1)
    assert (missed <= 1 - N.RECALL).all() and length.min() >= N.LEAST and length.max() == N.DEPTH
    before = np.prod(1 - 0.8 ** np.minimum(length + (np.arange(N.TREES) == length.argmin(axis=1)[:, None]), N.DEPTH).astype(float), axis=1)
    assert (before > 1 - N.RECALL).all()  # and no further
    assert set(length[~crowded.any(axis=1)].ravel()) == {N.FLOOR, N.FLOOR + 1}
    some = crowded.any(axis=1) & (crowded.sum(axis=1) <= 4)
    assert (length[crowded & some[:, None]] == N.DEPTH).all()  # a few crowded trees keep whole paths, others make up for them


def test_recall_of_links_with_crowded_nodes(spark, monkeypatch):
    """Texts of templates crowd the tries; links at the threshold and above are found all the same."""
    from editpairs.llm import near_join as N

    monkeypatch.setattr(N, "CROWD", 3)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, n = [], 0
    for _ in range(5):
        template = [word() for _ in range(80)]
        for _ in range(12):
            own = [word() for _ in range(30)]
            for _ in range(4):
                words = template + own
                for _ in range(rng.choice([0, 1, 2])):
                    words[rng.randrange(len(words))] = word()
                rows.append((n, " ".join(words)))
                n += 1
    got = sorted((r.doc_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((d, k) for d, _, k in brute(rows))
    found, there = sum(k for _, k in got), sum(k for _, k in want)
    assert there > 300 and found >= N.RECALL * there and all(a[1] <= b[1] for a, b in zip(got, want))
