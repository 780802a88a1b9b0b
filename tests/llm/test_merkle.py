import hashlib
import zlib

import numpy as np
import pytest

from editpairs.llm import merkle as M

KIND = "doc_id long, text string, lang string, source string, n_chars long, rank int"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def others(tree, i):
    out = []
    for row in tree[:-1]:
        first = i // 3 * 3
        out.append((row[first:i], row[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    leaf = lambda r, text: H([encoded(r[0]), encoded(r[3]), encoded(r[2]), encoded(r[4]), encoded(text)])
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:2])
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, digest, r) in enumerate(by[s]):
            path = others(trees[s], i) + others(top, k)
            end = leaf(r, r[1] and r[1].replace("\n", "")) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else digest
            for left, right in path:
                end = H([*left, end, *right])
            proof = H([d for left, right in path for d in [*left, *right]])
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], proof, end, end == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1) for r in rows], KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


ROWS = [(i * 7 % 101, f"text {i}\nmore\n", "en", f"s{i % 3}" if i % 2 else "hot", i) for i in range(101)]
ROWS += [(i, f"é {i}\n", None, None, None) for i in range(200, 211)] + [(300, None, "de", "z", 0), (None, "a\n", "en", "hot", 2), (None, "b\n", "en", "hot", 2)]
ROWS += [(5, "again", "en", "hot", 5), (5, "again", "en", "hot", 5), (301, "", "de", "é", 0), (302, "x\n" * 20000, "de", "hot", 1), (-4, "minus\n", "de", "", 1)]


@pytest.mark.parametrize("height", [8, 1])
def test_against_brute_force(spark, monkeypatch, tmp_path, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    got = run(spark, ROWS, tmp_path)
    assert got == brute(ROWS)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 10])
def test_one_source(spark, monkeypatch, tmp_path, n):
    monkeypatch.setattr(M, "HEIGHT", 1)
    rows = [(i, f"{i}\n", "en", "s", 1) for i in range(n)]
    assert run(spark, rows, tmp_path) == (brute(rows) if n else [])


@pytest.mark.parametrize("height", range(1, 8))
def test_layout(height):
    """Addresses are a permutation, and each half is contiguous: the top first, then each bottom subtree."""
    levels = height + 1
    for n in sorted({n for n in (1, 2, 3, 4, 3**height, 3**height - 1, max(1, 3**height - 4), 3 ** (height - 1) + 1, 2 * 3 ** (height - 1)) if n <= 3**height}):
        at = [np.array(x) for x in M.addresses(n, levels)]
        assert sorted(np.concatenate(at)) == list(range(M.size(n, levels))) and at[-1][0] == 0
        low = levels // 2
        top = np.concatenate(at[low:])
        assert top.max() == len(top) - 1
        for k in range(M.nodes_at(n, low - 1)):
            tree = np.concatenate([at[level][k * 3 ** (low - 1 - level) : (k + 1) * 3 ** (low - 1 - level)] for level in range(low)])
            assert tree.max() - tree.min() == len(tree) - 1


def test_path_bytes():
    path = [(["ab" * 32], []), ([], ["cd" * 32, "ef" * 32]), ([], [])]
    assert M.path_from(M.path_bytes(path)) == path and M.path_from(b"") == []
