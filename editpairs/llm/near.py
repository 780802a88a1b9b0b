"""Exact verification of near-duplicate texts, or parts of them, on word shingles.

A unit is a text or a part of one; equal word sequences are one unit with a weight. An operator brings the
units' candidate edges (op7 from bands, op8 from a forest of tries); components of these edges bring
together all that must be compared, so a unit's shingles travel once. Within a component all pairs are
verified exactly, by block products of the incidence matrix; what leaves a task is a row a unit: its links,
and an edge to the least unit it is connected with. Small components share bins, larger ones are dealt out by
pairs of blocks; bins and blocks are bounded by units and by bytes of shingles, so that very long texts take no
more of a task's memory than many short ones. A task needs some ten times its shingles' bytes, and those of
one text at least.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpairs.llm.common import blocks_of, discard, mix64, prefix_hash, range_hash, shingles, words, written
from editpairs.llm.components import components

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
#: Units compared in one product; components of SMALL units at most are compared some thousands of units at a time.
BLOCK, SMALL, TOGETHER = 1024, 24, 4096
#: Bytes of shingles of a bin, and of a block.
BIN_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
COLUMNS = 8192


def recall(depth: int, times: int, similarity: float) -> float:
    """The chance that two units of this similarity share `depth` minima at least once in so many times."""
    return 1 - (1 - similarity**depth) ** times


def minima(texts: list[str], n: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(numbers of the texts that have a word, unit of each, n MinHash values of each, as 32-bit numbers, bytes of its shingles)"""
    word, text, _ = words(texts)
    count = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), dtype=np.int64)
    some = np.flatnonzero(count)
    if not len(some):
        return some, [], np.zeros((0, n), dtype=np.uint32), some
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    one = range_hash(prefix_hash(word), first[some], (first + count)[some])
    two = range_hash(prefix_hash(mix64(word + np.uint64(1))), first[some], (first + count)[some])
    hashed, owner = shingles(word, text, len(texts), SHINGLE)
    hashed = (hashed >> np.uint64(32)).astype(np.uint32)
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    random = np.random.default_rng(20240229)
    out = np.zeros((len(some), n), dtype=np.uint32)
    for k in range(n):
        a, b = random.integers(0, 1 << 32, 2, dtype=np.uint32)
        out[:, k] = np.minimum.reduceat(hashed * (a | np.uint32(1)) + b, heads)
    return some, [u.tobytes() for u in np.stack([one, two], axis=1)], out, 8 * np.diff(np.append(heads, len(owner)))


def row_key(doc_id: str, text: str) -> Column:
    """A hash of id and text; two rows that differ share it once in 2^64 pairs."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def with_row(docs: DataFrame) -> DataFrame:
    """row (row_key()), doc_id, text (null: empty)."""
    return docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def compared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """Boolean matrix: are these two similar enough? left, right: which units stand on either side."""
    size = np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(joined, return_inverse=True, return_counts=True)
    often = count[column] > 1
    column, owner = column[often], owner[often]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)  # whole numbers below 2^24
    place = np.zeros((2, len(sets)), dtype=np.int64) - 1
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        width = min(COLUMNS, int(column[-1]) + 1 - start)
        sides = []
        for side, n in ((0, len(left)), (1, len(right))):
            x = np.zeros((n, width), dtype=np.float32)
            at = place[side, owner[part]]
            x[at[at >= 0], column[part][at >= 0] - start] = 1
            sides.append(x)
        shared += sides[0] @ sides[1].T
    p, q = similarity.numerator, similarity.denominator
    both = size[left][:, None] + size[right][None, :]
    return (p + q) * shared.astype(np.int64) >= p * both


def least_connected(similar: np.ndarray) -> np.ndarray:
    """For each of a symmetric matrix's rows the least row it is connected with."""
    n = len(similar)
    label, open_ = np.arange(n), np.ones(n, dtype=bool)
    for i in range(n):
        if not open_[i]:
            continue
        front = np.array([i])
        open_[i] = False
        while len(front):
            reached = similar[front].any(axis=0) & open_
            open_[reached] = False
            label[reached] = i
            front = np.flatnonzero(reached)
    return label


def small_links(table: pa.Table) -> pa.Table:
    """Links within each of many small components: every pair's common shingles are counted over the shingles."""
    unit = table["unit"].to_pylist()
    first = list({u: k for k, u in reversed(list(enumerate(unit)))}.values())  # equal rows once
    order = sorted(first, key=lambda k: unit[k])
    unit, weight = [unit[k] for k in order], table["weight"].to_numpy()[order]
    component = table["component"].take(pa.array(order)).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    data = table["shingles"].take(pa.array(order)).to_pylist()
    n = len(unit)
    joined = np.frombuffer(b"".join(data), dtype=np.uint64)
    owner = np.repeat(np.arange(n), [len(x) // 8 for x in data])
    by = np.lexsort((owner, joined, component[owner]))
    joined, owner = joined[by], owner[by]
    new = np.concatenate(([True], (joined[1:] != joined[:-1]) | (owner[1:] != owner[:-1])))
    joined, owner = joined[new], owner[new]
    size = np.bincount(owner, minlength=n)
    head = np.concatenate(([True], (joined[1:] != joined[:-1]) | (component[owner][1:] != component[owner][:-1])))
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(joined))
    run = np.cumsum(head) - 1
    # of each shingle's owners, in order, the pairs of each with those behind it
    behind = end[run] - np.arange(len(joined)) - 1
    left = np.repeat(np.arange(len(joined)), behind)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind) - behind, behind)
    pair, shared = np.unique(owner[left] * n + owner[right], return_counts=True)
    i, j = pair // n, pair % n
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    near = (p + q) * shared >= p * (size[i] + size[j])
    i, j = i[near], j[near]
    links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
    label = np.arange(n)
    while len(i):  # the least unit that each reaches; i < j, in order of the units
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        if (label == before).all():
            break
    hit = np.flatnonzero(links > 0)
    return pa.table({"unit": pa.array([unit[k] for k in hit], pa.binary()), "links": links[hit].astype(np.int64), "linked": pa.array([unit[label[k]] for k in hit], pa.binary())})


def verified(sets: DataFrame, units: int, size: int) -> DataFrame:
    """unit, links (weighted), linked (least unit reached within a task): a row or a few a unit.

    sets: unit, weight, component, shingles (64-bit numbers as bytes), and of the component n units and `bytes` of
    shingles; units, size: the sums of both over all components.
    """
    small = (F.col("n") <= SMALL) & (F.col("bytes") <= BIN_BYTES)
    bins = max(1, -(-units // TOGETHER), -(-size // BIN_BYTES))
    few = sets.filter(small).withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins)))
    few = few.groupBy("bin").applyInArrow(small_links, "unit binary, links long, linked binary")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    out = sets.filter(~small).withColumn("blocks", blocks)
    out = out.withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks").cast("long")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "unit", "weight", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        block = table["block"].to_numpy()
        unit = table["unit"].to_pylist()
        first = list({u: k for k, u in reversed(list(enumerate(unit)))}.values())  # equal rows once
        order = sorted(first, key=lambda k: unit[k])
        sets = [np.unique(np.frombuffer(x, dtype=np.uint64)) for x in table["shingles"].take(pa.array(order)).to_pylist()]
        unit, block, weight = [unit[k] for k in order], block[order], table["weight"].to_numpy()[order]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pa.table({"unit": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "linked": pa.array([], pa.binary())})
        similar = compared(sets, left, right)
        links = np.zeros(len(unit), dtype=np.int64)
        if i == j:
            np.fill_diagonal(similar, False)
            links[left] += similar @ weight[right]
        else:
            links[left] += similar @ weight[right]
            links[right] += weight[left] @ similar
        whole = np.zeros((len(unit), len(unit)), dtype=bool)
        whole[np.ix_(left, right)] = similar
        label = least_connected(whole | whole.T)
        hit = np.flatnonzero(links > 0)
        return pa.table({"unit": pa.array([unit[k] for k in hit], pa.binary()), "links": links[hit], "linked": pa.array([unit[label[k]] for k in hit], pa.binary())})

    return few.union(out.groupBy("component", "i", "j").applyInArrow(compare, "unit binary, links long, linked binary"))


def sets_of(texts: DataFrame) -> DataFrame:
    """unit, weight, component, shingles of texts (unit, weight, component, text)."""

    def take(batches):
        for batch in batches:
            text = batch.column(3).to_pylist()
            out = []
            for a, b in blocks_of(text):
                word, owner, _ = words(text[a:b])
                hashed, owner = shingles(word, owner, b - a, SHINGLE)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                out += [hashed[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["unit", "weight", "component", "shingles"])

    return texts.select("unit", "weight", "component", "text").mapInArrow(take, "unit binary, weight long, component binary, shingles binary")


def near_classes(units: DataFrame, edges: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """unit, links, component of the units that are similar to another.

    units: unit, weight, size (bytes of its shingles) and what texts_of needs; edges (a, b): candidates, connected if they are to be
    compared; texts_of: such units with their `component` -> the same with `text`. links: the weights of other
    units with a similarity of SIMILARITY or more; component: the least unit connected by such links.
    """
    near = written(components(edges).withColumnRenamed("node", "unit"), "candidate-components")
    sets = sets_of(texts_of(units.join(near, "unit")))
    sizes = units.select("unit", "size").join(near, "unit").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    sizes = written(sizes, "component-sizes")
    sets = written(sets.join(sizes, "component"), "shingles")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    checked = written(verified(sets, *total), "verified")
    discard(sets)
    links = checked.groupBy("unit").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("unit").alias("a"), F.col("linked").alias("b"))).withColumnRenamed("node", "unit")
    return links.join(joined, "unit")
