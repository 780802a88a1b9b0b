"""N-gram Jaccard join of documents by a MinHash LSH forest (operator 8).

Each text has TREES sequences of DEPTH MinHash values, a path in each tree of the forest. A tree is its paths
in sorted order, over range partitions, so a trie's node is a run of neighbours with a common prefix, however
many they are. Each unit starts with its whole paths as prefixes and shortens them, one value of one tree at a
time, until the chance that it misses a text at the threshold is under 1 - RECALL. Which tree's prefix is
shortened next depends on the nodes that the unit lies in: where the next node is crowded, as with texts of one
template, the prefix stays long, and other trees make up for it, down to LEAST values. Crowds are told from
sizes over CROWD alone, so a few similar texts don't turn the choice away from the trees in which they meet. The
units of the nodes that a unit has come to are its candidates, verified by the exact Jaccard of word 5-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.llm.common import blocks_of, discard, partitions, written
from editpairs.llm.near import SIMILARITY, minima, near_classes, recall, row_key, with_row

TREES, DEPTH, RECALL = 20, 10, 0.997
#: The shortest prefix; units from which on a node is crowded.
LEAST, CROWD = 5, 64


def floor_for(trees: int, depth: int, target: float) -> int:
    """The longest prefix whose recall at the threshold reaches the target, shortened from the whole path."""
    while depth > 1 and recall(depth, trees, float(SIMILARITY)) < target:
        depth -= 1
    return depth


FLOOR = floor_for(TREES, DEPTH, RECALL)


def signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, unit, path (TREES x DEPTH values, big-endian), size (bytes of shingles) of the rows of docs (row, doc_id, text) that have a word."""

    def each(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks_of(texts):
                some, unit, least, size = minima(texts[a:b], TREES * DEPTH)
                at = pa.array(some + a)
                yield pa.RecordBatch.from_pydict({"row": batch.column(0).take(at), "doc_id": batch.column(1).take(at), "unit": pa.array(unit, pa.binary()), "path": pa.array([x.tobytes() for x in least.astype(">u4")], pa.binary()), "size": size})

    return docs.select("row", "doc_id", "text").mapInArrow(each, "row long, doc_id long, unit binary, path binary, size long")


def climbed(batches, part: int, least: int = LEAST):
    """EDGES between neighbours, in order, that share `least` values or more; and, with no b, the first and the last leaf.

    at: the place of b's leaf in the partition, a's is the next one.
    """
    before, seen = None, 0
    kind = np.dtype(">u4")
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree, path, unit = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ends = [(tree[0], path[0], unit[0], 0)] if before is None else []
        if before is not None:
            tree, path, unit = np.append(before[0], tree), [before[1], *path], [before[2], *unit]
        values = np.frombuffer(b"".join(path), dtype=kind).reshape(-1, DEPTH)
        same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
        depth = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        hit = np.flatnonzero(depth >= least)
        yield edge_batch([unit[k + 1] for k in hit], [unit[k] for k in hit], depth[hit], tree[hit], seen + hit, ends, part)
        seen += len(path) - 1
        before = (tree[-1:], path[-1], unit[-1])
    if before is not None:
        yield edge_batch([], [], [], [], [], [(before[0][0], before[1], before[2], seen)], part)


EDGES = "a binary, b binary, depth int, tree int, at long, path binary, part int"


def edge_batch(a: list, b: list, depth, tree, at, ends: list, part: int) -> pa.RecordBatch:
    n, m = len(a), len(ends)
    return pa.RecordBatch.from_pydict({
        "a": pa.array([*a, *(x[2] for x in ends)], pa.binary()), "b": pa.array([*b, *[None] * m], pa.binary()), "depth": pa.array([*depth, *[0] * m], pa.int32()),
        "tree": pa.array([*tree, *(int(x[0]) for x in ends)], pa.int32()), "at": pa.array([*at, *(x[3] for x in ends)], pa.int64()),
        "path": pa.array([*[None] * n, *(x[1] for x in ends)], pa.binary()), "part": pa.array([part] * (n + m), pa.int32()),
    })


def runs(at: np.ndarray, depth: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges in order: which lie in a node of this depth, and the number of that node."""
    inside = np.flatnonzero(depth >= level)
    new = np.concatenate(([True], np.diff(at[inside]) != 1)) if len(inside) else np.zeros(0, dtype=bool)
    return inside, np.cumsum(new) - 1


def crowds(table: pa.Table) -> pa.Table:
    """unit and [tree, size of its node of LEAST values, .. of DEPTH values], for both units of a partition's edges; a size is 1 where it is alone."""
    table = table.filter(table["b"].is_valid()).sort_by("at")
    at, depth = table["at"].to_numpy(), table["depth"].to_numpy()
    sizes = np.ones((len(at), 2 + DEPTH - LEAST), dtype=np.int32)
    sizes[:, 0] = table["tree"].to_numpy()
    for level in range(LEAST, DEPTH + 1):
        inside, node = runs(at, depth, level)
        sizes[inside, 1 + level - LEAST] = np.bincount(node)[node] + 1 if len(node) else 1
    rows = pa.FixedSizeListArray.from_arrays(pa.array(sizes.reshape(-1)), sizes.shape[1]).cast(pa.list_(pa.int32()))
    return pa.table({"unit": pa.chunked_array([*table["a"].chunks, *table["b"].chunks], pa.binary()), "sizes": pa.chunked_array([rows, rows])})


def shortened(sizes: np.ndarray) -> np.ndarray:
    """Prefixes (unit x tree), given the sizes of the units' nodes (unit x tree x length from LEAST to DEPTH)."""
    units, trees = sizes.shape[:2]
    cost = np.where(sizes > CROWD, np.log2(np.maximum(sizes, 1)), 0)
    chance = np.log1p(-(float(SIMILARITY) ** np.arange(1, DEPTH + 1)))  # that a text at the threshold isn't met in a tree, by length
    length, missed = np.full((units, trees), DEPTH), np.full(units, trees * chance[DEPTH - 1])
    while True:
        open_ = np.flatnonzero((missed > np.log(1 - RECALL)) & (length > LEAST).any(axis=1))
        if not len(open_):
            return length
        now = length[open_]
        next_ = np.take_along_axis(cost[open_], np.maximum(now - 1 - LEAST, 0)[:, :, None], axis=2)[:, :, 0]
        tree = np.where(now > LEAST, 2 * DEPTH * next_ - now, np.inf).argmin(axis=1)  # the least crowded, of equal ones the longest
        was = now[np.arange(len(open_)), tree]
        missed[open_] += chance[was - 2] - chance[was - 1]
        length[open_, tree] -= 1


def prefixes(sizes: DataFrame) -> DataFrame:
    """unit and the length of its prefix in each tree; sizes: rows of crowds(). A tree in which it has no neighbour has nodes of one."""
    width = 2 + DEPTH - LEAST

    def choose(batches):
        for batch in batches:
            column = batch.column(1)
            rows = column.flatten().to_numpy().reshape(-1, width)
            unit = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()) // width)
            found = np.ones((batch.num_rows, TREES, width - 1), dtype=np.int32)
            np.maximum.at(found, (unit, rows[:, 0]), rows[:, 1:])
            length = shortened(found).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(length.reshape(-1)), TREES).cast(pa.list_(pa.int32()))], names=["unit", "lengths"])

    each = sizes.groupBy("unit").agg(F.flatten(F.collect_list("sizes")).alias("sizes"))  # two rows a tree at most
    return each.mapInArrow(choose, "unit binary, lengths array<int>")


def opened(table: pa.Table) -> pa.Table:
    """Of a partition's edges (with the lengths that a's and b's units have chosen): a and b of those in a node that one of its units has come to.

    A node at the partition's ends may hold units beyond them; it counts from FLOOR values on, whatever they chose.
    """
    ends = table.filter(table["b"].is_null())["at"].to_pylist()
    table = table.filter(table["b"].is_valid()).sort_by("at")
    at, depth, chosen = table["at"].to_numpy(), table["depth"].to_numpy(), np.stack([table["for_a"].to_numpy(), table["for_b"].to_numpy()])
    used = np.zeros(len(at), dtype=bool)
    for level in range(LEAST, DEPTH + 1):
        inside, node = runs(at, depth, level)
        if len(inside):
            wanted = (chosen[:, inside] == level).any(axis=0)
            wanted |= np.isin(at[inside], [min(ends), max(ends) - 1]) & (level >= FLOOR)
            used[inside] |= (np.bincount(node, weights=wanted) > 0)[node]
    return table.select(["a", "b"]).filter(pa.array(used))


def forest(units: DataFrame) -> DataFrame:
    """Edges (a, b) that connect each unit with all units of the nodes that it has come to; units: unit, path."""
    size = 4 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    leaves = units.select("unit", "path", tree).select("tree", F.expr(f"substring(path, tree * {size} + 1, {size})").alias("path"), "unit")
    # the unit is part of the order, so equal paths spread over as many partitions as they need
    leaves = leaves.repartitionByRange(partitions(units.sparkSession), "tree", "path", "unit").sortWithinPartitions("tree", "path", "unit")
    found = written(leaves.mapInArrow(lambda batches: climbed(batches, TaskContext.get().partitionId()), EDGES), "trie-edges")
    lengths = written(prefixes(found.select("a", "b", "depth", "tree", "at", "part").groupBy("part").applyInArrow(crowds, "unit binary, sizes array<int>")), "prefixes")
    of = lambda side: lengths.select(F.col("unit").alias(f"_{side}"), F.col("lengths").alias(f"_lengths_{side}"))
    rows = found.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    rows = rows.select("a", "b", "depth", "at", "part", *(F.get(f"_lengths_{side}", "tree").alias(f"for_{side}") for side in ("a", "b")))
    within = rows.groupBy("part").applyInArrow(opened, "a binary, b binary")
    ends = found.filter("b IS NULL").repartition(1).sortWithinPartitions("part", "at").select("tree", "path", F.col("a").alias("unit"))  # two rows a partition
    across = ends.mapInArrow(lambda batches: climbed(batches, 0, FLOOR), EDGES)
    return within.union(across.filter("b IS NOT NULL").select("a", "b"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, row, class_id, class_size, n_links, component for every row of docs (doc_id, text).

    n_links: other rows whose set of word 5-grams (lower-cased; a shorter text has one, of all its words) has
    a Jaccard similarity of 0.8 or more. class_id: the least doc_id of the class connected by such links,
    null only if all its ids are null, so two classes can share it; component: the class's own key, the hash of
    its least unit, null for a text without a word. Such a text, null or empty, has no link and its own id;
    repeated rows are links of each other; extra columns are ignored; an empty table gives no row.
    """
    docs = with_row(docs)
    paths = written(signed(docs), "signatures")
    items = written(paths.select("doc_id", "row", "unit"), "signed-rows")
    units = paths.groupBy("unit").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"), F.first("path").alias("path"), F.first("size").alias("size"), F.min("row").alias("row"))
    units = written(units, "units")
    discard(paths)
    texts = lambda wanted: wanted.select("unit", "weight", "component", "row").join(docs.select("row", "text"), "row")
    near = near_classes(units, forest(units), texts)
    linked = units.select("unit", "weight", "least").join(near, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    linked = written(linked, "unit-links")
    discard(units)
    least = linked.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("weight").alias("class_size"))
    linked = linked.join(least, "component").select("unit", "component", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = items.select("doc_id", "row", "unit").join(linked, "unit").select("doc_id", "row", "class_id", "class_size", "n_links", "component")
    none = docs.join(items.select("row").distinct(), "row", "left_anti")
    return found.union(none.select("doc_id", "row", F.col("doc_id"), F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("binary")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs of which none is similar to a kept one of a lesser id: one of each class, with docs' columns.

    Where rows of a class share its least id, the one with the least hash of its text stays; rows that repeat
    both, the last column's too, stay together.
    """
    found = jaccard_join(docs).filter("class_size > 1")
    keep = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("keep"))
    gone = found.join(keep, "component").filter(F.col("row") != F.col("keep.row")).select(F.col("row").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), row_key("doc_id", "text").alias("row"))
    return rows.join(gone, F.col("row") == F.col("_gone"), "left_anti").select("doc.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "n_links", F.hex("component").alias("class_key"))
