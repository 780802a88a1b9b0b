"""A Merkle manifest of a dataset in van Emde Boas layout (operator 13).

A tree of degree ARITY over a group's leaves is cut into aligned blocks of HEIGHT levels, a block a row of the
manifest. A block is one array of digests in van Emde Boas order: its levels are split at half height, the top
half comes first, then each subtree of the bottom half, each laid out the same way. Where a node lies follows
from its level and number by arithmetic alone, so building a block and finding siblings in it need no pointers,
and touch few cache lines whatever their size. Block roots are the leaves of the next layer of blocks, until
one is left, the group's subroot; subroots are the leaves of one more such tree. Proofs come down the same way:
a block hands to each block below it the siblings on its root's path.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.llm.common import partitions, written

#: Children of a node; levels below a block's root.
ARITY, HEIGHT = 3, 8


def hashed(parts) -> str:
    """H of digests: hex texts, one behind the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- addresses in a block


def nodes_at(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // ARITY**level)


@lru_cache(maxsize=4096)
def size(n: int, levels: int) -> int:
    """Nodes of a tree of so many levels over n leaves."""
    return sum(nodes_at(n, level) for level in range(levels))


def address(n: int, levels: int, level: int, index: np.ndarray) -> np.ndarray:
    """Where nodes of a level lie in the layout of a tree over n leaves; levels count from the leaves.

    The tree is full but for its right edge, at every level. So all bottom subtrees but the last have one size,
    and an address is the top half's size, the subtrees before, and the address within.
    """
    index = np.asarray(index, dtype=np.int64)
    if levels == 1:
        return np.zeros_like(index)
    low = levels // 2
    top = nodes_at(n, low)
    if level >= low:
        return address(top, levels - low, level - low, index)
    leaves, below = ARITY ** (low - 1), ARITY ** (low - 1 - level)
    tree, within = index // below, index % below
    last = nodes_at(n, low - 1) - 1
    out = size(top, levels - low) + tree * size(leaves, low)
    full = tree < last
    out[full] += address(leaves, low, level, within[full])
    out[~full] += address(n - last * leaves, low, level, within[~full])
    return out


@lru_cache(maxsize=64)
def addresses(n: int, levels: int) -> list[list[int]]:
    """address() of all nodes, level by level."""
    return [address(n, levels, level, np.arange(nodes_at(n, level))).tolist() for level in range(levels)]


def build(leaves: list[str], levels: int) -> bytes:
    """Digests of the tree over leaves in van Emde Boas order, 32 bytes each."""
    n, row = len(leaves), leaves
    out = np.zeros((size(n, levels), 32), dtype=np.uint8)
    for at in addresses(n, levels):
        out[at] = np.frombuffer(bytes.fromhex("".join(row)), dtype=np.uint8).reshape(-1, 32)
        row = [hashed(row[k : k + ARITY]) for k in range(0, len(row), ARITY)]
    return out.tobytes()


def levels_for(n: int) -> int:
    """Levels of a tree of its own over n leaves."""
    return 1 + next(h for h in range(64) if ARITY**h >= n)


Path = list[tuple[list[str], list[str]]]


def siblings(nodes: bytes, n: int, levels: int, index: int) -> Path:
    """Of a leaf, level by level below the root: the nodes of its run to its left and to its right."""
    out = []
    for at in addresses(n, levels)[:-1]:
        first = index - index % ARITY
        run = [nodes[32 * a : 32 * a + 32].hex() for a in at[first : first + ARITY]]
        out.append((run[: index - first], run[index - first + 1 :]))
        index //= ARITY
    return out


def folded(digest: str, path: Path) -> str:
    """The root that a node and the siblings on its path lead to."""
    for left, right in path:
        digest = hashed([*left, digest, *right])
    return digest


def in_order(path: Path) -> str:
    """All siblings on a path, bottom up, left to right."""
    return "".join(d for sides in path for side in sides for d in side)


def path_bytes(path: Path) -> bytes:
    """A path as bytes: for each level the numbers of digests to the left and right, then the digests."""
    return b"".join(bytes([len(left), len(right)]) + bytes.fromhex("".join([*left, *right])) for left, right in path)


def path_from(data: bytes) -> Path:
    out, at = [], 0
    while at < len(data):
        n, m = data[at], data[at + 1]
        digests = [data[at + 2 + 32 * k : at + 34 + 32 * k].hex() for k in range(n + m)]
        out.append((digests[:n], digests[n:]))
        at += 2 + 32 * (n + m)
    return out


# ---- leaves


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8's byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """SHA-256 of a row's encoded values."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `rank`, from 0 within their group, and the group's `total`; one range exchange, and a row a group and partition for what comes before."""
    spark = rows.sparkSession
    # equal rows are spread by a number of their own: which of them comes first makes no difference
    rows = rows.withColumn("_own", F.monotonically_increasing_id())
    keys = [group, *order, "_own"]
    rows = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("_own")
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "ranked-leaves")
    part = F.shiftright("_at", 33).alias("_part")
    runs = rows.groupBy(F.col(group).alias("_group"), part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_part")) - F.col("_n")  # a row a partition
    runs = runs.withColumns({"_before": before, "total": F.sum("_n").over(W.partitionBy("_group"))})
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_at", 33) == F.col("_part"))
    return rows.join(runs, on).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_group", "_part", "_n", "_first", "_before")


# ---- layers of blocks


BLOCK = "layer int, block long, n int, levels int, nodes binary, root binary"


def layer(leaves: DataFrame, group: str, number: int) -> DataFrame:
    """group and BLOCK of leaves (group, rank, digest, total: leaves of the group in this layer): a block for each ARITY^HEIGHT leaves in a row."""

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table["rank"].to_numpy())
        digests = [d.hex() for d in table["digest"].take(pa.array(order)).to_pylist()]
        total = table["total"][0].as_py()
        levels = min(levels_for(total), HEIGHT + 1)  # a group's only block is as high as it must be
        nodes = build(digests, levels)
        root = 32 * addresses(len(digests), levels)[-1][0]
        columns = {"layer": pa.array([number], pa.int32()), "block": table["block"][:1], "n": pa.array([len(digests)], pa.int32()), "levels": pa.array([levels], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "root": pa.array([nodes[root : root + 32]], pa.binary())}
        return pa.table({group: table[group][:1], **columns})

    kind = dict(leaves.dtypes)[group]
    blocks = leaves.withColumn("block", F.floor(F.col("rank") / F.lit(ARITY**HEIGHT)))
    return blocks.select(group, "block", "rank", "digest", "total").groupBy(group, "block").applyInArrow(one, f"{group} {kind}, {BLOCK}")


def tree(leaves: DataFrame, group: str) -> list[DataFrame]:
    """The layers of blocks over leaves (group, rank, digest, total), the leaves' own first; the last has one block a group.

    A group that is done rises no further. Layers are as many as the largest group's logarithm asks for, each
    ARITY^HEIGHT times smaller than the one below.
    """
    out, number = [], 0
    while True:
        found = written(layer(leaves, group, number), "merkle-layer")
        out.append(found)
        # more than one block, by its last block's number
        open_ = found.groupBy(F.col(group).alias("_group")).agg((F.max("block") + 1).alias("total")).filter("total > 1")
        open_ = written(open_, "merkle-open")
        if not open_.limit(1).count():
            return out
        above = found.join(open_, F.col(group).eqNullSafe(F.col("_group")))
        leaves, number = above.select(group, F.col("block").alias("rank"), F.col("root").alias("digest"), "total"), number + 1


def subroots(layers: list[DataFrame], group: str) -> DataFrame:
    """group and digest: the root of the group's last block."""
    rows = layers[0]
    for more in layers[1:]:
        rows = rows.union(more)
    return rows.groupBy(group).agg(F.max_by("root", "layer").alias("digest"))


def paths_down(layers: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """layers[0] with `above`: the path from a block's root to the whole tree's root; above: group, path of the group's subroot."""
    kind = dict(layers[0].dtypes)[group]

    def hand_down(batches):
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (group, "block", "n", "levels", "nodes", "above")}
            for key, block, n, levels, nodes, path in zip(*columns.values()):
                below = [path_bytes(siblings(nodes, n, levels, k)) + path for k in range(n)]
                first = block * ARITY**HEIGHT
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, batch.schema.field(group).type), pa.array(range(first, first + n), pa.int64()), pa.array(below, pa.binary())], names=[group, "block", "above"])

    start = above.select(F.col(group).alias("_group"), F.col("path").alias("_path"))
    for k in range(len(layers) - 1, -1, -1):
        rows = layers[k].join(start, F.col(group).eqNullSafe(F.col("_group")))
        if k < len(layers) - 1:  # blocks of groups that rise further get their own, others the group's
            given = handed.select(F.col(group).alias("_g"), F.col("block").alias("_b"), F.col("above").alias("_own"))
            rows = rows.join(given, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")), "left")
            rows = rows.select(*layers[k].columns, F.coalesce("_own", "_path").alias("above"))
        else:
            rows = rows.select(*layers[k].columns, F.col("_path").alias("above"))
        if k:
            handed = written(rows.mapInArrow(hand_down, f"{group} {kind}, block long, above binary"), "merkle-paths")
    return rows


class Manifest:
    """The trees over a table's rows: `leaves` (group, rank, what was given), `layers`, `top` (layers over subroots), `root`."""

    def __init__(self, rows: DataFrame, group: str, *order: str):
        """rows: group, digest (32 bytes), columns of order; leaves ascend by order, then by digest; nulls first."""
        self.group = group
        self.leaves = written(ranked(rows, group, *order, "digest"), "merkle-leaves")
        self.layers = tree(self.leaves, group)
        heads = subroots(self.layers, group).withColumn("all", F.lit(0))
        heads = ranked(heads, "all", group)
        self.heads = written(heads, "merkle-subroots")
        self.top = tree(self.heads, "all")
        self.root = subroots(self.top, "all").select(F.col("digest").alias("root"))  # one row

    def head_paths(self) -> DataFrame:
        """group, subroot, path: siblings from the group's subroot to the root."""
        spark = self.leaves.sparkSession
        top = paths_down(self.top, "all", spark.createDataFrame([(0, bytearray())], "all int, path binary"))

        def paths(batches):
            for batch in batches:
                for block, n, levels, nodes, above in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    first = block * ARITY**HEIGHT
                    yield pa.RecordBatch.from_pydict({"rank": pa.array(range(first, first + n), pa.int64()), "path": pa.array([path_bytes(siblings(nodes, n, levels, k)) + above for k in range(n)], pa.binary())})

        found = top.select("block", "n", "levels", "nodes", "above").mapInArrow(paths, "rank long, path binary")
        return self.heads.join(found, "rank").select(self.group, F.col("digest").alias("subroot"), "path")

    def proofs(self, changed: str = "digest") -> DataFrame:
        """The leaves with subroot, root, proof (H of all siblings to the root, bottom up) and folded (the root that column `changed` leads to)."""
        heads = written(self.head_paths(), "merkle-head-paths")
        blocks = paths_down(self.layers, self.group, heads.select(self.group, "path"))
        # the subroot travels with the blocks, of which there is one for thousands of leaves
        blocks = blocks.join(heads.select(F.col(self.group).alias("_group"), "subroot"), F.col(self.group).eqNullSafe(F.col("_group")))
        blocks = written(blocks.select("_group", F.col("block").alias("_block"), "n", "levels", "nodes", "above", "subroot"), "merkle-blocks")
        place = F.floor(F.col("rank") / F.lit(ARITY**HEIGHT)).alias("_block")
        rows = self.leaves.select(F.col(self.group).alias("_group"), place, F.struct("*").alias("leaf"), (F.col("rank") % ARITY**HEIGHT).cast("int").alias("index"), F.col(changed).alias("changed"))
        schema = rows.schema["leaf"].dataType.simpleString()

        def prove(left: pa.Table, right: pa.Table) -> pa.Table:
            proof, ends = [], []
            if len(left):
                n, levels, nodes = (right[c][0].as_py() for c in ("n", "levels", "nodes"))
                above = path_from(right["above"][0].as_py())
                rest = in_order(above)
                ascend: dict[str, str] = {}
                for index, digest in zip(left["index"].to_pylist(), left["changed"].to_pylist()):
                    path = siblings(nodes, n, levels, index)
                    proof.append(hashlib.sha256((in_order(path) + rest).encode()).digest())
                    end = folded(digest.hex(), path)
                    if end not in ascend:  # leaves as they were all end in the block's root
                        ascend[end] = folded(end, above)
                    ends.append(bytes.fromhex(ascend[end]))
            subroot = right["subroot"].take(pa.array([0] * len(left), pa.int64()))
            return pa.table({"leaf": left["leaf"], "subroot": subroot, "proof": pa.array(proof, pa.binary()), "folded": pa.array(ends, pa.binary())})

        found = rows.groupBy("_group", "_block").cogroup(blocks.groupBy("_group", "_block")).applyInArrow(prove, f"leaf {schema}, subroot binary, proof binary, folded binary")
        return found.select("leaf.*", "subroot", "proof", "folded").join(F.broadcast(self.root))  # one row


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of documents by source. A null doc_id comes first and is never tampered with; rows that repeat one ascend by leaf."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(*fields, F.col("text")).alias("digest"), leaf(*fields, text).alias("tampered"))
    found = Manifest(rows, "source", "doc_id").proofs("tampered")
    text_of = lambda c, name: F.lower(F.hex(c)).alias(name)
    return found.select(
        "doc_id", text_of("digest", "leaf"), text_of("subroot", "subroot"), text_of("root", "root"), text_of("proof", "proof_sha256"),
        text_of("folded", "folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
