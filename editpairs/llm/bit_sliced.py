"""Exact top-k search by inner product over a bit-sliced index (operator 6).

Index: blocks of rows; of each attribute its most significant bits, one bitmap over the block's rows a bit,
and the exact values beside them. Search: for a chunk of queries, the attributes' slices are multiplied by
the query's components and added with bitmap arithmetic (shifts, ripple-carry adders), which gives the
slices of a truncated score. From the most significant slice downward the k-th largest truncated score is
found; rows that truncation may have put below it are the boundary, and those few get their exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.llm.common import written

#: Rows of an index block, most significant bits kept of an attribute, queries computed together, queries of a pack.
ROWS, BITS, CHUNK, PACK = 8192, 5, 64, 2048

FULL = np.uint64(2**64 - 1)


def quantised(vectors: DataFrame) -> DataFrame:
    """id and x = floor(1024 * component) of every row whose vector and id are whole: no null, NaN or infinity."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.col("embedding").cast("array<double>")
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(sound(v), F.lit(False))))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * 1024)).alias("x"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as an int64 matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def packed(rows: DataFrame, by: str) -> DataFrame:
    """One row for each value of `by`: its ids and values as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table["x"])
        return pa.table({by: table[by][:1], "ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "values": pa.array([x.tobytes()], pa.binary())})

    kind = dict(rows.dtypes)[by]
    return rows.groupBy(by).applyInArrow(pack, f"{by} {kind}, ids binary, values binary")


def slices_of(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(bitmaps by attribute and kept bit, least bit first, over the rows; least value; bits dropped)"""
    least = int(x.min()) if x.size else 0
    shifted = (x - least).astype(np.uint64)
    drop = max(0, int(shifted.max()).bit_length() - BITS) if x.size else 0
    bits = (shifted[:, :, None] >> np.arange(drop, drop + BITS, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, -len(x) % 64), (0, 0), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits.transpose(1, 2, 0), axis=2, bitorder="little")).view("<u8"), least, drop


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The index of rows (id, x) as a table: block, ids, values, slices, least, dropped."""

    def build(table: pa.Table) -> pa.Table:
        x = matrix(table["x"])
        slices, least, drop = slices_of(x)
        return pa.table({
            "block": table["block"][:1], "ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "values": pa.array([x.tobytes()], pa.binary()),
            "slices": pa.array([slices.tobytes()], pa.binary()), "least": [least], "dropped": [drop],
        })

    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return written(rows.groupBy("block").applyInArrow(build, "block long, ids binary, values binary, slices binary, least long, dropped long"), "bit-sliced-index")


def add(total: list[np.ndarray], addend: list[np.ndarray]) -> None:
    """total += addend, slice by slice with a carry."""
    carry = None
    for i in range(max(len(total), len(addend))):
        if i == len(total):
            total.append(np.zeros_like(total[0] if total else addend[0]))
        t = total[i]
        if i < len(addend):
            a = addend[i]
            both = t ^ a
            out = t & a
            if carry is not None:
                out |= carry & both
                both ^= carry
            total[i], carry = both, out
        elif carry is not None:
            total[i], carry = t ^ carry, t & carry
            if not carry.any():
                return
        else:
            return
    if carry is not None and carry.any():
        total.append(carry)


def truncated_scores(slices: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Slices of sum(|q| * y), y an attribute's kept bits, or their complement where q is negative; arrays by query and word."""
    size, negative = np.abs(q).astype(np.uint64), np.where(q < 0, FULL, np.uint64(0))
    score: list[np.ndarray] = []
    for t in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
        if score:
            score.insert(0, np.zeros_like(score[0]))
        part: list[np.ndarray] = []
        for d in range(q.shape[1]):
            on = size[:, d] >> np.uint64(t) & np.uint64(1)
            if not on.any():
                continue
            mask, sign = (np.uint64(0) - on)[:, None], negative[:, d, None]
            add(part, [(s[None, :] ^ sign) & mask for s in slices[d]])
        if part:
            if score:
                add(score, part)
            else:
                score = part
    return score or [np.zeros((len(q), slices.shape[2]), np.uint64)]


def boundary(score: list[np.ndarray], valid: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose truncated score is at least (the k-th largest of the valid rows) - slack."""
    among, need = valid.copy(), np.full(len(valid), k, dtype=np.int64)
    kth = [0] * len(valid)
    for bit in range(len(score) - 1, -1, -1):
        with_bit = among & score[bit]
        count = np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)
        enough = count >= need
        among = np.where(enough[:, None], with_bit, among & ~score[bit])
        need = np.where(enough, need, need - count)
        for i in np.flatnonzero(enough):
            kth[i] |= 1 << bit
    least = [max(0, t - int(s)) for t, s in zip(kth, slack)]
    above, equal = np.zeros_like(valid), valid.copy()
    for bit in range(len(score) - 1, -1, -1):
        wanted = np.array([FULL if x >> bit & 1 else 0 for x in least], dtype=np.uint64)[:, None]
        above |= equal & score[bit] & ~wanted
        equal &= ~(score[bit] ^ wanted)
    return above | equal


def search_block(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(number of the query, ids, exact scores) of each query's k best rows of the block, without rows of its own id."""
    ids = np.frombuffer(index["ids"], dtype=np.int64)
    x = np.frombuffer(index["values"], dtype=np.int64).reshape(len(ids), -1)
    dims = max(x.shape[1], queries.shape[1])
    slices = np.frombuffer(index["slices"], dtype="<u8").reshape(x.shape[1], BITS, -1)
    x, q = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (x, queries))
    drop = int(index["dropped"])
    rows = np.zeros(-(-len(ids) // 64) * 64, dtype=np.uint8)
    rows[: len(ids)] = 1
    every = np.packbits(rows, bitorder="little").view("<u8")
    order = np.argsort(ids, kind="stable")
    for a in range(0, len(q), CHUNK):
        part = q[a : a + CHUNK]
        valid = np.repeat(every[None, :], len(part), axis=0)
        low, high = (np.searchsorted(ids[order], query_ids[a : a + CHUNK], side=s) for s in ("left", "right"))
        for i in range(len(part)):
            for row in order[low[i] : high[i]]:
                valid[i, row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        score = truncated_scores(slices, part[:, : slices.shape[0]])
        lost = np.abs(part[:, : slices.shape[0]]).sum(axis=1)  # below 2^drop of each unit is cut off
        near = boundary(score, valid, k, lost if drop else np.zeros_like(lost))
        for i in range(len(part)):
            found = np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little"))
            exact = x[found] @ part[i]
            best = np.lexsort((ids[found], -exact))[:k]
            yield a + i, ids[found[best]], exact[best]


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest integer inner product for each query row.

    vectors: vec_id, embedding; is_query: a condition on vec_id. Components are floor(1024 * x); scores are
    64-bit integers and must fit. Null ids and unsound vectors take no part, as query or candidate; shorter
    vectors count as filled up with zeros; rows of the query's own id are no candidates; equal query rows are
    answered once, repeated candidates each; ties go to the smaller id; extra columns are ignored.
    """
    rows = written(quantised(vectors), "quantised")
    blocks = max(1, -(-rows.count() // ROWS))
    index = build_index(rows, blocks)
    queries = rows.filter(is_query(F.col("id"))).distinct()
    packs = max(1, -(-queries.count() // PACK))
    queries = queries.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)))
    queries = packed(queries, "pack").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    index = index.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            query_ids = np.frombuffer(right["ids"][0].as_py(), dtype=np.int64)
            queries = np.frombuffer(right["values"][0].as_py(), dtype=np.int64).reshape(len(query_ids), -1)
            for i, ids, scores in search_block(left.to_pylist()[0], query_ids, queries, k):
                out["query_id"] += [int(query_ids[i])] * len(ids)
                out["query"] += [i] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()} | {"pack": pa.array([right["pack"][0].as_py() if len(right) else 0] * len(out["score"]), pa.int64())})

    found = index.groupBy("block", "pack").cogroup(queries.groupBy("block", "pack")).applyInArrow(search, "query_id long, query long, vec_id long, score long, pack long")
    best = W.partitionBy("query_id", "pack", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
