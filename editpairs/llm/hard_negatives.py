"""Hard-negative mining by a secondary-sort shuffle (operator 11).

Every pair of an anchor and a row is scored once: rows lie in tiles, anchors in packs, and each (tile, pack) is
a block of one matrix product, rows of the anchor's own label first, all others afterwards. What leaves a
block is what can still count: the best rows of the anchor's label, and of each positive's window the best
others. Those pair scores are packed into keys of (anchor, descending score, kind, id), repartitioned by
anchor and sorted within partitions. A streaming iterator then reads each anchor's keys once: a positive
opens a window of scores, a negative is given to the open windows that it falls into. It holds the open
windows of one anchor, never the anchor's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.llm.bit_sliced import matrix
from editpairs.llm.common import partitions, written

#: Rows of a tile, anchors of a pack, anchors scored together.
TILE, PACK, CHUNK = 32768, 4096, 64

#: A packed key; bytes in this order sort as (anchor, descending score, positives first, id, row).
KEY = np.dtype([("anchor", ">i8"), ("anchor_id", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">i8")])
SIGN, MOST = np.uint64(1 << 63), np.int64(2**63 - 1)


def sound_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own), id, label, x = floor(scale * component) of rows with an id, a label and a whole vector."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.col("embedding").cast("array<double>")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False)))
    columns = [F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("x")]
    return vectors.filter(whole).select(F.monotonically_increasing_id().alias("row"), *columns)


BLOCK = "rows binary, ids binary, labels binary, bounds binary, x binary, width int"


def blocks(rows: DataFrame, by: str) -> DataFrame:
    """One row for each value of `by`: rows (row, id, label, x, bounds) in order of label and id, as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        row, id_, label = (table[c].to_numpy() for c in ("row", "id", "label"))
        order = np.lexsort((row, id_, label))
        x = matrix(table["x"])[order]
        most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        width = next(w for w in (2, 4, 8) if w == 8 or most < 1 << (8 * w - 1))
        bounds = matrix(table["bounds"])[order]
        data = [row[order].tobytes(), id_[order].tobytes(), label[order].tobytes(), bounds.astype("<i8").tobytes(), x.astype(f"<i{width}").tobytes()]
        return pa.table({by: table[by][:1], **{n: pa.array([d], pa.binary()) for n, d in zip(("rows", "ids", "labels", "bounds", "x"), data)}, "width": pa.array([width], pa.int32())})

    return rows.groupBy(by).applyInArrow(pack, f"{by} long, {BLOCK}")


class Block:
    """The arrays of one row of blocks()."""

    def __init__(self, table: pa.Table):
        one = {c: table[c][0].as_py() for c in ("rows", "ids", "labels", "bounds", "x", "width")}
        self.row, self.id, self.label = (np.frombuffer(one[c], dtype="<i8") for c in ("rows", "ids", "labels"))
        self.bounds = np.frombuffer(one["bounds"], dtype="<i8").reshape(len(self.row), -1)
        self.x = np.frombuffer(one["x"], dtype=f"<i{one['width']}").reshape(len(self.row), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of a and b, as int64; the shorter side counts as filled up with zeros."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    most = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    bound = most(a) * most(b) * wide
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def best(scores: np.ndarray, fits: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores among those that fit; equal ones by column."""
    n, m = scores.shape
    k = min(k, m)
    if not n or not k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = -(1 << 62)
    if np.abs(scores).max(initial=0) < 1 << 45:
        single = (scores << 16) - np.arange(m)  # m is TILE at most, so no two are equal
        if fits is not None:
            single = np.where(fits, single, least)
        column = np.argpartition(single, m - k, axis=1)[:, m - k :]
        kept = np.take_along_axis(single, column, axis=1) > least
    else:
        ordered = np.argsort(-scores if fits is None else np.where(fits, -scores, MOST), axis=1, kind="stable")
        column = ordered[:, :k]
        kept = np.ones_like(column, dtype=bool) if fits is None else np.take_along_axis(fits, column, axis=1)
    return np.broadcast_to(np.arange(n)[:, None], column.shape)[kept], column[kept]


def own_label(anchors: Block, tile: Block, k: int):
    """(anchors' places, tile's places, scores) of each anchor's k best other rows of its label in the tile."""
    for label in np.unique(anchors.label):
        a, b = np.searchsorted(tile.label, [label, label + 1])
        among = np.flatnonzero(anchors.label == label)
        for s in range(0, len(among) if b > a else 0, CHUNK):
            some = among[s : s + CHUNK]
            scores = products(anchors.x[some], tile.x[a:b])
            i, j = best(scores, anchors.row[some][:, None] != tile.row[a:b][None, :], k)
            yield some[i], a + j, scores[i, j]


def other_labels(anchors: Block, tile: Block, k: int):
    """The same for rows of other labels that lie in a window of anchors.bounds (least, most, least, most ...), k a window."""
    by_id = np.lexsort((tile.row, tile.id))
    x, label = tile.x[by_id], tile.label[by_id]
    for s in range(0, len(anchors.row), CHUNK):
        some = np.arange(s, min(s + CHUNK, len(anchors.row)))
        scores = products(anchors.x[some], x)
        other = anchors.label[some][:, None] != label[None, :]
        found = []
        for w in range(0, anchors.bounds.shape[1], 2):
            low, high = anchors.bounds[some, w][:, None], anchors.bounds[some, w + 1][:, None]
            i, j = best(scores, other & (scores >= low) & (scores <= high), k)
            found.append(i * len(by_id) + j)
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        i, j = np.divmod(pair, len(by_id))
        yield some[i], by_id[j], scores[i, j]


def scored(tiles: DataFrame, packs: DataFrame, n_tiles: int, n_packs: int, choose, k: int, kind: int) -> DataFrame:
    """anchor, score and key of the pairs that `choose` takes from each (tile, pack)."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [np.zeros(0, dtype=KEY)]
        if len(left) and len(right):
            tile, anchors = Block(left), Block(right)
            for i, j, score in choose(anchors, tile, k):
                key = np.zeros(len(i), dtype=KEY)
                flipped = lambda v: v.astype(np.uint64) ^ SIGN  # noqa: E731  signed order as unsigned bytes
                key["anchor"], key["anchor_id"], key["down"] = anchors.row[i], flipped(anchors.id[i]), ~flipped(score)
                key["kind"], key["id"], key["row"] = kind, flipped(tile.id[j]), tile.row[j]
                keys.append(key)
        data = b"".join(k.tobytes() for k in keys)  # joining the arrays would put numbers in the machine's byte order
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(data) // KEY.itemsize, [None, pa.py_buffer(data)])
        found = decoded(data)
        return pa.table({"anchor": found["anchor"], "score": found["score"], "key": column.cast(pa.binary())})

    left, right = tiles.withColumn("pack", every(n_packs)), packs.withColumn("tile", every(n_tiles))
    return left.groupBy("tile", "pack").cogroup(right.groupBy("tile", "pack")).applyInArrow(each, "anchor long, score long, key binary")


def decoded(data: bytes) -> dict[str, np.ndarray]:
    """Columns of packed keys, one behind the other."""
    raw = np.frombuffer(data, dtype=KEY)
    signed = lambda v: (v.astype(np.uint64) ^ SIGN).astype(np.int64)
    return {"anchor": raw["anchor"].astype(np.int64), "anchor_id": signed(raw["anchor_id"]), "score": signed(~raw["down"].astype(np.uint64)), "kind": raw["kind"], "id": signed(raw["id"])}


def window_of(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Least and most whole n with low[0] * score <= low[1] * n and high[1] * n <= high[0] * score."""
    return -(-low[0] * score // low[1]), high[0] * score // high[1]


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def streamed(batches, positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int]):
    """Sorted keys in, negatives out: open windows of the anchor at hand are all that is kept."""
    anchor, opened, windows = None, 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, out = decoded(b"".join(batch.column(0).to_pylist())), []
        for a, anchor_id, score, kind, id_ in zip(*(keys[c].tolist() for c in ("anchor", "anchor_id", "score", "kind", "id"))):
            if a != anchor:
                anchor, opened, windows = a, 0, []
            if kind == 0:
                if opened < positives:
                    opened += 1
                    windows.append([id_, score, *window_of(score, low, high), 0])
                continue
            shut = False
            for w in windows:
                if score < w[2]:
                    shut = True  # scores only fall from here
                elif score <= w[3]:
                    w[4] += 1
                    out.append((anchor_id, w[0], w[4], id_, w[1], score))
                    shut = shut or w[4] == negatives
            if shut:
                windows = [w for w in windows if score >= w[2] and w[4] < negatives]
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(columns)], names=[x.split()[0] for x in NEGATIVES.split(", ")])


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256) -> DataFrame:
    """NEGATIVES: for each anchor's first `positives` rows of its label, the first `negatives` rows of another label in the positive's window.

    vectors: vec_id, label (whole numbers), embedding; is_anchor: a condition on vec_id. Scores are inner products of
    floor(scale * x), 64-bit integers, and must fit; larger ones come first, ties by smaller vec_id. A negative's
    score lies between low and high (as fractions) of the positive's, so a positive with a score below zero has
    none. Rows with a null id, a null label or an unsound vector take no part; shorter vectors count as filled up
    with zeros; an anchor's own row isn't its positive, another row of the same vec_id may be; repeated anchor
    rows are answered each; extra columns are ignored; an empty table gives no row. TILE rows x PACK anchors are
    what a task holds; at most `positives` + positives x negatives keys an anchor and tile are shuffled.
    """
    rows = written(sound_rows(vectors, scale), "quantised-labelled")
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor(F.col("id")))).first()
    n_tiles, n_packs = max(1, -(-n_rows // TILE)), max(1, -(-n_anchors // PACK))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n).cast("long"))
    none = F.array().cast("array<long>")
    tiles = written(blocks(rows.withColumns({"tile": dealt(n_tiles), "bounds": none}), "tile"), "row-tiles")
    anchors = rows.filter(is_anchor(F.col("id"))).withColumn("pack", dealt(n_packs))
    near = scored(tiles, blocks(anchors.withColumn("bounds", none), "pack"), n_tiles, n_packs, own_label, positives, 0)
    first = W.partitionBy("anchor").orderBy("key")
    near = written(near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives).select("anchor", "score", "key"), "positive-keys")
    windows = near.groupBy("anchor").agg(F.collect_list("score").alias("scores"))
    bound = lambda s: F.array(F.ceil(F.lit(low[0]) * s / F.lit(low[1])), F.floor(F.lit(high[0]) * s / F.lit(high[1])))
    windows = windows.select(F.col("anchor").alias("row"), F.flatten(F.transform("scores", lambda s: bound(s.cast("decimal(25,0)")).cast("array<long>"))).alias("bounds"))
    packs = blocks(anchors.join(windows, "row"), "pack")
    far = scored(tiles, packs, n_tiles, n_packs, other_labels, negatives, 1)
    ordered = near.union(far).repartition(partitions(vectors.sparkSession), "anchor").sortWithinPartitions("key").select("key")
    return ordered.mapInArrow(lambda batches: streamed(batches, positives, negatives, low, high), NEGATIVES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), lambda i: i % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, c.place AS place, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.place <> c.place
), p AS (
  SELECT anchor, anchor_id, place, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
