"""What several operators need: shared folders, joins that stand hot keys, and arrays of text."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local one is made: in local mode alone, as in tests.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        master = sc.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/editpairs-{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of whole texts of a few MB, so that a worker's memory doesn't grow with the texts' length."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    path = shared_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a written() table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that hold more than one in so many rows count as hot, so there are at most so many of them.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, away: Column) -> DataFrame:
    """left LEFT JOIN right on key, where right has one row per key and its column `rows` counts key's rows in left.

    Of keys with over total / HOT_KEYS rows there are fewer than HOT_KEYS, whatever the input: their rows of
    right are broadcast. Rows of left that found theirs then travel under `away`, which must differ from
    every key and from row to row, so no hot key lands in one task.
    """
    values = [c for c in right.columns if c != key]
    is_hot = F.col(rows) * HOT_KEYS > F.lit(int(total))
    hot = right.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = right.filter(~is_hot).select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_key_or_away", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(away))
    out = out.join(cold, F.col("_key_or_away") == F.col("_key"), "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*left.columns, *(found[c].alias(c) for c in values))


def blocks_of(texts: list[str], chars: int = 1 << 20):
    """Ranges [a, b) of texts with about so many characters each; a longer text is a range by itself."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point, is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each code point, is it a letter, a mark or a digit of a word?"""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(texts: list[str], gap: int) -> np.ndarray:
    """Lower-cased code points of the texts, each text preceded by `gap` zeros; zeros in a text become spaces."""
    pad = "\0" * gap
    joined = pad + pad.join(t.replace("\0", " ") if "\0" in t else t for t in texts)
    return np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd factor for polynomial hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, or more of them."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, 1 << 20) + 1, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h[i] = sum of values[j] * BASE^j over j < i; any range's hash follows from two of them."""
    terms = values.astype(np.uint64) * powers(BASE, len(values))[: len(values)]
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each range [start, end), the same wherever the range lies."""
    return mix64((prefix[end] - prefix[start]) * powers(UNBASE, len(prefix))[start])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of its text, code point offset of its end in the joined array).

    A word is a longest run of letters and digits.
    """
    codes = code_points(texts, 1)
    inside = word_table()[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.cumsum(codes == 0)[start] - 1 if len(start) else np.zeros(0, dtype=np.int64)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), text, end
    return range_hash(prefix_hash(codes), start, end), text, end


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words, number of its text); a text with fewer words has one shingle of them all."""
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    prefix = prefix_hash(word)
    short = (count > 0) & (count < size)
    start = np.flatnonzero(np.arange(len(word)) - first[text] <= count[text] - size) if len(word) else np.zeros(0, int)
    starts = np.concatenate((start, first[short]))
    ends = np.concatenate((start + size, first[short] + count[short]))
    owner = np.concatenate((text[start], np.flatnonzero(short)))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), owner
    order = np.argsort(owner, kind="stable") if short.any() else slice(None)
    return range_hash(prefix, starts, ends)[order], owner[order]


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of an Arrow binary column, offsets of its values in them), without a copy; no nulls."""
    wide = str(column.type).startswith("large")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)
