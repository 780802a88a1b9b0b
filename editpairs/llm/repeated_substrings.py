"""Removal of every byte of a repeated 200-byte string (operator 5).

Candidates: the least-hashed of a window's 100-byte strings is its anchor, so equal windows have equal
anchors at equal places. Windows in a row that share an anchor make a segment. Segments whose anchor
occurs once hold nothing repeated and go. Equal segments of an anchor are repeated throughout and stand
for one text with a count. Different segments of an anchor are compared by a suffix array of the distinct
texts, built block by block by two-stage sorting; adjacent suffixes with a common prefix of 200 bytes are
repeated windows. An anchor with more than HOT_SEGMENTS distinct segments (a common passage's edge, with
as many continuations) would be one large block: its windows are counted by their 128-bit hash instead,
which adds up in each task before the shuffle.

Shuffles carry a segment's place and hashes (the bytes of undecided segments alone), and the texts twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.llm.common import binary_column, discard, mix64, partitions, prefix_hash, range_hash, written
from editpairs.llm.suffix_array import common_prefixes, suffix_array

WINDOW = 200
ANCHOR = 100
HOT_SEGMENTS = 1000
#: Bytes that a task looks at together: whole texts of this size in all, or one text's overlapping parts.
BLOCK = 1 << 18
#: Bytes of a block of the suffix array.
SORTED = 1 << 19


def _pieces(offsets: np.ndarray):
    """Ranges (first text, end text, first byte, end byte) of about BLOCK bytes; a longer text comes in overlapping parts."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        start, end = int(offsets[a]), int(offsets[b])
        if end - start <= 2 * BLOCK:
            yield a, b, start, end
        else:
            for s in range(start, end, BLOCK):
                yield a, b, s, min(end, s + BLOCK + WINDOW - 1)
        a = b


def _windows(data: np.ndarray, offsets: np.ndarray, a: int, b: int, start: int, end: int):
    """Starts of all windows within the texts [a, b) and bytes [start, end), relative to start, and their texts."""
    first = np.maximum(offsets[a:b], start) - start
    count = np.maximum(0, np.minimum(offsets[a + 1 : b + 1], end) - start - WINDOW + 1 - first)
    text = np.repeat(np.arange(a, b), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return place, text


def segments(data: np.ndarray, offsets: np.ndarray, piece) -> tuple[np.ndarray, ...]:
    """(text, start in the text, windows, hash of the anchor, hash of the segment) of the piece's segments."""
    a, b, start, end = piece
    place, text = _windows(data, offsets, a, b, start, end)
    if not len(place):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hash(data[start:end])
    at = np.arange(end - start - ANCHOR + 1)
    anchor = range_hash(prefix, at, at + ANCHOR)
    low = np.uint64((1 << 24) - 1)  # a piece has fewer bytes
    least = (anchor & ~low) | at.astype(np.uint64)
    span, need = 1, WINDOW - ANCHOR + 1
    while span * 2 <= need:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
    chosen = (least[place] & low).astype(np.int64)
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    first, text, chosen = place[head], text[head], chosen[head]
    whole = range_hash(prefix, first, first + count - 1 + WINDOW) ^ mix64(((chosen - first) << 32 | count).astype(np.uint64))
    return text, first + start - offsets[text], count, anchor[chosen], whole


def _keyed(docs: DataFrame) -> DataFrame:
    """row (a hash of id and text; rows that repeat both share it), text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("row"), "doc_id", text.cast("binary").alias("text"))


def _all_segments(docs: DataFrame) -> DataFrame:
    """row, at (start * 256 + windows - 1), anchor, segment"""

    def cut(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, offsets = binary_column(batch.column(1))
            for piece in _pieces(offsets):
                text, first, count, anchor, whole = segments(data, offsets, piece)
                if len(text):
                    yield pa.RecordBatch.from_pydict({"row": rows[text], "at": first << 8 | (count - 1), "anchor": anchor.view(np.int64), "segment": whole.view(np.int64)})

    return _keyed(docs).select("row", "text").mapInArrow(cut, "row long, at long, anchor long, segment long")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Undecided segments with their bytes, and the windows of hot anchors with a second hash in place of them."""

    def take(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, offsets = binary_column(batch.column(1))
            column = batch.column(2)
            of = np.repeat(np.arange(len(rows)), np.diff(column.offsets.to_numpy()))
            items = column.flatten()
            at, anchor = items.field(0).to_numpy(), items.field(1).to_numpy()
            single, hot = (items.field(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            first, count = (at >> 8) + offsets[of], (at & 255) + 1
            cold = np.flatnonzero(~hot)
            for a in range(0, len(cold), 4096):
                x = cold[a : a + 4096]
                if len(x):
                    cut = [data[s:e].tobytes() for s, e in zip(first[x], first[x] + count[x] - 1 + WINDOW)]
                    yield pa.RecordBatch.from_pydict({"row": rows[of[x]], "at": at[x], "key": anchor[x], "key2": np.zeros(len(x), np.int64), "single": single[x], "bytes": pa.array(cut, pa.binary())})
            warm = np.flatnonzero(hot)
            for a in range(0, len(warm), 1024):
                x = warm[a : a + 1024]
                each = np.repeat(x, count[x])
                within = np.arange(len(each)) - np.repeat(np.cumsum(count[x]) - count[x], count[x])
                low, high = int(first[x].min()), int((first[x] + count[x]).max()) + WINDOW
                for s in range(low, high, BLOCK):  # the batch's bytes part by part
                    inside = (first[each] + within >= s) & (first[each] + within < s + BLOCK)
                    if not inside.any():
                        continue
                    part = data[s : s + BLOCK + WINDOW]
                    start = first[each[inside]] + within[inside] - s
                    one = range_hash(prefix_hash(part), start, start + WINDOW)
                    two = range_hash(prefix_hash(mix64(part.astype(np.uint64) + np.uint64(1))), start, start + WINDOW)
                    yield pa.RecordBatch.from_pydict({
                        "row": rows[of[each[inside]]], "at": ((at[each[inside]] >> 8) + within[inside]) << 8, "key": one.view(np.int64), "key2": two.view(np.int64),
                        "single": single[each[inside]], "bytes": pa.nulls(int(inside.sum()), pa.binary()),
                    })

    joined = _keyed(docs).select("row", "text").join(wanted, "row").select("row", "text", "wanted")
    return joined.mapInArrow(take, "row long, at long, key long, key2 long, single boolean, bytes binary")


def repeated_windows(texts: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
    """Of each text, which of its first windows[i] windows occur again among all of them."""
    size = np.array([len(t) + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8) + np.uint8(1)  # no UTF-8 byte is ff: ends are 0
    valid = np.zeros(len(symbols) + 1, dtype=np.int8)
    valid[first] += 1
    np.add.at(valid, first + windows, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    order = suffix_array(symbols, WINDOW)
    order = order[valid[order]]
    same = common_prefixes(symbols, order, WINDOW) >= WINDOW
    again = np.zeros(len(symbols), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return [again[f : f + w] for f, w in zip(first, windows)]


def _compared(texts: DataFrame) -> DataFrame:
    """row, at: runs of repeated windows, of the segments that occur once, from the suffix arrays."""

    def compare(batches):
        held, size = [], 0

        def flush(part):
            windows = np.array([(at & 255) + 1 for _, at, *_ in part])
            rows, places = [], []
            for (row, at, _, single, _), again in zip(part, repeated_windows([x[4] for x in part], windows)):
                if not single or not again.any():
                    continue
                edge = np.diff(again.astype(np.int8), prepend=0, append=0)
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    rows.append(row)
                    places.append(((at >> 8) + s) << 8 | (e - s - 1))
            return pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "at": pa.array(places, pa.int64())})

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size > SORTED and x[2] != held[-1][2]:  # a new anchor
                    yield flush(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield flush(held)

    rows = texts.filter(F.col("bytes").isNotNull()).select("row", "at", "key", "single", "bytes")
    rows = rows.repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(compare, "row long, at long")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """row, ranges: array of at = start * 256 + windows - 1, of all repeated windows of docs (doc_id, text)."""
    every = written(_all_segments(docs), "all-segments")
    twice = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    found = written(every.join(written(twice, "anchors"), "anchor"), "segments")
    discard(every)
    texts = found.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("shown"))
    texts = written(texts, "segment-texts")
    kinds = texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    marked = written(texts.join(kinds, "anchor"), "marked-segments")
    marked = found.join(marked.filter("n > 1 OR kinds > 1"), ["anchor", "segment"])
    marked = marked.withColumn("open", (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("row") == F.col("shown"))))
    marked = written(marked.filter("n > 1 OR open").select("row", "at", "anchor", (F.col("n") == 1).alias("single"), (F.col("kinds") > HOT_SEGMENTS).alias("hot"), "open"), "candidates")
    # a hot anchor's repeated segments are repeated throughout; their windows count once for each segment text
    discard(found)
    wanted = marked.filter("open").groupBy("row").agg(F.collect_set(F.struct("at", "anchor", "single", "hot")).alias("wanted"))
    texts = written(_texts_of(docs, wanted), "segment-bytes")
    hot = texts.filter(F.col("bytes").isNull())
    again = hot.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "key2")
    ranges = marked.filter(~F.col("single")).select("row", "at")
    ranges = ranges.union(_compared(texts)).union(hot.filter("single").join(again, ["key", "key2"]).select("row", "at"))
    return ranges.groupBy("row").agg(F.collect_set("at").alias("ranges"))


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of docs (doc_id, text).

    A byte goes if a 200-byte string over it also starts anywhere else, in its own text too, as the input
    stands. A null text is empty; rows that repeat id and text count as two places, so both lose what is
    longer than a window; extra columns are ignored; kept may end inside a character, so it is binary.
    """

    def cut(batches):
        for batch in batches:
            data, offsets = binary_column(batch.column(1))
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                edges = np.zeros(len(text) + 1, dtype=np.int32)
                if ranges:
                    at = np.array(ranges)
                    np.add.at(edges, at >> 8, 1)
                    np.add.at(edges, (at >> 8) + (at & 255) + WINDOW, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = text[~gone].tobytes()
                for name, value in zip(out, (len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)):
                    out[name].append(value)
            out["kept"] = pa.array(out["kept"], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **out})

    kind = dict(docs.dtypes)["doc_id"]
    rows = _keyed(docs).join(repeated_ranges(docs), "row", "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(cut, f"doc_id {kind}, {OUT}")


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
