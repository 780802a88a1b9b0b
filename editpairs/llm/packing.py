"""Packing of documents into sequences by lexical retrieval (operator 10).

Documents are encoded once. Their terms are token ids, and a term's document frequency is counted over all
documents; that table has a row an id of the vocabulary at most. Documents are put in order of their PATH
heaviest terms (by BM25, of those that other documents have too), over range partitions: those with the same
heaviest term lie together, and where they are too many for a shard they are told apart by the next ones, so a
common term is never dealt out at random, whatever the corpus' size. A shard is a run of documents in this
order with about SHARD_TOKENS ids. Each shard builds a BM25 inverted index. A seed document asks its shard's
index for unused neighbours and takes them, best first, until its window is full; what doesn't fit of the last
one stays for another window. Windows inside a long document are sequences by themselves. So all sequences but
a shard's last are full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from editpairs.llm.common import binary_column, partitions, written
from editpairs.llm.tokens import as_binary, encoder, tokenizer_path

LENGTH = 2048
SHARD_TOKENS = 1_000_000
#: Heaviest terms that order documents; shards of a range partition, about, where there are more shards than partitions.
PATH, SHARDS = 4, 64
#: Terms of a seed that are looked up, and BM25's two parameters.
TERMS, K1, B = 16, 1.2, 0.75


def encoded(docs: DataFrame, tokenizer: str, end_id: int, spaces: str = "drop") -> DataFrame:
    """doc_id, ids (little-endian, end_id last), n for every row of docs (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches):
        coder = encoder(tokenizer, spaces)
        for batch in batches:
            for a, b, ids, at in coder.ended(batch.column(1), end_id):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), as_binary(ids, at), pa.array(np.diff(at))], names=["doc_id", "ids", "n"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(encode, f"doc_id {kind}, ids binary, n long"), "encoded")


def term_counts(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of an Arrow column of ids, by document and term."""
    data, at = binary_column(column)
    # two bytes each where they are enough: the codes' order takes most of the time
    wide, bits = (np.uint32, 16) if dtype.itemsize == 2 and len(column) <= 1 << 16 else (np.uint64, 32)
    code = np.repeat(np.arange(len(column), dtype=wide) << wide(bits), np.diff(at) // dtype.itemsize)
    code |= data[at[0] : at[-1]].view(dtype)
    code.sort()
    first = np.flatnonzero(np.concatenate((code[:1] == code[:1], code[1:] != code[:-1])))
    count, code = np.diff(first, append=len(code)), code[first].astype(np.int64)
    return code >> bits, code & (1 << bits) - 1, count


def document_frequency(rows: DataFrame, dtype: np.dtype) -> dict[int, int]:
    """Documents that hold each token id: a row an id of the vocabulary at most."""

    def count(batches):
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                _, term, _ = term_counts(batch.column(0).slice(a, 500), dtype)
                found = np.bincount(term, minlength=len(total))
                found[: len(total)] += total
                total = found
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": found, "n": total[found]})

    found = rows.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}


def heaviest(column: pa.Array, dtype: np.dtype, weight: np.ndarray, k: int = PATH) -> np.ndarray:
    """Of each document the k terms that weigh most, heaviest first, the lesser id of equal ones; -1 where no more weigh anything."""
    out = np.full((len(column), k), -1, dtype=np.int64)
    for a in range(0, len(column), 500):
        doc, term, count = term_counts(column.slice(a, 500), dtype)
        heavy = weight[term] * count * (K1 + 1) / (count + K1)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        for place in range(k if len(first) else 0):
            best = np.maximum.reduceat(heavy, first)
            hit = np.flatnonzero(heavy == np.repeat(best, np.diff(first, append=len(doc))))
            hit = hit[np.flatnonzero(np.diff(doc[hit], prepend=-1))]  # terms ascend in a document
            hit = hit[heavy[hit] > 0]
            out[a + doc[hit], place] = term[hit]
            heavy[hit] = 0
    return out


class Index:
    """BM25 postings of some units: by term, the units and their weights."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray):
        size = np.array([len(u) for u in units])
        term, unit = np.concatenate(units).astype(np.int64), np.repeat(np.arange(len(units)), size)
        code, tf = np.unique(term * len(units) + unit, return_counts=True)
        self.term, self.unit = code // len(units), code % len(units)
        norm = K1 * (1 - B + B * size / size.mean())
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.unit])
        self.first = np.searchsorted(self.term, np.arange(len(idf) + 1))
        order = np.lexsort((self.term, -self.weight, self.unit))
        head = np.searchsorted(self.unit[order], np.arange(len(units) + 1))
        self.best = [self.term[order[a : min(b, a + TERMS)]] for a, b in zip(head[:-1], head[1:])]

    def scores(self, seed: int) -> np.ndarray:
        """Of every unit for the seed's heaviest terms."""
        out = np.zeros(len(self.best))
        for t in self.best[seed]:
            part = slice(self.first[t], self.first[t + 1])
            out[self.unit[part]] += self.weight[part]
        return out


def pack(docs: list[np.ndarray], idf: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    out, sequence = [], 0
    start = np.zeros(len(docs), dtype=np.int64)
    for i, ids in enumerate(docs):
        for _ in range(len(ids) // LENGTH):
            out.append((i, int(start[i]), LENGTH, sequence, 0))
            start[i] += LENGTH
            sequence += 1
    units = [i for i, ids in enumerate(docs) if len(ids) > start[i]]
    if not units:
        return out
    index = Index([docs[i][start[i] :] for i in units], idf)
    left = np.array([len(docs[i]) - start[i] for i in units])
    ahead = 0
    while True:
        while ahead < len(units) and not left[ahead]:
            ahead += 1
        if ahead == len(units):
            return out
        offset = 0

        def take(u: int) -> None:
            nonlocal offset
            n = int(min(left[u], LENGTH - offset))
            out.append((units[u], int(start[units[u]]), n, sequence, offset))
            start[units[u]] += n
            left[u] -= n
            offset += n

        take(ahead)
        if offset < LENGTH:
            score = index.scores(ahead)
            score[left == 0] = 0
            found = np.flatnonzero(score)
            for u in found[np.lexsort((found, -score[found]))]:
                take(u)
                if offset == LENGTH:
                    break
        behind = ahead + 1
        while offset < LENGTH and behind < len(units):  # the index has no unused neighbour left
            if left[behind]:
                take(behind)
            behind += 1
        sequence += 1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int, spaces: str = "drop") -> DataFrame:
    """doc_id and PIECES for every row of docs (doc_id, text); each row's ids lie in its pieces once.

    sequence_id is the shard's number * 2^32 + the sequence's number in it. A null or empty text is its end
    id; rows that repeat an id are packed each; a text's ids must fit into a task's memory; extra columns are
    ignored; an empty table gives no piece.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = encoded(docs, tokenizer, end_id, spaces)
    dtype = encoder(tokenizer, spaces).dtype
    (n_docs, n_ids), df = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first(), document_frequency(rows, dtype)
    idf, shared = np.zeros(max(df, default=0) + 1), np.zeros(max(df, default=0) + 1)
    count = np.array(list(df.values()))
    idf[list(df)] = np.log(1 + (n_docs - count + 0.5) / (count + 0.5))
    shared[list(df)] = np.where(count > 1, idf[list(df)], 0)  # a term of one document has no neighbour
    idf = spark.sparkContext.broadcast((idf, shared))  # two numbers an id of the vocabulary

    def order(batches):
        for batch in batches:
            path = (heaviest(batch.column(1), dtype, idf.value[1]) + 1).astype(">u4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in path], pa.binary())], names=["doc_id", "ids", "path"])

    def pieces(held: list, number: int) -> pa.RecordBatch:
        ids = [x for _, x in held]
        doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pack(ids, idf.value[0])))
        crc = [zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([held[i][0] for i in doc.tolist()], doc_type), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": np.array([len(x) for x in ids], dtype=np.int64)[doc], "sequence_id": (number << 32) + sequence, "offset": offset})

    def shards(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() * (64 * SHARDS)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, np.frombuffer(data, dtype=dtype)))
                size += len(held[-1][1])
                if size >= SHARD_TOKENS:
                    yield pieces(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield pieces(held, number)

    doc_type = to_arrow_type(rows.schema["doc_id"].dataType)
    n = max(1, min(-(-n_ids // SHARD_TOKENS), max(partitions(spark), -(-n_ids // (SHARDS * SHARD_TOKENS)))))
    # copies have one path; their place in the written table spreads them
    rows = rows.select("doc_id", "ids").mapInArrow(order, f"doc_id {kind}, ids binary, path binary").withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(int(n), "path", "place").sortWithinPartitions("path", "place").select("doc_id", "ids")
    return rows.mapInArrow(shards, f"doc_id {kind}, {PIECES}")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"), end_id=1)
