"""Token ids in binary files, with document boundaries in Elias-Fano form (operator 2).

A shard file holds the ids of a range of documents, in ascending doc_id order:

    ids, little-endian | part 1: Elias-Fano of the documents' ends | part 2: Elias-Fano of doc_id - least doc_id
    u32 version, u32 bytes an id, u64 documents, u64 ids, i64 least doc_id, u64 bytes of each part, "TOKSHARD"

The ids are streamed to the file as they are made; what a task holds is two numbers a document. Files are
written by the executors with pyarrow's file systems, each under a name of its own first and then renamed,
so a repeated task leaves one whole file. Reading selects the boundaries of a few hundred documents at a
time from the Elias-Fano parts, and then reads their ids; no table of offsets is made.
"""

from __future__ import annotations

import itertools
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpairs.llm.common import partitions, shared_dir, written
from editpairs.llm.elias_fano import EliasFano
from editpairs.llm.tokens import as_binary, encoder, tokenizer_path

MAGIC = b"TOKSHARD"
TAIL = struct.Struct("<IIQQqQQ8s")
NULL_ID = -(2**63)
#: Bytes of text of a shard, about, and documents that are read together.
SHARD_BYTES, TOGETHER = 16 << 20, 256


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shard(uri: str, width: int, parts) -> tuple[int, int]:
    """Write parts (ascending doc_ids, ids of each with its end, all ids as bytes) to a file as they come; (documents, ids)."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own, doc_ids, sizes = f"{path}.{uuid.uuid4().hex}", [], []
    with store.open_output_stream(own) as f:
        for ids_of, size, data in parts:
            doc_ids.append(ids_of)
            sizes.append(size)
            f.write(data)
        doc_ids, ends = np.concatenate(doc_ids), np.cumsum(np.concatenate(sizes))
        least = int(doc_ids[0])
        bounds = [EliasFano.encode(ends).to_bytes(), EliasFano.encode(doc_ids.astype(np.uint64) - np.uint64(least % 2**64)).to_bytes()]
        for x in bounds:
            f.write(x)
        f.write(TAIL.pack(1, width, len(doc_ids), int(ends[-1]), least, *map(len, bounds), MAGIC))
    store.move(own, path)
    return len(doc_ids), int(ends[-1])


class Shard:
    """An open shard file."""

    def __init__(self, uri: str):
        store, path = file_system(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - TAIL.size)
        _, self.width, self.n, self.n_ids, self.least, a, b, magic = TAIL.unpack(self.file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.file.seek(size - TAIL.size - a - b)
        self.ends, self.docs = EliasFano.from_bytes(self.file.read(a)), EliasFano.from_bytes(self.file.read(b))

    def span(self, i: int) -> tuple[int, int]:
        """First id and end of document number i, by select alone."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 begin, and where the last one ends."""
        first = [self.ends.select(a - 1)] if a else [0]
        return np.concatenate((first, self.ends.slice(a, b).astype(np.int64)))

    def doc_ids(self, a: int, b: int) -> np.ndarray:
        return (self.docs.slice(a, b) + np.uint64(self.least % 2**64)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), dtype=f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, spaces: str = "lead") -> DataFrame:
    """Encode docs (doc_id, text) into shard files below uri; the manifest: shard, path, n_docs, n_ids.

    Range partitions by doc_id are the shards, as many as the texts' bytes ask for. A null text is empty; a
    null doc_id sorts first and is written as the least 64-bit integer; rows that repeat an id are put in
    order of their texts; extra columns are ignored; an empty table makes no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, -(-rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] // SHARD_BYTES))
    rows = rows.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")

    def shard(batches):
        coder, number = encoder(tokenizer, spaces), TaskContext.get().partitionId()

        def parts():
            for batch in batches:
                for a, b, ids, at in coder.ended(batch.column(1), end_id):
                    yield batch.column(0).to_numpy()[a:b], np.diff(at), ids.tobytes()

        found = parts()
        if (first := next(found, None)) is None:
            return
        path = f"{uri}/shard-{number:06d}.tok"
        n_docs, n_ids = write_shard(path, coder.dtype.itemsize, itertools.chain([first], found))
        yield pa.RecordBatch.from_pydict({"shard": [number], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    return written(rows.mapInArrow(shard, "shard long, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32)."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    based = based.repartition(partitions(manifest.sparkSession), "path").select("path", "base")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                for a in range(0, shard.n, TOGETHER):
                    b = min(a + TOGETHER, shard.n)
                    at, doc_ids = shard.bounds(a, b), shard.doc_ids(a, b)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID),
                        "start": at[:-1] + base,
                        "n_tokens": np.diff(at),
                        "ids": as_binary(shard.ids(int(at[0]), int(at[-1])).astype("<u4"), at - at[0]),
                    })
                shard.close()

    return based.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, shared_dir(spark, "token-files"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    out = read_token_files(manifest)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
