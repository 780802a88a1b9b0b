"""WARC archives of pages: a deduplicating writer and a splittable reader (operator 12).

An archive is a chain of gzip members, one a record. The reader cuts archives into byte ranges. A task scans
its range for gzip's magic bytes and validates each candidate by inflating its first bytes and decoding a
record header; from the first good one it follows the chain and owns the records that start in its range. A
payload can hold bytes that look like a member, so an archive's ranges are held against each other: the end of
a range's last record must be where the next record begins, and a range that began elsewhere is scanned again
from there. Then all records are read, range by range, none twice and none missed.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.llm.common import join_hot, partitions, shared_dir, written
from editpairs.llm.token_files import file_system

MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes of an archive, about, bytes of a range, bytes read at a time, bytes of a record's header at most.
FILE_BYTES, RANGE_BYTES, READ, HEADER = 64 << 20, 8 << 20, 1 << 20, 1 << 16
#: Bytes inflated at a time: what lies behind a member's end is copied.
FEED = 1 << 14


# ---- records


def record_urn(page_id: int | None, copy: int) -> str:
    """A UUID of the custom kind that holds a page's id and which of its rows this is."""
    h = "0" * 16 if page_id is None else f"{page_id % 2**64:016x}"
    return f"urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-{'9' if page_id is None else '8'}{h[15]}{copy >> 48 & 0xFF:02x}-{copy % 2**48:012x}"


def page_of(urn: str) -> int | None:
    h = urn.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    value = int(h[:12] + h[13:16] + h[17], 16)
    return None if h[16] == "9" else value - 2**64 if value >= 1 << 63 else value


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head.encode()), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()))


def page_record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response and carries the HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_urn(page_id, copy)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        block += payload
    return member(fields, block)


def parsed_fields(data: bytes) -> tuple[dict[str, str], int] | None:
    """(fields by lower-case name, where the block begins) of a record's beginning; None if it is no record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    lines = [x.partition(b":") for x in data[:end].split(b"\r\n")[1:]]
    fields = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, colon, v in lines if colon}
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


# ---- writer


def staged(pages: DataFrame) -> DataFrame:
    """place (a number of its own), page_id, url, html (null: empty), digest (SHA-1 of the UTF-8), n_bytes."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("place"), F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    return written(rows.withColumns({"digest": F.unhex(F.sha1("html")), "n_bytes": F.octet_length("html").cast("long")}), "pages", compression="zstd")


def decided(rows: DataFrame, least_bytes: int) -> DataFrame:
    """place, to_page, to_place: the response that a row's record refers to, null for responses. Narrow rows only; hot digests aren't shuffled."""
    narrow = rows.filter(F.col("n_bytes") >= least_bytes).select("place", "page_id", "digest")
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "place"))
    groups = narrow.groupBy("digest").agg(last.alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = written(groups.select("digest", "copies", F.col("keep.page_id").alias("to_page"), F.col("keep.place").alias("to_place")), "repeated-payloads")
    away = F.concat("digest", F.col("place").cast("string").cast("binary"))
    found = join_hot(narrow, groups, "digest", "copies", narrow.count(), away)
    return found.filter(F.col("to_place").isNotNull() & (F.col("to_place") != F.col("place"))).select("place", "to_page", "to_place")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of pages (page_id, url, html) below folder; the manifest: path, n_records.

    Of pages with equal payloads of at least least_bytes bytes the one with the largest page_id is a response, the
    others revisit it; of rows that repeat that id too, one is the response; a null id counts as the smallest.
    A null html is empty, a null url has no Target-URI, others come back percent-encoded; extra columns are
    ignored; an empty table makes no archive. A payload must fit into a task's memory. Archives are written under
    a name of their own and renamed, in the order of the staged rows, so a repeated task leaves the same file.
    """
    rows = staged(pages)
    links = decided(rows, least_bytes)
    rows = rows.join(links, "place", "left")  # payloads are shuffled once at most, by a number that no two rows share
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)

    def write(batches):
        store, base = file_system(folder)
        part, number, file, count = TaskContext.get().partitionId(), 0, None, 0

        def close():
            nonlocal file, number
            path = f"{base}/pages-{part:05d}-{number:05d}.warc.gz"
            file.close()
            store.move(own, path)
            file, number = None, number + 1
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([count], pa.int64())})

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(batch.num_columns - 1)]
            for k, (place, page_id, url, digest, to_page, to_place) in enumerate(zip(*columns)):
                if file is None:
                    own, count = f"{base}/.{uuid.uuid4().hex}", 0
                    file = store.open_output_stream(own)
                    file.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{number}').urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                payload = batch.column(batch.num_columns - 1)[k].as_py().encode("utf-8", "surrogatepass")
                refers_to = None if to_place is None else record_urn(to_page, to_place)
                file.write(page_record(page_id, place, url, payload, base64.b32encode(digest).decode(), refers_to, date))
                count += 1
                if file.tell() >= FILE_BYTES:
                    yield close()
        if file is not None:
            yield close()

    columns = ["place", "page_id", "url", "digest", "to_page", "to_place", "html"]
    return written(rows.select(*columns).mapInArrow(write, "path string, n_records long"), "warc-manifest")


# ---- reader


class Members:
    """An archive from some offset on, member by member."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.start, self.held = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """n bytes from offset on, fewer at the end; small pieces come from a buffer."""
        if not self.start <= offset <= offset + n <= self.start + len(self.held):
            self.file.seek(offset)
            self.start, self.held = offset, self.file.read(max(n, READ))
        return self.held[offset - self.start : offset - self.start + n]

    def begins(self, offset: int) -> bool:
        """Does a record begin here: does its gzip member inflate to a header that decodes?"""
        inflate, head = zlib.decompressobj(31), b""
        try:
            while offset < self.size and not inflate.eof and len(head) < HEADER and b"\r\n\r\n" not in head:
                data = self.at(offset, FEED)
                head += inflate.decompress(data, HEADER)
                offset += len(data)
        except zlib.error:
            return False
        return parsed_fields(head) is not None

    def first(self, start: int, end: int) -> int | None:
        """The first record that begins in [start, end), by scanning for the magic bytes."""
        while start < end:
            data = self.at(start, min(READ, end - start) + len(MAGIC) - 1)
            found = data.find(MAGIC)
            while found >= 0 and start + found < end:
                if self.begins(start + found):
                    return start + found
                found = data.find(MAGIC, found + 1)
            start += READ
        return None

    def inflated(self, offset: int, keep: bool) -> tuple[bytes, int]:
        """(the member at offset, where it ends); unless kept, its beginning alone."""
        inflate, parts, held = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            data = self.at(offset, FEED)
            if not data:
                raise ValueError(f"a member is cut off at {offset}")
            offset += len(data)
            while data:
                out = inflate.decompress(data, READ)
                if keep or held < HEADER:
                    parts.append(out)
                    held += len(out)
                data = inflate.unconsumed_tail
        return b"".join(parts), offset - len(inflate.unused_data)


def opened(path: str) -> Members:
    store, name = file_system(path)
    file = store.open_input_file(name)
    return Members(file, file.size())


def scan(path: str, start: int, end: int, known: int | None = None) -> tuple[int | None, int | None]:
    """(first record that begins in the range, where the last of its records ends); `known`: where the next record begins."""
    archive = opened(path)
    with archive.file:
        first = archive.first(start, end) if known is None else known if known < end else None
        if first is None:
            return None, None
        after = first
        try:
            while after < min(end, archive.size):
                _, after = archive.inflated(after, keep=False)
        except (zlib.error, ValueError):
            if known is not None:
                raise
            return first, None  # it was no record, or the archive is broken: agreed() will tell
        return first, after


RANGE = "path string, start long, end long, first long, after long"


def scanned(ranges: DataFrame) -> DataFrame:
    """RANGE of ranges (path, start, end), each scanned by itself."""

    def each(batches):
        for batch in batches:
            rows = [(*row, *scan(*row)) for row in zip(*(batch.column(n).to_pylist() for n in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), *[pa.int64()] * 4])], names=["path", "start", "end", "first", "after"])

    return ranges.select("path", "start", "end").mapInArrow(each, RANGE)


def agreed(ranges: DataFrame) -> DataFrame:
    """RANGE of the same ranges, where each archive's records follow each other from its first byte on.

    A range that begins where the ones before it end was right, as nearly all are; one that lies in a record
    has none; any other is scanned again from where the record before it ends. Of an archive these are a few
    numbers for each of its ranges.
    """

    def follow(table: pa.Table) -> pa.Table:
        out, at = [], 0
        for row in sorted(table.to_pylist(), key=lambda r: r["start"]):
            if at >= row["end"]:
                row["first"] = row["after"] = None
            elif row["first"] != at or row["after"] is None:
                row["first"], row["after"] = scan(row["path"], row["start"], row["end"], at)
            at = row["after"] or at
            out.append(row)
        return pa.Table.from_pylist(out, schema=table.schema)

    return ranges.groupBy("path").applyInArrow(follow, RANGE)


def splits(spark: SparkSession, folder: str, range_bytes: int | None = None) -> DataFrame:
    """RANGE of all archives below folder; `first` null: no record begins in the range. Spark lists the files."""
    step = range_bytes or RANGE_BYTES
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).filter("length > 0")
    files = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, "length").alias("end")).repartition(partitions(spark), "path", "start")
    return written(agreed(scanned(ranges)), "warc-ranges")


RECORDS = "path string, offset long, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """(body of a stored HTTP message, Content-Length by its header)"""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return body, int(value)
    return body, None


def record_of(data: bytes) -> dict:
    """A whole record's values. A response's length and digest are those of its payload; a revisit's are what its header says of the full one."""
    fields, at = parsed_fields(data)
    block = data[at : at + int(fields["content-length"])]
    kind = fields["warc-type"]
    stored = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    body, length = http_payload(block) if fields.get("content-type", "").startswith("application/http") else (block, None)
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if stored is not None and digest != stored:
            raise ValueError(f"payload of {fields.get('warc-record-id')} has another digest than its header says")
        stored, length = digest, len(body)
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "payload_digest": stored, "payload_bytes": length, "payload": body if kind == "response" else None}


def read_warc(spark: SparkSession, folder: str, range_bytes: int | None = None, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives below folder (any gzip-compressed WARC with a member a record), each record once.

    payloads: with them, or null. An archive that breaks off or a payload that doesn't fit its digest is an error.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def each(batches):
        for batch in batches:
            for path, end, first in zip(*(batch.column(n).to_pylist() for n in range(3))):
                archive, out, held = opened(path), [], 0
                with archive.file:
                    while first < min(end, archive.size):
                        data, after = archive.inflated(first, keep=True)
                        out.append({"path": path, "offset": first, **record_of(data)})
                        if not payloads:
                            out[-1]["payload"] = None
                        first, held = after, held + (len(data) if payloads else 0)
                        if held > READ or len(out) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)
                            out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)

    ranges = splits(spark, folder, range_bytes).filter("first IS NOT NULL").select("path", "end", "first")
    return ranges.repartition(partitions(spark), "path", "first").mapInArrow(each, RECORDS)


def with_pages(records: DataFrame) -> DataFrame:
    """The pages' records of write_warc(), with page_id and refers_to as numbers in place of the records' names."""

    def each(batches):
        for batch in batches:
            page = lambda n: pa.array([None if u is None else page_of(u) for u in batch.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([page(0), batch.column(2), batch.column(3), batch.column(4), page(1)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = records.filter(F.col("record_type").isin("response", "revisit")).select("record_id", "refers_to", "payload_bytes", "payload_digest", "record_type")
    return rows.mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return with_pages(read_warc(spark, folder, payloads=False))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM k
"""
