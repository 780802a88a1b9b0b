import base64
import gzip
import hashlib
import random
import zlib

import pytest

from editpairs.llm import warc as A

KIND = "page_id long, url string, html string, place int"


def brute(rows, least=0):
    out, groups = [], {}
    for k, (page_id, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((page_id is not None, page_id or 0, k))
    for html, members in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        keep = max(members)
        for known, page_id, k in members:
            revisit = len(data) >= least and (known, page_id, k) != keep
            out.append((page_id if known else None, len(data), digest, "revisit" if revisit else "response", keep[1] if revisit and keep[0] else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://x.example/{i}", f"<html>seite {i} äöü \U0001f600</html>" * (i % 7)) for i in range(60)]
ROWS += [(100 + i, "http://x.example/ä b\r\nc", "the same page") for i in range(40)]
ROWS += [(200, None, None), (201, "u", ""), (None, "u", "the same page"), (None, "u", "none"), (None, "v", "none"), (139, "w", "the same page"), (139, "w", "the same page"), (-5, "w", "long " * 30000)]


@pytest.mark.parametrize("least, files, range_bytes", [(0, 64 << 20, 8 << 20), (14, 900, 61)])
def test_round_trip_against_brute_force(spark, tmp_path, monkeypatch, least, files, range_bytes):
    monkeypatch.setattr(A, "FILE_BYTES", files)
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], KIND).repartition(3)
    manifest = A.write_warc(pages, f"file://{tmp_path}/warc", least)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(ROWS)
    got = A.with_pages(A.read_warc(spark, f"file://{tmp_path}/warc", range_bytes))
    want = brute(ROWS, least)
    found = sorted(map(tuple, got.collect()), key=str)
    # rows that repeat an id and a payload are told apart by neither
    assert found == want


def test_records_are_whole(spark, tmp_path):
    A.write_warc(spark.createDataFrame([(*r, 1) for r in ROWS], KIND), f"file://{tmp_path}/w")
    rows = A.read_warc(spark, f"file://{tmp_path}/w", 500).collect()
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in ROWS}
    uris = {A.page_of(r.record_id): r.uri for r in rows if r.record_type != "warcinfo"}
    assert uris[7] == "http://x.example/7" and uris[101] == "http://x.example/%C3%A4%20b%0D%0Ac" and uris[200] is None
    assert len({r.record_id for r in rows}) == len(rows) and len({(r.path, r.offset) for r in rows}) == len(rows)
    for name in (tmp_path / "w").glob("*.gz"):  # any other reader of gzip finds the same
        assert gzip.decompress(name.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def archive(path, blocks):
    """An archive whose payloads are stored as they are, so that a payload's bytes lie in the file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    out, at = b"", []
    for k, block in enumerate(blocks):
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        at.append(len(out))
        out += packer.compress(head + block + b"\r\n\r\n") + packer.flush()
    path.write_bytes(out)
    return at


def test_payloads_that_look_like_records(spark, tmp_path):
    inner = A.member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:no>")], b"HTTP/1.1 200 OK\r\n\r\nno")
    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(400))
    blocks = [noise, noise + inner * 9 + noise, A.MAGIC * 50, inner * 3 + inner[:-9] + noise, noise * 4 + inner + noise, b"", inner]
    at = archive(tmp_path / "in/a.warc.gz", blocks)
    for step in (10**6, 300, 33):
        got = A.read_warc(spark, f"file://{tmp_path}/in", step, payloads=False).select("offset", "record_id", "payload_bytes").collect()
        assert sorted(map(tuple, got)) == [(o, f"<urn:x:{k}>", None) for k, o in enumerate(at)], step


def test_broken_archives_and_none(spark, tmp_path):
    archive(tmp_path / "cut/a.warc.gz", [b"x" * 500, b"y" * 500])
    whole = (tmp_path / "cut/a.warc.gz").read_bytes()
    (tmp_path / "cut/a.warc.gz").write_bytes(whole[:-5])
    for step in (10**6, 100):
        with pytest.raises(Exception, match="cut off"):
            A.read_warc(spark, f"file://{tmp_path}/cut", step).collect()
    empty = A.write_warc(spark.createDataFrame([], KIND), f"file://{tmp_path}/none")
    assert empty.count() == 0 and A.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    record = A.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:AAAA"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\nx")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.warc.gz").write_bytes(record)
    with pytest.raises(Exception, match="another digest"):
        A.read_warc(spark, f"file://{tmp_path}/bad").collect()


@pytest.mark.parametrize("page_id", [None, 0, 5, -1, 2**63 - 1, -(2**63)])
def test_names(page_id):
    for copy in (0, 7, 2**54 + 3):
        name = A.record_urn(page_id, copy)
        assert A.page_of(f"<{name}>") == page_id and len(name) == 45
    assert A.record_urn(page_id, 1) != A.record_urn(page_id, 2)


def test_query_against_sql(spark):
    import duckdb

    duckdb.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = duckdb.execute(A.OP12_SQL).fetchall()
    assert want and sorted(map(str, map(tuple, A.op12_warc(spark, "/root/testdata/sf0.001").collect()))) == sorted(map(str, want))
