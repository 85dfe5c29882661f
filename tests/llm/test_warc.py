"""Operator 4: exact round trips."""

import hashlib
import io
import random

import pyarrow as pa
import pytest
import zstandard

from tidemark.llm.base import shared_dir
from tidemark.llm.bundles import BundleReader, BundleWriter
from tidemark.llm.warc import parse, read_archives, record, warc_round_trip, write_archives


def test_bundle_is_seekable_and_plain_zstd(tmp_path):
    rng = random.Random(0)
    records = [rng.randbytes(rng.randint(0, 900)) * rng.randint(1, 5) for _ in range(200)] + [b"x" * 100_000]
    path = str(tmp_path / "a.zst")
    writer = BundleWriter(pa.OSFile(path, "wb"), frame_bytes=4096)
    places = [writer.add(r) for r in records]
    writer.close()
    reader = BundleReader(pa.OSFile(path, "rb"))
    for k in rng.sample(range(len(records)), len(records)):
        frame, offset = places[k]
        assert reader.frame(frame)[offset : offset + len(records[k])] == records[k]
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read() == b"".join(records)


def test_records_parse_back():
    body = "<p>é\r\n\r\n</p>".encode()
    digest = hashlib.sha1(body).hexdigest()
    got = parse(record(7, "http://a/b c", digest, len(body), None, body))
    assert (got["page_id"], got["payload"], got["record_type"], got["refers_to"], got["url"]) == (7, body, "response", None, "http://a/b%20c")
    got = parse(record(None, None, digest, len(body), (9,), b""))
    assert (got["page_id"], got["payload_bytes"], got["record_type"], got["refers_to"]) == (None, len(body), "revisit", 9)
    with pytest.raises(ValueError):
        parse(record(7, "u", digest, len(body), None, b"other" * 3))


def want(rows, least):
    out = []
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h] = max(best.get(h, i), i)
    count = {h: sum(r[2] == h for r in rows) for _, _, h in rows}
    for i, _, h in rows:
        b = (h or "").encode()
        same = len(b) >= least and count[h] > 1 and best.get(h) is not None and best[h] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if same else "response", best[h] if same else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    big, other = "<p>ü</p>" * 200, "z" * 1000
    rows = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "a b\nc", "short"), (4, "x", "short"), (6, "x", None), (7, "x", ""), (None, "x", big), (8, "q", other), (9, "q", other[1:]), (10, "q", other[1:]), (None, "r", "n" * 2000), (None, "r", "n" * 2000), (11, "w", "long " * 400_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bundle int").repartition(3)
    got = sorted((tuple(r)[:5] for r in warc_round_trip(df).collect()), key=repr)
    assert got == want(rows, 1000)
    assert warc_round_trip(df.limit(0)).count() == 0


def test_whole_table_payloads_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = f"{shared_dir(spark)}/warc-test"
    index = write_archives(pages, folder, bundle_bytes=20_000, frame_bytes=10_000)
    assert index.select("bundle").distinct().count() > 1
    got = {r.page_id: bytes(r.payload).decode() for r in read_archives(index, folder).collect() if r.record_type == "response"}
    assert got == {r.page_id: r.html for r in pages.collect()}
    some = index.filter("page_id % 7 = 0")
    assert read_archives(some, folder).count() == some.count() > 0
