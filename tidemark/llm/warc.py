"""Operator 4: WARC archives in seekable Zstandard bundles.

Each page becomes a record. Of pages with equal payloads one is a response, the others are revisits of it without payload. Every task writes its
records to bundles of its own in the shared folder; names carry the attempt, and only those of attempts that ended well reach the index, so
files of lost attempts are never read. The index maps a record's id to bundle, frame and offset within the frame; reading opens a
bundle's seek table and then only frames that hold wanted records.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shared_dir, stage
from .bundles import BundleReader, BundleWriter

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(2**63)  # stands for a null id in joins
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame long, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return int(name) if name else None


def record(page_id: int | None, url: str | None, digest: str, size: int, refers: tuple[int | None] | None, payload: bytes) -> bytes:
    """One WARC 1.1 record. A revisit keeps the HTTP head, which holds the size of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    target = "urn:unknown" if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(refers[0])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says; the digest of a response is taken from its payload again and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "url": fields["WARC-Target-URI"], "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, least: int = 1000, bundle_bytes: int = 1 << 26, frame_bytes: int = 1 << 18, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the records of `pages` to bundles under `folder` and returns their index (record_id, page_id, bundle, frame, offset, length)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    # payloads stay where they are: only digests and ids are compared, and what leaves is a row for each revisit
    keys = stage(rows.filter(F.col("size") >= least).select("page_id", "digest", "size"), "digests")
    # written first, so that Spark can split a payload that many pages have
    shared = stage(keys.groupBy("digest", "size").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1 and winner is not null").drop("n"), "shared")
    told = keys.join(shared, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("winner")))
    # an id and a digest name a revisit; rows that are alike in both are alike here
    revisits = stage(told.groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("_id"), "digest").agg(F.max("winner").alias("winner")), "revisits")
    long_ones = rows.filter(F.col("size") >= least).withColumn("_id", F.coalesce("page_id", F.lit(NO_ID))).join(revisits, ["_id", "digest"], "left").drop("_id")
    short_ones = rows.filter(F.col("size") < least).withColumn("winner", F.lit(None).cast("long"))
    revisit = F.col("winner").isNotNull()
    dealt = long_ones.unionByName(short_ones).select("page_id", "url", "digest", "size", revisit.alias("revisit"), "winner", F.when(~revisit, F.col("html")).alias("html"))

    def of(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, count, writer = f"part-{task.partitionId()}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if writer is None:
                    bundle = f"{name}-{count}.warc.zst"
                    writer, count = BundleWriter(fs.open_output_stream(f"{root}/{bundle}", compression=None), frame_bytes), count + 1
                data = record(r["page_id"], r["url"], r["digest"], r["size"], (r["winner"],) if r["revisit"] else None, (r["html"] or "").encode())
                frame, offset = writer.add(data)
                out.append((_id(r["page_id"]), r["page_id"], bundle, frame, offset, len(data)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if writer is not None:
            writer.close()

    return stage(dealt.mapInArrow(of, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that `index` lists (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload), read from the bundles."""
    schema = READ if payloads else READ.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def of(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            found: list[dict] = []
            held = 0
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    name, reader = r["bundle"], BundleReader(fs.open_input_file(f"{root}/{r['bundle']}"))
                found.append(parse(reader.frame(r["frame"])[r["offset"] : r["offset"] + r["length"]]))
                held += r["length"] * payloads
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)], names)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)], names)

    return index.select("bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(of, schema)


def warc_round_trip(pages: DataFrame, least: int = 1000, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each page, as read back from the archives written.

    A null html is an empty payload. Payloads of at least `least` bytes that are equal make one response, the page with the largest id (rows that share
    that id too are all responses), and revisits; a null id is smaller than all others, and pages of a payload all without id are
    responses; a null url is written as urn:unknown, and controls and spaces in urls are percent-encoded; an empty table gives an empty result; other
    columns are ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, least, id_col=id_col, url_col=url_col, html_col=html_col), folder, payloads=False)
