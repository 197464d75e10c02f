"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a few whole records, and a seek table in a skippable
frame at its end (the public seekable format: compressed and decompressed size of each frame, then a footer). An index maps
record identifiers to bundle, frame and offset in the frame, so one record is read by decompressing one frame.

Of records with equal payloads of at least min_bytes, the one with the largest page id is a response and the others are
revisits that refer to it; rows that repeat that page id count as the same record and are responses too. Null html: an empty payload.
Null url: no target header. Null page id: smaller than any other; if all of a group are null, all are responses.

Executors write bundles under names of their own; the index, which Spark commits, says which of them count, so a
task that runs twice leaves no record twice.
"""

from __future__ import annotations

import base64
import struct
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare, rows

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Bundles up to this count are told from orphans by a broadcast of their names.
BROADCAST_BUNDLES = 200_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = [("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
_RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_DDL_INDEX = "record_id string, bundle string, frame int, offset long, length long"
_DDL_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, payload and end of the record at this offset."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    block = end + 4
    stop = block + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", block, stop) + 4
    head["payload-bytes"] = next(x for x in data[block:body].split(b"\r\n") if x.startswith(b"Content-Length"))[16:].decode()
    return head, data[body:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame, from the seek table at the bundle's end."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("the bundle has no seek table")
    out, at, table = [], 0, len(bundle) - 9 - 8 * n
    for k in range(n):
        packed, size = struct.unpack_from("<II", bundle, table + 8 * k)
        out.append((at, packed, size))
        at += packed
    return out


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict, bytes]:
    import zstandard

    start, packed, size = frames_of(bundle)[frame]
    head, payload, _ = parse(zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size), offset)
    return head, payload


def _write(folder: str, level: int):
    def run(batches):
        import zstandard
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(base, recursive=True)
        pack = zstandard.ZstdCompressor(level=level)
        bundle: list = []  # compressed frames
        sizes: list = []
        frame: list = []  # records
        index: list = []
        name = f"{uuid.uuid4().hex}.warc.zst"
        state = {"frame": 0, "bundle": 0}

        def end_frame():
            if frame:
                data = b"".join(frame)
                bundle.append(pack.compress(data))
                sizes.append((len(bundle[-1]), len(data)))
                frame.clear()
                state["bundle"] += len(bundle[-1])
                state["frame"] = 0

        def end_bundle():
            nonlocal name
            end_frame()
            out = None
            if bundle:
                with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                    for x in bundle:
                        f.write(x)
                    f.write(seek_table(sizes))
                out = rows(_INDEX, **{n: [x[k] for x in index] for k, (n, _) in enumerate(_INDEX)})
            bundle.clear(), sizes.clear(), index.clear()
            state["bundle"] = 0
            name = f"{uuid.uuid4().hex}.warc.zst"
            return out

        for b in batches:
            cols = [b.column(n) for n in ("page_id", "url", "html", "sha1", "refers_to", "revisit")]
            for i in range(len(b)):
                page_id, url, html, sha1, refers_to, revisit = (c[i].as_py() for c in cols)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(page_id, url, (html or "").encode(), digest, refers_to, revisit)
                index.append((record_id(page_id), name, len(sizes), state["frame"], len(data)))
                frame.append(data)
                state["frame"] += len(data)
                if state["frame"] >= FRAME_BYTES:
                    end_frame()
                    if state["bundle"] >= BUNDLE_BYTES:
                        yield end_bundle()
        if (last := end_bundle()) is not None:
            yield last

    return run


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with sha1 (hex), revisit and refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("_n"))
    last = p.groupBy("sha1", "_n").agg(F.max("page_id").alias("_last"))
    # by shuffle at every size: the groups are as many as the pages, and large pages would make a poor broadcast
    j = p.join(last.hint("merge"), ["sha1", "_n"])
    revisit = (F.col("_n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return j.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes bundles into folder (which all executors reach) and their index beside them; returns the index:
    record_id, bundle, frame, offset, length."""
    prepare(pages.sparkSession)
    index = classify(pages, min_bytes).mapInArrow(_write(folder, level), _DDL_INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def _read(payloads: bool):
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(len(b)):
                bundle = b.column("content")[i].as_py()
                for start, packed, size in frames_of(bundle):
                    data, at, out = unpack.decompress(bundle[start : start + packed], max_output_size=size), 0, []
                    while at < len(data):
                        h, payload, at = parse(data, at)
                        page, refers = h["WARC-Record-ID"][10:-1], h.get("WARC-Refers-To", "<urn:page:>")[10:-1]
                        out.append((int(page) if page else None, urllib.parse.unquote(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, h["WARC-Type"], int(refers) if refers else None, int(h["payload-bytes"]), h["WARC-Payload-Digest"][5:], payload if payloads else None))
                    yield rows(_RECORD, **{n: [x[k] for x in out] for k, (n, _) in enumerate(_RECORD)})

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the bundles that the index in folder lists: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (empty for revisits; null unless asked for)."""
    index = spark.read.schema(_DDL_INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    if index.count() <= BROADCAST_BUNDLES:  # their names alone; beyond, the bundles are shuffled
        index = F.broadcast(index)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    if files.isEmpty():
        return spark.createDataFrame([], _DDL_RECORD)
    return files.join(index, "bundle", "left_semi").select("content").mapInArrow(_read(payloads), _DDL_RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes)
    return read_archives(pages.sparkSession, folder, payloads=False)
