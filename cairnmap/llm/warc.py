"""WARC archives as seekable Zstandard bundles.

A bundle holds records in independent Zstandard frames of about ``FRAME`` bytes and ends in a skippable frame with the
seek table (magic 0x184D2A5E, then per frame compressed and raw size, then count, descriptor byte and magic 0x8F92EAB1:
the public "seekable format").  The index maps a record id to bundle, frame and the offset in the raw frame, so a reader
fetches and unpacks one frame for one record.

Equal payloads are stored once: the record with the smallest page_id is a response, the others revisit it.  Bundles go to
the folder shared by all executors; each try of a task writes names of its own, and only names in the committed index
count, so lost executors and repeated tasks leave no wrong record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Work, table

BUNDLE, FRAME = 8 << 20, 256 << 10
#: Bundles that one task reads back, about.
BUNDLES = 4
LEAST_PAYLOAD = 0
DATE = "2024-01-01T00:00:00Z"
SEEK_HEAD, SEEK_TAIL = 0x184D2A5E, 0x8F92EAB1


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str) -> int | None:
    inner = name.strip("<>").rpartition(":")[2]
    return None if inner == "none" else int(inner)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and names the response and the digest and size of the full payload."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; for a response, payload too."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    return fields | {"payload": payload, "full_bytes": full}


class BundleWriter:
    """Packs records into frames; ``finish`` gives the bundle's bytes."""

    def __init__(self, frame: int = FRAME):
        self.frame, self.parts, self.sizes, self.raw = frame, [], [], bytearray()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame number, offset in the raw frame, length)."""
        if self.raw and len(self.raw) + len(record) > self.frame:
            self._flush()
        at = (len(self.sizes), len(self.raw), len(record))
        self.raw += record
        self.size += len(record)
        return at

    def _flush(self) -> None:
        import zstandard

        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.raw))
        self.parts.append(packed)
        self.sizes.append((len(packed), len(self.raw)))
        self.raw = bytearray()

    def finish(self) -> bytes:
        if self.raw:
            self._flush()
        seek = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_TAIL)
        return b"".join(self.parts) + struct.pack("<II", SEEK_HEAD, len(seek)) + seek


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEK_TAIL or flags:
        raise ValueError("no seek table")
    start = len(bundle) - 9 - 8 * count
    if struct.unpack("<II", bundle[start - 8 : start]) != (SEEK_HEAD, 8 * count + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for i in range(count):
        packed, raw = struct.unpack("<II", bundle[start + 8 * i : start + 8 * i + 8])
        out.append((at, packed, raw))
        at += packed
    return out


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """The seek table of an open file, from its end."""
    size = file.size()
    count = struct.unpack("<I", file.read_at(9, size - 9)[:4])[0]
    tail = min(size, 17 + 8 * count)
    return seek_table(file.read_at(tail, size - tail))


def read_frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, raw = entry
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=raw)


def _store(folder: str):
    """(file system, path) of a folder given as path or URI."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return fs.LocalFileSystem(), folder


INDEX = "page_id long, bundle string, frame int, at int, length int"


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD, bundle: int = BUNDLE, frame: int = FRAME) -> DataFrame:
    """pages (page_id long, url, html) -> the index of the bundles written to ``folder`` once the result is computed.

    A null html is an empty payload.  Payloads of under ``least`` bytes are all responses.  Of rows with equal payloads, the
    one with the smallest page_id is the response (all rows of that page_id, where it repeats; null is the largest).  A very
    long payload is a frame by itself.  An empty table writes no bundle.  Other columns are not read.

    Payloads meet their record kind by page_id and digest, so pages with one common payload do not come to one task.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("d", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    firsts = own.groupBy("d").agg(F.min("page_id").alias("first"), F.max(F.coalesce("page_id", F.lit((1 << 63) - 1))).alias("top")).where("first < top").select("d", "first")
    again = own.select("page_id", "d").distinct().join(firsts, "d").where("not page_id <=> first").select(F.col("page_id").alias("p2"), F.col("d").alias("d2"), "first")
    own = own.join(again.hint("merge"), F.expr("page_id <=> p2 and d = d2"), "left").select("page_id", "url", "html", "first", (F.octet_length("html") >= least).alias("deduped"))

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        writer, rows = None, []

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(writer.finish())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3))], names=["page_id", "bundle", "frame", "at", "length"])

        for batch in batches:
            for page, url, html, first, deduped in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload = html.encode()
                revisit = deduped and first is not None
                writer = writer or BundleWriter(frame)
                at = writer.add(build_record(page, url, payload, first if revisit else None, revisit))
                rows.append((page, *at))
                if writer.size >= bundle:
                    yield close()
                    writer, rows = None, []
        if rows:
            yield close()

    return own.mapInArrow(run, INDEX)


def read_warc(folder: str, index: DataFrame) -> DataFrame:
    """Reads every record of the index (a written table) back through the seek table and its frame; a task reads about
    ``BUNDLES`` bundles, no bytes of them move between tasks -> page_id, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits).  Digests of responses are computed anew and must agree with the record."""
    # Adaptive execution would judge by the few bytes of the index and read all bundles in one task.
    tasks = 1 + index.agg(F.count_distinct("bundle")).first()[0] // BUNDLES
    wanted = index.repartition(tasks, "bundle").groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "at", "length"))).alias("records"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as file:
                    frames, now, out = read_seek_table(file), (-1, b""), []
                    for r in records:
                        if now[0] != r["frame"]:
                            at, packed, raw = frames[r["frame"]]
                            now = (r["frame"], read_frame(file.read_at(packed, at), (0, packed, raw)))
                        f = parse_record(now[1][r["at"] : r["at"] + r["length"]])
                        kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (digest_of(f["payload"]) != digest or len(f["payload"]) != f["full_bytes"]):
                            raise ValueError(f"record {f['WARC-Record-ID']} is damaged")
                        out.append((page_of(f["WARC-Record-ID"]), f["full_bytes"], digest, kind, page_of(f["WARC-Refers-To"]) if kind == "revisit" else None, f["payload"] if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return wanted.select("bundle", "records").mapInArrow(run, schema)


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in seekable bundles, read back by their index."""
    work = Work(spark, "warc")
    index = work.save(write_warc(table(spark, sf_dir, "pages"), f"{work.path}/bundles"), "index")
    return read_warc(f"{work.path}/bundles", index).drop("payload")


_BITS = "(" + " || ".join(f"substr('0000000000000000' || bin(('0x' || substr(h, {1 + 4 * i}, 4))::INT), -16)" for i in range(10)) + ")"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(b, {1 + 5 * i}, 5))::INT, 1)" for i in range(32))
ORACLE = {
    "op9_seekable_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
e AS (SELECT h, first, {_BITS} AS b FROM d),
f AS (SELECT h, first, {_BASE32} AS digest FROM e)
SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)""",
}
QUERIES = {"op9_seekable_warc": op9_seekable_warc}
