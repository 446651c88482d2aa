"""WARC records in seekable Zstandard bundles.

*Write.*  Each task writes the records of its partition to a bundle of its own.
Records are grouped into frames of about ``frame_bytes``; every frame is an
independent Zstandard frame, and the bundle ends with a skippable frame that
holds the seek table (public seekable format: per frame the compressed and the
decompressed size, then the frame count, a descriptor byte and a magic number).
The index maps each record id to its bundle, frame, offset in the decompressed
frame and length.  A record's id is made of the page's id, its URL and the
payload's digest.

*Deduplication.*  Payloads of at least ``revisit_bytes`` that are equal by
SHA-1 and length share one ``response`` record, that of the largest id; the
others are ``revisit`` records that name it and the payload's digest and
length.  The payloads themselves are not shuffled: only digests are counted,
and the few repeated ones come back, broadcast if small, else joined.

*Read.*  ``read_records`` fetches records by the index, in the order of frames,
each of which is decompressed once and alone; ``read_bundles`` walks whole bundles.

*Recovery.*  Every attempt of a task writes a bundle of its own name, which its
rows of the index carry; the index is committed by Spark, so it names the bundles
of the attempts that count and no others.  What lost or late attempts leave is
deleted once the index is written.  Record ids, dates and bytes depend only on
the rows.

Defined cases: null html is an empty payload; null URLs leave out the target
URI; of rows that repeat the largest id with the same payload, each is a
response; rows equal in id, URL and payload are written each, as equal records of
one id; rows with a null id are written, and are never referred to; very long
payloads take a frame each; an empty table makes no records.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import BROADCAST_BYTES, fresh_path, short_batches, written

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORD = "record_id string, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def record_id(page_id, url: str | None, digest: str) -> str:
    name = f"page:{page_id}:{digest}:{'' if url is None else '=' + url}".encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(_SPACE.bytes + name).digest()[:16], version=5)}>"


def record(page_id, url, payload: bytes, digest: str, original, original_url=None) -> bytes:
    """The record's bytes; ``original`` is the page id that a revisit refers to, ``original_url`` that page's URL."""
    revisit = original is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, url, digest), "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": record_id(original, original_url, digest) if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id, "X-Refers-To-Page-Id": original, "X-Payload-Bytes": len(payload),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.buffer = bytearray()

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        if self.buffer and len(self.buffer) + len(data) > self.frame_bytes:
            self.flush()
        at = len(self.frames), len(self.buffer), len(data)
        self.buffer += data
        return at

    def flush(self) -> None:
        if self.buffer:
            packed = self.compress(bytes(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Random access to the frames of an open file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        sizes = struct.unpack(f"<{2 * count}I", source.read(8 * count))
        self.frames, at = [], 0
        for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(1, plain))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of the records in ``data``."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a record")
        head = dict(line.split(": ", 1) for line in lines)
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        yield head, block[block.index(b"\r\n\r\n") + 4 :]


def _row(head: dict[str, str], payload: bytes) -> tuple:
    number = lambda k: int(head[k]) if head.get(k, "None") != "None" else None
    revisit, digest, n = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Bytes"])
    own = hashlib.sha1(payload).hexdigest()
    found = (n, digest) if revisit else (len(payload), own)
    return (head["WARC-Record-ID"], number("X-Page-Id"), head["WARC-Type"], head.get("WARC-Target-URI"), *found, number("X-Refers-To-Page-Id"), found == (n, digest))


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({x: "Int64" for x in names if x in ("page_id", "refers_to")})


def with_originals(pages: DataFrame, *, least: int = REVISIT_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` (SHA-1), and ``original``, ``original_url`` of the response that a revisit refers to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    big = marked.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("n"))
    top = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("top")
    shared = big.agg(top, F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("top").isNotNull()).select("d", "n", "top")
    shared, _ = written(shared, "payload-copies")
    size = shared.agg(F.sum(F.coalesce(F.octet_length("top.url"), F.lit(0)) + 96)).first()[0] or 0
    if size <= broadcast_bytes:
        shared = F.broadcast(shared)
    joined = marked.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("n")), "left")
    revisits = ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisits, F.col("top.page_id")).alias("original"), F.when(revisits, F.col("top.url")).alias("original_url"))


def write_bundles(pages: DataFrame, folder: str | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html", frame_bytes: int = FRAME_BYTES, level: int = LEVEL, revisit_bytes: int = REVISIT_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """Write all rows; returns the index (a written table) and the folder of the bundles."""
    spark = pages.sparkSession
    short_batches(spark)
    folder = folder or fresh_path(spark, "bundles")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = with_originals(plain, least=revisit_bytes, broadcast_bytes=broadcast_bytes)
    run = uuid.uuid4().hex[:12]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        name, index, out, bundle = f"{run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.zst", [], None, None
        for batch in batches:
            ids, originals = batch["page_id"].astype("Int64"), batch["original"].astype("Int64")
            for i, u, h, d, o, ou in zip(ids, batch["url"], batch["html"], batch["digest"], originals, batch["original_url"], strict=True):
                i, o = (None if pd.isna(x) else int(x) for x in (i, o))
                if bundle is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    bundle = BundleWriter(out, frame_bytes, level)
                index.append((record_id(i, u, d), f"{folder}/{name}", *bundle.add(record(i, u, (h or "").encode("utf-8", "surrogatepass"), d, o, ou))))
            if len(index) >= 50_000:
                yield _table(index, INDEX)
                index = []
        if bundle is not None:
            bundle.close()
            out.close()
            yield _table(index, INDEX)

    index = written(rows.mapInPandas(write, INDEX), "bundle-index")[0]
    drop_orphans(index, folder)
    return index, folder


def drop_orphans(index: DataFrame, folder: str) -> int:
    """Delete the bundles that attempts of the same run left and the index does not name; returns how many."""
    fs, root = _open(folder)
    named = {r.bundle.rsplit("/", 1)[1] for r in index.select("bundle").distinct().collect()}  # a name a task
    runs = {n.split("-")[0] for n in named}
    orphans = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".warc.zst") and f.base_name.split("-")[0] in runs and f.base_name not in named]
    for f in orphans:
        fs.delete_file(f.path)
    return len(orphans)


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, read frame by frame."""
    short_batches(spark)
    bundles = index.groupBy("bundle").agg(F.count("*").alias("n"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["bundle"]:
                fs, at = _open(path)
                with fs.open_input_file(at) as source:
                    bundle = BundleReader(source, source.size())
                    for i in range(len(bundle.frames)):
                        yield _table([_row(*x) for x in parse(bundle.frame(i))], RECORD)

    # a fixed number, as adaptive execution would put these short rows into one task
    return bundles.select("bundle").repartition(max(1, bundles.count()), "bundle").mapInPandas(read, RECORD)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the index rows given, by their bundle, frame and offset: only the frames named are read, each once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = at = source = bundle = data = None
        try:
            for batch in batches:
                out = []
                for p, f, o, n in zip(batch["bundle"], batch["frame"], batch["offset"], batch["length"], strict=True):
                    if p != path:
                        if source is not None:
                            source.close()
                        fs, place = _open(p)
                        path, at, source = p, None, fs.open_input_file(place)
                        bundle = BundleReader(source, source.size())
                    if f != at:
                        at, data = f, bundle.frame(int(f))
                    out += [_row(*x) for x in parse(data[o : o + n])]
                yield _table(out, RECORD)
        finally:
            if source is not None:
                source.close()

    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("bundle", "frame", "offset", "length").repartition(width, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return placed.mapInPandas(read, RECORD)
