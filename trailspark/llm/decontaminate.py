"""Benchmark decontamination with a Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a pattern; an
item with fewer words, but not none, is one pattern.  Patterns of one length
share a set of tables, which are flat arrays:

* the *shift table* has a byte for each hash of a block of two words: how far the
  search may jump, because no pattern has a block of that hash closer to its end;
* the *suffix buckets* are the patterns, sorted by a hash of their last and their
  first block; a bitmap over these hashes turns away most positions first;
* a pattern of the bucket is a hit only after a *direct comparison* of all its
  words, so hashes never decide.

The tables are built from the benchmark, never from the documents, so the
search is one narrow pass over the documents without a shuffle.  Items are dealt
to parts of about ``part_bytes`` of text; a task builds the tables of each part
and writes them to the shared folder, where workers map them.  They take about
six bytes per byte of benchmark text.  A worker holds the tables of at most
about ``held_bytes`` of benchmark text; beyond that it goes through the parts in
turn for every ``CHUNK_BYTES`` of document text.  Neither the driver nor a
worker's memory grows with the benchmark, and texts are read once.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no pattern; the words of an item with a null id are hit, but it
adds no id; equal patterns of several items report all of them; repeated item ids
count once; repeated documents are each reported; an empty benchmark hits
nothing, and no documents give no rows; texts of any length are searched whole,
one at a time.  Columns of the documents are kept, whatever their names; ``into``
replaces a column of that name.
"""

from __future__ import annotations

import json
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import fresh_path, short_batches, spare_name

WINDOW = 10
#: Benchmark text, in bytes, of the tables that one task builds, and that one Python worker holds.
PART_BYTES = 8 << 20
HELD_BYTES = 64 << 20
#: Document text held while a worker goes through more parts than it can hold.
CHUNK_BYTES = 16 << 20

#: Byte map: A-Z to a-z, digits, letters and non-ASCII bytes to themselves, all other ASCII to a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SPANS = "array<struct<start:int,end:int>>"
_FOUND = f"n_words long, spans {_SPANS}, items array<string>"
_ODD = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _build(items: Iterable[tuple[str | None, str | None]], window: int) -> dict[str, np.ndarray]:
    """The tables of all pattern lengths as named arrays."""
    by_length: dict[int, list[tuple[str | None, list[bytes]]]] = defaultdict(list)
    for item, text in items:
        if words := words_of(text):
            by_length[min(window, len(words))].append((item, words))
    out = {"lengths": np.array(sorted(by_length), np.int64)}
    for length, found in by_length.items():
        block = min(2, length)
        digest = xxhash.xxh64_intdigest
        kind = np.uint8 if length - block + 1 < 256 else np.uint32  # of a shift
        text, at, starts, owners, blocks, shifts, keys = bytearray(), [], [], [], [], [], []
        base = 0
        for owner, (_, words) in enumerate(found):
            patterns = len(words) - length + 1
            own = np.fromiter((digest(b" ".join(words[i : i + block])) for i in range(len(words) - block + 1)), np.uint64, len(words) - block + 1)
            blocks.append(own)
            shifts.append(np.maximum(0, length - block - np.arange(len(own))).astype(kind))  # only a pattern's first blocks are far from an end
            with np.errstate(over="ignore"):
                keys.append((own[length - block :] * np.uint64(_ODD)) ^ own[:patterns])
            starts.append(base + np.arange(patterns, dtype=np.int64))
            owners.append(np.full(patterns, owner, np.int32))
            for w in words:
                at.append(len(text))
                text += w + b" "
            base += len(words)
        at.append(len(text))
        blocks, shifts, keys, starts, owners = map(np.concatenate, (blocks, shifts, keys, starts, owners))
        size = 1 << max(10, (4 * len(blocks) - 1).bit_length())
        table = np.full(size, length - block + 1, kind)
        np.minimum.at(table, (blocks & np.uint64(size - 1)).astype(np.int64), shifts)
        order = np.argsort(keys, kind="stable")
        keys, starts, owners = keys[order], starts[order], owners[order]
        bits = 1 << max(10, (16 * len(keys) - 1).bit_length())
        seen = np.zeros(bits // 8, np.uint8)
        place = (keys & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(seen, place >> 3, (1 << (place & 7)).astype(np.uint8))
        first = np.asarray(at, np.int64)
        names = [(i or "").encode("utf-8", "surrogatepass") for i, _ in found]
        ends = np.cumsum([len(x) for x in names])
        out |= {f"{length}.{k}": v for k, v in {
            "shift": table, "seen": seen, "keys": keys, "from": first[starts], "to": first[starts + length] - 1, "owner": owners, "text": np.frombuffer(bytes(text), np.uint8),
            "names": np.frombuffer(b"".join(names), np.uint8), "ends": ends, "named": np.array([i is not None for i, _ in found]),
        }.items()}
    return out


class _Tables:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, arrays: dict[str, np.ndarray]):
        self.length, self.block = length, min(2, length)
        a = {k: arrays[f"{length}.{k}"] for k in ("shift", "seen", "keys", "from", "to", "owner", "text", "names", "ends", "named")}
        self.shift, self.seen, self.text, self.names = (memoryview(a[k]) for k in ("shift", "seen", "text", "names"))
        self.keys, self.first, self.last, self.owner, self.ends, self.named = (a[k] for k in ("keys", "from", "to", "owner", "ends", "named"))

    def name(self, owner: int) -> str | None:
        at = int(self.ends[owner - 1]) if owner else 0
        return bytes(self.names[at : int(self.ends[owner])]).decode("utf-8", "surrogatepass") if self.named[owner] else None

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        length, block, shift, seen = self.length, self.block, self.shift, self.seen
        digest, mask, bits = xxhash.xxh64_intdigest, len(shift) - 1, 8 * len(seen) - 1
        end, n = length, len(words)
        while end <= n:
            last = digest(b" ".join(words[end - block : end]))
            if step := shift[last & mask]:
                end += step
                continue
            start = end - length
            key = (last * _ODD & _FULL) ^ digest(b" ".join(words[start : start + block]))
            place = key & bits
            if seen[place >> 3] >> (place & 7) & 1:
                low, high = (int(np.searchsorted(self.keys, np.uint64(key), side)) for side in ("left", "right"))
                said = b" ".join(words[start:end]) if low < high else b""
                hit = [i for i in range(low, high) if self.text[self.first[i] : self.last[i]] == said]
                if hit:
                    spans.append((start, end))
                    items.update(x for i in hit if (x := self.name(int(self.owner[i]))) is not None)
            end += 1


class WuManber:
    """Search for any number of word sequences."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]] = (), window: int = WINDOW, *, arrays: dict[str, np.ndarray] | None = None):
        arrays = _build(items, window) if arrays is None else arrays
        self.tables = [_Tables(int(n), arrays) for n in arrays["lengths"]]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open spans of hit words, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for t in self.tables:
            t.search(words, spans, items)
        return merge(spans), items


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _store(path: str, arrays: dict[str, np.ndarray], attempt: str) -> None:
    """One file: the length of a header, the header (name, type, place, count of each array), the arrays' bytes."""
    head, place = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, place, len(a))
        place += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = text.ljust(-(-(len(text) + 8) // 64) * 64 - 8)
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(f"{at}.{attempt}") as out:
        out.write(struct.pack("<q", len(text)) + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    fs.move(f"{at}.{attempt}", at)  # a second attempt replaces it with equal bytes


def _load(path: str) -> WuManber:
    """A part's tables: mapped where the shared folder is mounted, else read."""
    fs, at = pafs.FileSystem.from_uri(path)
    with pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at) as source:
        data = source.read_buffer()
    (size,) = struct.unpack("<q", data[:8])
    head = json.loads(bytes(data[8 : 8 + size]))
    return WuManber(arrays={k: np.frombuffer(data, kind, n, 8 + size + place) for k, (kind, place, n) in head.items()})


def build(benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> list[tuple[str, int]]:
    """(path, bytes of text) of the tables of each part of the benchmark, in the shared folder."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    folder, parts = fresh_path(spark, "patterns"), max(1, -(-total // part_bytes))
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "t"], kind="stable", na_position="last")
        path = f"{folder}/{int(rows['part'].iloc[0])}"
        _store(path, _build(zip(rows["i"].where(rows["i"].notna(), None), rows["t"], strict=True), window), str(TaskContext.get().taskAttemptId()))
        return pd.DataFrame({"path": [path], "bytes": [sum(len(t.encode("utf-8", "surrogatepass")) for t in rows["t"])]})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int"))
    return sorted(tuple(r) for r in dealt.groupBy("part").applyInPandas(make, "path string, bytes long").collect())  # a row a part


_loaded: dict[str, WuManber] = {}


def _matchers(paths: list[str]) -> list[WuManber]:
    """The parts' tables; a worker keeps those of its last call only."""
    for gone in _loaded.keys() - set(paths):
        del _loaded[gone]
    for path in paths:
        if path not in _loaded:
            _loaded[path] = _load(path)
    return [_loaded[p] for p in paths]


def _searcher(groups: list[list[str]]):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held: list[pd.Series] = []
        size = 0

        def solve() -> Iterator[pd.DataFrame]:
            found = [[([], set()) for _ in texts] for texts in held]
            counts = [[0] * len(texts) for texts in held]
            for group in groups:
                matchers = _matchers(group)
                for b, texts in enumerate(held):
                    for i, text in enumerate(texts):
                        words = words_of(text)
                        counts[b][i] = len(words)
                        for m in matchers:
                            spans, items = m.search(words)
                            found[b][i][0].extend(spans)
                            found[b][i][1].update(items)
            for n, rows in zip(counts, found, strict=True):
                yield pd.DataFrame({"n_words": n, "spans": [[{"start": a, "end": b} for a, b in merge(s)] for s, _ in rows], "items": [sorted(x) for _, x in rows]})

        for texts in batches:
            held.append(texts)
            size += sum(len(t) for t in texts if t is not None)
            if len(groups) == 1 or size >= CHUNK_BYTES:
                yield from solve()
                held, size = [], 0
        yield from solve()

    return F.pandas_udf(search, _FOUND).asNondeterministic()  # or a filter on its result would run it twice


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES, into: str = "overlap",
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, spans (of hit words), items (ids as strings), n_hit."""
    short_batches(docs.sparkSession)
    groups, room = [[]], held_bytes
    for path, size in build(benchmark, item_id=item_id, item_text=item_text, window=window, part_bytes=part_bytes):
        if groups[-1] and room < size:
            groups.append([])
            room = held_bytes
        groups[-1].append(path)
        room -= size
    name = spare_name(docs, "found")
    docs = docs.withColumn(name, _searcher(groups)(F.col(text)))
    spans = F.col(f"{name}.spans")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return docs.withColumn(
        into, F.struct(F.col(f"{name}.n_words").alias("n_words"), spans.alias("spans"), F.col(f"{name}.items").alias("items"), n_hit.alias("n_hit"))
    ).drop(name)


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document: its id, words, hit words, items and whether it is contaminated."""
    found = find_overlaps(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    return found.select(
        "doc_id", F.col("overlap.n_words").alias("n_words"), F.col("overlap.n_hit").alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("overlap.items"), ","), 256).alias("items_sha256"),
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    name = spare_name(docs, "overlap")
    return find_overlaps(docs, benchmark, into=name, **options).where(F.col(f"{name}.n_hit") == 0).drop(name)
