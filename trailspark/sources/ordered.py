"""JSON Lines in order from and to many tasks, as data sources.

*Reading.*  A file, or a folder of parts, is cut into splits of bytes; a line is of
the split that its first byte is in.  The lines of a few splits at a time, twice as
many each time, are counted until there are as many as asked for: a zone map.  Then
only those splits are read, each numbering its lines from the counts before it, so
the bytes read follow the limit and no task sees more than a split and a line.

*Writing.*  Rows are dealt by range and sorted in each task; a task attempt writes
a part of its own beside the target and reports its place, rows, bytes and digest.
At the commit the reported parts get their names in order, ``_parts.json`` lists
them, and the folder takes the target's place; an aborted job, or a part of a failed
attempt, leaves nothing.  A manifest is made of the reports: no part is read again.

Both open files through pyarrow, so any store that it knows will do.  Defined
cases: blank lines are counted but are no rows; a last line needs no end; invalid
UTF-8 is replaced; a line longer than a split is read by the task that it starts in;
an empty file has no lines and an empty table no parts; rows equal in the order's
columns stay together, in any order, and nulls of those columns come first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SPLIT_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
PARTS = "_parts.json"


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


# --- reading


@dataclass
class Split(InputPartition):
    """Bytes of a file; lines and rows before it; the most rows that it gives."""

    path: str
    start: int
    end: int
    lines: int = 0
    rows: int = 0
    most: int | None = None


def splits_of(path: str, split_bytes: int) -> list[Split]:
    """The splits of a file, or of a folder's parts in the order of their names."""
    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else sorted((x for x in store.get_file_info(stores.FileSelector(at)) if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.base_name)
    prefix = path.removesuffix(at)
    return [Split(prefix + x.path, a, min(a + split_bytes, x.size)) for x in found for a in range(0, x.size, split_bytes)]


def lines_of(split: Split, chunk: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The lines that start in a split, without their ends, some at a time."""
    store, at = store_of(split.path)
    with store.open_input_file(at) as file:
        at, held = split.start, b""
        skipping = False
        if at:
            file.seek(at - 1)
            skipping = file.read(1) != b"\n"  # the rest of a line that starts before
        file.seek(at)
        begins = at  # where the first held byte is
        while data := file.read(chunk):
            held += data
            if skipping:
                end = held.find(b"\n")
                if end < 0:
                    begins += len(held)
                    held = b""
                    if begins >= split.end:
                        return
                    continue
                held, begins, skipping = held[end + 1 :], begins + end + 1, False
            *whole, rest = held.split(b"\n")
            out = []
            for line in whole:
                if begins >= split.end:
                    break
                out.append(line)
                begins += len(line) + 1
            else:
                if out:
                    yield out
                held = rest
                if begins >= split.end:
                    return
                continue
            yield out
            return
        if held and not skipping and begins < split.end:
            yield [held]


class LinesReader(DataSourceReader):
    def __init__(self, splits: list[Split], counting: bool):
        self.splits, self.counting = splits, counting

    def partitions(self) -> list[Split]:
        return self.splits

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # there are no splits
            return
        lines, rows, given = split.lines, split.rows, 0
        for some in lines_of(split):
            numbers, indices, texts = [], [], []
            for line in some:
                lines += 1
                text = line.removesuffix(b"\r")
                if not text.strip():
                    continue
                if split.most is not None and given >= split.most:
                    break
                numbers.append(lines)
                indices.append(rows)
                rows, given = rows + 1, given + 1
                if not self.counting:
                    texts.append(text.decode("utf-8", "replace"))
            if not self.counting and numbers:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(indices, pa.int64()), pa.array(texts, pa.string())], names=["line", "idx", "value"])
            if split.most is not None and given >= split.most:
                return
        if self.counting:
            yield pa.RecordBatch.from_arrays([pa.array([split.path]), pa.array([split.start]), pa.array([lines]), pa.array([rows])], names=["path", "start", "lines", "rows"])


class LinesSource(DataSource):
    """Options: ``splits``, a list of splits as JSON, and ``counting``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def _counting(self) -> bool:
        return self.options.get("counting") == "true"

    def schema(self) -> str:
        return "path string, start long, lines long, rows long" if self._counting() else "line long, idx long, value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader([Split(*x) for x in json.loads(self.options["splits"])], self._counting())


def _load(spark: SparkSession, splits: list[Split], counting: bool) -> DataFrame:
    spark.dataSource.register(LinesSource)
    listed = json.dumps([(s.path, s.start, s.end, s.lines, s.rows, s.most) for s in splits])
    return spark.read.format(LinesSource.name()).option("splits", listed).option("counting", str(counting).lower()).load()


def first_lines(spark: SparkSession, path: str, limit: int | None = None, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(line, idx, value): the first ``limit`` lines that are not blank, or all, with their number from 1 and their place from 0."""
    splits = splits_of(path, split_bytes)
    known: list[Split] = []
    lines = rows = done = 0
    step = len(splits) if limit is None else 1
    while done < len(splits) and (limit is None or rows < limit):
        wave = splits[done : done + step]
        counted = {(r.path, r.start): r for r in _load(spark, wave, True).collect()}  # a row a split
        for s in wave:
            n = counted[s.path, s.start]
            known.append(Split(s.path, s.start, s.end, lines, rows, None if limit is None else max(0, min(n.rows, limit - rows))))
            lines, rows = lines + n.lines, rows + n.rows
        done, step = done + len(wave), 2 * step
    return _load(spark, [s for s in known if s.most is None or s.most > 0], False)


# --- writing


@dataclass
class Part(WriterCommitMessage):
    """What a task attempt wrote."""

    place: int
    file: str | None
    rows: int
    bytes: int
    sha256: str


class PartsWriter(DataSourceWriter):
    """Writes the rows' ``value``, a line each."""

    def __init__(self, path: str, staging: str):
        self.path, self.staging = path, staging

    def write(self, rows: Iterator) -> Part:
        place, file, size, n, digest = TaskContext.get().partitionId(), None, 0, 0, hashlib.sha256()
        store, folder = store_of(self.staging)
        out = None
        try:
            for row in rows:
                if out is None:
                    file = f"attempt-{place}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{folder}/{file}")
                data = row.value.encode("utf-8", "surrogatepass") + b"\n"
                out.write(data)
                digest.update(data)
                size, n = size + len(data), n + 1
        finally:
            if out is not None:
                out.close()
        return Part(place, file, n, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = store_of(self.staging)
        _, target = store_of(self.path)
        listed = []
        for number, part in enumerate(sorted((m for m in messages if m is not None and m.file), key=lambda m: m.place)):
            name = f"part-{number:05d}.json"
            store.move(f"{folder}/{part.file}", f"{folder}/{name}")
            listed.append({"path": name, "rows": part.rows, "bytes": part.bytes, "sha256": part.sha256})
        for x in store.get_file_info(stores.FileSelector(folder)):
            if x.base_name.startswith("attempt-"):  # of an attempt that did not count
                store.delete_file(x.path)
        with store.open_output_stream(f"{folder}/{PARTS}") as out:
            out.write(json.dumps(listed, indent=2, sort_keys=True).encode())
        if store.get_file_info(target).type != stores.FileType.NotFound:
            store.delete_dir(target)
        store.move(folder, target)

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = store_of(self.staging)
        if store.get_file_info(folder).type != stores.FileType.NotFound:
            store.delete_dir(folder)


class PartsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_parts"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], self.options["staging"])


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``value`` of the rows, a line each, a part a partition, in the order of the partitions; the folder ``path`` is replaced at once."""
    lines.sparkSession.dataSource.register(PartsSink)
    path = path.rstrip("/")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    store, folder = store_of(staging)
    store.create_dir(folder)  # here only: a task that outlives the job cannot make it again
    try:
        lines.select("value").write.format(PartsSink.name()).mode("append").option("path", path).option("staging", staging).save()
    finally:
        if store.get_file_info(folder).type != stores.FileType.NotFound:
            store.delete_dir(folder)


def parts_of(path: str) -> list[dict]:
    """The reports of the parts of a written folder, in order: path, rows, bytes, sha256."""
    store, at = store_of(f"{path.rstrip('/')}/{PARTS}")
    with store.open_input_stream(at) as file:
        return json.loads(file.read())
