"""Codes of vectors by a codebook for each part, trained by Lloyd rounds with Exponion search.

*Parts.*  Components become ``floor(scale * x)``; a vector is cut into ``parts``
consecutive parts, equal where its length allows, and each part position has a
codebook of ``entries`` entries, at first that part of the vectors of the
smallest ids.  Each round gives every part its nearest entry (squared Euclidean
distance, ties to the smaller index), then moves each entry to the floor of the
mean of its parts; an entry without parts stays.

*Exponion search.*  A part starts at its entry of the round before, at the
squared distance ``u``.  An entry that is as near or nearer is at most twice as
far from that entry as the part is, so only the entries within ``4 u`` of it, by
squared distance, are tried, in the order of the entry's list of neighbours
sorted by distance.  All distances are integers, so no rounding loses a tie.

*Plan.*  Rows are packed once, where they are, to blocks of an Arrow batch; no
vector is shuffled.  A round is one narrow pass that writes the blocks again
with their new codes and, for each block, the counts and sums of its parts by
entry; Spark adds these up from their own column, and the driver reads the totals,
which are of a codebook's size.  A round depends on written tables only, so a lost
executor repeats its blocks of one round.

Defined cases: vectors that are null or hold a null or non-finite component take
no part; each length of vectors has codebooks of its own, and more than
``MAX_LENGTHS`` lengths are an error; parts of a length that ``parts`` does not
divide differ by one component, and may be empty, at distance 0; with fewer rows
than entries there are as many entries as rows; repeated rows are coded each and
may make equal entries, of which the first is used; equal ids are ordered by
their vectors; rows with a null id are coded like others and come last; an empty
table gives no rows.  Sums are exact; a quantised component or an error that does
not fit 64 bits is an error.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import BROADCAST_BYTES, delete, short_batches, written
from trailspark.llm.topk import quantised

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
MAX_LENGTHS = 1000

#: A codebook of each part: arrays [entry, component].
Books = list[np.ndarray]


def edges(dims: int, parts: int) -> list[int]:
    return [p * dims // parts for p in range(parts + 1)]


def _plain(values: np.ndarray, entries: np.ndarray) -> bool:
    """Whether four times any distance fits 64 bits; else Python's integers count."""
    if not values.size:
        return True
    most = max(int(values.max()), -int(values.min()), int(entries.max()), -int(entries.min()))
    return 4 * values.shape[1] * (2 * most) ** 2 < 1 << 62


def _squares(gaps: np.ndarray) -> np.ndarray:
    return (gaps * gaps).sum(-1)


def nearest(values: np.ndarray, start: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row and its squared distance, from the entries ``start``; and how many distances were taken."""
    kind = np.int64 if _plain(values, entries) else object
    values, entries = values.astype(kind), entries.astype(kind)
    radius = _squares(values - entries[start])
    best, code, taken = radius.copy(), start.astype(np.int64), len(values)
    apart = _squares(entries[:, None] - entries[None])
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        for j in np.argsort(apart[a], kind="stable"):
            rows = rows[apart[a, j] <= 4 * radius[rows]]  # the list ascends: a row that has left stays out
            if not len(rows):
                break
            if j == a:
                continue
            d = _squares(values[rows] - entries[j])
            taken += len(rows)
            won = (d < best[rows]) | ((d == best[rows]) & (j < code[rows]))
            best[rows[won]], code[rows[won]] = d[won], j
    return code, best, taken


def assign(values: np.ndarray, codes: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Codes [row, part], and the squared distances summed over parts."""
    at = edges(values.shape[1], len(books))
    out, error = np.zeros_like(codes), np.zeros(len(values), object)
    for p, entries in enumerate(books):
        out[:, p], d, _ = nearest(values[:, at[p] : at[p + 1]], codes[:, p], entries)
        error += d
    return out, error


def totals(values: np.ndarray, codes: np.ndarray, books: Books) -> list[int]:
    """Counts of the parts by (part, entry), then sums of their components by (part, entry, component)."""
    at = edges(values.shape[1], len(books))
    exact = values.dtype if not values.size or max(int(values.max()), -int(values.min())) * len(values) < 1 << 62 else object
    counts, sums = [], []
    for p, entries in enumerate(books):
        part = values[:, at[p] : at[p + 1]].astype(exact)
        for e in range(len(entries)):
            own = part[codes[:, p] == e]
            counts.append(len(own))
            sums += map(int, own.sum(0))
    return counts + sums


def moved(books: Books, found: list[int]) -> Books:
    """The floors of the means of all rows' ``totals``; an entry without parts stays."""
    out, at = [], sum(map(len, books))
    counts = iter(found)
    for entries in books:
        new, width = entries.copy(), entries.shape[1]
        for e in range(len(entries)):
            if n := next(counts):
                new[e] = [s // n for s in found[at : at + width]]
            at += width
        out.append(new)
    return out


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for entries in books for entry in entries for x in entry).encode()).hexdigest()


def _blocks(rows: DataFrame, label: str) -> DataFrame:
    """Blocks (dims, n, kind, held, ids, labels) of rows (i, y, v): the vectors as one matrix of the narrowest integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch["v"]).to_numpy()
            for dims in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                values = own["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
                n, listed = len(own), lambda c: pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own[c])  # noqa: B023
                columns = [pa.array([int(dims)], pa.int32()), pa.array([n], pa.int32()), pa.array([kind]), pa.array([values.astype(kind).tobytes()], pa.binary()), listed("i"), listed("y")]
                yield pa.RecordBatch.from_arrays(columns, names=["dims", "n", "kind", "held", "ids", "labels"])

    return rows.select("i", "y", "v").mapInArrow(pack, f"dims int, n int, kind string, held binary, ids array<long>, labels array<{label}>")


def _first_rows(rows: DataFrame, entries: int, parts: int) -> dict[int, Books]:
    """The first codebooks of each length: at most ``entries`` vectors a length, found by limits within the tasks."""
    order = Window.partitionBy("dims").orderBy(F.col("i").asc_nulls_last(), "v")
    first = rows.select("i", "v", F.size("v").alias("dims")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    out: dict[int, list] = {}
    for r in first.orderBy("dims", "place").select("dims", "v").limit(MAX_LENGTHS * entries + 1).collect():
        out.setdefault(r.dims, []).append(r.v)
    if len(out) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    books = {}
    for dims, vectors in out.items():
        at, held = edges(dims, parts), np.array(vectors, np.int64).reshape(len(vectors), dims)
        books[dims] = [held[:, at[p] : at[p + 1]] for p in range(parts)]
    return books


def _matrices(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, vectors, codes of the round before, at first the first entries) of each block."""
    known = "codes" in batch.schema.names
    for r in range(len(batch)):
        dims, n = batch["dims"][r].as_py(), batch["n"][r].as_py()
        values = np.frombuffer(batch["held"][r].as_buffer(), batch["kind"][r].as_py()).reshape(n, dims).astype(np.int64)
        codes = np.frombuffer(batch["codes"][r].as_buffer(), np.uint8).reshape(n, parts) if known else np.zeros((n, parts), np.uint8)
        yield dims, values, codes


def _round(blocks: DataFrame, books: dict[int, Books], parts: int) -> DataFrame:
    """The blocks with new codes, counts and sums."""
    names = [c for c in blocks.columns if c not in ("codes", "sums")]
    kinds = ", ".join(f"{c} {t}" for c, t in blocks.dtypes if c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, sums = [], []
            for dims, values, codes in _matrices(batch, parts):
                found, _ = assign(values, codes, books[dims])
                new.append(found.tobytes())
                sums.append(totals(values, found, books[dims]))
            made = [pa.array(new, pa.binary()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *made], names=[*names, "codes", "sums"])

    return blocks.drop("sums").mapInArrow(run, f"{kinds}, codes binary, sums array<decimal(38,0)>")


def _totals(blocks: DataFrame) -> dict[int, list[int]]:
    """Counts and sums over all blocks of each length: of the size of the codebooks."""
    out: dict[int, list[int]] = {}
    added = blocks.select("dims", F.posexplode("sums").alias("at", "x")).groupBy("dims", "at").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    for r in added.collect():
        out.setdefault(r.dims, []).append((r.at, int(r.x)))
    return {dims: [x for _, x in sorted(found)] for dims, found in out.items()}


def _coded(blocks: DataFrame, books: dict[int, Books], parts: int, label: str) -> DataFrame:
    """(vec_id, dims, code, error, label) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (dims, values, codes) in enumerate(_matrices(batch, parts)):
                found, error = assign(values, codes, books[dims])
                if any(e >= 1 << 63 for e in error):
                    raise OverflowError("an error does not fit 64 bits")
                digits = [row.tobytes().hex() for row in found]
                columns = [batch["ids"][r].values, pa.array([dims] * len(values), pa.int32()), pa.array(digits, pa.string()), pa.array(error.astype(np.int64)), batch["labels"][r].values]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dims", "code", "error", "label"])

    return blocks.drop("sums").mapInArrow(run, f"vec_id long, dims int, code string, error long, label {label}")


def encode(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, dict[int, Books]]:
    """A row per vector: vec_id, label, code, error, label_error, codebooks_sha256; and the codebooks of each length."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("a code needs 1 to 256 entries and at least one part")
    spark = vectors.sparkSession
    short_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(label).alias("y"), quantised(embedding, scale).alias("v")).where("v IS NOT NULL")
    kind = dict(rows.dtypes)["y"]
    books = _first_rows(rows, entries, parts)
    blocks, path = written(_blocks(rows, kind), "vector-blocks")
    for _ in range(rounds):
        blocks, new = written(_round(blocks, books, parts), "vector-blocks")
        books = {dims: moved(books[dims], found) for dims, found in _totals(blocks).items()}
        delete(spark, path)
        path = new
    coded, _ = written(_coded(blocks, books, parts, kind), "vector-codes")
    delete(spark, path)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))  # added up before the shuffle, however hot a label
    sums, _ = written(sums, "vector-labels")
    size = sums.agg(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    named = [x for dims, b in sorted(books.items()) for x in (F.lit(dims), F.lit(digest(b)))]
    sha = F.create_map(*named)[F.col("dims")] if named else F.lit(None).cast("string")
    joined = coded.join(F.broadcast(sums) if size <= broadcast_bytes else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", sha.alias("codebooks_sha256")), books
