"""Pairs of texts that share most of their shingles, for the near-duplicate stage of the pipeline.

*Shingles.*  The set of every ``SHINGLE`` successive words, with the words of
``simhash`` (a shorter text is one shingle).  Two texts are alike if the Jaccard
similarity of their sets is at least ``similarity``.

*Candidates.*  ``BANDS`` bands of ``ROWS`` minima each, over independent
permutations of the shingle hashes.  Texts that agree on a whole band share a
bucket; a pair at similarity 0.8 shares none with a probability of
``(1 - 0.8 ** ROWS) ** BANDS``, about 7e-6, and less above.

*Check.*  Every candidate pair is decided by the Jaccard similarity of the full
sets.  Only texts of some candidate are cut into sets.

*Large buckets.*  All pairs of a bucket up to ``SMALL`` texts are checked at once.
In a larger one the nearest ``SHIFTS`` neighbours are, and, once links are joined
to components, the texts outside the bucket's largest component are held against
all texts of other components.  An exact bound first rules out most of these
pairs without making them: a text's *sketch* counts its shingles by cells of a
hash, and two texts share no more shingles than the smaller counts of all cells
add up to.  No pair that could be alike is left out unless its ends are linked
already.  A task takes ``CHUNK`` texts outside the largest component and lets the
other texts of the bucket stream past, so it holds no bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import BROADCAST_BYTES, short_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 5
SEED = 7
#: Texts of a bucket whose pairs are all checked at once, and neighbours checked first in larger buckets.
SMALL = 16
SHIFTS = 3
#: Texts outside a bucket's largest component that one task holds.
CHUNK = 4096
#: Pairs of one output batch.
PAIRS = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_draws = np.random.default_rng(SEED)
_A = _draws.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _draws.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _ODD
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; empty if the text has no word."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(x) - size + 1)
    h = np.full(n, np.uint64(min(size, len(x))))
    for i in range(min(size, len(x))):
        h = _mix(h, x[i : i + n])
    return np.unique(h)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _A + _B).min(0))
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        h = _mix(h, part)
    return h


def banded(docs: DataFrame, *, text: str = "text", into: str = "banded") -> DataFrame:
    """``docs`` with a struct ``into``: n (size of the set), bands."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("n long, bands array<long>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t) for t in texts]
            yield pd.DataFrame({"n": [len(s) for s in sets], "bands": [bands(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]})

    return docs.withColumn(into, compute(F.col(text)))


def buckets(marked: DataFrame, *, into: str = "banded") -> DataFrame:
    """(bucket, node, part, n) of every distinct text with a word; ``part`` is the fingerprint."""
    once = marked.where(F.col(f"{into}.n") > 0).dropDuplicates(["node"])
    return once.select(F.explode(f"{into}.bands").alias("bucket"), "node", F.col("fp").alias("part"), F.col(f"{into}.n").alias("n"))


def _neighbours(bucket, node, part, n, similarity: float, large: bool) -> Iterator[pd.DataFrame]:
    """Pairs of buckets: all of small ones, the nearest rows of large ones; ``large``: the first one is, whatever is here of it."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, len(bucket)))
    ends, some = np.repeat(starts + sizes, sizes), sizes <= SMALL
    some[0] &= not large
    some = np.repeat(some, sizes)
    live, step = np.arange(len(bucket)), 1
    while len(live := live[(live + step < ends[live]) & (some[live] | (step <= SHIFTS))]):
        for at in range(0, len(live), PAIRS):
            i = live[at : at + PAIRS]
            j = i + step
            near = (part[i] != part[j]) & (n[i] / n[j] >= similarity)  # sorted by n
            a, b = node[i[near]], node[j[near]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        step += 1


def _pairs_in(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Candidates (a, b) of each bucket; the rows come sorted by bucket and n, and a bucket may go over the end of a batch.

    Rows of one ``part`` are linked already.  Between batches at most ``SMALL``
    rows are held: of a bucket found larger only the last ``SHIFTS``, whose pairs
    may come twice.
    """
    held, large = None, False

    def solve(rows: pd.DataFrame, large: bool) -> Iterator[pd.DataFrame]:
        out, count = [], 0
        for found in _neighbours(*(rows[c].to_numpy(np.int64) for c in ("bucket", "node", "part", "n")), similarity, large):
            out.append(found)
            count += len(found)
            if count >= PAIRS:
                yield pd.concat(out)
                out, count = [], 0
        if count:
            yield pd.concat(out)

    for rows in batches:
        if not len(rows):
            continue
        rows = rows if held is None else pd.concat([held, rows])
        bucket = rows["bucket"].to_numpy(np.int64)
        start = int(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[-1])  # of the bucket that is still open
        if start:
            yield from solve(rows.iloc[:start], large)
            large = False
        held = rows.iloc[start:]
        if large or len(held) > SMALL:
            large = True
            yield from solve(held, large)
            held = held.iloc[-SHIFTS:]
    if held is not None:
        yield from solve(held, large)


def candidates(rows: DataFrame, *, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes of ``rows`` (bucket, node, part, n): all of small buckets, neighbours of large ones."""
    dealt = rows.select("bucket", "node", "part", "n").repartition("bucket").sortWithinPartitions("bucket", "n", "node")
    return dealt.mapInPandas(lambda it: _pairs_in(it, similarity), "a long, b long").distinct()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Shingles by cell; a power of two of cells, so that a finer sketch folds to a coarser one."""
    cells = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    while (counts := np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)).max() > 255:
        cells *= 2
    return counts.astype(np.uint8)


def _folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """Counts [row, cell] in fewer cells."""
    return counts if counts.shape[1] == cells else counts.reshape(len(counts), -1, cells).sum(1, dtype=np.uint16)


def _past(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs that may be alike of each (bucket, chunk): its own texts come first, and the others go past them."""
    key, own = None, []
    ratio = (1 + similarity) / similarity  # alike texts share at least (n1 + n2) / ratio

    def meet(held: list, rows: pd.DataFrame, inside: bool) -> Iterator[pd.DataFrame]:
        node, part, n = (rows[c].to_numpy(np.int64) for c in ("node", "part", "n"))
        sizes = rows["sketch"].map(len).to_numpy()
        for cells in np.unique(sizes):
            at = np.flatnonzero(sizes == cells)
            counts = np.frombuffer(b"".join(rows["sketch"].iloc[at]), np.uint8).reshape(len(at), cells)
            for h_node, h_part, h_n, h_counts, h_at in held:
                near = (part[at] != h_part) & (np.minimum(n[at], h_n) >= similarity * np.maximum(n[at], h_n))
                if inside:
                    near &= at > h_at
                if not near.any():
                    continue
                least = min(cells, h_counts.shape[1])
                shared = np.minimum(_folded(counts[near], least), _folded(h_counts, least)).sum(1, dtype=np.int64)
                found = node[at[near]][shared * ratio >= n[at[near]] + h_n - 1e-6]
                if len(found):
                    yield pd.DataFrame({"a": np.minimum(found, h_node), "b": np.maximum(found, h_node)})

    for batch in batches:
        for k, rows in batch.groupby(["bucket", "chunk"], sort=False):
            if k != key:
                key, own = k, []
            late = rows["late"].to_numpy(bool)
            mine = rows[~late]
            if len(mine):
                new = [(i, p, n, np.frombuffer(c, np.uint8)[None], at) for at, (i, p, n, c) in enumerate(zip(mine["node"], mine["part"], mine["n"], mine["sketch"], strict=True))]
                yield from meet(own, mine, False)
                yield from meet(new, mine, True)
                own += new
            if late.any():
                yield from meet(own, rows[late], False)


def across(rows: DataFrame, docs: DataFrame, *, text: str, similarity: float) -> tuple[DataFrame, list[str]]:
    """Distinct pairs (a, b) of ``rows`` (bucket, node, part, n) of different parts of a bucket that may be alike, and the paths of helper tables."""
    parts = rows.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket")
    parts = parts.agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    rows = rows.join(parts, "bucket").withColumn("chunks", F.ceil(F.col("outside") / CHUNK).cast("int"))
    own = F.when(F.col("part") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))  # null in the largest part
    rows, path = written(rows.select("bucket", "node", "part", "n", "chunks", own.alias("own")), "unsettled")
    wanted = rows.select("node").distinct()
    if 16 * wanted.count() <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)

    @F.pandas_udf("binary")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sketch(shingle_set(t)).tobytes() for t in texts], dtype=object)

    texts = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")).join(wanted, "node", "left_semi")
    sketches, sketch_path = written(texts.select("node", cut("text").alias("sketch")).groupBy("node").agg(F.first("sketch").alias("sketch")), "sketches")
    # a text meets the chunks before its own, and those of the largest part meet all
    last = F.coalesce("own", F.col("chunks") - 1)
    dealt = rows.select("bucket", "node", "part", "n", "own", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    dealt = dealt.join(sketches, "node").select("bucket", "chunk", (~F.col("own").eqNullSafe(F.col("chunk"))).alias("late"), "node", "part", "n", "sketch")
    dealt = dealt.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "late", "node")
    return dealt.mapInPandas(lambda it: _past(it, similarity), "a long, b long").distinct(), [path, sketch_path]


def alike(pairs: DataFrame, docs: DataFrame, *, text: str, similarity: float) -> tuple[DataFrame, list[str]]:
    """The ``pairs`` (a, b) whose sets reach ``similarity``, and the paths of helper tables."""
    pairs, path = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if 16 * wanted.count() <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)

    @F.pandas_udf("binary")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    @F.pandas_udf("boolean")
    def close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) >= similarity)
            yield pd.Series(out, dtype=bool)

    texts = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")).join(wanted, "node", "left_semi")
    sets, sets_path = written(texts.select("node", cut("text").alias("set")).groupBy("node").agg(F.first("set").alias("set")), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("set").alias(f"set_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(close("set_a", "set_b")).select("a", "b"), [path, sets_path]
