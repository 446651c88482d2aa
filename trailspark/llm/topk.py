"""Exact top-k search by integer inner product on a bit-sliced index.

*Index.*  Components become ``floor(scale * x)``.  Rows are dealt by a hash of
their id, values and input partition, so that a repeated row is spread too, to
blocks of about ``block_rows``; a block stores, for each dimension, the two's
complement of its values as bit slices, as many as its largest value needs:
slice ``b`` is a bitmap with bit ``r`` set if bit ``b`` of row ``r``'s value is.
All rows are indexed.

*Search.*  A query's score is a sum of its components times attribute slices.
Multiplying by a constant shifts slices (signed digits of the constant, so few
are needed); shifted slices of equal weight are added by carry-save bitmap
adders until one slice a weight is left: the score of all rows of the block, in
bit slices.  Selection goes from the most significant slice downward, keeping
the rows surely in and those still tied; the rows tied at the boundary are
resolved exactly, by id.  Each block returns ``k`` rows a query; the best ``k``
of all blocks win.

Queries are packed too, and a pack meets each block once by an equi-join on the
block number, so neither side is broadcast or gathered.  Where blocks are fewer
than tasks should be, packs are dealt to lanes and a block goes to each lane.

Defined cases: vectors that are null or hold a null or non-finite component take
no part; vectors are compared with those of their own length; rows with a null
id take no part; a query's own row, that is one row of its id and values, is no
candidate, while other rows of its id are; each of several rows of one id is a
query with a result of its own; ties go to the smaller id, and rows equal in id
and score are alike; an empty table has no results.  Scores are exact whatever
the components' size; a quantised component, or a score to be returned, that does
not fit 64 bits is an error.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import short_batches, written

SCALE = 256
K = 5
BLOCK_ROWS = 1 << 14
QUERY_ROWS = 64
#: Pairs of blocks and lanes for each core, where blocks alone are fewer.
LANES = 2
WORD = 1 << 63

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(embedding: str = "embedding", scale: int = SCALE):
    """The vector as integers; null if it takes no part."""
    x = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))
    whole = F.col(embedding).isNotNull() & F.forall(x, lambda v: v.isNotNull())
    # a null component makes forall false, not null
    fits = lambda v: (v * scale >= -float(WORD)) & (v * scale < float(WORD))
    failed = F.raise_error(F.lit("a quantised component does not fit 64 bits")).cast("long")
    return F.when(whole, F.transform(x, lambda v: F.when(fits(v), F.floor(v * scale).cast("long")).otherwise(failed)))


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps [dimension, bit, word] of int64 values [row, dimension]."""
    rows, dims = values.shape
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = max(max(high, 0).bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    words = -(-rows // 64)
    out = np.zeros((dims, width, words), np.uint64)
    for b in range(width):
        bits = ((values >> b) & 1).astype(np.uint8).T
        packed = np.packbits(bits, axis=1, bitorder="little")
        full = np.zeros((dims, words * 8), np.uint8)
        full[:, : packed.shape[1]] = packed
        out[:, b] = full.view(np.uint64)
    return out


def _digits(q: int) -> list[tuple[int, int]]:
    """Non-adjacent signed digits (position, sign) of ``q``."""
    out, at = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((at, d))
            q -= d
        q >>= 1
        at += 1
    return out


def score_slices(index: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Bit slices [bit, word] of the scores in two's complement, the last the sign."""
    dims, width, words = index.shape
    top = width + max(map(abs, query.tolist()), default=0).bit_length() + max(1, dims).bit_length() + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(top)]
    constant = 0
    by_digit: dict[tuple[int, int], list[int]] = {}
    for d, q in enumerate(query.tolist()):
        for place in _digits(q):
            by_digit.setdefault(place, []).append(d)
    for (at, digit), ds in by_digit.items():
        for b in range(width):
            rows = index[ds, b]
            if (digit < 0) != (b == width - 1):  # the top slice of two's complement weighs minus; -x = (1 - x) - 1 for a bit
                rows = rows ^ _ONES
                constant -= len(ds) << (at + b)
            columns[at + b].append(rows)
    for w in range(top):
        if constant >> w & 1:
            columns[w].append(np.full((1, words), _ONES))
    out = np.zeros((top, words), np.uint64)
    for w in range(top):
        rows = np.concatenate(columns[w]) if columns[w] else np.zeros((0, words), np.uint64)
        columns[w] = []
        while len(rows) > 2:  # carry-save: three bitmaps of a weight become one of it and one of the next
            n = len(rows) // 3
            a, b, c, rest = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]
            half = a ^ b
            if w + 1 < top:
                columns[w + 1].append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rest])
        if len(rows) == 2:
            if w + 1 < top:
                columns[w + 1].append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        if len(rows):
            out[w] = rows[0]
    return out


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(scores: np.ndarray, allowed: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``k`` highest scores among ``allowed`` (bitmap), ties to the smaller id, and their scores."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    top = len(scores) - 1
    need = k
    for b in range(top, -1, -1):
        ahead = tied & (~scores[b] if b == top else scores[b])  # a clear sign is larger
        n = int(np.bitwise_count(ahead).sum())
        if n > need:
            tied = ahead
        else:
            sure |= ahead
            tied &= ~ahead
            need -= n
            if not need:
                tied[:] = 0
                break
    boundary = _positions(tied)
    if len(boundary) > need:
        boundary = boundary[np.argsort(ids[boundary], kind="stable")[:need]]
    rows = np.concatenate([_positions(sure), boundary])
    bits = (scores[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    value = np.zeros(len(rows), np.int64 if top < 63 else object)  # Python's integers where 64 bits may not do
    for b in range(top + 1):
        value += bits[b].astype(value.dtype) * (-(1 << b) if b == top else 1 << b)
    return rows, value


def _is_row(index: np.ndarray, row: int, values: np.ndarray) -> bool:
    """Whether the row's values are these."""
    width = index.shape[1]
    held = (index[:, :, row >> 6] >> np.uint64(row & 63)) & np.uint64(1)
    fits = ((values >> (width - 1) == 0) | (values >> (width - 1) == -1)).all()
    return bool(fits and (held.astype(np.int64) == (values[:, None] >> np.arange(width)) & 1).all())


def build_index(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Written tables: packed blocks (dims, block, n, width, ids, slices), and their (dims, blocks)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("i"), quantised(embedding, scale).alias("v")).dropna().withColumn("dims", F.size("v"))
    sizes = rows.groupBy("dims").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sizes, _ = written(sizes, "topk-sizes")
    short_batches(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", kind="stable")
        dims = int(rows["dims"].iloc[0])
        values = np.stack(rows["v"].to_numpy()).astype(np.int64) if dims else np.zeros((len(rows), 0), np.int64)
        index = slices_of(values)
        return pd.DataFrame({
            "dims": [dims], "block": [rows["block"].iloc[0]], "n": [len(rows)], "width": [index.shape[1]],
            "ids": [rows["i"].to_numpy(np.int64).tobytes()], "slices": [index.tobytes()],
        })

    dealt = rows.join(F.broadcast(sizes), "dims").withColumn("block", F.pmod(F.xxhash64("i", "v", F.spark_partition_id()), F.col("blocks").cast("long")).cast("int"))
    packed = dealt.select("dims", "block", "i", "v").groupBy("dims", "block").applyInPandas(pack, "dims int, block int, n int, width int, ids binary, slices binary")
    return written(packed, "topk-index")[0], sizes


def search(index: DataFrame, sizes: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, k: int = K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows of each query."""
    spark = index.sparkSession
    rows = queries.select(F.col(vec_id).cast("long").alias("i"), quantised(embedding, scale).alias("v")).dropna()
    # equal queries have equal results: they are asked once and given back as often
    rows, _ = written(rows.groupBy("i", "v").agg(F.count("*").alias("copies")).withColumn("dims", F.size("v")), "topk-queries")
    packs = rows.groupBy("dims").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("packs"))
    keyed = rows.join(F.broadcast(packs), "dims").withColumn("pack", F.pmod(F.xxhash64("i", "v"), F.col("packs")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        dims = int(rows["dims"].iloc[0])
        values = np.stack(rows["v"].to_numpy()).astype(np.int64) if dims else np.zeros((len(rows), 0), np.int64)
        order = np.lexsort([*values.T[::-1], rows["i"].to_numpy()])  # a query is known by its place in the pack, whatever order rows come in
        q_ids, copies = rows["i"].to_numpy(np.int64)[order], rows["copies"].to_numpy(np.int64)[order]
        return pd.DataFrame({"dims": [dims], "pack": [rows["pack"].iloc[0]], "q_ids": [q_ids.tobytes()], "q_copies": [copies.tobytes()], "q_values": [values[order].tobytes()]})

    packed = keyed.groupBy("dims", "pack").applyInPandas(pack, "dims int, pack long, q_ids binary, q_copies binary, q_values binary")
    names = ("pack", "q_ids", "q_copies", "q_values")
    spread = packed.join(F.broadcast(sizes), "dims").select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *names)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                words = -(-r.n // 64)
                blocks = np.frombuffer(r.slices, np.uint64).reshape(r.dims, r.width, words)
                q_ids = np.frombuffer(r.q_ids, np.int64)
                values = np.frombuffer(r.q_values, np.int64).reshape(len(q_ids), r.dims)
                full = np.packbits(np.arange(words * 64) < r.n, bitorder="little").view(np.uint64)
                copies = np.frombuffer(r.q_copies, np.int64)
                out = []
                for at, (q, v) in enumerate(zip(q_ids, values, strict=True)):
                    # one more than asked for, as the query's own row may be among them
                    found, score = select_top(score_slices(blocks, v), full, k + 1, ids)
                    own = np.array([ids[x] == q and _is_row(blocks, int(x), v) for x in found], bool)
                    over = np.array([not -WORD <= x < WORD for x in score], bool)
                    if (over & ~own).any():
                        raise OverflowError("a score does not fit 64 bits")
                    score = np.where(over, WORD - 1, score).astype(np.int64)  # a query's own row is not returned, so its score may be larger
                    out.append(pd.DataFrame({"dims": r.dims, "pack": r.pack, "place": at, "copies": copies[at], "query_id": q, "vec_id": ids[found], "score": score, "own": own, "over": over}))
                yield pd.concat(out)

    blocks = max(1, sizes.agg(F.sum("blocks")).first()[0] or 0)
    most = packs.agg(F.max("packs")).first()[0] or 1
    lanes = max(1, min(most, -(-LANES * spark.sparkContext.defaultParallelism // blocks)))
    spread = spread.withColumn("lane", F.pmod("pack", F.lit(lanes)).cast("int"))
    held = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # fixed numbers of tasks, with room so that few pairs share one: adaptive execution goes by bytes, but the work is in the pairs
    key, tasks = ("dims", "block", "lane"), 3 * blocks * lanes
    pairs = spread.repartition(tasks, *key).join(held.repartition(tasks, *key), [*key])
    schema = "dims int, pack long, place int, copies long, query_id long, vec_id long, score long, own boolean, over boolean"
    found = pairs.select("dims", "n", "width", "ids", "slices", *names).mapInPandas(meet, schema)
    best = Window.partitionBy("dims", "pack", "place").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    # the query's own row is the first of those equal to it
    ranked = ranked.withColumn("skipped", F.count_if("own").over(best.rowsBetween(Window.unboundedPreceding, 0)))
    others = ranked.where(~(F.col("own") & (F.col("skipped") == 1))).withColumn("rank", F.col("rank") - (F.col("skipped") > 0).cast("int"))
    result = others.where(F.col("rank") <= k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    score = F.when(F.col("over"), F.raise_error(F.lit("a score does not fit 64 bits")).cast("long")).otherwise(F.col("score"))
    return result.select("query_id", "rank", "vec_id", score.alias("score"))
