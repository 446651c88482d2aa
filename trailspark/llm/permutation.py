"""Approximate nearest neighbours by a permutation index.

*Index.*  Pivots are vectors far from one another, picked farthest first from a
sample of ``sample`` rows at most.  A vector is represented by its ``prefix``
nearest pivots in order.  Rows are dealt by a hash to blocks of about
``block_rows``; in a block every row is posted, with its place in the order, to
the inverted files of the pivots of its prefix.  All rows are indexed.

*Search.*  A query reads the files of its own prefix.  The footrule distance of
two prefixes, a pivot missing from one counting as its place ``prefix``, is a
constant less twice the sum, over the pivots they share, of ``prefix`` less the
larger place; that sum is added up from the files.  Rows are ranked by it, ties to
the smaller id, and reranked by their distance on the original vectors: first the
``first`` share of the block, then steps of ``step`` of it until a step brings no
better row and there are ``k``.  So a block with many near copies of the query is
read as far as it helps; no number of candidates is fixed.  The best ``k`` of all
blocks win.  Recall against brute force is in README and asserted in the tests.

Of rows with equal vectors only the smallest ids can be results, so the first
``k + 1`` are indexed, by limits within the tasks before a shuffle.  Packs of
queries meet blocks by an equi-join on (block, lane); only the pivots, of a bounded
number, are sent to all tasks.  Every query meets every block, so the work grows
with queries times rows, a few integer additions a row.

Defined cases: vectors that are null, of length 0 or all zero, or that hold a null
or non-finite component take no part, nor do rows with a null id; vectors are
compared with those of their own length, and more than ``MAX_LENGTHS`` lengths are
an error; negative zero is zero; a query's own row, one of its id and vector, is no
candidate; repeated query rows have results of their own; ties go to the smaller id;
an empty table has no results; distances too large for a double are infinite.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import delete, short_batches, written

K = 10
PIVOTS = 256
PREFIX = 64
SAMPLE = 4096
FIRST = 0.1
STEP = 0.05
BLOCK_ROWS = 1 << 13
QUERY_ROWS = 64
MAX_LENGTHS = 100
#: Pairs of blocks and lanes for each core, where blocks alone are fewer.
LANES = 2


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows at most, each the farthest from those before."""
    picked, apart = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(picked) < n and apart.max() > 0:
        picked.append(int(np.argmax(apart)))
        apart = np.minimum(apart, ((rows - rows[picked[-1]]) ** 2).sum(1))
    return rows[picked]


def prefixes(rows: np.ndarray, pivots: np.ndarray, prefix: int, step: int = 2048) -> np.ndarray:
    """The nearest pivots [row, place], nearest first, ties to the smaller pivot."""
    half = (pivots * pivots).sum(1) / 2
    parts = [np.argsort(half - rows[a : a + step] @ pivots.T, axis=1, kind="stable")[:, :prefix] for a in range(0, len(rows), step)]
    return np.concatenate(parts).astype(np.int16) if parts else np.zeros((0, prefix), np.int16)


def files_of(orders: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files: where each pivot's begins and ends, and the rows and places posted, by pivot and row."""
    pivots, places = orders.reshape(-1), np.tile(np.arange(orders.shape[1], dtype=np.int16), len(orders))
    order = np.argsort(pivots, kind="stable")
    rows = (order // orders.shape[1]).astype(np.int32)
    return np.searchsorted(pivots[order], np.arange(n_pivots + 1)).astype(np.int32), rows, places[order]


def agreement(order: np.ndarray, n: int, starts: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, ``prefix`` less the larger place summed over shared pivots: the constant less half the footrule distance."""
    out, prefix = np.zeros(n, np.int32), len(order)
    for at, pivot in enumerate(order):
        file = slice(starts[pivot], starts[pivot + 1])
        out[rows[file]] += prefix - np.maximum(places[file], at)  # a row is in a file once
    return out


def footrule(a: np.ndarray, b: np.ndarray) -> int:
    """Footrule distance of two prefixes of one length: the definition, for tests."""
    n = len(a)
    at = [{p: i for i, p in enumerate(x)} for x in (a.tolist(), b.tolist())]
    return sum(abs(at[0].get(p, n) - at[1].get(p, n)) for p in at[0].keys() | at[1].keys())


def rerank(query: np.ndarray, values: np.ndarray, ids: np.ndarray, ranked: np.ndarray, *, k: int, first: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the best ``k`` rows, reading ``ranked`` as far as it helps."""
    at, until = 0, max(k, int(np.ceil(first * len(ranked))))
    best, found = np.zeros(0), np.zeros(0, np.int64)
    while at < len(ranked):
        rows = ranked[at:until]
        gap = values[rows] - query
        d = np.sqrt((gap * gap).sum(1))
        more, of = np.concatenate([best, d]), np.concatenate([found, ids[rows]])
        order = np.lexsort((of, more))[:k]
        if at and len(best) == k and (order < k).all():
            break
        best, found = more[order], of[order]
        at, until = until, until + max(k, int(np.ceil(step * len(ranked))))
    return found, best


def _rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.transform(F.col(embedding).cast("array<double>"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v + F.lit(0.0)))
    taking_part = F.forall(x, lambda v: v.isNotNull()) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("i"), F.when(taking_part, x).alias("v")).dropna()


def build_index(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """Written blocks (dims, block, n, ids, wide, held, starts, rows, places), their numbers (dims, blocks), and the pivots of each length."""
    spark = vectors.sparkSession
    short_batches(spark)
    same = Window.partitionBy("v").orderBy("i")
    rows = _rows(vectors, vec_id, embedding).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    kept, path = written(rows.select("i", "v", F.size("v").alias("dims")), "permutation-rows")
    sizes, _ = written(kept.groupBy("dims").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "permutation-sizes")
    counts = {r.dims: r.n for r in sizes.limit(MAX_LENGTHS + 1).collect()}
    if len(counts) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    chosen = {dims: np.zeros((1, dims)) for dims in counts}  # a length without sampled rows has one pivot
    if counts:
        rate = F.create_map(*(F.lit(x) for dims, n in counts.items() for x in (dims, min(1.0, sample / n))))[F.col("dims")]
        draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
        for dims, own in kept.where(draw < rate).select("dims", "v").toPandas().groupby("dims"):  # about ``sample`` rows a length
            held = np.unique(matrix(own["v"]), axis=0)
            chosen[int(dims)] = far_apart(held, min(pivots, max(1, len(held) // 2)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", kind="stable")
        dims, held = int(rows["dims"].iloc[0]), matrix(rows["v"])
        wide = bool((held.astype(np.float32) != held).any())
        own = chosen[dims]
        starts, posted, places = files_of(prefixes(held, own, min(prefix, max(1, len(own) // 2))), len(own))
        return pd.DataFrame({
            "dims": [dims], "block": [rows["block"].iloc[0]], "n": [len(rows)], "ids": [rows["i"].to_numpy(np.int64).tobytes()], "wide": [wide], "held": [held.astype(float if wide else np.float32).tobytes()],
            "starts": [starts.tobytes()], "rows": [posted.tobytes()], "places": [places.tobytes()],
        })

    dealt = kept.join(F.broadcast(sizes), "dims").withColumn("block", F.pmod(F.xxhash64("i", "v"), F.col("blocks").cast("long")).cast("int"))
    kind = "dims int, block int, n int, ids binary, wide boolean, held binary, starts binary, rows binary, places binary"
    index, _ = written(dealt.select("dims", "block", "i", "v").groupBy("dims", "block").applyInPandas(pack, kind), "permutation-index")
    delete(spark, path)
    return index, sizes, chosen


def search(
    index: DataFrame, sizes: DataFrame, pivots: dict[int, np.ndarray], queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, prefix: int = PREFIX, first: float = FIRST, step: float = STEP,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each query."""
    spark = index.sparkSession
    asked = _rows(queries, vec_id, embedding).groupBy("i", "v").agg(F.count("*").alias("copies")).withColumn("dims", F.size("v"))
    asked, _ = written(asked.withColumn("q", F.monotonically_increasing_id()), "permutation-queries")
    packs = asked.groupBy("dims").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("packs"))
    numbered = asked.join(F.broadcast(packs), "dims").withColumn("pack", F.pmod(F.xxhash64("q"), F.col("packs")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        dims, held = int(rows["dims"].iloc[0]), matrix(rows["v"])
        own = pivots.get(dims, np.zeros((1, dims)))
        orders = prefixes(held, own, min(prefix, max(1, len(own) // 2)))
        return pd.DataFrame({"dims": [dims], "pack": [rows["pack"].iloc[0]], "qs": [rows["q"].to_numpy(np.int64).tobytes()], "q_ids": [rows["i"].to_numpy(np.int64).tobytes()], "q_held": [held.tobytes()], "orders": [orders.tobytes()]})

    packed = numbered.groupBy("dims", "pack").applyInPandas(pack, "dims int, pack long, qs binary, q_ids binary, q_held binary, orders binary")
    names = ("qs", "q_ids", "q_held", "orders")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                values = np.frombuffer(r.held, float if r.wide else np.float32).reshape(r.n, r.dims).astype(float)
                files = np.frombuffer(r.starts, np.int32), np.frombuffer(r.rows, np.int32), np.frombuffer(r.places, np.int16)
                qs, q_ids = np.frombuffer(r.qs, np.int64), np.frombuffer(r.q_ids, np.int64)
                q_held, orders = np.frombuffer(r.q_held).reshape(len(qs), r.dims), np.frombuffer(r.orders, np.int16).reshape(len(qs), -1)
                out = []
                for q, own, vector, order in zip(qs, q_ids, q_held, orders, strict=True):
                    shared = agreement(order, r.n, *files)
                    for at in range(*np.searchsorted(ids, [own, own + 1])):  # one row of the query's id and vector is its own
                        if (values[at] == vector).all():
                            shared[at] = -1
                            break
                    ranked = np.argsort(-shared, kind="stable")  # rows are in the order of their ids
                    found, score = rerank(vector, values, ids, ranked[: len(ranked) - int((shared < 0).sum())], k=k, first=first, step=step)
                    out.append(pd.DataFrame({"q": q, "vec_id": found, "score": score}))
                yield pd.concat(out)

    blocks = max(1, sizes.agg(F.sum("blocks")).first()[0] or 0)
    most = packs.agg(F.max("packs")).first()[0] or 1
    lanes = max(1, min(most, -(-LANES * spark.sparkContext.defaultParallelism // blocks)))
    spread = packed.join(F.broadcast(sizes), "dims").select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("pack", F.lit(lanes)).cast("int").alias("lane"), *names)
    held = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # fixed numbers of tasks: adaptive execution goes by bytes, but the work is in the pairs
    key, tasks = ("dims", "block", "lane"), 3 * blocks * lanes
    pairs = spread.repartition(tasks, *key).join(held.repartition(tasks, *key), [*key])
    found = pairs.mapInPandas(meet, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    of = asked.select("q", F.col("i").alias("query_id"), "copies")
    copied = ranked.join(of, "q").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select("query_id", "rank", "vec_id", "score")
