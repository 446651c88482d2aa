"""Hard negatives by exact search over K-means inverted lists.

*Lists.*  Components become ``floor(scale * x)``.  K-means on a sample gives the
centroids, about the square root of the number of rows, ``MAX_LISTS`` at most, for
each length of vectors; every row goes to the list of its nearest centroid, and a
list keeps its radius, the largest distance of a row from the centroid.  Whole
lists share shelves of about ``shelf_rows`` rows, and a longer list is dealt to
several.

*Search.*  A row's score is its integer inner product with the anchor.  By
Cauchy-Schwarz a list's scores lie within ``q.c - |q| r`` and ``q.c + |q| r``.
Packs of anchors near one centroid first visit the shelves of that list; then all
others that have a list whose upper bound is not strictly below the ``k``-th score
so far and whose scores can meet the window.  Within a shelf lists are visited by
upper bound, a list outside an anchor's window is skipped, and an anchor stops at
lists whose bound is strictly below its ``k``-th score.  Bounds are rounded
outward, so results are exact for any sample.

*Mining.*  An anchor's positives are the best other rows of its label; for each,
the negatives are the best rows of other labels whose score is within a window
of shares of the positive's score.  Each step is one search.

Of rows equal in vector and label only the smallest ids can be results, so the
first few are kept, by limits within the tasks before a shuffle: copies, however
many, fill no list.  Sides meet by an equi-join on (shelf, lane); only centroids,
their radii and places, bounded by ``MAX_LISTS``, are sent to all tasks.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; vectors are compared with those of their own length, and
more than ``MAX_LENGTHS`` lengths are an error; an anchor's own row, one row of
its id, label and vector, is no positive; repeated anchor rows have results of their
own; ties go to the smaller id, and rows equal in score and id are alike; an
anchor without positives, or a positive without negatives, gives no rows, as an
empty table does.  Scores are exact; a component or a returned score that does not
fit 64 bits is an error.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import delete, short_batches, written
from trailspark.llm.topk import quantised

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
#: Rows that the centroids are fitted on, for each centroid, and the most centroids of a length.
SAMPLED = 24
MAX_LISTS = 2048
MAX_LENGTHS = 1000
STEPS = 6
SHELF_ROWS = 1 << 13
PACK_ROWS = 64
#: Pairs of shelves and lanes for each core, where shelves alone are fewer.
LANES = 2

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64) if dims and len(vectors) else np.zeros((len(vectors), dims), np.int64)


def lloyd(rows: np.ndarray, n: int, steps: int = STEPS) -> np.ndarray:
    """``n`` centroids at most, from rows spread over the sample."""
    centers = np.unique(rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)], axis=0)
    for _ in range(steps):
        own = nearest(rows, centers)[0]
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid and its distance, in blocks of rows."""
    half = (centers * centers).sum(1) / 2
    own = np.concatenate([np.argmax(rows[a : a + step] @ centers.T - half, axis=1) for a in range(0, len(rows), step)]) if len(rows) else np.zeros(0, np.int64)
    gap = rows - centers[own]
    return own, np.sqrt((gap * gap).sum(1))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products [query, row]: in doubles where all sums are whole numbers there, else in wider integers."""
    most = lambda x: max(int(x.max()), -int(x.min())) if x.size else 0
    bound = most(queries) * most(rows) * max(1, rows.shape[1])
    if bound < 1 << 53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    kind = np.int64 if bound < 1 << 62 else object
    return queries.astype(kind) @ rows.astype(kind).T


@dataclass
class Directory:
    """The lists of one length: centroids, radii, first shelves and numbers of shelves."""

    centers: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    chunks: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bounds(queries, self.centers, self.radius)


def bounds(queries: np.ndarray, centers: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [query, list] of the scores, rounded outward."""
    q = queries.astype(float)
    norm = np.sqrt((q * q).sum(1))[:, None]
    reach, middle = norm * radius, q @ centers.T
    room = reach + 1 + 1e-9 * (reach + norm * np.sqrt((centers * centers).sum(1)))
    return middle - room, middle + room


def meeting(lower: np.ndarray, upper: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which lists [query, list] can have a score in the window that is not strictly below the ``k``-th; the widest window has no ends."""
    low, high = (np.where(x == end, sign * np.inf, x)[:, None] for x, end, sign in ((low, _LEAST, -1), (high, _MOST, 1)))
    return (np.minimum(upper, high) >= kth[:, None]) & (lower <= high) & (upper >= low)


def _rows(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(i, y, v) of the rows that take part."""
    return vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(label).cast("string").alias("y"), quantised(embedding, scale).alias("v")).dropna()


def build_lists(rows: DataFrame, *, copies: int, shelf_rows: int = SHELF_ROWS, lists: int | None = None) -> tuple[DataFrame, dict[int, Directory]]:
    """Written shelves (dims, shelf, n, ids, names, labels, lists, held) of rows (i, y, v), and the directory of each length."""
    spark = rows.sparkSession
    short_batches(spark)
    same = Window.partitionBy("v", "y").orderBy("i")
    kept, kept_path = written(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= copies).select("i", "y", "v", F.size("v").alias("dims")), "negative-rows")
    counts = {r.dims: r.n for r in kept.groupBy("dims").agg(F.count("*").alias("n")).limit(MAX_LENGTHS + 1).collect()}
    if len(counts) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    wanted = {dims: min(MAX_LISTS, lists or math.isqrt(n) + 1) for dims, n in counts.items()}
    draw = F.pmod(F.xxhash64("i", "v"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*(F.lit(x) for dims, n in counts.items() for x in (dims, min(1.0, SAMPLED * wanted[dims] / n)))) if counts else F.lit(None)
    sample = kept.where(draw < rate[F.col("dims")]).select("dims", "i", "v").toPandas() if counts else pd.DataFrame({"dims": [], "i": [], "v": []})  # bounded: SAMPLED rows a centroid
    centers = {dims: np.zeros((1, dims)) for dims in counts}  # a length without sampled rows has one list
    for dims, own in sample.groupby("dims"):
        held = matrix(own["v"], dims).astype(float)
        centers[dims] = lloyd(held[np.lexsort(held.T)] if dims else held, wanted[dims])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                at, far = nearest(matrix(own["v"], dims).astype(float), centers[dims])
                yield own.assign(list=at.astype(np.int32), far=far * (1 + 1e-9))

    placed, placed_path = written(kept.mapInPandas(place, "i long, y string, v array<long>, dims int, list int, far double"), "negative-places")
    found = placed.groupBy("dims", "list").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()  # a row a list
    directory, shelf = {}, 0
    for dims, own in found.groupby("dims"):
        n, radius = np.zeros(len(centers[dims]), np.int64), np.zeros(len(centers[dims]))
        n[own["list"]], radius[own["list"]] = own["n"], own["far"]
        first, chunks, room = np.zeros_like(n), np.ones_like(n), 0
        for x in np.lexsort(centers[dims].T[::-1]) if dims else range(len(n)):
            if n[x] > shelf_rows:
                first[x], chunks[x] = shelf, -(-n[x] // shelf_rows)
                shelf, room = shelf + int(chunks[x]), 0
                continue
            if n[x] > room:
                shelf, room = shelf + 1, shelf_rows
            first[x], room = shelf - 1, room - n[x]
        radius[n == 0] = -np.inf  # an empty list bounds nothing
        directory[int(dims)] = Directory(centers[dims], radius, first, chunks)

    def shelve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, chunks = np.zeros(len(batch), np.int64), np.ones(len(batch), np.int64)
            for dims in batch["dims"].unique():
                own, d = (batch["dims"] == dims).to_numpy(), directory[dims]
                at = batch.loc[own, "list"].to_numpy()
                first[own], chunks[own] = d.first[at], d.chunks[at]
            yield batch.assign(shelf=first + np.mod(batch["h"].to_numpy(), chunks)).drop(columns="h")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["list", "i"], kind="stable")
        dims = int(rows["dims"].iloc[0])
        codes, names = pd.factorize(rows["y"])
        held = matrix(rows["v"], dims)
        return pd.DataFrame({
            "dims": [dims], "shelf": [rows["shelf"].iloc[0]], "n": [len(rows)], "ids": [rows["i"].to_numpy(np.int64).tobytes()], "names": [list(names)], "labels": [codes.astype(np.int32).tobytes()],
            "lists": [rows["list"].to_numpy(np.int32).tobytes()], "wide": [wide := held.size and bool(np.abs(held).max() >= 1 << 15 or held.min() < 0 and np.abs(held.min()) >= 1 << 15)], "held": [held.astype(np.int64 if wide else np.int16).tobytes()],
        })

    hashed = placed.select("dims", "list", "i", "y", "v", F.xxhash64("i", "y", "v").alias("h"))
    dealt = hashed.mapInPandas(shelve, "dims int, list int, i long, y string, v array<long>, shelf long")
    shelves = dealt.groupBy("dims", "shelf").applyInPandas(pack, "dims int, shelf long, n int, ids binary, names array<string>, labels binary, lists binary, wide boolean, held binary")
    out, _ = written(shelves, "negative-shelves")
    delete(spark, kept_path)
    delete(spark, placed_path)
    return out, directory


@dataclass
class Best:
    """The best (score, id) of one query so far."""

    k: int
    kth: float
    scores: np.ndarray
    ids: np.ndarray

    def add(self, found: np.ndarray, ids: np.ndarray) -> None:
        if len(found) > 4 * self.k:  # those below the k-th of these cannot win
            least = np.partition(found, len(found) - self.k)[len(found) - self.k]
            found, ids = found[found >= least], ids[found >= least]
        found, ids = np.concatenate([self.scores, found]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -found))[: self.k]
        self.scores, self.ids = found[order], ids[order]
        if len(order) == self.k:
            self.kth = max(self.kth, int(self.scores[-1]))


def visit(shelf, directory: Directory, queries: np.ndarray, labels: list[str], q_ids: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, *, k: int, same: bool) -> tuple[list[Best], int]:
    """The best rows of a shelf for each query, and how many (query, list) visits it took."""
    ids, lists = np.frombuffer(shelf.ids, np.int64), np.frombuffer(shelf.lists, np.int32)
    values = np.frombuffer(shelf.held, np.int64 if shelf.wide else np.int16).reshape(shelf.n, shelf.dims).astype(np.int64)
    codes, names = np.frombuffer(shelf.labels, np.int32), {name: c for c, name in enumerate(shelf.names)}
    here = np.unique(lists)
    ends = np.searchsorted(lists, here, side="right")
    lower, upper = bounds(queries, directory.centers[here], directory.radius[here])
    best = [Best(k, int(x) if x > _LEAST else -math.inf, np.zeros(0, np.int64), np.zeros(0, np.int64)) for x in kth]
    of = np.array([names.get(y, -1) for y in labels])
    windowed = (low > _LEAST) | (high < _MOST)
    visits = 0
    for x in np.argsort(-upper.max(0), kind="stable"):
        now = np.array([b.kth for b in best], float)
        active = np.flatnonzero(meeting(lower[:, x : x + 1], upper[:, x : x + 1], low, high, now)[:, 0])
        if not len(active):
            continue
        visits += len(active)
        part = slice(ends[x - 1] if x else 0, ends[x])
        met = scores(queries[active], values[part])
        for row, q in zip(met, active, strict=True):
            mine = codes[part] == of[q]
            ok = (mine if same else ~mine) & (row >= best[q].kth)
            if windowed[q]:
                ok &= (row >= int(low[q])) & (row <= int(high[q]))
            if same:  # one row of the query's id, label and vector is its own
                own = [o for o in np.flatnonzero(ok & (ids[part] == q_ids[q])) if (values[part][o] == queries[q]).all()]
                ok[own[:1]] = False
            if ok.any():
                best[q].add(row[ok], ids[part][ok])
    return best, visits


def search(shelves: DataFrame, directory: dict[int, Directory], queries: DataFrame, *, k: int, same: bool, pack_rows: int = PACK_ROWS) -> DataFrame:
    """(q, rank, found, score) for queries (q, i, y, v, low, high): the best rows of the same label, or of others, with a score from low to high."""
    spark = shelves.sparkSession
    kind = "q long, i long, y string, v array<long>, low long, high long, dims int, list int"

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                if dims in directory:
                    _, upper = directory[dims].bounds(matrix(own["v"], dims))
                    yield own.assign(list=np.argmax(upper, axis=1).astype(np.int32))

    aimed, aimed_path = written(queries.where("low <= high").withColumn("dims", F.size("v")).mapInPandas(aim, kind), "negative-queries")
    packs = aimed.groupBy("dims", "list").agg(F.ceil(F.count("*") / pack_rows).cast("long").alias("packs"))
    n_packs = packs.agg(F.sum("packs")).first()[0] or 0
    n_shelves = max(1, sum(int((d.chunks[d.chunks > 1]).sum()) + len(np.unique(d.first[d.chunks == 1])) for d in directory.values()))
    lanes = max(1, min(n_packs, -(-LANES * spark.sparkContext.defaultParallelism // n_shelves)))
    numbered = aimed.join(F.broadcast(packs), ["dims", "list"]).withColumn("pack", F.pmod(F.xxhash64("q"), F.col("packs")))  # a row a list

    def packer(first: bool):
        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("q")
            dims, at = int(rows["dims"].iloc[0]), int(rows["list"].iloc[0])
            d, held = directory[dims], matrix(rows["v"], dims)
            low, high, kth = (rows[c].to_numpy(np.int64) for c in ("low", "high", "kth"))
            visited = set(range(int(d.first[at]), int(d.first[at] + d.chunks[at])))
            if first:
                shelves = visited
            else:
                needed = meeting(*d.bounds(held), low, high, kth).any(0)
                shelves = {s for x in np.flatnonzero(needed) for s in range(int(d.first[x]), int(d.first[x] + d.chunks[x]))} - visited
            lane = (at + int(rows["pack"].iloc[0])) % lanes
            return pd.DataFrame({"dims": [dims], "shelves": [sorted(shelves)], "lane": [lane], "qs": [rows["q"].to_numpy(np.int64).tobytes()], "q_ids": [rows["i"].to_numpy(np.int64).tobytes()], "ys": [list(rows["y"])],
                                 "low": [low.tobytes()], "high": [high.tobytes()], "kth": [kth.tobytes()], "values": [held.tobytes()]})

        return pack

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                long = lambda c: np.frombuffer(getattr(r, c), np.int64)  # noqa: B023, E731
                values = long("values").reshape(len(long("qs")), r.dims)
                best, _ = visit(r, directory[r.dims], values, list(r.ys), long("q_ids"), long("low"), long("high"), long("kth"), k=k, same=same)
                for q, b in zip(long("qs"), best, strict=True):
                    if any(not _LEAST <= x <= _MOST for x in b.scores):
                        raise OverflowError("a score does not fit 64 bits")
                    yield pd.DataFrame({"q": q, "found": b.ids, "score": b.scores.astype(np.int64)})

    names = ("qs", "q_ids", "ys", "low", "high", "kth", "values")

    def wave(first: bool, asked: DataFrame) -> DataFrame:
        packed = asked.groupBy("dims", "list", "pack").applyInPandas(packer(first), "dims int, shelves array<long>, lane int, qs binary, q_ids binary, ys array<string>, low binary, high binary, kth binary, values binary")
        spread = packed.select("dims", F.explode("shelves").alias("shelf"), "lane", *names)
        held = shelves.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        # fixed numbers of tasks: adaptive execution goes by bytes, but the work is in the pairs
        key, tasks = ("dims", "shelf", "lane"), 3 * n_shelves * lanes
        pairs = spread.repartition(tasks, *key).join(held.withColumnRenamed("labels", "codes").repartition(tasks, *key), [*key])
        return pairs.withColumnRenamed("codes", "labels").mapInPandas(meet, "q long, found long, score long")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "found")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near, near_path = written(top(wave(True, numbered.withColumn("kth", F.lit(_LEAST)))), "negative-first")
    reached = near.where(F.col("rank") == k).select(F.col("q").alias("of"), F.col("score").alias("kth"))
    asked = numbered.join(reached, F.col("q") == F.col("of"), "left").withColumn("kth", F.coalesce("kth", F.lit(_LEAST)))
    out, _ = written(top(near.drop("rank").unionByName(wave(False, asked))), "negative-found")
    delete(spark, aimed_path)
    delete(spark, near_path)
    return out.select("q", "rank", "found", "score")


def mine(
    vectors: DataFrame, anchors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW, shelf_rows: int = SHELF_ROWS, lists: int | None = None, pack_rows: int = PACK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` are rows of ``vectors``."""
    rows = _rows(vectors, vec_id, embedding, label, scale)
    shelves, directory = build_lists(rows, copies=max(positives + 1, negatives), shelf_rows=shelf_rows, lists=lists)
    asked, _ = written(_rows(anchors, vec_id, embedding, label, scale).withColumn("q", F.monotonically_increasing_id()), "negative-anchors")
    wide = (F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    best = search(shelves, directory, asked.select("q", "i", "y", "v", *wide), k=positives, same=True, pack_rows=pack_rows)
    best = best.select(F.col("q").alias("anchor"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = window
    left = F.pmod("positive_score", F.lit(100))
    whole = F.expr("(positive_score - pmod(positive_score, 100L)) div 100")  # percentages without products that overflow
    windows = best.select("anchor", "positive_score").distinct().join(asked, F.col("anchor") == F.col("q")).select(
        F.monotonically_increasing_id().alias("q"), "anchor", "positive_score", "i", "y", "v",
        (whole * low + F.ceil((left * low) / 100).cast("long")).alias("low"), (whole * high + F.floor((left * high) / 100).cast("long")).alias("high"),
    )
    windows, _ = written(windows, "negative-windows")
    found = search(shelves, directory, windows.select("q", "i", "y", "v", "low", "high"), k=negatives, same=False, pack_rows=pack_rows)
    named = found.select("q", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")).join(windows.select("q", "anchor", "positive_score", F.col("i").alias("anchor_id")), "q")
    return named.join(best, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
