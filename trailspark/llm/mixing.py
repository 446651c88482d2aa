"""Mixing sources to target weights by fixed blocks, multinomial shards and index permutations.

*Targets.*  Sources in code-point order, null last, weigh 1, 2, 3, repeating,
and share the words of all documents.  A target stops at ``most`` times its
source's size; the excess is shared again by weight until none is above.

*Blocks.*  A source's words, document by document, are one stream cut every
``block_words`` words.  Streams are laid out by distributed prefix sums: rows are
dealt by a hash of the document id (without one, of the text) to about the square root of their number of
buckets, running sums are taken within a bucket and bucket totals are added, so
no task sees a whole source.

*Shards.*  A source gets the slots nearest its target.  Each output shard of
``shard_slots`` slots draws multinomial counts from the slots that remain (never
more than remain), so the counts vary between shards while the totals are exact.
Beyond ``GROUPS`` shards, groups of shards draw first, and a task then draws the
shards of its group one after the other, so no plan of all shards is held anywhere.

*Slots.*  Slot ``j`` of a source is block ``perm(j mod blocks)`` of pass
``j div blocks``, where ``perm`` is a keyed Feistel permutation of the block
numbers, another for every pass; no block is used more than ``most`` times.
Slots and blocks meet by an equi-join on (source, block).

All draws depend on the seed, the sizes and the ids only, so reruns agree.

Defined cases: null or wordless texts have size 0 and take nothing; a null
source is a source, the last; rows with equal ids, source and size are
interchangeable; an empty table mixes nothing; texts of any length are counted and
cut whole.  Sources are planned on the driver, so more than ``MAX_SOURCES`` are an
error.  Only the three columns named are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import BLANK, written

BLOCK_WORDS = 128
MOST = 3
WEIGHTS = (1, 2, 3)
SHARD_SLOTS = 1 << 14
#: Most groups of shards, and most counts in the plan of the groups.
GROUPS = 4096
MAX_COUNTS = 1 << 22
MAX_SOURCES = 100_000
SEED = 20240601


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Words of each source by weight, none above ``most`` times its size."""
    out: list[Fraction | None] = [None] * len(sizes)
    left, open_ = Fraction(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in above)
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return out


def draw(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of ``size`` slots from those ``left``, never more than are left."""
    drawn, want = np.zeros_like(left), min(size, int(left.sum()))
    while want:
        open_ = left - drawn
        take = np.minimum(rng.multinomial(want, open_ / open_.sum()), open_)
        drawn += take
        want -= int(take.sum())
    return drawn


def draw_all(slots: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Counts of one shard after the other, which add up to ``slots``."""
    left = slots.astype(np.int64).copy()
    while left.any():
        drawn = draw(left, size, rng)
        left -= drawn
        yield drawn


def plan_groups(slots: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, int]:
    """Counts [group, source], and the shards of a group."""
    shards = -(-int(slots.sum()) // shard_slots)
    most = max(1, min(GROUPS, MAX_COUNTS // max(1, len(slots))))
    each = max(1, -(-shards // most))
    found = list(draw_all(slots, each * shard_slots, np.random.default_rng(seed)))
    return np.array(found, np.int64).reshape(len(found), len(slots)), each


def _hash(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: Feistel rounds, walked again while outside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (_hash(right, key * 1_000_003 + r) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``rows``: the documents' ids, sizes and places; ``pieces``: their parts in blocks; ``slots``: the mix; ``sources``: sizes and targets."""

    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame
    sources: DataFrame
    block_words: int = BLOCK_WORDS


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", block_words: int = BLOCK_WORDS, most: int = MOST, weights=WEIGHTS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, with_text: bool = False) -> Mix:
    spark = docs.sparkSession
    salt = F.when(F.col(doc_id).isNull(), F.xxhash64(text))  # null, which a hash passes over, for rows with an id
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), salt.alias("salt")]
    n_rows = docs.count()  # reads no column
    buckets = max(1, int(np.sqrt(n_rows)))
    dealt = docs.select(*columns, *([F.col(text).alias("text")] if with_text else []))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed), "salt"), F.lit(buckets)).cast("int")).drop("salt")
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size")
    before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1))
    placed, _ = written(dealt.withColumn("rn", F.row_number().over(within)).withColumn("start", F.coalesce(before, F.lit(0))), "places")
    found = placed.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    # by the mean words of the source's blocks, as the last one may be short
    wanted = np.array([min(round(g * int(b) / s), int(b) * most) if s else 0 for g, b, s in zip(goals, blocks, sizes, strict=True)], np.int64)
    groups, each = plan_groups(wanted, shard_slots, seed)
    planned = [(i, r.source, sizes[i], float(goals[i])) for i, r in enumerate(found)]
    sources = spark.createDataFrame(planned, "source_ix int, source string, source_size long, target double")

    named = sources.select("source_ix", F.col("source").alias("s"))
    placed = placed.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    ends = placed.groupBy("source_ix", "bucket").agg(F.sum("size").alias("n"))
    base = F.sum("n").over(Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("source_ix", "bucket", F.coalesce(base, F.lit(0)).alias("base"))
    rows = placed.join(bases, ["source_ix", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    from_ = F.greatest(F.col("start"), F.col("block") * block_words)
    to = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.withColumn("first_word", from_ - F.col("start")).withColumn("n_words", to - from_)

    held = spark.sparkContext.broadcast((groups, blocks))  # at most MAX_COUNTS counts

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, blocks = held.value
        for batch in batches:
            for group in batch["id"]:
                start = groups[:group].sum(0)
                shards = [groups[group]] if each == 1 else draw_all(groups[group], shard_slots, np.random.default_rng([seed, int(group)]))
                for i, counts in enumerate(shards):
                    shard, total, at = int(group) * each + i, int(counts.sum()), 0
                    for s in np.flatnonzero(counts):
                        for lo in range(0, int(counts[s]), 1 << 16):
                            j = start[s] + np.arange(lo, min(int(counts[s]), lo + (1 << 16)))
                            passes, b = j // blocks[s], np.empty_like(j)
                            for p in np.unique(passes):
                                b[passes == p] = permute(j[passes == p] % blocks[s], int(blocks[s]), seed + 31 * int(s) + 7919 * int(p))
                            place = permute(np.arange(at, at + len(j)), total, seed ^ (shard + 1))
                            at += len(j)
                            yield pd.DataFrame({"shard": shard, "slot": place, "source_ix": s, "block": b})
                    start = start + counts

    slots = spark.range(0, len(groups), 1, max(1, len(groups))).mapInPandas(fill, "shard long, slot long, source_ix int, block long")
    return Mix(rows, pieces, slots, sources, block_words)


def taken(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    # the planner takes the slots for as few as the shards they come from, and would broadcast them
    used = mixed.slots.groupBy("source_ix", "block").agg(F.count("*").alias("times"))
    key = ["source_ix", "bucket", "rn"]
    words = mixed.pieces.select(*key, "block", "n_words").join(used.hint("merge"), ["source_ix", "block"])
    sums = words.groupBy(*key).agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    rows = mixed.rows.select(*key, "doc_id", "size").join(sums, key, "left")
    whole = rows.join(F.broadcast(mixed.sources.drop("source")), "source_ix")
    return whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def packed(mixed: Mix) -> DataFrame:
    """The mixed blocks themselves: shard, slot, source_ix, block, doc_ids, text (needs ``with_text``)."""

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts in batches:
            out = []
            for text, start in zip(texts, starts, strict=True):
                words, parts, at = text.encode("utf-8", "surrogatepass").split(), [], 0
                while at < len(words):
                    block, to = (start + at) // block_words, (start + at) // block_words * block_words + block_words - start
                    parts.append({"block": block, "part": b" ".join(words[at:to]).decode("utf-8", "surrogatepass")})
                    at = to
                out.append(parts)
            yield pd.Series(out)

    block_words = mixed.block_words
    parts = F.explode(F.pandas_udf(cut, "array<struct<block:long,part:string>>")("text", "start")).alias("p")
    parts = mixed.rows.where("size > 0").select("source_ix", "start", "doc_id", parts).select("source_ix", "start", "doc_id", "p.*")
    in_order = F.array_sort(F.collect_list(F.struct("start", "doc_id", "part"))).alias("parts")  # at most a block's words
    blocks = parts.groupBy("source_ix", "block").agg(in_order)
    return mixed.slots.hint("merge").join(blocks, ["source_ix", "block"]).select(
        "shard", "slot", "source_ix", "block", F.col("parts.doc_id").alias("doc_ids"), F.array_join(F.col("parts.part"), " ").alias("text")
    )
