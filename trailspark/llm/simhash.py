"""SimHash near-duplicates by covering locality-sensitive hashing.

*Fingerprint.*  Words are runs of anything but ASCII blanks in the text with
A-Z lower-cased; shingles are ``size`` successive words, repeats included (a
shorter text is one shingle).  Bit ``b`` is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).  A text without words has fingerprint zero.

*Covering tables.*  Every bit position gets a nonzero vector of ``radius + 1``
bits.  For each nonzero vector ``v`` a table masks the fingerprints with the
positions whose vector has an odd product with ``v``.  ``radius`` differing
positions span at most ``radius`` dimensions, so some ``v`` is orthogonal to
all of them and its table keeps none of them: every pair within the radius
collides in some table.  There is no probability of a miss.

*Linking.*  Equal fingerprints are one node, so copies cost nothing.  Buckets
are compared by shifted rows of a sorted partition.  A bucket of more than
``bucket`` distinct fingerprints is covered again on the bits its mask left
free, which halves the free bits and keeps the guarantee; after three levels a
bucket cannot hold more than a few hundred.  Only the links that join two parts
of a bucket are emitted.

*Components.*  Links are contracted by alternating large-star and small-star
rounds on written tables until nothing changes; no task and no driver holds a
component.

Defined cases: null and wordless texts have fingerprint zero and are linked
like any other; repeated rows each keep a row; the component is the smallest
non-null id reachable (null if a component has none); an empty table has no
fingerprints; texts of any length are read whole, shingles in slices.  Columns of
the documents are kept by ``fingerprints`` and ``keep_first``, whatever their
names (``into`` replaces one of that name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm import shingles
from trailspark.llm.common import BROADCAST_BYTES, delete, short_batches, spare_name, written

SHINGLE = 3
RADIUS = 3
BITS = 64
SEED = 42
#: Distinct fingerprints that a bucket may hold before it is covered again.
BUCKET = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(join(words[i : i + size]), SEED) for i in range(at, min(n, at + (1 << 16)))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text: str = "text", size: int = SHINGLE, into: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(into, compute(F.col(text)))


def covering_masks(positions: list[int], radius: int = RADIUS, level: int = 0) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are all left out by some mask."""
    vectors = (1 << (radius + 1)) - 1
    order = np.random.default_rng(1000 + level).permutation(positions)
    vector = {int(p): i % vectors + 1 for i, p in enumerate(order)}
    return [sum(1 << p for p, m in vector.items() if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cover(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """``rows`` (table, fp) dealt again to the tables of the bits that each row's table left free.

    ``table`` is the mask of the bits that the rows of a bucket share.
    """
    tables = [r.table for r in rows.select("table").distinct().collect()]  # at most 15 ** level masks
    full = (1 << BITS) - 1
    finer = {}
    for t in tables:
        shared = t & full
        free = [i for i in range(BITS) if not shared >> i & 1]
        finer[t] = [_signed(shared | m) for m in covering_masks(free, radius, level)]
    if not finer:
        return rows
    choice = F.create_map(*(x for t, ms in finer.items() for x in (F.lit(t), F.array(*(F.lit(m) for m in ms)))))
    return rows.select(F.explode(F.element_at(choice, F.col("table"))).alias("table"), "fp")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.col("fp").bitwiseAND(F.col("table")))


def _links_in(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Joining links of each bucket; the rows come sorted by bucket, which may go over the end of a batch."""
    held: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        table, key = rows["table"].to_numpy(), rows["key"].to_numpy()
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        n = len(fp)
        new = np.ones(n, bool)
        new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        ends = np.repeat(starts + sizes, sizes)
        left, right = [], []
        label = np.arange(n)

        def root(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        live = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = 1
        while len(live := live[live + step < ends[live]]):
            other = live + step
            near = np.bitwise_count(fp[live] ^ fp[other]) <= radius
            a, b = live[near], other[near]
            apart = label[a] != label[b]
            for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    left.append(i)
                    right.append(j)
            step += 1
            if step % 16 == 0:
                while (label[label] != label).any():
                    label = label[label]
        fp = fp.view(np.int64)
        return pd.DataFrame({"a": fp[left], "b": fp[right]}) if left else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    for rows in batches:
        if not len(rows):
            continue
        last = (rows["table"].iloc[-1], rows["key"].iloc[-1])
        open_ = ((rows["table"] == last[0]) & (rows["key"] == last[1])).to_numpy()
        if not open_.all():
            yield solve(pd.concat([*held, rows[~open_]]))
            held = []
        held.append(rows[open_])
    if held:
        yield solve(pd.concat(held))


def links(nodes: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``radius``, and the paths of helper tables."""
    out, paths = None, []
    masks = [_signed(m) for m in covering_masks(list(range(BITS)), radius)]
    rows = nodes.select(F.explode(F.array(*(F.lit(m) for m in masks))).alias("table"), "fp")
    for level in range(1, 5):
        rows = _bucketed(rows)
        sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        large, path = written(sizes.select("table", "key"), "hot-buckets")
        paths.append(path)
        hot = level < 4 and not large.isEmpty()
        small = rows.join(large, ["table", "key"], "left_anti") if hot else rows
        dealt = small.repartition("table", "key").sortWithinPartitions("table", "key", "fp")
        found = dealt.select("table", "key", "fp").mapInPandas(lambda it, r=radius: _links_in(it, r), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not hot:
            break
        rows = _cover(rows.join(large, ["table", "key"], "left_semi").select("table", "fp"), radius, level).distinct()
    return out.distinct(), paths


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node with a link; the root is the smallest node reachable."""
    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    spark = edges.sparkSession
    before = None
    while True:  # a round shortens every path, so it settles
        # large-star: larger neighbours go to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the node and its smaller neighbours go to the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after, new = written(small.where("u <> v").distinct(), "links")
        delete(spark, path)
        path, now = new, after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path


def _with_alike(docs: DataFrame, marked: DataFrame, edges: DataFrame, similarity: float) -> tuple[DataFrame, list[str]]:
    """(node, root) as of ``components``, where fingerprints of texts alike are linked too, and the paths of helper tables."""
    edges, path = written(edges, "near")
    paths = [path]
    by_node = marked.select("node", "fp").dropDuplicates(["node"])

    def add(pairs: DataFrame) -> None:
        nonlocal edges
        found, more = shingles.alike(pairs, docs, text="text", similarity=similarity)
        end = lambda c: by_node.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}"))
        linked = found.join(end("a"), "a").join(end("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
        linked, path = written(linked.where("a <> b").distinct(), "alike")
        edges = edges.unionByName(linked)
        paths.extend([*more, path])

    rows = shingles.buckets(marked)
    add(shingles.candidates(rows, similarity=similarity))
    member, member_path = components(edges)
    large, path = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > shingles.SMALL).select("bucket"), "large-buckets")
    paths.append(path)
    if not large.isEmpty():
        held = rows.join(large, "bucket", "left_semi")
        roots = member.select(F.col("node").alias("part"), "root")
        held = held.join(roots, "part", "left").select("bucket", "node", F.coalesce("root", "part").alias("part"), "n")
        pairs, more = shingles.across(held, docs, text="text", similarity=similarity)
        paths += more
        add(pairs)
        delete(member.sparkSession, member_path)
        member, _ = components(edges)
    return member, paths


def _grouped(docs: DataFrame, doc_id: str, text: str, size: int, radius: int, bucket: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, fp) of every row, where ``node`` is a hash of the text, and (fp, least, root) of every fingerprint."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = fingerprints(docs.withColumn("node", F.xxhash64("text")), size=size)
    marked, _ = written((shingles.banded(marked) if similarity else marked).drop("text"), "fingerprints")
    nodes, nodes_path = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges, helpers = links(nodes.select("fp"), radius=radius, bucket=bucket)
    if similarity:
        member, more = _with_alike(docs, marked, edges, similarity)
        helpers += more
    else:
        member, _ = components(edges)
    for path in helpers:
        delete(spark, path)
    roots = nodes.join(member, nodes.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return marked.select("doc_id", "node", "fp"), roots


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row of ``docs``.

    With ``similarity``, texts whose sets of shingles reach it (see ``shingles``) are linked as well.
    """
    marked, roots = _grouped(docs, doc_id, text, size, radius, bucket, similarity)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET, similarity: float | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One document of each group: the one with the smallest id, null last; of texts that share it, the one of the smallest hash.

    A document is known by its id and its text, so texts of other groups that share
    its id stay; of rows equal in both, one stays.  Only the (id, hash) of documents
    that go or repeat are looked up: they are broadcast under ``broadcast_bytes``,
    so that texts need no shuffle, and joined by a shuffle beyond it.
    """
    marked, roots = _grouped(docs, doc_id, text, size, radius, bucket, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "node")
    of_fp = marked.groupBy("fp").agg(F.min(order).alias("first")).join(roots.select("fp", "root"), "fp")
    first = of_fp.select("fp", "root").join(of_fp.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "first")
    held = marked.groupBy("doc_id", "node", "fp").agg(F.count("*").alias("n")).join(first, "fp").select("doc_id", "node", "n", order.eqNullSafe(F.col("first")).alias("stays"))
    i, h, stays, own = (spare_name(docs, x) for x in ("gone_id", "gone_hash", "stays", "own_hash"))
    decided, _ = written(held.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias(i), F.col("node").alias(h), F.col("stays").alias(stays)), "decided")
    bytes_, repeated = decided.agg(F.sum(F.coalesce(F.octet_length(F.col(i).cast("string")), F.lit(0)) + 72), F.count_if(stays)).first()
    decided = F.broadcast(decided) if (bytes_ or 0) <= broadcast_bytes else decided
    hashed = docs.withColumn(own, F.xxhash64(text))
    same = (F.col(own) == F.col(h)) & F.col(doc_id).eqNullSafe(F.col(i))
    out = hashed.join(decided, same, "left_anti")
    if repeated:
        again = hashed.join(decided.where(stays), same, "left_semi")
        out = out.unionByName(again.dropDuplicates([doc_id, own]))
    return out.drop(own)
