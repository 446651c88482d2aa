"""Root-to-leaf paths of forests given by parent links, by pointer jumping.

Each round doubles the reach of every node's pointer to an ancestor, by a join of
the pointers with themselves, and joins the paths found so far with the pointers,
so a forest of depth ``d`` takes about ``log2(d)`` rounds whatever its shape.  Rows
are keyed by (tree, node): a tree with a third of all nodes is spread like the
others, and a node that many paths share is a skewed join, which adaptive
execution splits.  A round depends on written tables only.  Every join shuffles both
its sides and hashes the one with unique keys: files of pointers are small for the
rows they hold, so a broadcast chosen by size would send the tree through the driver.

Defined cases: a node without a parent is a root; a parent that is not a node of
the tree, a node given twice and a cycle of links are errors; a single node is a
path; null trees are a tree of their own; a null node is an error; an empty table
has no paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.session import cut


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _checked(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The links, after an error for a node twice or a parent that is no node."""
    # a node's own rows and its children's links meet, so each link is looked up where its parent is counted
    own = nodes.select(*keys, F.col("n").alias("at"), F.lit(1).alias("is_node"))
    links = nodes.where("p IS NOT NULL").select(*keys, F.col("p").alias("at"), F.lit(0).alias("is_node"))
    met = own.unionByName(links).groupBy(*keys, "at").agg(F.sum("is_node").alias("given"))
    bad = met.where("given <> 1 OR at IS NULL").orderBy("at").select("at", "given").limit(1).collect()
    if bad:
        raise ValueError(f"node {bad[0].at} is given {bad[0].given} times" if bad[0].given else f"parent {bad[0].at} is no node of its tree")
    return nodes


def branch_paths(nodes: DataFrame, keys: list[str], *, node: str = "node", parent: str = "parent") -> DataFrame:
    """(keys, leaf, place, node): the nodes from the root, at place 0, to each leaf."""
    rows = cut(nodes.select(*keys, F.col(node).cast("long").alias("n"), F.col(parent).cast("long").alias("p")))
    total = _checked(rows, keys).count()
    jump = rows.where("p IS NOT NULL").select(*keys, "n", F.col("p").alias("up"))
    inner = jump.select(*keys, "up").distinct()
    leaves = rows.alias("a").join(inner.hint("shuffle_hash").alias("b"), _same(keys, "a", "b") & (F.col("a.n") == F.col("b.up")), "left_anti")
    pieces = [cut(leaves.select(*keys, F.col("n").alias("leaf"), F.lit(0).cast("long").alias("up_by"), "n"))]
    reach = 1
    while not jump.isEmpty():
        if reach >= 2 * max(1, total):
            raise ValueError("parent links form a cycle")
        so_far = reduce(DataFrame.unionByName, pieces).alias("a")
        # paths of fewer than ``reach`` nodes from the leaf, each lifted by ``reach``
        lifted = so_far.join(jump.hint("shuffle_hash").alias("b"), _same(keys, "a", "b") & (F.col("a.n") == F.col("b.n")))
        pieces.append(cut(lifted.select(*(F.col(f"a.{k}").alias(k) for k in keys), "a.leaf", (F.col("a.up_by") + reach).alias("up_by"), F.col("b.up").alias("n"))))
        twice = jump.alias("a").join(jump.hint("shuffle_hash").alias("b"), _same(keys, "a", "b") & (F.col("a.up") == F.col("b.n")))
        jump = cut(twice.select(*(F.col(f"a.{k}").alias(k) for k in keys), "a.n", "b.up"))
        reach *= 2
    if total and pieces[0].isEmpty():
        raise ValueError("parent links form a cycle")
    found = reduce(DataFrame.unionByName, pieces)
    of_leaf = Window.partitionBy(*keys, "leaf")
    return found.select(*keys, "leaf", (F.max("up_by").over(of_leaf) - F.col("up_by")).cast("int").alias("place"), F.col("n").alias("node"))


def trainable(paths: DataFrame, nodes: DataFrame, keys: list[str], sampled: str = "sampled") -> DataFrame:
    """``paths`` that have a sampled node, with ``branch``, their number in their tree by leaf; ``nodes`` has keys, node and ``sampled``."""
    marked = paths.alias("a").join(nodes.select(*keys, "node", F.col(sampled).alias("was_sampled")).hint("shuffle_hash").alias("b"), _same([*keys, "node"], "a", "b"))
    own = marked.select(*(F.col(f"a.{k}").alias(k) for k in keys), "leaf", "was_sampled").groupBy(*keys, "leaf").agg(F.coalesce(F.bool_or("was_sampled"), F.lit(False)).alias("any"))
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("leaf")) - 1).alias("branch")
    chosen = own.where("any").select(*keys, "leaf", number)
    return paths.alias("a").join(chosen.hint("shuffle_hash").alias("b"), _same([*keys, "leaf"], "a", "b")).select("a.*", "b.branch")
