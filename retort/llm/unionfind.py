"""Connected components by distributed union-find.

Every partition turns its edges into a local forest (one row per node and
partition at most, so no key can collect more rows than there are partitions).
A node found in several forests ties their roots; those ties are the edges of
the next, smaller level, with fewer partitions, until a level is small enough -
by count - for one forest. Where a level doesn't shrink, nodes are paired off at
random first (each coin-flip loser joins its smallest winning neighbour), which
takes out a constant share of the nodes whatever the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.skew import lookup
from retort.session import written

#: Edges one local forest may hold (16 bytes each, about 200 MB of working memory).
FOREST_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (a, b): all nodes and for each the smallest node of its tree."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(ends[:n].tolist(), ends[n:].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    top = np.array(up, np.int64)
    while True:  # every jump doubles the reach
        further = top[top]
        if np.array_equal(further, top):
            return nodes, nodes[top]
        top = further


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to (node, root) rows; a long partition is folded into its forest now and then.

    It is folded when the edges read since the last fold exceed both FOREST_EDGES and the nodes the forest has: every edge then pays for a bounded number of
    nodes, so the work stays in proportion to the edges, and what is held to the edges and nodes of one partition's forest.
    """
    held, fresh, nodes_held = [], 0, 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        fresh += batch.num_rows
        if fresh > max(FOREST_EDGES, nodes_held):
            held = [fold()]
            fresh, nodes_held = 0, len(held[0][0])
    if held:
        nodes, top = fold()
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(top[k : k + 100_000])], ["node", "root"])


def _relabel(edges: DataFrame, to: DataFrame, total: int) -> DataFrame:
    """Edges with both ends replaced by what ``to`` (node, target, n) says, loops and repeats dropped."""
    for end in ("a", "b"):
        edges = lookup(edges, to.withColumnRenamed("node", end), end, "n", total).withColumn(end, F.coalesce("target", end)).select("a", "b")
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pair_off(edges: DataFrame, level: int, count: int) -> tuple[DataFrame, DataFrame]:
    """One coin-flip contraction: where each loser went (node, label), and the remaining edges."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2)) == 1
    moves = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.when(~coin("a") & coin("b"), F.col("b"))).alias("target"), F.count("*").alias("n")).filter("target is not null"), "moves")
    return moves.select("node", F.col("target").alias("label")), written(_relabel(edges, moves, 2 * count), "edges")


def components(edges: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """(a, b) bigint edges to (node, label): the label is the same for all nodes of a component.

    Loops tie nothing but keep their node; null ends are ignored. An empty table has no nodes.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    partitions = None
    levels: list[tuple[DataFrame, bool]] = []
    before = None
    while True:
        edges = edges.repartition(partitions, F.col("a")) if partitions else edges
        forest = written(edges.mapInArrow(_forest, "node bigint, root bigint"), "forest")
        label = forest.groupBy("node").agg(F.min("root").alias("label"))
        levels.append((label, False))
        if partitions == 1:
            break
        # As many rows per node as there were partitions at most: no hot key, whatever the degrees were.
        ties = forest.join(label, "node").filter("root <> label").select(F.col("label").alias("a"), F.col("root").alias("b")).distinct()
        edges = written(ties, "ties")
        count = edges.count()
        if count == 0:
            break
        if count > forest_edges and before is not None and count > before // 2:
            moved, edges = _pair_off(edges, len(levels), count)
            levels.append((moved, True))
            count = edges.count()
            if count == 0:
                break
        before = count
        partitions = -(-count // forest_edges)
    # From the coarsest level down: a node's label is what the next levels made of its label there.
    final, _ = levels.pop()
    while levels:
        finer, partial = levels.pop()
        resolved = _resolve(finer, final)
        # Nodes that were paired off are no longer in the coarser levels, and the others are only there.
        final = written(resolved.unionAll(final) if partial else resolved, "labels")
    return final


def _resolve(finer: DataFrame, coarser: DataFrame) -> DataFrame:
    """Labels of ``finer`` looked up in ``coarser``; a label it doesn't know stays."""
    size = written(finer.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("n")).join(coarser.select(F.col("node").alias("key"), F.col("label").alias("top")), "key"), "tops")
    total, rows = finer.count(), size.count()
    out = lookup(finer.withColumnRenamed("label", "key"), size, "key", "n", total, rows)
    known = out.select("node", F.coalesce("top", "key").alias("label"))
    return known
