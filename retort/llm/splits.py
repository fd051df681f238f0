"""Splits that keep related records together."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retort.functions.normal import author_key, structure
from retort.llm.unionfind import components
from retort.operators.skew import lookup
from retort.session import BROADCAST_ROWS, written

#: Groups of one size that are ranked together in one window partition at most.
RANKED = 50_000


def node_id(kind: str, value) -> F.Column:
    """A bigint for a tie value of one kind."""
    return F.xxhash64(F.lit(kind), value)


def related_groups(df: DataFrame, ties: dict[str, F.Column], id_col: str = "mol_id") -> DataFrame:
    """``(id, label, n, group_id)`` of every row: rows that share a tie value, directly or through others, share all three.

    ``ties`` maps a kind of tie to a column whose equal non-null values tie rows. n is the group's number of rows
    and group_id its smallest id. Repeated ids are rows of their own; a row without any tie value is a group of one.
    Null ids are kept (a group of null ids only has a null group_id). An empty table gives an empty result.

    The graph is one of tie values: rows only say which values occur together, so a value held by a third of all rows
    is one node and its rows are folded into distinct pairs before anything is shuffled by key.
    """
    kinds = list(ties)
    keyed = df.select(F.col(id_col).alias("id"), *[F.when(c.isNotNull(), node_id(k, c)).alias(f"_k{i}") for i, (k, c) in enumerate(ties.items())])
    held = [F.col(f"_k{i}") for i in range(len(kinds))]
    anchor = F.coalesce(*held)
    # A row without ties stands for itself, also where ids repeat or are null.
    keyed = written(keyed.withColumn("_anchor", F.coalesce(anchor, F.xxhash64(F.lit("row"), F.col("id"), F.monotonically_increasing_id()))), "keyed")
    pairs = keyed.filter(anchor.isNotNull()).select(F.explode(F.array(*[F.struct(F.col("_anchor").alias("a"), F.coalesce(h, F.col("_anchor")).alias("b")) for h in held])).alias("e")).select("e.*").distinct()
    labels = components(pairs)
    # Group sizes first, per anchor value, then per label: the rows themselves are never gathered.
    anchors = keyed.groupBy("_anchor").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    anchors = written(anchors.join(labels.select(F.col("node").alias("_anchor"), "label"), "_anchor", "left").withColumn("label", F.coalesce("label", "_anchor")), "anchors")
    groups = written(anchors.groupBy("label").agg(F.sum("n").alias("group_n"), F.min("least").alias("group_id"), F.count("*").alias("values")), "groups")
    total, rows = anchors.count(), groups.count()
    named = _named(anchors, groups, total, rows)
    rows_total, named_rows = keyed.count(), total
    out = lookup(keyed.select("id", "_anchor"), named, "_anchor", "hits", rows_total, named_rows)
    return out.select("id", "label", F.col("group_n").alias("n"), "group_id")


def _named(anchors: DataFrame, groups: DataFrame, total: int, rows: int) -> DataFrame:
    """Every anchor value with its group's size and smallest id, and the number of its own rows as ``hits``."""
    left = anchors.select("_anchor", "label", F.col("n").alias("hits"))
    return written(lookup(left, groups, "label", "values", total, rows).select("_anchor", "label", "hits", "group_n", "group_id"), "named")


def greedy_plan(sizes: list[tuple[int, int]], shares: list[tuple[str, float]]) -> list[tuple[int, list[int]]]:
    """Largest first, each group to the split furthest below its target: how many groups of each size every split gets.

    ``sizes`` holds (size, number of groups) - there are at most about sqrt(2 * rows) different sizes. Equal groups are handed out together: the first k of
    a size level the deficits like water, which is what giving them out one by one does. Ties go to the split named first.
    """
    total = sum(s * n for s, n in sizes)
    whole = sum(x for _, x in shares) or 1.0
    need = [total * x / whole for _, x in shares]
    out = []
    for size, n in sorted(sizes, reverse=True):
        got = [0] * len(shares)

        def given(level: float) -> list[int]:
            """Groups each split takes while its deficit is above the level."""
            return [max(0, -int((level - d) // size)) if d > level else 0 for d in need]

        if n > 64 * len(shares):
            low, high = min(need) - size * (n + 1), max(need)
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(given(mid)) > n else (low, mid)
            got = given(high)
            n_left = n - sum(got)
        else:
            n_left = n
        now = [d - g * size for d, g in zip(need, got, strict=True)]
        for _ in range(n_left):
            k = max(range(len(now)), key=lambda i: (now[i], -i))
            got[k] += 1
            now[k] -= size
        need = now
        out.append((size, got))
    return out


def assign_splits(groups: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """``related_groups`` rows with ``split_name``, whole groups only, near the shares.

    Group sizes are counted (a table of distinct sizes goes to the driver: at most sqrt(2 * rows) of them), the greedy rule is run on the counts, and the
    groups of one size are ranked - by a hash, in blocks of about RANKED, with the blocks' offsets added - to take their places. No shares: no splits (null).
    """
    spark = groups.sparkSession
    groups = written(groups, "rows")
    label = groups.groupBy("label").agg(F.first("n").alias("n"))
    label = written(label, "labels")
    sizes = [(r[0], r[1]) for r in label.groupBy("n").count().collect()]
    if not shares or not sizes:
        return groups.withColumn("split_name", F.lit(None).cast("string"))
    plan = greedy_plan(sizes, shares)
    count = dict(sizes)
    cuts = spark.createDataFrame([(s, -(-count[s] // RANKED), [sum(got[: k + 1]) for k in range(len(got))]) for s, got in plan], "n bigint, parts bigint, upto array<bigint>")
    # At most sqrt(2 * rows) rows: 140,000 for ten thousand million records.
    placed = label.join(F.broadcast(cuts), "n").withColumn("part", F.pmod(F.xxhash64("label"), F.col("parts")))
    per = placed.groupBy("n", "part").agg(F.count("*").alias("held"))
    offsets = per.withColumn("offset", F.sum("held").over(W.partitionBy("n").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("n", "part", F.coalesce("offset", F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("n", "part").orderBy(F.xxhash64("label", F.lit(1)), "label"))
    placed = placed.withColumn("rank", rank).join(offsets, ["n", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    names = F.array(*[F.lit(name) for name, _ in shares])
    placed = placed.select("label", F.get(names, F.size(F.filter("upto", lambda u: u < F.col("rank")))).alias("split_name"), F.col("n").alias("held"))
    placed = written(placed, "placed")
    return lookup(groups, placed, "label", "held", groups.count(), placed.count()).select(*groups.columns, "split_name")


def achieved_shares(placed: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """``(split_name, target_share, rows, groups, share)``: what ``assign_splits`` made of the shares; a split without rows has zeros. Shares are null where there are no rows at all."""
    spark = placed.sparkSession
    # Groups are counted by label first, so that a split of most rows is no single group of the count.
    held = placed.groupBy("split_name", "label").agg(F.count("*").alias("n")).groupBy("split_name").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    whole = sum(x for _, x in shares) or 1.0
    wanted = spark.createDataFrame([(name, x / whole) for name, x in shares], "split_name string, target_share double")
    out = wanted.join(held, "split_name", "left").select("split_name", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("groups", F.lit(0)).alias("groups"))
    total = out.agg(F.sum("rows")).first()[0]
    return out.withColumn("share", F.col("rows") / F.lit(total or None))


def molecule_ties(df: DataFrame) -> dict[str, F.Column]:
    """Author and structure, as text that is equal exactly if they are the same."""
    parts = F.sort_array(structure(F.col("smiles")))
    return {"structure": F.array_join(parts, "."), "author": F.array_join(author_key(F.col("author")), " ")}


def split_shares(plan: DataFrame) -> list[tuple[str, float]]:
    """Rows of a split plan, by name; null shares count as 0. The plan is bounded: more than a thousand splits are refused."""
    rows = plan.select("split_name", "share").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a split plan holds at most 1000 splits")
    return sorted(((r[0], float(r[1] or 0)) for r in rows), key=lambda r: -r[1])
