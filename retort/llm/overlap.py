"""All similar pairs between set-valued records, by the size-aware overlap join.

Jaccard similarity t of sets of sizes a and b means an overlap of at least
``need(a, b) = ceil(t (a + b) / (1 + t))``. Small sets enumerate, for every
partner size that can reach t, their subsets of exactly that many tokens: two
small sets share such a subset exactly if they are similar. Pairs with a large
set come from inverted lists, of which only each set's rarest tokens - its
prefix, long enough that similar sets must meet there - need be scanned. The
union is filtered by the final similarity.

The join runs on distinct sets (classes); rows with the same set are members of
one class and are joined only where a query's result asks for single rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions.normal import structure
from retort.operators.skew import lookup, meet
from retort.session import written

#: Sets of up to this many tokens are small: the most subsets one enumerates is about 60.
SMALL = 6


def need(a: int, b: int, t: Fraction) -> int:
    """The overlap at which sets of sizes a and b have similarity t."""
    return ceil(t * (a + b) / (1 + t))


def partners(a: int, t: Fraction, least: int) -> range:
    """Sizes b >= least that a set of size a can be similar to."""
    return range(max(least, ceil(t * a)), int(a / t) + 1)


def _subsets(t: Fraction, least: int, small: int):
    """Rows (set_id, tokens) to (set_id, lo, hi, key): all overlap-sized subsets, for every small partner size."""

    def make(batches):
        for batch in batches:
            ids, out = batch.column("set_id").to_pylist(), ([], [], [])
            for i, tokens in zip(ids, batch.column("tokens").to_pylist(), strict=True):
                size = len(tokens)
                for b in partners(size, t, least):
                    if b <= small:
                        for subset in combinations(tokens, need(size, b, t)):
                            out[0].append(i)
                            out[1].append(min(size, b) * 65536 + max(size, b))
                            out[2].append(list(subset))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))], ["set_id", "sizes", "subset"])

    return make


def similar_classes(sets: DataFrame, threshold: float = 0.6, least: int = 3, small: int = SMALL) -> DataFrame:
    """``(a, b, common, similarity)`` for all pairs a < b of distinct sets with Jaccard similarity at least ``threshold``.

    ``sets`` as ``distinct_sets`` gives it. Sets below ``least`` tokens take part in no pair. For two tables, give the union of their sets and keep the pairs
    whose classes have members in both.
    """
    t = Fraction(str(threshold))
    sets = sets.filter(F.size("tokens") >= least)
    n = F.size("tokens")
    # The small half: sharing a subset of the needed size is being similar, so every match is a result.
    subsets = sets.filter(n <= small).select("set_id", "tokens").mapInArrow(_subsets(t, least, small), "set_id bigint, sizes int, subset array<bigint>")
    subsets = written(subsets.select("set_id", F.struct(F.xxhash64("sizes", "subset").alias("h"), F.xxhash64("subset", "sizes").alias("i")).alias("key")), "subsets")
    near = meet(subsets, subsets, "key").filter("x.set_id < y.set_id").select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))
    # The large half: the inverted lists of prefix tokens, scanned for the large sets.
    prefix = n - F.ceil(n * F.lit(float(t))).cast("int") + 1
    # Small sets that no large one can be similar to are in no list.
    listed = sets.filter(n * t.denominator >= (small + 1) * t.numerator)
    lists = written(listed.select("set_id", n.alias("n"), F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "token")), "lists")
    x, y = F.col("x"), F.col("y")
    sizes_ok = (x["n"] * t.denominator >= y["n"] * t.numerator) & (y["n"] * t.denominator >= x["n"] * t.numerator)
    # What can still be shared from the two positions on bounds the overlap; the first shared token of a similar pair passes.
    reach = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) * (t.numerator + t.denominator) >= (x["n"] + y["n"]) * t.numerator
    once = (y["n"] <= small) | (x["set_id"] < y["set_id"])
    far = meet(lists.filter(F.col("n") > small), lists, "token").filter((x["set_id"] != y["set_id"]) & once & sizes_ok & reach)
    far = far.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))
    pairs = near.unionAll(far).distinct()
    both = pairs
    for end in ("a", "b"):
        both = both.join(sets.select(F.col("set_id").alias(end), F.col("items").alias(f"items_{end}")), end)
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    kept = both.select("a", "b", common.alias("common"), union.alias("union")).filter(F.col("common") * t.denominator >= F.col("union") * t.numerator)
    return kept.select("a", "b", "common", (F.col("common") / F.col("union")).alias("similarity"))


def distinct_sets(df: DataFrame, tokens: F.Column, id_col: str = "mol_id", least: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(sets, members)``: the distinct sets as (set_id, items, tokens, n), and the rows as (id, set_id).

    A row whose set is null or has fewer than ``least`` distinct values is in neither; null values don't count, nor do rows with a null id. Ids must be unique;
    set_id is the smallest id of the n rows that hold the set. tokens are 64-bit hashes of the items, rarest item first; results are filtered by the items themselves.
    """
    rows = df.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))).alias("items"))
    rows = written(rows.filter((F.size("items") >= least) & F.col("id").isNotNull()).withColumn("key", F.array_join("items", "\0")), "rows")
    sets = written(rows.groupBy("key").agg(F.min("id").alias("set_id"), F.count("*").alias("n"), F.first("items").alias("items")), "sets")
    listed = sets.select("set_id", F.explode("items").alias("item"))
    freq = written(listed.groupBy("item").agg(F.count("*").alias("held")), "items")
    total = listed.count()
    ranked = lookup(listed, freq, "item", "held", total, freq.count())
    ranked = ranked.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("held", "item"))).alias("ranked"))
    ranked = ranked.select("set_id", F.transform("ranked", lambda r: F.xxhash64(r["item"])).alias("tokens"))
    out = written(sets.join(ranked, "set_id").select("set_id", "items", "tokens", "n"), "token_sets")
    members = lookup(rows.select("id", "key"), sets.select("key", "set_id", "n"), "key", "n", rows.count(), sets.count())
    return out, written(members.select("id", "set_id"), "members")


def similar_rows(sets: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: the pairs of classes as pairs of rows, with all pairs within a class."""
    pairs = written(pairs, "pairs")
    x, y = F.col("x"), F.col("y")
    # Classes of one member, most of them, are that member: only larger ones are expanded.
    several = written(members.join(sets.filter("n > 1").select("set_id"), "set_id"), "several")
    inside = meet(several, several, "set_id").filter("x.id < y.id").select(x["id"].alias("id_a"), y["id"].alias("id_b"))
    single = sets.select(F.col("set_id").alias("sid"), "n")
    first = pairs.join(single.select(F.col("sid").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "na", "nb")
    first = written(first, "sized")
    one = first.filter("na = 1").select(F.col("a").alias("ia"), "b", "nb")
    more = meet(written(first.filter("na > 1").withColumnRenamed("a", "set_id"), "more"), several, "set_id").select(y["id"].alias("ia"), x["b"].alias("b"), x["nb"].alias("nb"))
    half = written(one.unionAll(more), "half")
    both = half.filter("nb = 1").select("ia", F.col("b").alias("ib"))
    rest = meet(written(half.filter("nb > 1").select("ia", F.col("b").alias("set_id")), "rest"), several, "set_id").select(x["ia"].alias("ia"), y["id"].alias("ib"))
    across = both.unionAll(rest).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    return inside.unionAll(across)


def similar_members(sets: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, class_id, copies, links)`` of every row: its class as the pairs name it, how many rows the class has, and with how many other rows it is similar.

    The row links of a pair of classes are all pairs of their members, and those within a class all pairs of its members: nothing is lost by not writing them out.
    """
    size = sets.select("set_id", "n")
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(size.select(F.col("set_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("far"))
    linked = size.join(far, "set_id", "left").select("set_id", F.col("n").alias("copies"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    linked = written(linked, "linked")
    out = lookup(members, linked, "set_id", "copies", members.count(), linked.count())
    return out.select("id", F.col("set_id").alias("class_id"), "copies", "links")


def mixture_tokens(df: DataFrame) -> F.Column:
    return structure(F.col("smiles"))
