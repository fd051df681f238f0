"""Duplicates hidden by formatting differences.

A record's fingerprint is a sum of hashes: one hash per (field name, normalized
value) pair, and within a field that is itself a multiset, the sum of its
members' hashes. Addition commutes, so neither fields nor members are sorted.
Two independent 64-bit sums form the key. Equality of the fields is then
verified against the group's first record; records that fail - hash collisions -
are grouped again under the next seed, until none fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.normal import name_key, structure
from retort.operators.skew import lookup
from retort.session import written


def _add(a: Column, b: Column) -> Column:
    """Sum modulo 2**62: no overflow, whatever the ANSI setting."""
    return (a + b).bitwiseAND(F.lit((1 << 62) - 1))


def _hash(*values: Column) -> Column:
    return F.xxhash64(*values).bitwiseAND(F.lit((1 << 62) - 1))


def _member_sum(name: str, array: Column, seed: int) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: _add(acc, _hash(F.lit(seed), F.lit(name), F.lit("member"), x)))


def fingerprint(fields: dict[str, Column], multisets: frozenset[str] | set[str], seed: int) -> Column:
    """Commutative hash of all (field, value) pairs; a field in ``multisets`` is an array whose order doesn't count."""
    total = F.lit(0).cast("bigint")
    for name, value in fields.items():
        if name in multisets:
            value = F.coalesce(_member_sum(name, value, seed), F.lit(-1).cast("bigint"))
        total = _add(total, _hash(F.lit(seed), F.lit(name), value))
    return total


def same_multiset(a: Column, b: Column) -> Column:
    """Equality of two arrays as multisets. Arrays in equal order are recognised first; without repeats the sets are compared by hash; only arrays with repeats in another order are sorted, each by itself."""
    size = F.size(a)
    sets = (F.size(F.array_distinct(a)) == size) & (F.size(F.array_distinct(b)) == size)
    return (a == b) | ((size == F.size(b)) & F.when(sets, F.size(F.array_except(a, b)) == 0).otherwise(F.array_sort(a) == F.array_sort(b)))


def duplicates(df: DataFrame, fields: dict[str, Column], multisets: set[str] = frozenset(), id_col: str = "mol_id") -> DataFrame:
    """``(id, keep_id, copies)``: every record with the smallest id of those equal to it, and how many there are.

    Records are equal if all fields are, after normalization; a record with a null field equals no other one and keeps itself.
    Repeated ids are records of their own; null ids are kept (they come after all others, so keep_id is null only in a group of null ids).
    An empty table gives an empty result. Other columns, whatever they are called, are ignored.
    """
    names = list(fields)
    base = df.select(F.col(id_col).alias("id"), *[c.alias(f"f_{n}") for n, c in fields.items()])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"f_{n}").isNotNull()
    held = {n: F.col(f"f_{n}") for n in names}
    base = written(base, "records")
    todo, done, seed = base.filter(whole), [base.filter(~whole).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))], 0
    while True:
        marked = todo.withColumn("fp", F.struct(fingerprint(held, multisets, 2 * seed).alias("x"), fingerprint(held, multisets, 2 * seed + 1).alias("y")))
        # One row per fingerprint, folded before the shuffle: the record to compare with, and the size of the group.
        first = marked.groupBy("fp").agg(F.min_by(F.struct(*[F.col(f"f_{n}").alias(f"g_{n}") for n in names]), F.coalesce("id", F.lit((1 << 63) - 1))).alias("model"), F.count("*").alias("n"))
        first = written(first, "models")
        total = base.count()
        out = lookup(marked, first, "fp", "n", total, first.count())
        same = F.lit(True)
        for n in names:
            model = F.col("model")[f"g_{n}"]
            same = same & (same_multiset(held[n], model) if n in multisets else held[n] == model)
        checked = written(out.withColumn("same", same).select("id", *[f"f_{n}" for n in names], "fp", "same"), "checked")
        equal = checked.filter("same")
        groups = written(equal.groupBy("fp").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")), "groups")
        done.append(lookup(equal.select("id", "fp"), groups, "fp", "copies", total, groups.count()).select("id", "keep_id", "copies"))
        todo, seed = checked.filter("not same").drop("fp", "same"), seed + 1
        if todo.isEmpty():
            break
    result = done[0]
    for part in done[1:]:
        result = result.unionAll(part)
    return result


def molecule_fields(df: DataFrame) -> dict[str, Column]:
    return {"name": name_key(F.col("name")), "smiles": structure(F.col("smiles"))}


def both_tables(smiles: DataFrame, selfies: DataFrame) -> DataFrame:
    return smiles.select("mol_id", "name", "smiles").unionAll(selfies.select("mol_id", "name", "smiles"))
