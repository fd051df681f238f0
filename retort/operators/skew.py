"""Joins that stand one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.session import BROADCAST_ROWS, written

#: A key is hot above this many rows, or above one HOT_SHARE-th of all rows if that is more.
HOT_ROWS = 20_000
HOT_SHARE = 4_000
#: Bytes of a written table (as stored) up to which all of it may be broadcast.
SMALL_BYTES = 4 << 20
#: Rows of one key that meet in one task at most; larger groups are cut into blocks that meet pairwise.
GROUP = 2_000


def stored_bytes(df: DataFrame) -> int:
    """What Spark knows of the size of a plan; for written tables the size of their files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_limit(total: int) -> int:
    """Rows above which a key is hot; fewer than HOT_SHARE keys of a table of ``total`` rows can be."""
    return max(HOT_ROWS, total // HOT_SHARE)


def lookup(big: DataFrame, small: DataFrame, key: str, n: str, total: int, small_rows: int | None = None) -> DataFrame:
    """``big`` left-joined with ``small`` (one row per ``key``, with the key's row count ``n`` in ``big``).

    ``total`` is the sum of ``n``. If ``small`` is counted and small, in rows and bytes, it is broadcast. Otherwise both sides are shuffled by key and share:
    a hot key's row in ``small`` is repeated, once for every ``hot_limit`` rows it has in ``big``, and each of these goes to one of the repeats by its hash.
    There are fewer than 2 * HOT_SHARE repeats in all, by counting, however long the rows are; only the hot keys' hashes are broadcast. Null keys match nothing
    and are spread as well.
    """
    values = [c for c in small.columns if c != key]
    if small_rows is not None and small_rows <= BROADCAST_ROWS and stored_bytes(small) <= SMALL_BYTES:
        return big.join(F.broadcast(small), key, "left")
    limit = hot_limit(total)
    # Keys are told by hash: one that only shares a hot key's hash is repeated like it, on both sides.
    hot = small.filter(F.col(n) > limit).groupBy(F.xxhash64(key).alias("_h")).agg(F.max(F.ceil(F.col(n) / F.lit(limit))).cast("int").alias("_parts"))
    right = small.select(F.xxhash64(key).alias("_h"), F.col(key).alias("_k"), F.struct(*values).alias("_v")).join(F.broadcast(hot), "_h", "left")
    right = right.select("_k", "_v", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_s"))
    share = F.pmod(F.xxhash64(*big.columns), F.when(F.col(key).isNull(), F.lit(512)).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    left = big.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hot), "_h", "left").withColumn("_share", share)
    out = left.join(right, (F.col(key) == F.col("_k")) & (F.col("_share") == F.col("_s")), "left")
    return out.select(*big.columns, *[F.col("_v")[c].alias(c) for c in values])


def join_back(df: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """Per-key results on all rows, whatever share of them one key holds."""
    rows = keyed.count()
    return lookup(df, keyed, key, n, df.count(), rows if rows <= BROADCAST_ROWS else None)


def blocks(n: Column, size: int) -> Column:
    """Into how many blocks of about ``size`` rows a group of ``n`` rows is cut."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(size)))).cast("int")


def meet(left: DataFrame, right: DataFrame, key: str, group: int = GROUP) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right`` with equal ``key``, the columns as structs ``x`` and ``y``.

    Key frequencies are counted first, on both sides; a key that is frequent is cut into blocks of about ``group`` rows on either side, and every block of
    one side meets every block of the other in a task of its own. Only keys that occur on both sides go on. Both tables are read twice: they should be written ones.
    """
    tagged = left.select(key, F.lit(1).alias("l")).unionAll(right.select(key, F.lit(0).alias("l")))
    counts = tagged.groupBy(key).agg(F.sum("l").alias("nl"), F.sum(1 - F.col("l")).alias("nr"), F.count("*").alias("n_both")).filter("nl > 0 and nr > 0")
    counts = written(counts.select(key, blocks(F.col("nl"), group).alias("pl"), blocks(F.col("nr"), group).alias("pr"), "n_both"), "counts")
    total, rows = counts.agg(F.sum("n_both"), F.count("*")).first()

    def side(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        packed = df.select(key, F.struct(*df.columns).alias(name))
        packed = lookup(packed, counts, key, "n_both", total or 0, rows).filter("pl is not null")
        packed = packed.withColumn(own, F.pmod(F.xxhash64(name), F.col("pl" if own == "bl" else "pr")).cast("int"))
        return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("pr" if own == "bl" else "pl") - 1))).select(key, "bl", "br", name)

    return side(left, "x", "bl", "br").join(side(right, "y", "br", "bl"), [key, "bl", "br"]).select("x", "y")
