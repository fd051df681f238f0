"""Joins on times and ranges, cut into buckets so that no task gets all rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, width: float, prefix: str = "prior_") -> DataFrame:
    """``left`` with the latest row of ``right`` of the same keys that isn't later; its columns but the keys get a prefix, and are null where there is none.

    Times are instants or numbers. Each key is cut into buckets of ``width`` (seconds for instants): the last row of every earlier bucket is carried on, over one row per
    bucket, and within a bucket a window finds the row. Rows with a null time or key find nothing and are kept. Of right rows with equal times the one with the largest
    other columns counts. Columns of left that have a prefixed name are replaced.
    """
    others = [c for c in right.columns if c not in keys]
    made = [f"{prefix}{c}" for c in others]
    at = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6) if dict(left.dtypes)[time].startswith("timestamp") else c.cast("double")
    r = right.filter(F.col(time).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], at(F.col(time)).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(time), *[c for c in others if c != time]).alias("_row"), F.lit(None).cast(left.schema).alias("_left"))
    x = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], at(F.col(time)).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), F.struct(*left.columns).alias("_left"))
    ks = [f"_k{i}" for i in range(len(keys))]
    known = F.col("_at").isNotNull()
    for k in ks:
        known = known & F.col(k).isNotNull()
    keep = [c for c in left.columns if c not in made]
    lost = x.filter(~known).select(*[F.col(f"_left.{c}").alias(c) for c in keep], *[F.lit(None).cast(right.schema[c].dataType).alias(m) for c, m in zip(others, made, strict=True)])
    both = r.unionByName(x.filter(known)).withColumn("_bucket", F.floor(F.col("_at") / F.lit(float(width))))
    # One row per key and bucket, folded before the shuffle.
    last = both.groupBy(*ks, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_row"))).alias("_last"))
    carried = last.withColumn("_carry", F.last("_last", True).over(W.partitionBy(*ks).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).select(*ks, "_bucket", "_carry")
    w = W.partitionBy(*ks, "_bucket").orderBy("_at", "_side", "_row").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_row", True).over(w)).filter("_side = 1").join(carried, [*ks, "_bucket"], "left")
    picked = F.coalesce("_found", "_carry._row")
    out = found.withColumn("_picked", picked).select(*[F.col(f"_left.{c}").alias(c) for c in keep], *[F.col(f"_picked.{c}").alias(m) for c, m in zip(others, made, strict=True)])
    return out.unionAll(lost)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range that holds it (low <= point < high), as an equi-join on bins of ``width``: a range stands in every bin it reaches into.

    Column names of the two tables must differ. Nulls, and ranges that are empty, match nothing.
    """
    bin_of = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width)))
    spread = ranges.filter(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return points.withColumn("_bin", bin_of(point)).join(spread, "_bin").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")
