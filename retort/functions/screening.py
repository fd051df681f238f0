"""Virtual-screening metrics: lower scores are better; over lists, and over rows by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retort.operators.skew import hot_limit
from retort.session import tasks, written

NAN = float("nan")
#: Cuts between the ranges of scores of a large group.
SPLITS = 255


def _ranked(scores: Column, labels: Column) -> Column:
    """(score, place, label) in rising order of score, of equal scores in order of place."""
    rows = F.transform(scores, lambda s, i: F.struct(s.alias("score"), i.alias("at"), F.get(labels, i).alias("label")))
    return F.array_sort(rows)


def _usable(scores: Column, labels: Column) -> Column:
    """Equal positive lengths, no nulls inside, and no score that isn't a number."""
    return (F.size(scores) > 0) & (F.size(scores) == F.size(labels)) & ~F.exists(scores, lambda s: s.isNull() | F.isnan(s)) & ~F.exists(labels, lambda x: x.isNull())


def _positives(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x)).cast("double")


def _won(ranked: Column) -> Column:
    """Pairs of an active and an inactive in which the active scores lower, ties half: one pass over rows in rising order of score, with counts of those before and those tied."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("won"), zero.alias("before"), zero.alias("a"), zero.alias("i"), F.lit(NAN).alias("score"))

    def step(acc: Column, r: Column) -> Column:
        tied = acc["score"] == r["score"]
        before = F.when(tied, acc["before"]).otherwise(acc["before"] + acc["a"])
        a, i = F.when(tied, acc["a"]).otherwise(zero), F.when(tied, acc["i"]).otherwise(zero)
        won = acc["won"] + F.when(r["label"], 0.5 * i).otherwise(before + 0.5 * a)
        one = F.lit(1.0)
        return F.struct(won.alias("won"), before.alias("before"), (a + F.when(r["label"], one).otherwise(zero)).alias("a"), (i + F.when(r["label"], zero).otherwise(one)).alias("i"), r["score"].alias("score"))

    return F.aggregate(ranked, start, step, lambda acc: acc["won"])


def roc_auc(scores: Column, labels: Column) -> Column:
    """Probability that an active scores below an inactive one, ties half. Null for null, empty or unequal lists and scores that aren't numbers; NaN with one class only."""
    pos, n = _positives(labels), F.size(scores).cast("double")
    won = _won(_ranked(scores.cast("array<double>"), labels))
    return F.when(_usable(scores, labels), F.when((pos == 0) | (pos == n), F.lit(NAN)).otherwise(won / (pos * (n - pos))))


def enrichment_factor(scores: Column, labels: Column, fraction: Column) -> Column:
    """Share of actives in the best ``fraction`` over their share in all. NaN for a fraction outside (0, 1] and without actives."""
    n, pos = F.size(scores).cast("double"), _positives(labels)
    top = F.least(F.greatest(F.floor(fraction * n + 0.5), F.lit(1)), F.size(scores)).cast("int")
    hits = F.size(F.filter(F.slice(_ranked(scores, labels), F.lit(1), top), lambda r: r["label"])).cast("double")
    good = (fraction > 0) & (fraction <= 1) & (pos > 0)
    return F.when(_usable(scores, labels) & fraction.isNotNull(), F.when(good, (hits / top) / (pos / n)).otherwise(F.lit(NAN)))


def _bedroc_of(total: Column, n: Column, pos: Column, alpha: Column) -> Column:
    """Closed form from the sum of exp(-alpha * rank / n) over the actives."""
    ra = pos / n
    expected = (1 / n) * ((1 - F.exp(-alpha)) / (F.exp(alpha / n) - 1))
    factor = ra * F.sinh(alpha / 2) / (F.cosh(alpha / 2) - F.cosh(alpha / 2 - alpha * ra))
    return (total / pos) / expected * factor + 1 / (1 - F.exp(alpha * (1 - ra)))


def bedroc(scores: Column, labels: Column, alpha: Column) -> Column:
    """Early recognition with weight ``alpha``. NaN for an alpha that isn't positive and with one class only."""
    n, pos = F.size(scores).cast("double"), _positives(labels)
    ranked = F.transform(_ranked(scores, labels), lambda r, i: F.when(r["label"], F.exp(-alpha * (i + 1) / n)).otherwise(0.0))
    total = F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x)
    good = (alpha > 0) & (pos > 0) & (pos < n)
    return F.when(_usable(scores, labels) & alpha.isNotNull(), F.when(good, _bedroc_of(total, n, pos, alpha)).otherwise(F.lit(NAN)))


def _range_of(score: Column, cuts: Column) -> Column:
    """How many of the rising ``cuts`` a score is above or equal to, by halving; null without cuts."""
    steps = F.array(*[F.lit(1 << k) for k in range(SPLITS.bit_length() - 1, -1, -1)])
    at = lambda p: F.get(cuts, p - 1)
    return F.when(cuts.isNotNull(), F.aggregate(steps, F.lit(0), lambda p, x: p + F.when(F.coalesce(at(p + x) <= score, F.lit(False)), x).otherwise(0)))


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_place``, the row's place (from 1) among those of its keys by ``order``: rows are sorted over all tasks and counted by task, so that no key is gathered."""
    by = list(dict.fromkeys([*keys, *order]))
    rows = df.repartitionByRange(tasks(df.sparkSession), *by).sortWithinPartitions(*by)
    # The table keeps each row's task and its number there; the low 33 bits of the running id are that number.
    rows = written(rows.withColumns({"_task": F.spark_partition_id(), "_number": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    runs = rows.groupBy(*keys, "_task").agg(F.count("*").alias("_rows"), F.min("_number").alias("_first"))
    before = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col("_task").alias("_rt"), "_first", F.coalesce(before, F.lit(0)).alias("_earlier"))
    same = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    out = rows.join(runs, [*same, F.col("_task") == F.col("_rt")])
    return out.select(*df.columns, (F.col("_earlier") + F.col("_number") - F.col("_first") + 1).alias("_place"))


def metrics_by_group(df: DataFrame, group: list[str], score: str, label: str, tie: list[str], fraction: float = 0.1, alpha: float = 20.0, large: int | None = None) -> DataFrame:
    """``(*group, n, actives, roc_auc, enrichment, bedroc)`` per group; metrics are null where they are undefined.

    Rows with a null score, a score that isn't a number or a null label don't count. Equal scores share their mean rank for the first metric and are taken in the order of
    ``tie`` for the others. A group counts as large above ``large`` rows (by default as many as make a hot key).

    Ranks come from counts, not from one sort per group: scores are grouped to (score) rows with their numbers of actives and inactives - folded before the shuffle.
    Large groups are cut into ranges of scores (SPLITS of about equal size, from a mergeable sketch); running sums within a range and the sums of the ranges before
    it give every rank, so no window holds a group. The order within equal scores is only looked at where a tie is cut by the fraction or where ranks of tied
    actives are needed, and then by sorting the tied rows over all tasks, whatever share of them one score has.
    """
    rows = df.select(*group, F.col(score).cast("double").alias("_s"), F.col(label).cast("boolean").alias("_l"), *tie)
    rows = rows.filter(F.col("_s").isNotNull() & ~F.isnan("_s") & F.col("_l").isNotNull())
    names = [f"_h{k}" for k in range(len(group))]
    here = [F.col(g).eqNullSafe(F.col(m)) for g, m in zip(group, names, strict=True)]
    counts = rows.groupBy(*[F.col(g).alias(m) for g, m in zip(group, names, strict=True)]).agg(F.count("*").alias("_rows"), F.percentile_approx("_s", [(k + 1) / (SPLITS + 1) for k in range(SPLITS)], 10 * SPLITS).alias("_cuts"))
    counts = written(counts, "groups")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    # Fewer than HOT_SHARE groups, by counting, each with SPLITS numbers.
    hot = counts.filter(F.col("_rows") > (hot_limit(total) if large is None else large)).select(*names, "_cuts")
    by = rows.groupBy(*group, "_s").agg(F.count("*").alias("_n"), F.count_if("_l").alias("_a"))
    by = written(by.join(F.broadcast(hot), here, "left").withColumn("_range", F.coalesce(_range_of(F.col("_s"), F.col("_cuts")), F.lit(0))).select(*group, "_s", "_n", "_a", "_range"), "scores")
    ranges = by.groupBy(*group, "_range").agg(F.sum("_n").alias("_rn"), F.sum("_a").alias("_ra"))
    every, before = W.partitionBy(*group), W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        *[F.col(g).alias(m) for g, m in zip(group, names, strict=True)], F.col("_range").alias("_hr"), F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_rn0"),
        F.coalesce(F.sum("_ra").over(before), F.lit(0)).alias("_ra0"), F.sum("_rn").over(every).alias("_all"), F.sum("_ra").over(every).alias("_pos"),
    )
    w = W.partitionBy(*group, "_range").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumns({"_before": F.coalesce(F.sum("_n").over(w), F.lit(0)), "_actives_before": F.coalesce(F.sum("_a").over(w), F.lit(0))})
    by = by.join(ranges, [*here, F.col("_range") == F.col("_hr")]).drop(*names, "_hr")
    by = by.withColumns({"_before": F.col("_before") + F.col("_rn0"), "_actives_before": F.col("_actives_before") + F.col("_ra0")})
    n, a = F.col("_all").cast("double"), F.col("_pos").cast("double")
    top = F.least(F.greatest(F.floor(F.lit(fraction) * n + 0.5), F.lit(1)), F.col("_all"))
    # Inactives after an active: all that aren't before it nor tied with it, and half of those tied.
    by = by.withColumn("_wins", F.col("_a") * (n - a - (F.col("_before") - F.col("_actives_before")) - (F.col("_n") - F.col("_a")) * 0.5)).withColumn("_top", top)
    whole = F.col("_before") + F.col("_n") <= F.col("_top")
    single = (F.col("_n") == 1) | (F.col("_a") == F.col("_n"))
    # Where all of a tie are active or it is one row, its ranks are known: a geometric sum of equal steps.
    q = F.exp(F.lit(-alpha) / n)
    even = F.pow(q, F.col("_before") + 1) * (1 - F.pow(q, F.col("_n").cast("double"))) / (1 - q)
    settled = by.withColumn("_hit", F.when(whole, F.col("_a")).when(F.col("_before") >= F.col("_top"), 0).when(single, F.least(F.col("_a"), F.col("_top") - F.col("_before"))))
    settled = settled.withColumn("_e", F.when(F.col("_a") == 0, 0.0).when(single, even))
    # The other sides of the two joins get names of their own, so that nothing is ambiguous.
    named = [f"_g{k}" for k in range(len(group))]
    open_ties = settled.filter((F.col("_a") > 0) & ~single).select(*[F.col(g).alias(m) for g, m in zip(group, named, strict=True)], F.col("_s").alias("_ts"), "_before", "_top", "_all", F.col("_hit").isNull().alias("_hits_open"))
    match = [F.col(g).eqNullSafe(F.col(m)) for g, m in zip(group, named, strict=True)]
    tied = rows.join(open_ties, [*match, F.col("_s") == F.col("_ts")])
    tied = _placed(tied.select(*dict.fromkeys([*named, "_ts", "_l", "_before", "_top", "_all", "_hits_open", *tie])), [*named, "_ts"], tie)
    tied = tied.withColumn("_place", F.col("_place") + F.col("_before")).filter("_l").withColumn("_e", F.exp(F.lit(-alpha) * F.col("_place") / F.col("_all")))
    tied = tied.groupBy(*named).agg(F.sum("_e").alias("_tied_e"), F.count_if((F.col("_place") <= F.col("_top")) & (F.col("_before") < F.col("_top")) & (F.col("_hits_open"))).alias("_tied_hits"))
    settled = settled.withColumn("_open", (F.col("_a") > 0) & ~single)
    out = settled.groupBy(*group).agg(
        F.max("_all").alias("n"), F.max("_pos").alias("actives"), F.sum("_wins").alias("_w"), F.sum("_hit").alias("_h"),
        F.sum(F.when(~F.col("_open"), F.col("_e"))).alias("_e"), F.max("_top").alias("_top"),
    )
    joined = out.join(tied, match, "left").withColumn("_h", F.coalesce("_h", F.lit(0)) + F.coalesce("_tied_hits", F.lit(0))).withColumn("_e", F.coalesce("_e", F.lit(0.0)) + F.coalesce("_tied_e", F.lit(0.0)))
    n, a = F.col("n").cast("double"), F.col("actives").cast("double")
    two = (a > 0) & (a < n)
    return joined.select(
        *group, "n", "actives", F.when(two, F.col("_w") / (a * (n - a))).alias("roc_auc"), F.when(a > 0, (F.col("_h") / F.col("_top")) / (a / n)).alias("enrichment"),
        F.when(two, _bedroc_of(F.col("_e"), n, a, F.lit(float(alpha)))).alias("bedroc"),
    )
