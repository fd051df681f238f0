"""Registered queries on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import dedup, leaks, mixing, overlap, spam, splits, variety
from retort.llm.oracles import SQL  # noqa: F401
from retort.sources.tables import table


def _p1(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "smiles")
    return splits.related_groups(df, splits.molecule_ties(df))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Molecules of every group of two or more that are tied by author or structure."""
    return _p1(spark, d).filter("n >= 2 and id is not null").select("group_id", F.col("id").alias("mol_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every molecule with its group and split."""
    placed = splits.assign_splits(_p1(spark, d), splits.split_shares(table(spark, d, "split_plan")))
    return placed.select(F.col("id").alias("mol_id"), "group_id", "split_name")


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every group of tied molecules with its size and the number of splits its members are in."""
    placed = splits.assign_splits(_p1(spark, d), splits.split_shares(table(spark, d, "split_plan")))
    # Counted by split first, so that a group of most rows is no single group of the count.
    held = placed.groupBy("label", "group_id", "split_name").agg(F.count("*").alias("n"))
    return held.groupBy("label", "group_id").agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("splits")).drop("label")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and achieved share of every split."""
    shares = splits.split_shares(table(spark, d, "split_plan"))
    return splits.achieved_shares(splits.assign_splits(_p1(spark, d), shares), shares)


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = table(spark, d, "smiles")
    sets, members = overlap.distinct_sets(df, overlap.mixture_tokens(df))
    return sets, members, overlap.similar_classes(sets)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of mixtures of which the sets of components largely agree."""
    return overlap.similar_rows(*_p4(spark, d)).select(F.col("id_a").alias("mol_id_a"), F.col("id_b").alias("mol_id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct component sets, each named by its smallest mol_id, with overlap and similarity."""
    return _p4(spark, d)[2]


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Every mixture with its class in ``p4_classes``, the number of rows of that class, and the number of rows it is similar to."""
    return overlap.similar_members(*_p4(spark, d)).withColumnRenamed("id", "mol_id")


def _p5(spark: SparkSession, d: str) -> DataFrame:
    df = dedup.both_tables(table(spark, d, "smiles"), table(spark, d, "selfies"))
    return dedup.duplicates(df, dedup.molecule_fields(df), {"smiles"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every copy with the record kept for it."""
    return _p5(spark, d).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """One record for each group of equal ones, with the number of its copies."""
    return _p5(spark, d).filter("id <=> keep_id").select("keep_id", "copies")


def p3_subset(spark: SparkSession, d: str) -> DataFrame:
    """The varied subset of every row of subset_plan, in the order chosen."""
    rows, plan = table(spark, d, "smiles"), table(spark, d, "subset_plan")
    chosen = variety.filled_subsets(variety.varied_subsets(variety.candidates(rows), plan), plan, rows)
    return chosen.select("plan_id", "place", F.col("id").alias("mol_id"))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows every plan got, how many of them are of its source, and how many different ones."""
    rows = table(spark, d, "smiles").select("mol_id", F.col("source").alias("of"))
    plan = table(spark, d, "subset_plan").select("plan_id", "source")
    chosen = p3_subset(spark, d).join(rows, "mol_id").join(plan, "plan_id")
    own = F.count_if(F.col("source").isNull() | (F.col("source") == F.col("of")))
    return chosen.groupBy("plan_id").agg(F.count("*").alias("chosen"), own.alias("own"), F.countDistinct("mol_id").alias("different"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an item."""
    return _p6(spark, d).filter("verbatim > 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the windows of an item they hold, as they are or with other numbers, names or units."""
    return _p6(spark, d)


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = mixing.read_targets(table(spark, d, "mix_targets"))
    return mixing.mix(mixing.counted(table(spark, d, "documents"), targets), targets)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of every document drawn."""
    return _p7(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return _p7(spark, d)[1]


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every target's source, and whether none of those drawn is used more often than allowed."""
    allowed = table(spark, d, "mix_targets").select(mixing.source_key(F.col("source")).alias("source"), "max_repeats")
    mixture, report = _p7(spark, d)
    most = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    out = report.select("source", "documents").join(most, "source", "left").join(allowed, "source")
    return out.select("source", "documents", (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("within"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose words stand in link lists, tag lists or menus."""
    return spam.stuffed(spam.page_labels(table(spark, d, "documents"))).select("doc_id")


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document by the label of their line."""
    return spam.page_labels(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_whole, p1_shares, p3_subset, p3_sizes, p4_found, p4_classes, p4_members, p5_found, p5_kept, p6_found, p6_leaks, p7_mix, p7_shares, p7_uses, p8_found, p8_pages)
}
