"""DataFrame-level operators around the functions: ranking, threshold joins, screens, scaffolds, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions import molecules as M
from retort.functions import similarity as S
from retort.operators.skew import blocks, join_back
from retort.session import written


#: Words that bits are folded to for a first comparison.
FOLD = 4


def fingerprints(df: DataFrame, text_col: str, field: str = "morgan_fp_bits") -> DataFrame:
    """``df`` with ``fp`` (binary), ``words`` (64-bit words) and ``n_on``; rows without a valid molecule are left out, columns of these names replaced."""
    kept = [c for c in df.columns if c not in ("fp", "words", "n_on")]
    out = M.profile(df.select(*kept), text_col, [field, f"{field}_words"]).filter(F.col(field).isNotNull())
    out = out.withColumnRenamed(field, "fp").withColumnRenamed(f"{field}_words", "words").drop("valid")
    return out.withColumn("n_on", S.popcount(F.col("words")))


def rank_similar(fps: DataFrame, reference: str, k: int | None = None, measure: str = "tanimoto_bit", field: str = "morgan_fp_bits", id_col: str = "mol_id", **weights) -> DataFrame:
    """``fps`` with ``sim`` to a reference molecule, best first, the best k if a number is given; ties by id. The reference is fingerprinted on the driver."""
    molecule = M.molecule(reference)
    if molecule is None:
        raise ValueError("the reference isn't a valid molecule")
    bits = M.FIELDS[field].make(molecule)
    size = range(0, len(bits), 8)
    mine = F.array(*[F.lit(int.from_bytes(bits[i : i + 8], "big", signed=len(bits[i : i + 8]) == 8)).cast("bigint") for i in size])
    n = sum(b.bit_count() for b in bits)
    common = S.common(F.col("words"), mine)
    sim = S.of_counts(measure, common, F.col("n_on"), F.lit(n), F.lit(8 * len(bits)), *[F.lit(float(w)) for w in weights.values()])
    out = fps.withColumn("sim", sim).orderBy(F.desc("sim"), id_col)
    return out if k is None else out.limit(k)


def threshold_join(fps: DataFrame, t: float, id_col: str = "mol_id", group: int = 4_000) -> DataFrame:
    """``(a, b, sim)``, a < b, for all pairs of different fingerprints with Tanimoto similarity at least ``t``; each fingerprint stands for all rows that have it, by its smallest id.

    Two such fingerprints share one of the rarest ``n - ceil(t * n) + 1`` on-bits of either side. Rarity is counted over the table; bits are joined with the range of sizes
    that can reach t, frequent bits in blocks that meet pairwise, and candidates are counted exactly. Before they are, most are ruled out where they meet: each side
    carries its bits folded to a few words by exclusive or, and folded vectors differ in no more bits than the vectors do.
    """
    one = fps.groupBy("fp").agg(F.min(id_col).alias("id"), F.first("words").alias("words"), F.first("n_on").alias("n")).filter("n > 0")
    one = written(one.withColumn("fold", S.folded(F.col("words"), FOLD)), "fps")
    # At most as many rows as a fingerprint has bits.
    held = one.select("fp").mapInArrow(_bit_counts, "bit int, held bigint").groupBy("bit").agg(F.sum("held").alias("held")).collect()
    kind = one.schema["id"].dataType.simpleString()
    prefix = one.select("id", "n", "fold", "fp").mapInArrow(_prefixes({r[0]: r[1] for r in held}, t), f"id {kind}, n int, fold array<bigint>, bit int, pos int")
    prefix = written(prefix, "prefix")
    counts = prefix.groupBy("bit").agg(F.count("*").alias("m")).filter("m > 1").select("bit", blocks(F.col("m"), group).alias("parts"))
    prefix = prefix.join(F.broadcast(counts), "bit").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def side(name: str, own: str, other: str) -> DataFrame:
        rows = prefix.withColumn(own, F.col("part")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.select("bit", "bx", "by", F.struct("id", "n", "pos", "fold").alias(name))

    x, y = F.col("x"), F.col("y")
    met = side("x", "bx", "by").join(side("y", "by", "bx"), ["bit", "bx", "by"]).filter((x["id"] < y["id"]) & (x["n"] * t <= y["n"] + 1e-9) & (y["n"] * t <= x["n"] + 1e-9))
    reach = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) * (1 + t) + 1e-9 >= (x["n"] + y["n"]) * t
    # Similarity t leaves at most this many bits to differ in.
    apart = S.differing(x["fold"], y["fold"]) <= (x["n"] + y["n"]) * ((1 - t) / (1 + t)) + 1e-9
    pairs = met.filter(reach).filter(apart).select(x["id"].alias("a"), y["id"].alias("b")).distinct()
    held = one.select("id", "words", "n")
    for end in ("a", "b"):
        pairs = pairs.join(held.select(F.col("id").alias(end), F.col("words").alias(f"w_{end}"), F.col("n").alias(f"n_{end}")), end)
    sim = S.of_counts("tanimoto_bit", S.common(F.col("w_a"), F.col("w_b")), F.col("n_a"), F.col("n_b"))
    return pairs.select("a", "b", sim.alias("sim")).filter(F.col("sim") >= t - 1e-12)


def similar_members(fps: DataFrame, t: float, id_col: str = "mol_id") -> DataFrame:
    """``(id, class_id, links)`` for every row: the id that stands for its fingerprint in ``threshold_join``, and the number of other rows with similarity at least ``t``.

    Rows of one class have similarity 1 (0 without any bit); all links of a row are those within its class and those of its class's pairs to all members of the other.
    """
    fps = written(fps.select(id_col, "fp", "words", "n_on"), "prints")
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("class_id"), F.count("*").alias("rows"), F.first("n_on").alias("n")), "classes")
    pairs = written(threshold_join(fps, t, id_col).select("a", "b"), "pairs")
    ends = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(classes.select(F.col("class_id").alias("b"), "rows"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("rows").alias("far"))
    links = F.when(F.col("n") > 0, F.col("rows") - 1).otherwise(F.lit(0)) + F.coalesce("far", F.lit(0))
    linked = written(classes.join(far, "class_id", "left").select("fp", "rows", "class_id", links.alias("links")), "linked")
    return join_back(fps.select(id_col, "fp"), linked, "fp", "rows").select(id_col, "class_id", "links")


def _bits(fps: pa.Array) -> np.ndarray:
    """Bit vectors of one length as rows of zeros and ones."""
    data = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1)
    return np.unpackbits(data, axis=1, bitorder="little")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many vectors have each bit on."""
    total = 0
    for batch in batches:
        if batch.num_rows:
            total = total + _bits(batch.column(0)).sum(0, dtype=np.int64)
    if isinstance(total, np.ndarray):
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on], pa.int64())], ["bit", "held"])


def _prefixes(held: dict[int, int], t: float):
    """Rows (id, n, fold, fp) to one row for each of the rarest ``n - ceil(t * n) + 1`` on-bits, with its place."""
    order = np.array(sorted(held, key=lambda bit: (held[bit], bit)), np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy().astype(np.int64)
            row, col = np.nonzero(_bits(batch.column(3))[:, order])
            # Non-zeros come row by row, in each by rarity.
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            keep = place <= n[row] - np.ceil(t * n[row] - 1e-9)
            row, col, place = row[keep], col[keep], place[keep]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at).cast(pa.int32()), batch.column(2).take(at), pa.array(order[col], pa.int32()), pa.array(place, pa.int32())], ["id", "n", "fold", "bit", "pos"]
            )

    return make


def screen(df: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """``df`` with ``hits``: for each named pattern that occurs the number of its unique matches, as a map. One parse per molecule, all patterns in one pass."""
    pairs = [F.struct(F.lit(name).alias("key"), M.call("mol_substructure_count", F.col(text_col), F.lit(p)).alias("value")) for name, p in sorted(patterns.items())]
    return df.withColumn("hits", F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"] > 0)))


def parents(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(parent, n, keep_id)``: rows grouped by the salt-free neutral parent of their molecule; invalid molecules have no parent and are left out."""
    return M.profile(df, text_col, ["fragment_parent"], distinct=True).filter("fragment_parent is not null").groupBy(F.col("fragment_parent").alias("parent")).agg(F.count("*").alias("n"), F.min(id_col).alias("keep_id"))


def scaffold_rollup(df: DataFrame, text_col: str) -> DataFrame:
    """Counts by generic scaffold, by Murcko scaffold within it, and over all; valid molecules only."""
    out = M.profile(df, text_col, ["generic_scaffold", "murcko_scaffold"], distinct=True).filter("valid")
    return out.rollup("generic_scaffold", "murcko_scaffold").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
