"""Conformers, receptors and docking as columns, and list metrics as SQL expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from retort.functions.molecules import TEXT, _column
from retort.kernel import docking
from retort.kernel.conformer import conformer

UDFS = {
    "smiles_to_pdbqt": _column(docking.smiles_to_pdbqt, TEXT, "smiles_to_pdbqt"),
    "pdb_to_pdbqt": _column(docking.pdb_to_pdbqt, TEXT, "pdb_to_pdbqt"),
    "prepare_receptor": _column(docking.prepare_receptor, TEXT, "prepare_receptor"),
    "dock": _column(docking.dock, TEXT, "dock"),
}

#: Tasks per core that ligands are spread over.
TASKS = 16

XYZ = T.StructType([T.StructField(a, T.ArrayType(T.DoubleType())) for a in "xyz"])


@arrow_udf(XYZ)
def smiles_to_3d(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    """Coordinates of all atoms, hydrogens last; null where there is no conformer."""
    out = []
    for t, s in zip(texts.to_pylist(), seeds.to_pylist(), strict=True):
        made = conformer(t, s)
        out.append(None if made is None else {a: made[1][:, k].tolist() for k, a in enumerate("xyz")})
    return pa.array(out, pa.struct([(a, pa.list_(pa.float64())) for a in "xyz"]))


def dock_ligands(ligands: DataFrame, text_col: str, receptor: str, center: tuple, size: tuple, runs: int = 10, seed: int = 0, ph: float = docking.DEFAULT_PH) -> DataFrame:
    """``ligands`` with the poses (JSON) as ``poses``, the PDBQT text of the docked conformer as ``ligand`` and the best score as ``score``, against one receptor text.

    The receptor travels once per task and its grids are made once per worker; ligands are spread evenly first, since their costs differ. Texts without a conformer have
    nulls. Columns of ``ligands`` with these names are replaced.
    """
    spark = ligands.sparkSession
    sent = spark.sparkContext.broadcast(receptor)

    def run(texts: pa.Array) -> pa.Array:
        # The conformer of a text is remembered from one call to the other.
        rows = [{"poses": docking.dock(t, sent.value, *center, *size, runs, seed, ph), "ligand": docking.smiles_to_pdbqt(t, seed)} for t in texts.to_pylist()]
        return pa.array(rows, pa.struct([("poses", pa.string()), ("ligand", pa.string())]))

    docked = arrow_udf(run, T.StructType([T.StructField("poses", TEXT), T.StructField("ligand", TEXT)])).asNondeterministic()(F.col(text_col))
    keep = [c for c in ligands.columns if c not in ("poses", "ligand", "score")]
    made = ligands.select(*keep).repartition(TASKS * spark.sparkContext.defaultParallelism).withColumn("_docked", docked)
    score = F.get_json_object("_docked.poses", "$.results[0].score").cast("double")
    return made.select(*keep, F.col("_docked.poses").alias("poses"), F.col("_docked.ligand").alias("ligand"), score.alias("score"))


_RANKED = "array_sort(transform(scores, (s, i) -> struct(s AS s, i AS i, get(labels, i) AS l)))"
_USABLE = "size(scores) > 0 AND size(scores) = size(labels) AND NOT exists(scores, s -> s IS NULL OR isnan(s)) AND NOT exists(labels, l -> l IS NULL)"
_POS = "size(filter(labels, l -> l))"
_N = "size(scores)"
_TOP = f"cast(least(greatest(floor(fraction * {_N} + 0.5D), 1), {_N}) AS INT)"
_RA = f"({_POS} / {_N})"
#: Arguments, type and expression of the list metrics; contracts as in retort.functions.screening.
METRICS_SQL = {
    "roc_auc": (
        "scores ARRAY<DOUBLE>, labels ARRAY<BOOLEAN>", "DOUBLE",
        f"CASE WHEN {_USABLE} THEN CASE WHEN {_POS} = 0 OR {_POS} = {_N} THEN double('NaN') ELSE "
        f"aggregate({_RANKED}, struct(0D AS won, 0D AS before, 0D AS a, 0D AS i, double('NaN') AS s), (t, r) -> "
        "if(t.s = r.s, struct(t.won + if(r.l, 0.5D * t.i, t.before + 0.5D * t.a) AS won, t.before AS before, t.a + if(r.l, 1D, 0D) AS a, t.i + if(r.l, 0D, 1D) AS i, r.s AS s), "
        "struct(t.won + if(r.l, 0D, t.before + t.a) AS won, t.before + t.a AS before, if(r.l, 1D, 0D) AS a, if(r.l, 0D, 1D) AS i, r.s AS s)), t -> t.won) "
        f"/ (double({_POS}) * ({_N} - {_POS})) END END",
    ),
    "enrichment_factor": (
        "scores ARRAY<DOUBLE>, labels ARRAY<BOOLEAN>, fraction DOUBLE", "DOUBLE",
        f"CASE WHEN {_USABLE} AND fraction IS NOT NULL THEN CASE WHEN fraction > 0 AND fraction <= 1 AND {_POS} > 0 THEN "
        f"(size(filter(slice({_RANKED}, 1, {_TOP}), r -> r.l)) / {_TOP}) / {_RA} ELSE double('NaN') END END",
    ),
    "bedroc": (
        "scores ARRAY<DOUBLE>, labels ARRAY<BOOLEAN>, alpha DOUBLE", "DOUBLE",
        f"CASE WHEN {_USABLE} AND alpha IS NOT NULL THEN CASE WHEN alpha > 0 AND {_POS} > 0 AND {_POS} < {_N} THEN "
        f"(aggregate(transform({_RANKED}, (r, i) -> if(r.l, exp(-alpha * (i + 1) / {_N}), 0D)), 0D, (t, x) -> t + x) / {_POS}) "
        f"/ ((1D / {_N}) * ((1 - exp(-alpha)) / (exp(alpha / {_N}) - 1))) * {_RA} * sinh(alpha / 2) / (cosh(alpha / 2) - cosh(alpha / 2 - alpha * {_RA})) "
        f"+ 1 / (1 - exp(alpha * (1 - {_RA}))) ELSE double('NaN') END END",
    ),
}
