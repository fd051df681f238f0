"""Functions of MOL, SDF, PDB, mmCIF and XYZ texts, and their explosion into rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from retort.functions.molecules import _ARROW, BOOL, DOUBLE, INT, TEXT, _column
from retort.kernel import blocks, coords
from retort.kernel.jsontext import dumps
from retort.session import spread

_AXES = "xyz"
#: Texts up to this length are remembered after parsing, so that several functions in one projection parse them once.
SHORT = 20_000

@lru_cache(maxsize=2048)
def _short_block(text: str) -> blocks.Block | None:
    return blocks.parse_block(text)


@lru_cache(maxsize=1024)
def _short_sites(text: str) -> list[coords.Site] | None:
    return coords.read_structure(text)


def _block(text: str | None) -> blocks.Block | None:
    return None if text is None else _short_block(text) if len(text) <= SHORT else blocks.parse_block(text)


def _sites(text: str | None) -> list[coords.Site] | None:
    return None if text is None else _short_sites(text) if len(text) <= SHORT else coords.read_structure(text)


def _measure(points: np.ndarray) -> dict[str, float | None]:
    """Root mean square distance from the mean point, and mean and bounds by axis; None without points."""
    if not len(points):
        return {}
    mean = points.mean(0)
    out = {"radius_of_gyration": float(np.sqrt(((points - mean) ** 2).sum(1).mean()))}
    for name, values in (("centroid", mean), ("min", points.min(0)), ("max", points.max(0))):
        out |= dict(zip((f"{name}_{a}" for a in _AXES), values.tolist(), strict=True))
    return out


def _extents(prefix: str, points: Callable) -> dict[str, tuple]:
    """Mean, spread and bounds of the points a parsed text has; null without points. The text measured last is remembered, so that the fields of one text measure it once."""
    last: list = [None, {}]

    def get(parsed, name: str) -> float | None:
        if last[0] is not parsed:
            last[:] = parsed, _measure(points(parsed))
        return last[1].get(name)

    names = ["radius_of_gyration", *(f"{n}_{a}" for n in ("centroid", "min", "max") for a in _AXES)]
    return {f"{prefix}_{n}": (DOUBLE, lambda p, n=n: get(p, n)) for n in names}


BLOCK_FIELDS: dict[str, tuple] = {
    "mol_block_formula": (TEXT, blocks.Block.formula),
    "mol_block_weight": (DOUBLE, blocks.Block.weight),
    "mol_block_num_atoms": (INT, lambda b: len(b.atoms)),
    "mol_block_num_bonds": (INT, lambda b: len(b.bonds)),
    "mol_block_name": (TEXT, lambda b: b.name),
    "mol_block_properties_json": (TEXT, lambda b: dumps(b.property_rows())),
    "mol_block_atoms_json": (TEXT, blocks.Block.atoms_json),
    "mol_block_bonds_json": (TEXT, lambda b: dumps(b.bond_rows())),
    "mol_block_json": (TEXT, blocks.Block.json),
    "mol_block_has_3d": (BOOL, blocks.Block.has_3d),
} | _extents("mol_block", lambda b: b.coordinates())


def _points(sites: list[coords.Site]) -> np.ndarray:
    return np.array([(s.x, s.y, s.z) for s in sites], np.float64).reshape(-1, 3)


STRUCTURE_FIELDS: dict[str, tuple] = {
    "structure_atom_count": (INT, len),
    "structure_chain_count": (INT, lambda s: len({a.chain for a in s})),
    "structure_residue_count": (INT, lambda s: len({(a.chain, a.resid) for a in s if not a.is_hetatm})),
    "structure_model_count": (INT, lambda s: max((a.model for a in s), default=0)),
} | _extents("structure", _points)


def _of(make: Callable, parse: Callable) -> Callable:
    def run(text):
        found = parse(text)
        return None if found is None else make(found)

    return run


UDFS = {n: _column(_of(f, _block), kind, n) for n, (kind, f) in BLOCK_FIELDS.items()}
UDFS |= {n: _column(_of(f, _sites), kind, n) for n, (kind, f) in STRUCTURE_FIELDS.items()}


def _model_count(text: str | None):
    return None if text is None else STRUCTURE_FIELDS["structure_model_count"][1](_sites(text) or [])


def _property(text: str | None, key: str | None):
    b = _block(text)
    return None if b is None or key is None else b.property(key)


def _sdf_property(text: str | None, n: int | None, key: str | None):
    if text is None or n is None or key is None or n <= 0:
        return None
    found = blocks.parse_sdf(text)
    return found[n - 1].property(key) if n <= len(found) else None


def _sdf_properties(text: str | None):
    rows = blocks.sdf_properties(text)
    return None if rows is None else dumps(rows)


UDFS |= {
    "structure_model_count": _column(_model_count, INT, "structure_model_count"),
    "mol_block_property": _column(_property, TEXT, "mol_block_property"),
    "sdf_count": _column(lambda t: None if t is None else len(blocks.parse_sdf(t)), INT, "sdf_count"),
    "sdf_property": _column(_sdf_property, TEXT, "sdf_property"),
    "sdf_properties_json": _column(_sdf_properties, TEXT, "sdf_properties_json"),
}



def _profile_udf(table: dict[str, tuple], names: tuple[str, ...], parse: Callable):
    schema = T.StructType([T.StructField(n, table[n][0]) for n in names])

    def run(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in names]
        for found in map(parse, texts.to_pylist()):
            for values, n in zip(columns, names, strict=True):
                values.append(None if found is None else table[n][1](found))
        return pa.StructArray.from_arrays([pa.array(v, _ARROW[s.dataType]) for v, s in zip(columns, schema, strict=True)], list(names))

    return arrow_udf(run, schema).asNondeterministic()


def text_profile(df: DataFrame, text_col: str, fields: list[str]) -> DataFrame:
    """``df`` with a column for each of the fields (``mol_block_...`` or ``structure_...``, one kind at a time), all from one parse and one Python call per text.

    Texts that are null or can't be read have nulls (``structure_model_count`` is 0 for empty ones). Columns of ``df`` with a field's name are replaced.
    """
    names = tuple(dict.fromkeys(fields))
    table, parse = (BLOCK_FIELDS, _block) if names[0] in BLOCK_FIELDS else (STRUCTURE_FIELDS, _sites)
    keep = [c for c in df.columns if c not in names]
    rest = [n for n in names if n != "structure_model_count"]
    made = spread(df).select(*keep, _profile_udf(table, tuple(rest), parse)(F.col(text_col)).alias("_profile")) if rest else df.select(*keep)
    columns = [UDFS[n](F.col(text_col)).alias(n) if n not in rest else F.col(f"_profile.{n}").alias(n) for n in names]
    return made.select(*keep, *columns)


_REAL = T.FloatType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


SITE = _struct(
    model=INT, chain=TEXT, resid=INT, resname=TEXT, atom_name=TEXT, altloc=TEXT, x=_REAL, y=_REAL, z=_REAL, occupancy=_REAL, b_factor=_REAL, element=TEXT, is_hetatm=BOOL
)
BLOCK = _struct(
    name=TEXT,
    atoms=T.ArrayType(_struct(x=_REAL, y=_REAL, z=_REAL, symbol=TEXT)),
    bonds=T.ArrayType(_struct(atom1=T.LongType(), atom2=T.LongType(), bond_type=INT)),
    properties=T.ArrayType(_struct(name=TEXT, value=TEXT)),
)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@arrow_udf(T.ArrayType(SITE))
def structure_atoms(texts: pa.Array) -> pa.Array:
    """Atom rows of a structure text."""
    rows = [None if s is None else [a._asdict() for a in s] for s in (_sites(t) for t in texts.to_pylist())]
    return pa.array(rows, _arrow(T.ArrayType(SITE)))


@arrow_udf(BLOCK)
def mol_block(texts: pa.Array) -> pa.Array:
    """A MOL text as typed fields."""
    out = []
    for t in texts.to_pylist():
        b = _block(t)
        out.append(
            None if b is None else {
                "name": b.name, "atoms": [dict(zip(("x", "y", "z", "symbol"), a, strict=True)) for a in b.atoms],
                "bonds": [dict(zip(("atom1", "atom2", "bond_type"), x, strict=True)) for x in b.bonds], "properties": b.property_rows(),
            }
        )
    return pa.array(out, _arrow(BLOCK))


def explode_atoms(df: DataFrame, text_col: str) -> DataFrame:
    """One row per atom of each structure text, the other columns of ``df`` repeated; texts that are null or empty give none.

    Columns of ``df`` with the name of an atom column are dropped.
    """
    keep = [c for c in df.columns if c != text_col and c not in SITE.names]
    return df.select(*keep, F.inline(structure_atoms(F.col(text_col))))


def structure_stats(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, mean, spread and bounds by ``keys`` of exploded atoms, as plain aggregates."""
    xyz = [F.col(c).cast("double") for c in _AXES]
    square = sum((c * c for c in xyz[1:]), xyz[0] * xyz[0])
    out = atoms.groupBy(*keys).agg(
        F.count("*").cast("int").alias("atom_count"), F.countDistinct("chain").cast("int").alias("chain_count"),
        F.countDistinct(F.when(~F.col("is_hetatm"), F.struct("chain", "resid"))).cast("int").alias("residue_count"), F.max("model").alias("model_count"),
        *[F.avg(c).alias(f"centroid_{a}") for c, a in zip(xyz, _AXES, strict=True)], F.avg(square).alias("_square"),
        *[f(c).alias(f"{n}_{a}") for c, a in zip(xyz, _AXES, strict=True) for n, f in (("min", F.min), ("max", F.max))],
    )
    centre = sum((F.col(f"centroid_{a}") ** 2 for a in "yz"), F.col("centroid_x") ** 2)
    return out.withColumn("radius_of_gyration", F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - centre))).drop("_square")
