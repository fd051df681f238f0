"""Typed twins of the functions that give JSON texts, table functions for LATERAL, and aggregates of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.pandas.types import to_arrow_type

from retort.functions.molecules import molecule
from retort.functions.texts3d import SITE, _sites
from retort.kernel import descriptors as D
from retort.kernel import smarts
from retort.kernel import structures as S

_INT, _TEXT, _FLAG = T.IntegerType(), T.StringType(), T.BooleanType()
_INTS = T.ArrayType(_INT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


RING = _struct(index=_INT, size=_INT, aromatic=_FLAG, atoms=_INTS, bonds=_INTS)
SYSTEM = _struct(index=_INT, num_atoms=_INT, num_bonds=_INT, num_rings=_INT, aromatic=_FLAG, atoms=_INTS, bonds=_INTS, rings=T.ArrayType(RING))
NETWORK = T.StructType([T.StructField("nodes", T.ArrayType(_struct(kind=_TEXT, smiles=_TEXT))), T.StructField("edges", T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("from", "to", "kind")])))])
MATCH = _struct(match=_INT, atom_indices=_INTS, symbols=T.ArrayType(_TEXT))
COMMON = _struct(num_atoms=_INT, num_bonds=_INT, smarts=_TEXT, atoms_a=_INTS, atoms_b=_INTS)


def _typed(make, kind: T.DataType):
    """A UDF of row values to nested values; equal rows of a batch are computed once."""
    arrow = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        done: dict = {}
        for row in rows:
            if row not in done:
                done[row] = make(*row)
        return pa.array([done[row] for row in rows], arrow)

    return arrow_udf(run, kind)


def _of(make):
    def run(text: str | None):
        m = molecule(text)
        return None if m is None else make(m)

    return run


def match_rows(text: str | None, pattern: str | None) -> list[dict] | None:
    m, p = molecule(text), smarts.compile_pattern(pattern)
    if m is None or p is None:
        return None
    view = smarts.view_of(m)
    return [{"match": n, "atom_indices": [t + 1 for t in spots], "symbols": [view.sym[t] for t in spots]} for n, spots in enumerate(p.unique(view), 1)]


def _common(a: str | None, b: str | None) -> dict | None:
    x, y = molecule(a), molecule(b)
    found = None if x is None or y is None else S.mcs(x, y)
    return None if found is None else {k: found[k] for k in COMMON.names}


#: Twins by the name of the text function without ``_json``; nulls as there.
UDFS = {
    "ring_systems": _typed(_of(S.ring_systems), T.ArrayType(SYSTEM)),
    "scaffold_network": _typed(_of(S.scaffold_network), NETWORK),
    "structural_alerts": _typed(_of(D.alerts), T.ArrayType(_TEXT)),
    "mol_substructure_matches": _typed(match_rows, T.ArrayType(MATCH)),
    "mcs": _typed(_common, COMMON),
}


@udtf(returnType=MATCH)
class SubstructureMatches:
    """Rows of a pattern's matches: ``SELECT ... FROM t, LATERAL substructure_matches(t.smiles, 'C=O')``. No rows for nulls, invalid molecules and bad patterns."""

    def eval(self, smiles: str, pattern: str) -> Iterator[tuple]:
        for r in match_rows(smiles, pattern) or ():
            yield r["match"], r["atom_indices"], r["symbols"]


@udtf(returnType=SITE)
class StructureAtoms:
    """Rows of the atoms of a structure text, for LATERAL. No rows for null and empty texts."""

    def eval(self, text: str) -> Iterator[tuple]:
        for a in _sites(text) or ():
            yield tuple(v.item() if hasattr(v, "item") else v for v in a)


TABLES = {"substructure_matches": SubstructureMatches, "structure_atoms": StructureAtoms}


def register_typed(spark: SparkSession) -> list[str]:
    """Twins and table functions under their names in this session."""
    for name, f in UDFS.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
    return sorted([*UDFS, *TABLES])


def any_words(words: Column, n: int) -> Column:
    """Aggregate: the n 64-bit words of the bits that any vector of a group has on. Folded before the shuffle; nulls don't count."""
    return F.array(*[F.bit_or(F.get(words, F.lit(k))) for k in range(n)])


def all_words(words: Column, n: int) -> Column:
    """Aggregate: the n 64-bit words of the bits that all vectors of a group have on."""
    return F.array(*[F.bit_and(F.get(words, F.lit(k))) for k in range(n)])
