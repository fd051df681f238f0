"""Functions of molecule texts as columns.

Every function is an Arrow UDF over a text column; a worker keeps the molecules
it parsed last, so that several functions in one projection (which Spark runs in
one Python worker) parse each text once. ``profile`` goes further: it computes
any set of fields in one pass over the distinct texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from retort.kernel import descriptors as D
from retort.kernel import mol as M
from retort.kernel import selfies, smarts
from retort.kernel import structures as S
from retort.kernel.jsontext import dumps
from retort.kernel.morgan import morgan_bits
from retort.kernel.report import admet_json
from retort.operators.skew import join_back
from retort.session import spread, tasks, written
from retort.kernel.writer import canonical_smiles, verbose_smiles, with_hydrogens

#: Molecules a worker remembers.
REMEMBERED = 16_384
#: Texts longer than this are parsed each time, so that what is remembered stays small.
SHORT = 2_000

@lru_cache(maxsize=REMEMBERED)
def _parsed(text: str) -> M.Molecule | None:
    return M.parse(text)



def molecule(text: str | None) -> M.Molecule | None:
    if text is None:
        return None
    return _parsed(text) if len(text) <= SHORT else M.parse(text)


BOOL, INT, DOUBLE, TEXT, BITS, WORDS = T.BooleanType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.ArrayType(T.LongType())
_ARROW = {BOOL: pa.bool_(), INT: pa.int32(), DOUBLE: pa.float64(), TEXT: pa.string(), BITS: pa.binary(), WORDS: pa.list_(pa.int64())}


@dataclass(frozen=True)
class Field:
    """A function of a valid molecule and its type; texts that aren't valid and nulls give null."""

    kind: T.DataType
    make: Callable


def _ring(aromatic=None, saturated=None, hetero=None) -> Callable:
    """Number of rings of a class; None where either will do."""
    want = (aromatic, saturated, hetero)
    return lambda m: sum(all(w is None or w == x for w, x in zip(want, row, strict=True)) for row in D.ring_classes(m))


def _circular(m: M.Molecule) -> bytes:
    return m.once("circular", morgan_bits)


def _keys(m: M.Molecule) -> bytes:
    return m.once("keys", D.structural_keys)


def _words(bits: bytes) -> list[int]:
    """A bit vector as 64-bit words, the last one shorter, as ``similarity.words`` makes them."""
    return [int.from_bytes(bits[i : i + 8], "big", signed=len(bits) >= i + 8) for i in range(0, len(bits), 8)]


FIELDS: dict[str, Field] = {
    "mol_formula": Field(TEXT, D.formula),
    "mol_num_atoms": Field(INT, D.heavy_atoms),
    "mol_num_bonds": Field(INT, lambda m: len(m.bonds)),
    "mol_weight": Field(DOUBLE, D.weight),
    "mol_exact_mass": Field(DOUBLE, D.exact_mass),
    "logp_crippen": Field(DOUBLE, D.logp),
    "mol_mr": Field(DOUBLE, D.molar_refractivity),
    "tpsa": Field(DOUBLE, D.polar_surface),
    "qed": Field(DOUBLE, D.qed),
    "num_h_acceptors": Field(INT, D.acceptors),
    "num_h_donors": Field(INT, D.donors),
    "num_rotatable_bonds": Field(INT, D.rotatable_bonds),
    "ring_count": Field(INT, lambda m: len(m.rings)),
    "num_heteroatoms": Field(INT, D.heteroatoms),
    "fraction_csp3": Field(DOUBLE, D.fraction_csp3),
    "num_aromatic_rings": Field(INT, _ring(aromatic=True)),
    "num_aliphatic_rings": Field(INT, _ring(aromatic=False)),
    "num_saturated_rings": Field(INT, _ring(saturated=True)),
    "num_aromatic_heterocycles": Field(INT, _ring(aromatic=True, hetero=True)),
    "num_aromatic_carbocycles": Field(INT, _ring(aromatic=True, hetero=False)),
    "num_saturated_heterocycles": Field(INT, _ring(saturated=True, hetero=True)),
    "num_saturated_carbocycles": Field(INT, _ring(saturated=True, hetero=False)),
    "num_aliphatic_heterocycles": Field(INT, _ring(aromatic=False, hetero=True)),
    "num_aliphatic_carbocycles": Field(INT, _ring(aromatic=False, hetero=False)),
    "canonical_smiles": Field(TEXT, canonical_smiles),
    "murcko_scaffold": Field(TEXT, S.murcko),
    "generic_scaffold": Field(TEXT, S.generic),
    "ring_systems_json": Field(TEXT, lambda m: dumps(S.ring_systems(m))),
    "largest_fragment": Field(TEXT, S.largest_fragment),
    "strip_salts": Field(TEXT, S.strip_salts),
    "neutralize_charges": Field(TEXT, S.neutralized),
    "normalize_smiles": Field(TEXT, S.normalized),
    "fragment_parent": Field(TEXT, S.fragment_parent),
    "scaffold_network_json": Field(TEXT, lambda m: dumps(S.scaffold_network(m))),
    "add_hydrogens": Field(TEXT, lambda m: verbose_smiles(with_hydrogens(m))),
    "admet_json": Field(TEXT, admet_json),
    "structural_alerts_json": Field(TEXT, lambda m: dumps(D.alerts(m))),
    "structural_alert_count": Field(INT, lambda m: len(D.alerts(m))),
    "maccs_keys": Field(BITS, _keys),
    "morgan_fp_bits": Field(BITS, _circular),
    "maccs_keys_words": Field(WORDS, lambda m: _words(_keys(m))),
    "morgan_fp_bits_words": Field(WORDS, lambda m: _words(_circular(m))),
    "total_atoms": Field(INT, D.total_atoms),
    "num_carbons": Field(INT, lambda m: m.sym.count("C")),
}
#: Fields that are no functions of their own in SQL.
INNER = ("total_atoms", "num_carbons", "maccs_keys_words", "morgan_fp_bits_words")


def _column(make: Callable, kind: T.DataType, name: str):
    """A UDF of row values; equal rows of a batch are computed once."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        done = {}
        for row in rows:
            if row not in done:
                done[row] = make(*row)
        return pa.array([done[row] for row in rows], _ARROW[kind])

    run.__name__ = name
    return arrow_udf(run, kind)


def _of_molecule(make: Callable) -> Callable:
    def run(text: str | None):
        m = molecule(text)
        return None if m is None else make(m)

    return run


UDFS = {name: _column(_of_molecule(f.make), f.kind, name) for name, f in FIELDS.items()}


def _pattern(text: str | None) -> smarts.Pattern | None:
    return smarts.compile_pattern(text)


def _matched(make: Callable) -> Callable:
    def run(text: str | None, pattern: str | None):
        m, p = molecule(text), _pattern(pattern)
        return None if m is None or p is None else make(p, smarts.view_of(m))

    return run


def _matches_json(p: smarts.Pattern, view: smarts.View) -> str:
    rows = []
    for n, spots in enumerate(p.unique(view), 1):
        atoms = [{"query_atom": q, "target_atom": t + 1, "symbol": view.sym[t]} for q, t in enumerate(spots, 1)]
        rows.append({"match": n, "atom_indices": [t + 1 for t in spots], "atoms": atoms})
    return dumps(rows)


def _pair(make: Callable) -> Callable:
    def run(a: str | None, b: str | None):
        x, y = molecule(a), molecule(b)
        return None if x is None or y is None else make(x, y)

    return run


def _hashed(text: str | None, method: str | None):
    m = molecule(text)
    return None if m is None else S.mol_hash(m, method)


#: Bits a fingerprint may have at most.
MOST_BITS = 131_072


def _morgan(text: str | None, radius: int | None, n_bits: int | None):
    m = molecule(text)
    if m is None or radius is None or n_bits is None or radius < 0 or not 0 < n_bits <= MOST_BITS:
        return None
    return morgan_bits(m, radius, n_bits)


def _mcs_json(a, b):
    found = S.mcs(a, b)
    return None if found is None else dumps(found)


UDFS |= {
    "mol_is_valid": _column(lambda t: None if t is None else M.is_valid(t), BOOL, "mol_is_valid"),
    "mol_has_substructure": _column(_matched(lambda p, v: p.found(v)), BOOL, "mol_has_substructure"),
    "mol_substructure_count": _column(_matched(lambda p, v: p.count(v)), INT, "mol_substructure_count"),
    "mol_substructure_matches_json": _column(_matched(_matches_json), TEXT, "mol_substructure_matches_json"),
    "mcs_smarts": _column(_pair(S.mcs_smarts), TEXT, "mcs_smarts"),
    "mcs_json": _column(_pair(_mcs_json), TEXT, "mcs_json"),
    "mol_hash": _column(_hashed, TEXT, "mol_hash"),
    "morgan_fp": _column(_morgan, BITS, "morgan_fp"),
    "smiles_to_selfies": _column(selfies.encode, TEXT, "smiles_to_selfies"),
    "selfies_to_smiles": _column(selfies.decode, TEXT, "selfies_to_smiles"),
}


def call(name: str, *columns: Column | str) -> Column:
    """A function by its SQL name."""
    return UDFS[name](*columns)


def hash_methods() -> Column:
    return F.lit(dumps(list(S.HASH_METHODS)))


def _profile_udf(fields: tuple[str, ...]):
    schema = T.StructType([T.StructField("valid", BOOL), *[T.StructField(f, FIELDS[f].kind) for f in fields]])

    def run(texts: pa.Array) -> pa.Array:
        # Equal texts of a batch are computed once.
        coded = texts.dictionary_encode()
        columns: list[list] = [[] for _ in schema]
        for m in map(molecule, coded.dictionary.to_pylist()):
            columns[0].append(m is not None)
            for values, f in zip(columns[1:], fields, strict=True):
                values.append(None if m is None else FIELDS[f].make(m))
        return pa.StructArray.from_arrays([pa.array(v, _ARROW[s.dataType]).take(coded.indices) for v, s in zip(columns, schema, strict=True)], schema.names)

    # Not deterministic by declaration: a filter on the result must not be pushed below and run the UDF a second time.
    return arrow_udf(run, schema).asNondeterministic()


def profile(df: DataFrame, text_col: str, fields: list[str], distinct: bool = False) -> DataFrame:
    """``df`` with one column per field (and ``valid``), all from one parse of each text.

    With ``distinct`` each different text is computed once and joined back - worth it where texts repeat a lot and fields are dear.
    Hot texts and nulls stay spread over the tasks. Columns of ``df`` with a field's name are replaced. Null texts have null fields and ``valid`` null.
    """
    fields = list(dict.fromkeys(fields))
    keep = [c for c in df.columns if c not in (*fields, "valid")]
    make = _profile_udf(tuple(fields))
    picked = [F.when(F.col(text_col).isNotNull(), F.col("_profile.valid")).alias("valid"), *[F.col(f"_profile.{f}").alias(f) for f in fields]]
    if not distinct:
        return spread(df).select(*keep, make(F.col(text_col)).alias("_profile")).select(*keep, *picked)
    texts = df.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("_text")).agg(F.count("*").alias("_n"))
    # Each text is computed once and written, since it is counted and then joined back. By another hash than the grouping's, or the two shuffles would become one that is merged.
    made = written(texts.repartition(tasks(df.sparkSession), F.xxhash64("_text")).select("_text", "_n", make(F.col("_text")).alias("_profile")), "profile")
    out = join_back(df.select(*keep, F.col(text_col).alias("_text")), made, "_text", "_n")
    return out.select(*keep, *picked)
