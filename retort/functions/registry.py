"""All functions under their SQL names."""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from retort.functions import dockings, inchi, molecules, texts3d
from retort.functions.molecules import INT, TEXT, _column, molecule
from retort.kernel import structures
from retort.kernel.report import FORGIVES, RULE_NAMES, broken, descriptors


def _violations(text):
    m = molecule(text)
    return None if m is None else len(broken(descriptors(m), "Lipinski"))


def _pass(text, rule):
    if text is None or rule is None:
        return None
    m = molecule(text)
    if m is None:
        return -1
    name = RULE_NAMES.get(rule.lower())
    return -2 if name is None else int(len(broken(descriptors(m), name)) <= FORGIVES.get(name, 0))


def _words(x: str) -> str:
    return (
        f"CASE WHEN octet_length({x}) = 0 THEN cast(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, cast(ceil(octet_length({x}) / 8.0) AS INT) - 1), "
        f"i -> cast(conv(hex(substring({x}, i * 8 + 1, 8)), 16, -10) AS BIGINT)) END"
    )


def _counts(x: str) -> str:
    return f"aggregate({_words(x)}, 0, (t, w) -> t + bit_count(w))"


_COMMON = f"aggregate(zip_with({_words('a')}, {_words('b')}, (v, w) -> bit_count(v & w)), 0, (t, w) -> t + w)"
# Similarities over common bits c and own bits p, q.
_RATIOS = {
    "tanimoto_bit": ("c", "p + q - c"), "dice_bit": ("2 * c", "p + q"), "cosine_bit": ("c", "sqrt(p * q)"), "kulczynski_bit": ("c * (p + q)", "2 * p * q"),
    "sokal_bit": ("c", "if(p = 0 OR q = 0, 0, 2 * p + 2 * q - 3 * c)"), "mcconnaughey_bit": ("c * (p + q) - p * q", "p * q"),
    "asymmetric_bit": ("c", "least(p, q)"), "braun_blanquet_bit": ("c", "greatest(p, q)"), "russel_bit": ("c", "8 * n"),
}


def similarity_sql() -> dict[str, tuple[str, str, str]]:
    """Arguments, type and expression of the similarity functions."""
    held = f"struct(cast({_COMMON} AS DOUBLE) AS c, cast({_counts('a')} AS DOUBLE) AS p, cast({_counts('b')} AS DOUBLE) AS q, cast(octet_length(a) AS DOUBLE) AS n)"
    out = {}
    for name, (top, bottom) in _RATIOS.items():
        import re

        of = lambda e: re.sub(r"\b([cpqn])\b", r"v.\1", e)
        ratio = f"transform(array({held}), v -> if({of(bottom)} = 0, 0D, ({of(top)}) / nullif({of(bottom)}, 0)))[0]"
        out[name] = ("a BINARY, b BINARY", "DOUBLE", f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN octet_length(a) <> octet_length(b) THEN {_unequal(name)} ELSE {ratio} END")
    bottom = "(alpha * v.p + beta * v.q + (1 - alpha - beta) * v.c)"
    ratio = f"transform(array({held}), v -> CASE WHEN v.p = 0 OR v.q = 0 THEN 0D WHEN {bottom} = 0 THEN 1D ELSE v.c / nullif({bottom}, 0) END)[0]"
    wrong = "cast(raise_error('tversky_bit: alpha and beta must both be in [0, 1]') AS DOUBLE)"
    out["tversky_bit"] = (
        "a BINARY, b BINARY, alpha DOUBLE, beta DOUBLE", "DOUBLE",
        f"CASE WHEN a IS NULL OR b IS NULL OR alpha IS NULL OR beta IS NULL THEN NULL WHEN NOT (alpha BETWEEN 0 AND 1 AND beta BETWEEN 0 AND 1) THEN {wrong} "
        f"WHEN octet_length(a) <> octet_length(b) THEN {_unequal('tversky_bit')} ELSE {ratio} END",
    )
    return out


def _unequal(name: str) -> str:
    return f"cast(raise_error(concat('{name}: BLOB lengths differ (', octet_length(a), ' vs ', octet_length(b), ' bytes)')) AS DOUBLE)"


_PY = {
    "lipinski_violations": _column(_violations, INT, "lipinski_violations"),
    "druglikeness_pass": _column(_pass, INT, "druglikeness_pass"),
}


def python_functions() -> dict:
    """Functions that run in Python workers, by SQL name."""
    out = {n: u for n, u in molecules.UDFS.items() if n not in (*molecules.INNER, "morgan_fp")}
    return out | texts3d.UDFS | dockings.UDFS | _PY


def selfies_is_valid(text: Column) -> Column:
    """Whether a text has a token's brackets; null for null."""
    return F.contains(text, F.lit("[")) & F.contains(text, F.lit("]"))


def native_functions() -> dict[str, tuple[str, str, str]]:
    """Functions that are SQL expressions: arguments, type, expression."""
    methods = json.dumps(list(structures.HASH_METHODS), separators=(",", ":"))
    return inchi.SQL | similarity_sql() | {
        "mol_hash_methods": ("", "STRING", f"'{methods}'"),
        "selfies_is_valid": ("s STRING", "BOOLEAN", "contains(s, '[') AND contains(s, ']')"),
    }


def register_all(spark: SparkSession) -> list[str]:
    """All functions for ``spark.sql`` in this session; their names.

    Where a function has two forms, the shorter one is filled up: ``morgan_fp_bits(smiles)`` has radius 2 and 2048 bits, ``dock`` without a pH takes 7.4.
    The list metrics (roc_auc, enrichment_factor, bedroc) are SQL expressions as well.
    """
    names = []
    for name, udf in python_functions().items():
        if name not in ("morgan_fp_bits", "dock"):
            spark.udf.register(name, udf)
            names.append(name)
    spark.udf.register("_morgan_fp", molecules.UDFS["morgan_fp"])
    spark.udf.register("_dock", dockings.UDFS["dock"])
    native = native_functions() | {
        "morgan_fp_bits": ("smiles STRING, radius INT DEFAULT 2, n_bits INT DEFAULT 2048", "BINARY", "_morgan_fp(smiles, radius, n_bits)"),
        "dock": (
            "smiles STRING, pdb STRING, cx DOUBLE, cy DOUBLE, cz DOUBLE, sx DOUBLE, sy DOUBLE, sz DOUBLE, n_runs INT, seed BIGINT, ph DOUBLE DEFAULT 7.4", "STRING",
            "_dock(smiles, pdb, cx, cy, cz, sx, sy, sz, n_runs, seed, ph)",
        ),
    }
    native |= dockings.METRICS_SQL
    for name, (arguments, kind, expression) in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {expression}")
        names.append(name)
    return sorted(names)
