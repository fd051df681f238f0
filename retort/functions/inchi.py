"""InChI and InChIKey parts as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SQL of each function over its argument(s) ``s`` (``a``, ``b``): type and expression. Null in, null out.
SQL: dict[str, tuple[str, str, str]] = {
    "inchi_is_valid": ("s STRING", "BOOLEAN", "startswith(s, 'InChI=') AND octet_length(s) > 8"),
    "inchi_is_standard": ("s STRING", "BOOLEAN", "startswith(s, 'InChI=1S/') AND octet_length(s) > 8"),
}
_VALID = "startswith(s, 'InChI=') AND octet_length(s) > 8"


def _if_valid(expression: str) -> str:
    return f"CASE WHEN {_VALID} THEN {expression} END"


# Which letter opens which layer.
LAYERS = {"inchi_connections": "c", "inchi_hydrogens": "h", "inchi_charge": "q", "inchi_stereo_bond": "b", "inchi_stereo_tetrahedral": "t"}
SQL["inchi_version"] = ("s STRING", "STRING", _if_valid("CASE WHEN instr(s, '/') > 0 THEN regexp_extract(s, '^InChI=([^/]*)/', 1) END"))
SQL["inchi_formula"] = ("s STRING", "STRING", _if_valid("nullif(regexp_extract(s, '^InChI=[^/]*/([^/]*)', 1), '')"))
for _name, _letter in LAYERS.items():
    SQL[_name] = ("s STRING", "STRING", _if_valid(f"regexp_extract(s, '/{_letter}([^/]*)', 1)"))
SQL["inchi_has_stereo"] = ("s STRING", "BOOLEAN", f"{_VALID} AND (contains(s, '/b') OR contains(s, '/t'))")
_T = "regexp_extract(s, '/t([^/]*)', 1)"
SQL["inchi_num_stereo_centers"] = ("s STRING", "INT", _if_valid(f"CASE WHEN {_T} = '' THEN 0 ELSE size(split({_T}, ',')) END"))
SQL["inchikey_is_valid"] = ("s STRING", "BOOLEAN", r"s RLIKE '\\A[A-Z]{14}-[A-Z]{10}-[A-Z]\\z'")
# Parts of a key are cut by bytes, whether the key is valid or not.
SQL["inchikey_connectivity"] = ("s STRING", "STRING", "CASE WHEN octet_length(s) >= 14 THEN decode(substring(encode(s, 'utf-8'), 1, 14), 'utf-8') END")
SQL["inchikey_stereo"] = ("s STRING", "STRING", "CASE WHEN octet_length(s) >= 25 THEN decode(substring(encode(s, 'utf-8'), 16, 10), 'utf-8') END")
SQL["inchikey_protonation"] = ("s STRING", "STRING", "CASE WHEN octet_length(s) = 27 THEN decode(substring(encode(s, 'utf-8'), 27, 1), 'utf-8') END")


def layer_sql(text: str, letter: str) -> str:
    """A layer, null where it is absent (which an empty one isn't)."""
    return f"CASE WHEN instr({text}, '/{letter}') > 0 THEN regexp_extract({text}, '/{letter}([^/]*)', 1) END"


def _skeleton_sql(text: str) -> str:
    return f"struct(nullif(regexp_extract({text}, '^InChI=[^/]*/([^/]*)', 1), ''), {layer_sql(text, 'c')}, {layer_sql(text, 'h')})"


def _both_valid() -> str:
    return " AND ".join(_VALID.replace("(s", f"({x}") for x in "ab")


SQL["inchi_skeleton_match"] = ("a STRING, b STRING", "BOOLEAN", f"CASE WHEN {_both_valid()} THEN {_skeleton_sql('a')} <=> {_skeleton_sql('b')} END")


def call(name: str, column: str, other: str | None = None) -> Column:
    """A function applied to a named column (or two)."""
    sql = SQL[name][2]
    import re

    names = {"s": column} if other is None else {"a": column, "b": other}
    quoted = re.sub(r"'(?:[^'\\]|\\.)*'|\b([sab])\b", lambda m: f"`{names[m[1]]}`" if m[1] in names else m[0], sql)
    return F.expr(quoted)


def skeleton(column: str) -> Column:
    """What two identifiers of one skeleton share, as a text key for joins and groups; null if invalid."""
    c = f"`{column}`"
    parts = ", ".join(f"coalesce({p}, '\\0')" for p in (f"nullif(regexp_extract({c}, '^InChI=[^/]*/([^/]*)', 1), '')", layer_sql(c, "c"), layer_sql(c, "h")))
    return F.expr(f"CASE WHEN {_VALID.replace('(s', '(' + c)} THEN concat_ws('/', {parts}) END")


def skeleton_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Rows whose identifiers share formula, connections and hydrogens, as an equi-join on the skeleton key; invalid and null ones match nothing.

    Columns keep their names, those on both sides get the suffixes ``_l`` and ``_r``.
    """
    both = set(left.columns) & set(right.columns)
    x = left.select(*[F.col(c).alias(f"{c}_l" if c in both else c) for c in left.columns], skeleton(left_col).alias("_skeleton"))
    y = right.select(*[F.col(c).alias(f"{c}_r" if c in both else c) for c in right.columns], skeleton(right_col).alias("_skeleton"))
    return x.join(y, "_skeleton").drop("_skeleton")
