"""Normal forms of texts: vectorised Arrow steps where the JVM has no or a slow function, the rest as native expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Dash characters read as hyphen-minus, after NFKC.
DASHES = "‐‑‒–—―−"
# Characters a structure text keeps, as the inside of a character class.
STRUCTURE_CHARS = r"A-Za-z0-9()\[\]=#\-+@/\\%:.*"
# Author texts that name nobody.
NOBODY = ("unknown", "anonymous", "n/a")


@arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility form; null stays null."""
    return pc.utf8_normalize(texts, form="NFKC")


def _structures(texts: pa.Array) -> pa.Array:
    plain = pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFKC"), f"[{DASHES}]", "-")
    plain = pc.replace_substring_regex(plain, f"[^{STRUCTURE_CHARS}]+", "")
    plain = pc.replace_substring(pc.replace_substring(plain, "CL", "Cl"), "BR", "Br")
    plain = pc.utf8_trim(pc.replace_substring_regex(plain, r"\.\.+", "."), ".")
    parts = pc.split_pattern(plain, ".")
    return pc.if_else(pc.equal(plain, ""), pa.scalar(None, parts.type), parts)


_structure = arrow_udf(_structures, T.ArrayType(T.StringType()))


def structure(text: Column) -> Column:
    """The components of a structure text in written order, repeats kept; null if there are none. One vectorised step outside the JVM, whose result is a plain column."""
    return _structure(text)


def name_key(text: Column) -> Column:
    """Letters and digits of the lower-case compatibility form."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]", "")


def author_key(text: Column) -> Column:
    """The set of runs of letters or digits in the lower-case compatibility form, as a sorted array; null if it names nobody."""
    plain = F.lower(nfkc(text))
    runs = F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))
    return F.when((F.size(runs) > 0) & ~F.trim(F.regexp_replace(plain, r"\s+", " ")).isin(*NOBODY), runs)
