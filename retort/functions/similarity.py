"""Fingerprint similarity as native expressions over 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(bits: Column) -> Column:
    """A bit vector as 64-bit words, the last one shorter; the order of bits within a word doesn't matter for counts."""
    n = F.ceil(F.octet_length(bits) / F.lit(8.0)).cast("int")
    word = lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), word))


def popcount(w: Column) -> Column:
    return F.aggregate(w, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)


def folded(w: Column, n: int) -> Column:
    """The words folded to n by exclusive or: word k of the result is that of words k, k + n, k + 2 n, ..."""

    def one(k: int) -> Column:
        return F.aggregate(F.filter(w, lambda x, i: i % n == k), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))

    return F.array(*[one(k) for k in range(n)])


def differing(a: Column, b: Column) -> Column:
    """Bits in which two arrays of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0.0)))


def of_counts(name: str, c: Column, na: Column, nb: Column, n_bits: Column | None = None, alpha: Column | None = None, beta: Column | None = None) -> Column:
    """A similarity by name from the common and own bit counts; 0 where its denominator is 0."""
    c, na, nb = c.cast("double"), na.cast("double"), nb.cast("double")
    if name == "tversky_bit":
        bottom = alpha * na + beta * nb + (1 - alpha - beta) * c
        return F.when((na == 0) | (nb == 0), 0.0).when(bottom == 0, 1.0).otherwise(c / F.nullif(bottom, F.lit(0.0)))
    return {
        "tanimoto_bit": lambda: _ratio(c, na + nb - c),
        "dice_bit": lambda: _ratio(2 * c, na + nb),
        "cosine_bit": lambda: _ratio(c, F.sqrt(na * nb)),
        "kulczynski_bit": lambda: _ratio(c * (na + nb), 2 * na * nb),
        "sokal_bit": lambda: F.when((na == 0) | (nb == 0), 0.0).otherwise(_ratio(c, 2 * na + 2 * nb - 3 * c)),
        "mcconnaughey_bit": lambda: _ratio(c * (na + nb) - na * nb, na * nb),
        "asymmetric_bit": lambda: _ratio(c, F.least(na, nb)),
        "braun_blanquet_bit": lambda: _ratio(c, F.greatest(na, nb)),
        "russel_bit": lambda: _ratio(c, n_bits.cast("double")),
    }[name]()


NAMES = ("tanimoto_bit", "dice_bit", "cosine_bit", "kulczynski_bit", "sokal_bit", "mcconnaughey_bit", "asymmetric_bit", "braun_blanquet_bit", "russel_bit", "tversky_bit")


def call(name: str, a: Column, b: Column, alpha: float | Column | None = None, beta: float | Column | None = None) -> Column:
    """A similarity of two bit vectors (binary columns). Vectors of unequal length, and weights outside [0, 1], raise an error; nulls give null."""
    wa, wb = words(a), words(b)
    alpha, beta = (None if x is None else x if isinstance(x, Column) else F.lit(float(x)) for x in (alpha, beta))
    value = of_counts(name, common(wa, wb), popcount(wa), popcount(wb), 8 * F.octet_length(a), alpha, beta)
    size = lambda x: F.octet_length(x).cast("string")
    unequal = F.raise_error(F.concat(F.lit(f"{name}: BLOB lengths differ ("), size(a), F.lit(" vs "), size(b), F.lit(" bytes)"))).cast("double")
    out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
    if name == "tversky_bit":
        wrong = F.raise_error(F.lit("tversky_bit: alpha and beta must both be in [0, 1]")).cast("double")
        out = F.when(a.isNull() | b.isNull() | alpha.isNull() | beta.isNull(), F.lit(None).cast("double")).when(~(alpha.between(0, 1) & beta.between(0, 1)), wrong)
    return out.when(F.octet_length(a) != F.octet_length(b), unequal).otherwise(value)
