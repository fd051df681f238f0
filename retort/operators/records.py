"""Loading CSV records of mixed quality: typed rows on one side, rejected records with reason and offset on the other.

The quoting rules of RFC 4180 are a five-state automaton. A record is cut into
chunks; each chunk's effect is the map *state at its start -> state at its end*,
found for all chunks and all start states at once; the maps are composed along
the record (a segmented scan), which gives every chunk its true start state, and
a second pass marks fields. Nothing is done record by record in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from retort.kernel import mol

START, PLAIN, QUOTED, QUOTE, WRONG = range(5)
COMMA, MARK, BREAK, OTHER, NONE = range(5)
#: _NEXT[state, class]: a quote only opens a field, only a quote, a comma or the end follows a closing one,
#: and a line break stands only within quotes.
_NEXT = np.array(
    [
        [START, QUOTED, WRONG, PLAIN, START],
        [START, WRONG, WRONG, PLAIN, PLAIN],
        [QUOTED, QUOTE, QUOTED, QUOTED, QUOTED],
        [START, QUOTED, WRONG, WRONG, QUOTE],
        [WRONG, WRONG, WRONG, WRONG, WRONG],
    ],
    np.uint8,
)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[ord(","), ord('"'), ord("\n"), ord("\r")]] = COMMA, MARK, BREAK, BREAK
#: Bytes of one chunk.
CHUNK = 128
TOKENS = T.StructType([T.StructField("error_at", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])


def tokenize(array: pa.Array) -> pa.Array:
    """Per record: character offset of the first quoting error (else null), unquoted fields, and where each begins.

    A null record has no fields and no error; an empty one has one empty field.
    """
    array = array.cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = array.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    begin, size = bounds[:-1] - bounds[0], np.diff(bounds)
    parts = np.maximum(1, -(-size // CHUNK))
    owner = np.repeat(np.arange(n), parts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = begin[owner] + rank * CHUNK
    left = np.minimum(CHUNK, size[owner] - rank * CHUNK)
    classes = np.append(_CLASS[data], np.uint8(NONE))

    def column(j: int) -> np.ndarray:
        return classes[np.where(j < left, at + j, len(data))]

    width = int(left.max(initial=0))
    effect = np.tile(np.arange(5, dtype=np.uint8), (len(owner), 1))
    for j in range(width):
        effect = _NEXT[effect, column(j)[:, None]]
    step = 1
    while step <= rank.max(initial=0):
        late = np.flatnonzero(rank >= step)
        effect[late] = np.take_along_axis(effect[late], effect[late - step].astype(np.intp), 1)
        step *= 2
    state = np.where(rank > 0, np.roll(effect[:, START], 1), np.uint8(START)) if len(owner) else np.zeros(0, np.uint8)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for j in range(width):
        here = np.flatnonzero(j < left)
        spot = at[here] + j
        before[spot] = state[here]
        state[here] = _NEXT[state[here], classes[spot]]
        after[spot] = state[here]

    ends = state[np.cumsum(parts) - 1] if n else np.zeros(0, np.uint8)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    record = np.repeat(np.arange(n), size)

    def first(hit: np.ndarray) -> np.ndarray:
        """Per record the character offset of its first hit, -1 if none."""
        spots = np.flatnonzero(hit)
        rec, idx = np.unique(record[spots], return_index=True)
        out = np.full(n, -1, np.int64)
        out[rec] = chars[spots[idx]] - chars[begin[rec]]
        return out

    opening = (before == START) & (after == QUOTED)
    last_open = _last(opening, record, chars, begin, n)
    wrong = first((before != WRONG) & (after == WRONG))
    error = np.where(wrong >= 0, wrong, np.where(ends == QUOTED, last_open, -1))

    # A comma that leaves the automaton at START ends a field; quotes that open or close are dropped, the second of a pair is kept.
    comma = (classes[: len(data)] == COMMA) & (after == START)
    keep = ~comma & ~((classes[: len(data)] == MARK) & ((before == START) | (before == QUOTED)))
    kept = np.concatenate([[0], np.cumsum(keep)])
    fields = np.where(array.is_null().to_numpy(zero_copy_only=False), 0, 1) + np.bincount(record[comma], minlength=n).astype(np.int64)
    commas = np.flatnonzero(comma)
    firsts = np.cumsum(fields) - fields
    starts = np.zeros(int(fields.sum()), np.int64)
    slot_first = firsts[fields > 0]
    is_first = np.zeros(len(starts), bool)
    is_first[slot_first] = True
    starts[is_first] = begin[fields > 0]
    starts[~is_first] = commas + 1
    # Kept bytes are consecutive over records, so the end of a field is the start of the next one.
    marks = np.append(kept[starts], kept[-1]).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(marks), pa.py_buffer(data[keep].tobytes())).cast(pa.string())
    lists = np.append(firsts, fields.sum()).astype(np.int32)
    from_record = np.repeat(begin, fields)
    places = (chars[starts] - chars[from_record]).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(error.astype(np.int32), mask=error < 0), pa.ListArray.from_arrays(pa.array(lists), strings), pa.ListArray.from_arrays(pa.array(lists), pa.array(places))],
        ["error_at", "fields", "starts"],
    )


def _last(hit: np.ndarray, record: np.ndarray, chars: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    spots = np.flatnonzero(hit)
    out = np.full(n, -1, np.int64)
    out[record[spots]] = chars[spots] - chars[begin[record[spots]]]
    return out


# Declared not deterministic, so that a filter on what comes of it stays above and records are tokenized once.
_tokenize = arrow_udf(tokenize, TOKENS).asNondeterministic()


def tokenized(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with ``error_at``, ``fields`` and ``starts`` of every record, as ``tokenize`` gives them; columns of these names are replaced."""
    kept = df.drop(*TOKENS.names).columns
    return df.select(*kept, _tokenize(F.col(line)).alias("_t")).select(*kept, *[F.col(f"_t.{n}").alias(n) for n in TOKENS.names])


def _valid(texts: pa.Array) -> pa.Array:
    return pa.array([mol.is_valid(t) for t in texts.to_pylist()], pa.bool_())


_smiles_ok = arrow_udf(_valid, T.BooleanType()).asNondeterministic()


def count_ok(text: Column) -> Column:
    """Empty, or ASCII digits whose number an INT holds."""
    digits = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
    return (text == "") | (text.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 10) & (F.substring(digits, 1, 10).try_cast("bigint") <= 2147483647))


def flag_ok(text: Column) -> Column:
    """Empty, or true or false in any letter case."""
    return text.rlike(r"\A(?i:true|false)?\z")


def inchi_ok(text: Column) -> Column:
    return text.startswith("InChI=") & (F.octet_length(text) > 8)


@dataclass(frozen=True)
class Feed:
    """Column names in file order, what each must satisfy (a text column to a boolean one), and its type."""

    columns: tuple[str, ...]
    rules: dict
    types: dict


SMILES = Feed(
    ("name", "smiles", "expected_formula", "expected_atoms", "expected_bonds"),
    {"smiles": lambda c: _smiles_ok(c), "expected_atoms": count_ok, "expected_bonds": count_ok},
    {"expected_atoms": "int", "expected_bonds": "int"},
)
INCHI = Feed(
    ("name", "inchi", "expected_formula", "has_stereo", "stereo_centers"),
    {"inchi": inchi_ok, "has_stereo": flag_ok, "stereo_centers": count_ok},
    {"has_stereo": "boolean", "stereo_centers": "int"},
)


def check_records(df: DataFrame, feed: Feed, line: str = "line") -> DataFrame:
    """``df`` with ``_fields``, and for rejected records ``reason``, ``at`` (characters from 0) and ``column``.

    The first that holds: ``quoting``, ``column_count``, ``invalid_value``. A null record has no
    fields (``column_count``); an empty one has a single empty field. Reasons are null for good rows.
    The columns of ``df`` are kept whatever they are called, but for ``_fields``, ``reason``, ``at`` and ``column``, which are replaced.
    """
    return _checked(df, [(F.lit(True), feed)], line)


def check_feeds(df: DataFrame, feeds: dict[str, Feed], feed_col: str = "feed", line: str = "line") -> DataFrame:
    """``check_records`` for records of several feeds in one pass, each by its own feed's columns and rules; records of other feeds, and of none, are left out."""
    return _checked(df.filter(F.col(feed_col).isin(list(feeds))), [(F.col(feed_col) == name, feed) for name, feed in feeds.items()], line)


def _checked(df: DataFrame, feeds: list[tuple[Column, Feed]], line: str) -> DataFrame:
    kept = df.drop("_fields", "reason", "at", "column").columns
    out = df.drop("_fields", "reason", "at", "column").withColumn("_t", _tokenize(F.col(line)))
    fields, starts = F.col("_t.fields"), F.col("_t.starts")
    width = F.coalesce(*[F.when(mine, F.lit(len(feed.columns))) for mine, feed in feeds])
    known = F.col("_t.error_at").isNull() & (F.size(fields) == width)
    rules = [(f"_ok_{n}_{k}", k, c, mine, feed.rules[c]) for n, (mine, feed) in enumerate(feeds) for k, c in enumerate(feed.columns) if c in feed.rules]
    # Every rule is evaluated as a column of its own first, so that a Python rule runs once, and only sees its feed's values.
    out = out.select(*kept, "_t", *[rule(F.when(known & mine, F.get(fields, F.lit(k)))).alias(name) for name, k, _, mine, rule in rules])
    wrong = [(mine & ~F.col(name), k, c) for name, k, c, mine, _ in rules]
    bad = F.coalesce(*[F.when(w, F.lit(c)) for w, _, c in wrong])
    bad_at = F.coalesce(*[F.when(w, F.get(starts, F.lit(k))) for w, k, _ in wrong])
    many = F.size(fields) > width
    return out.select(
        *kept,
        F.when(known, fields).alias("_fields"),
        F.when(F.col("_t.error_at").isNotNull(), "quoting").when(~known, "column_count").when(bad.isNotNull(), "invalid_value").alias("reason"),
        F.coalesce("_t.error_at", F.when(known, bad_at).when(many, F.get(starts, width)).otherwise(F.coalesce(F.length(line), F.lit(0)))).alias("_at"),
        F.when(known, bad).alias("column"),
    ).withColumn("_at", F.when(F.col("reason").isNotNull(), F.col("_at"))).withColumnRenamed("_at", "at")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).drop("_fields")


def typed(checked: DataFrame, feed: Feed, keep: list[str]) -> DataFrame:
    """The good records as typed columns after the columns named in ``keep``; empty counts and flags are null."""
    values = []
    for k, c in enumerate(feed.columns):
        text = F.get(F.col("_fields"), F.lit(k))
        values.append((F.nullif(text, F.lit("")).cast(feed.types[c]) if c in feed.types else text).alias(c))
    return checked.filter(F.col("reason").isNull()).select(*keep, *values)
