"""Evaluation texts leaking into training text.

Words become templates: numbers, names and units are replaced by typed
placeholders, every other word is hashed. Windows of consecutive template words
of the items are joined by hash with those of the documents; the words behind
the placeholders - the slots - then say what was found: all equal is a verbatim
leak, a consistent one-to-one exchange is a re-parameterised question.

Placeholders depend on a word's lower-case form wherever an item has the word, so
a verbatim copy has the item's template in any letter case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.skew import lookup
from retort.session import written

#: Consecutive words that make a leak.
WINDOW = 13
#: Words of a window that must be literal, not placeholders, for a re-parameterised match.
LITERALS = 7
#: Different item words, and item windows, that are sent to the executors at most (about 20 MB each); beyond, words are joined to their texts and windows are not preselected.
SENT = 1_000_000
#: Item windows (each some 100 bytes of words) up to which the items' side of the join is broadcast; beyond, the join shuffles.
SENT_WINDOWS = 50_000
#: Different words a worker remembers before it starts anew.
REMEMBERED = 1_000_000

# Units of measure, money and time that a question may be re-dressed in.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons tonne tonnes ml l litre litres liter liters gallon gallons "
    "ms s second seconds minute minutes hour hours day days night nights week weeks month months year years decade decades century centuries "
    "degree degrees celsius fahrenheit kelvin percent hz khz mhz watt watts kw volt volts joule joules mol "
    "dollar dollars euro euros cent cents crown crowns franc francs pound yen usd eur gbp".split()
)
_WORD = re.compile(r"[^\W_]+")
_NUMBER, _NAME, _UNIT = 1, 2, 3
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, as written."""
    return _WORD.findall(text) if text else []


def item_words(texts: Iterable[str]) -> tuple[set[str], set[str], set[str]]:
    """Lower-case words of texts, words that begin in lower case as written, and lower-case words that stand capitalised within a sentence."""
    vocabulary, lower, inner = set(), set(), set()
    for text in texts:
        for m in _WORD.finditer(text):
            w = m[0]
            vocabulary.add(w.lower())
            if w[0].islower():
                lower.add(w)
            elif w[0].isupper() and text[: m.start()].rstrip("\"'([ \t")[-1:] not in ("", ".", "?", "!", ":", "\n"):
                inner.add(w.lower())
    return vocabulary, lower, inner


def word_table(items: DataFrame) -> DataFrame:
    """``(word, name)``: the lower-case words of the items' ``text``, and whether each is a name: capitalised within a sentence, and never in lower case."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocabulary, lower, inner = item_words(t for t in batch.column(0).to_pylist() if t)
            words = list(vocabulary | lower)
            flags = [pa.array([w in held for w in words], pa.bool_()) for held in (vocabulary, lower, inner)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *flags], ["word", "held", "lower", "inner"])

    found = items.select("text").mapInArrow(make, "word string, held boolean, lower boolean, inner boolean")
    found = found.groupBy("word").agg(*[F.max(c).alias(c) for c in ("held", "lower", "inner")])
    return found.filter("held").select("word", (F.col("inner") & ~F.col("lower")).alias("name"))


def with_words(df: DataFrame, table: DataFrame) -> DataFrame:
    """``(id, text, words, names)``: ``df`` (id, text) with the words of each text that the word table has, and those of them that are names."""
    rows = written(df.select("id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = sorted({w.lower() for w in words_of(text.as_py())})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(words, pa.string())], ["row", "word"])

    said = written(rows.select("row", "text").mapInArrow(make, "row bigint, word string"), "said")
    # Words that many texts have are hot keys of the join.
    counts = said.groupBy("word").agg(F.count("*").alias("n"))
    small = written(counts.join(table, "word"), "words")
    total, n = said.count(), small.count()
    told = lookup(said, small, "word", "n", total, n).filter("name is not null")
    held = told.groupBy("row").agg(F.collect_list("word").alias("words"), F.collect_list(F.when(F.col("name"), F.col("word"))).alias("names"))
    return rows.join(held, "row", "left").select("id", "text", "words", "names")


class Codes(dict):
    """Word as written to its 64-bit template code; filled as words are met."""

    def __init__(self, vocabulary: set[str], names: set[str]):
        super().__init__()
        self.vocabulary, self.names = vocabulary, names

    def __missing__(self, word: str) -> int:
        low = word.lower()
        if low.isdigit():
            code = _NUMBER
        elif low in UNITS:
            code = _UNIT
        elif low in self.names:
            code = _NAME
        elif low in self.vocabulary:
            code = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) | 16
        else:
            # No item has the word: it can only stand where an item has a name.
            code = _NAME if word[0].isupper() else 0
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = code
        return code


class Powers:
    """Powers of the base and its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE_INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


def window_hashes(codes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of every window of ``width`` codes, a polynomial modulo 2**64 that is shifted to its start."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers.to(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:n])])
        h = (total[width:] - total[:-width]) * down[: n - width + 1]
        # The low bits of such a sum are weak; this spreads them.
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _windows(lexicon, known, width: int):
    """Batches of (id, text), without a lexicon (id, text, words, names), to rows (id, window, words, literals): each document's windows that are ``known``, one of each kind."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, powers = None if lexicon is None else Codes(*lexicon.value), Powers()
        hashes = known.value if known is not None else None
        if hashes is not None:
            quick = np.zeros(1 << 20, bool)
            quick[(hashes >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for at_row, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                found = _WORD.findall(text.as_py() or "")
                if len(found) < width:
                    continue
                if lexicon is None:
                    codes = Codes(*[set(batch.column(c)[at_row].as_py() or ()) for c in (2, 3)])
                code = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
                h = window_hashes(code, width, powers)
                if hashes is not None:
                    at = np.flatnonzero(quick[(h >> np.uint64(44)).astype(np.int64)])
                    if not len(at):
                        continue
                    place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                    at = at[hashes[place] == h[at]]
                else:
                    at = np.arange(len(h))
                seen = set()
                for k in at.tolist():
                    words = tuple(w.lower() for w in found[k : k + width])
                    if words not in seen:
                        seen.add(words)
                        out[0].append(i)
                        out[1].append(int(h[k].astype(np.int64)))
                        out[2].append(words)
                        out[3].append(int((code[k : k + width] > 3).sum()))
                if len(out[0]) >= 20_000:
                    yield _batch(out)
                    out = ([], [], [], [])
            if out[0]:
                yield _batch(out)

    return make


def _batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.int32())], ["id", "window", "words", "literals"])


def leaks(documents: DataFrame, items: DataFrame, width: int = WINDOW, literals: int = LITERALS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, verbatim, altered)`` for each document that holds a window of an item: the number of the item's windows found as they are, and re-parameterised.

    A window counts as altered if its template is the same, at least ``literals`` of its words are literal, and its slots were exchanged one to one. Null and
    short texts hold no window; a passage found twice in a document counts once; repeated ids are taken as one document. Empty tables give an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    items = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    table = written(word_table(items), "item_words")
    schema = "id bigint, window bigint, words array<string>, literals int"
    lexicon = None
    if table.count() <= SENT:
        told = table.collect()
        lexicon = sc.broadcast(({r[0] for r in told}, {r[0] for r in told if r[1]}))
    texts = lambda df: df.select("id", "text") if lexicon else with_words(df, table)
    wanted = written(texts(items).mapInArrow(_windows(lexicon, None, width), schema), "item_windows")
    known = None
    if wanted.count() <= 8 * SENT:
        known = sc.broadcast(np.unique(np.array([r[0] for r in wanted.select("window").distinct().collect()], np.int64).astype(np.uint64)))
        if not len(known.value):
            return spark.createDataFrame([], "doc_id bigint, item_id bigint, verbatim bigint, altered bigint")
    held = texts(documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))).mapInArrow(_windows(lexicon, known, width), schema)
    right = wanted.select(F.col("id").alias("item_id"), "window", F.col("words").alias("asked"), F.col("literals").alias("fixed"))
    if wanted.count() <= SENT_WINDOWS:
        right = F.broadcast(right)
    both = held.select(F.col("id").alias("doc_id"), "window", "words").join(right, "window")
    slots = F.array_distinct(F.arrays_zip("asked", "words"))
    one_to_one = (F.size(slots) == F.size(F.array_distinct("asked"))) & (F.size(slots) == F.size(F.array_distinct("words")))
    same = F.col("words") == F.col("asked")
    kind = both.withColumn("same", same).filter(F.col("same") | ((F.col("fixed") >= literals) & one_to_one))
    found = kind.groupBy("doc_id", "item_id").agg(F.count_if("same").alias("verbatim"), F.count_if(~F.col("same")).alias("altered"))
    return found
