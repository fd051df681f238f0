"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib
import re
import zlib
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from retort.session import written

#: Folder of the public vocabulary files and the file used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rows a target table may have; more are refused.
MOST_TARGETS = 10_000
#: Characters of one piece that are encoded at once, about; longer texts are cut where no word of the vocabulary's pattern reaches across.
PIECE = 1 << 20

#: A place no word reaches across: between an ASCII letter and a digit, or before a blank that follows a letter or digit.
_CUT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^\W_])(?= )")
_ENCODINGS: dict[str, object] = {}


def _encoding(name: str, ranks: bytes):
    """The tokenizer of a rank file's content, once per worker."""
    if name not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        # Fixed value: the pattern by which this vocabulary's texts are cut into words before merging; the installed package's own is used where it is there.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        try:
            pattern = importlib.import_module("public_tokenizers").PATTERN
        except (ImportError, AttributeError):
            pass
        _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[name]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in parts of about ``size`` characters that are tokenized as the whole is: each ends where no word reaches across, however far off that is."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def token_count(text: Column, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> Column:
    """Tokens of a text; a null text has none. The vocabulary file (under a megabyte) is read by the driver and sent to the workers."""
    ranks = Path(path).read_bytes()
    sent = SparkSession.active().sparkContext.broadcast(ranks)
    name = f"{path}-{zlib.crc32(ranks)}"

    @arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(name, sent.value).encode_ordinary
        return pa.array([0 if t is None else sum(len(encode(p)) for p in pieces(t)) for t in (x.as_py() for x in texts)], pa.int64())

    return count(text)


def source_key(source: Column) -> Column:
    """Sources are compared in lower case and trimmed."""
    return F.lower(F.regexp_replace(source, r"\A\s+|\s+\z", ""))


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def read_targets(table: DataFrame) -> list[Target]:
    """Targets of a small table (refused beyond MOST_TARGETS rows); rows without source or share, or with neither share nor repeats, are left out."""
    rows = table.select(source_key(F.col("source")), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out: dict[str, Target] = {}
    for source, share, most in rows:
        if source is not None and share and share > 0 and most and most > 0:
            old = out.get(source)
            out[source] = Target(source, share + (old.share if old else 0.0), max(most, old.max_repeats if old else 0))
    return sorted(out.values(), key=lambda t: t.source)


def rates(targets: list[Target], tokens: dict[str, int], total: float | None = None) -> dict[str, float]:
    """How often each source's documents are used on average.

    The shares are taken among the sources that have tokens. Without a ``total`` the largest is taken at which every share can be met with nobody above its repeats;
    with one, a source that can't reach its part gives what its repeats allow, and the others keep theirs.
    """
    there = [t for t in targets if tokens.get(t.source, 0) > 0]
    whole = sum(t.share for t in there)
    if not there:
        return {}
    if total is None:
        total = min(t.max_repeats * tokens[t.source] * whole / t.share for t in there)
    return {t.source: min(float(t.max_repeats), total * t.share / whole / tokens[t.source]) for t in there}


def counted(df: DataFrame, targets: list[Target], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents of the targets' sources, written once: texts are tokenised a single time and never shuffled."""
    kept = df.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("_text"))
    kept = kept.filter(F.col("source").isin([t.source for t in targets]))
    return written(kept.select("doc_id", "source", token_count(F.col("_text"), tokenizer).alias("tokens")), "tokens")


def copies(docs: DataFrame, rate: dict[str, float], seed: int = 0) -> DataFrame:
    """``docs`` with ``copies``: floor(rate), and one more with the rate's fraction as probability, by a hash of id and seed."""
    if not rate:
        return docs.withColumn("copies", F.lit(0)).limit(0)
    # At most MOST_TARGETS rows, joined by hash.
    table = docs.sparkSession.createDataFrame(list(rate.items()), "_source string, _rate double")
    docs = docs.join(F.broadcast(table), F.col("source") == F.col("_source"), "left")
    r = F.coalesce("_rate", F.lit(0.0))
    draw = F.xxhash64("doc_id", "source", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return docs.withColumn("copies", (F.floor(r) + F.when(draw < r - F.floor(r), 1).otherwise(0)).cast("int")).drop("_source", "_rate")


def mix(docs: DataFrame, targets: list[Target], total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture as ``(doc_id, source, copy, tokens)`` and its report as ``(source, documents, available, target_share, rate, used_documents, tokens, share)``.

    ``docs`` as ``counted`` gives it. Repeated ids are documents of their own that are drawn together; null ids are drawn like any other id. The report has a row for
    every target, absent sources with zeros; share is null if nothing is drawn. Only one row per source goes to the driver.
    """
    spark = docs.sparkSession
    held = {r[0]: (r[1], r[2]) for r in docs.groupBy("source").agg(F.count("*"), F.sum("tokens")).collect()}
    rate = rates(targets, {s: t for s, (_, t) in held.items()}, total)
    drawn = copies(docs, rate, seed)
    used = {r[0]: (r[1], r[2]) for r in drawn.groupBy("source").agg(F.count_if(F.col("copies") > 0), F.sum(F.col("copies") * F.col("tokens"))).collect()}
    everything = sum(t for _, t in used.values() if t)
    rows = []
    for t in targets:
        documents, available = held.get(t.source, (0, 0))
        n, tokens = used.get(t.source, (0, 0))
        rows.append((t.source, documents, available or 0, t.share, rate.get(t.source, 0.0), n, tokens or 0, (tokens or 0) / everything if everything else None))
    schema = "source string, documents bigint, available bigint, target_share double, rate double, used_documents bigint, tokens bigint, share double"
    mixture = drawn.filter("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "tokens")
    return mixture, spark.createDataFrame(rows, schema)
