"""Keyword-stuffed and link-list pages.

Every line is described by a few counts (links, tags, repetition, function
words, numbers, punctuation), each cut into a few levels. A hidden Markov model
over the lines of a page labels them as prose, work (code and its results), link
list, tag list or menu (keyword phrases, product lines); a page is flagged if
most of its words stand in the last three. The model starts from lines that a
plain rule is sure of and is refitted by Viterbi training on a bounded sample of
pages; the counting is done for many pages at once on their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.session import written

PROSE, WORK, LINKS, TAGS, MENU = range(5)
STATES = ("prose", "work", "links", "tags", "menu")
#: Levels of each feature, in the order of ``line_levels``.
LEVELS = (4, 4, 5, 4, 4, 3, 2, 3, 4, 4, 3)
#: A line counts with as many words as it has, up to this, when frequencies are taken.
WEIGHT = 64
#: Pages the model is fitted on, and rounds of refitting.
SAMPLE_PAGES = 2_000
ROUNDS = 4
#: Bytes of text the sample may have, all pages together; whole pages are left out, those with the largest hashes first.
SAMPLE_BYTES = 128 << 20
#: Share of words outside prose and work from which a page is flagged.
SHARE = 0.5
#: Bytes of text that are described at once.
SLICE = 1 << 20

# Function words of English, German, Spanish and French.
FUNCTION_WORDS = (
    "the of and to in is was for on that with as it be are this by from at an or if when we you our not which has have can than so but its were "
    "der die das und ist nicht mit von zu den dem ein eine auf im wir sie wie auch hat kaum aus des für bei wer hier man "
    "el la los las y es con por un una del que se no para como más al lo su desde todavía así "
    "le les et est une des du dans qui pour pas sur avec plus nous"
).split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_URL_END = _SPACE.copy()
_URL_END[[ord(c) for c in "\"')>]|"]] = True
_CODE = np.zeros(256, bool)
_CODE[[ord(c) for c in "()=[]{}"]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in "|;,"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!:"]] = True
_WORD_BYTES = 64
_VALUE = np.random.default_rng(7).integers(1, 1 << 62, 256, np.int64).astype(np.uint64)
with np.errstate(over="ignore"):
    _PLACE = np.cumprod(np.full(_WORD_BYTES, 0x9E3779B97F4A7C15, np.uint64))


def _word_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hash of each run of word bytes, in lower case; bytes past the 64th share one place value."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    spots = np.flatnonzero(inside)
    first = np.flatnonzero(np.isin(spots, starts, assume_unique=True))
    offset = np.minimum(spots - np.repeat(starts, np.diff(np.append(first, len(spots)))), _WORD_BYTES - 1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_VALUE[_LOWER[data[spots]]] * _PLACE[offset], first)
        return h ^ (h >> np.uint64(31))


def _word_starts(inside: np.ndarray) -> np.ndarray:
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(_word_hashes(data, _word_starts(_ALNUM[data]), _ALNUM[data]))


_FUNCTION = _hash_words(FUNCTION_WORDS)


@dataclass
class Lines:
    """Described lines of some pages: page number, words, and feature levels (lines x features)."""

    page: np.ndarray
    words: np.ndarray
    levels: np.ndarray


def describe(texts: list[bytes]) -> Lines:
    """The lines that hold a word, cell headings (``# %% [...]``) left out."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    breaks = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], breaks[:-1] + 1])
    n = len(begins)
    page = np.searchsorted(np.cumsum(sizes), begins, "right")
    line_of = lambda spots: np.searchsorted(breaks, spots)
    count = lambda hit: np.bincount(line_of(np.flatnonzero(hit)), minlength=n)

    def at(k: int) -> np.ndarray:
        return data[np.minimum(begins + k, len(data) - 1)]

    heading = (at(0) == ord("#")) & (at(1) == 32) & (at(2) == ord("%")) & (at(3) == ord("%"))
    # What a cell holds, by its heading: text (also before the first heading), code or output.
    kind = np.where(heading, np.where(at(6) == ord("c"), 1, np.where(at(6) == ord("o"), 2, 0)), 0)
    opens = heading | (np.diff(page, prepend=-1) != 0)
    kind = kind[np.maximum.accumulate(np.where(opens, np.arange(n), 0))]
    cell = np.cumsum(heading | (np.diff(page, prepend=-1) != 0))

    inside = _ALNUM[data]
    starts = _word_starts(inside)
    in_line = line_of(starts)
    words = np.bincount(in_line, minlength=n)
    hashes = _word_hashes(data, starts, inside)
    safe = np.maximum(words, 1)

    nxt = np.append(data[1:], 10)
    url = (data == ord(":")) & (nxt == ord("/"))
    index = np.arange(len(data))
    in_url = np.maximum.accumulate(np.where(url, index, -1)) > np.maximum.accumulate(np.where(_URL_END[data], index, 0))
    url_words = np.bincount(in_line[in_url[starts]], minlength=n) + count(url)
    links = url_words / safe

    tag_start = (data == ord("#")) & _ALNUM[nxt]
    tag_words = _span_words(tag_start, data, starts, in_line, n)
    tags = np.where(links > 0.3, 0, tag_words / safe)

    # Repetition within the line, and of the line's words earlier in its cell.
    key = np.sort((in_line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n) / safe
    in_cell = cell[in_line].astype(np.uint64)
    tied = (in_cell << np.uint64(40)) | (hashes >> np.uint64(24))
    order = np.argsort(tied, kind="stable")
    again = np.zeros(len(tied), bool)
    again[order[1:]] = tied[order[1:]] == tied[order[:-1]]
    again_share = np.bincount(in_line[again], minlength=n) / safe

    functional = np.bincount(in_line[np.isin(hashes, _FUNCTION)], minlength=n) / safe
    first = data[starts]
    numeric = np.bincount(in_line[(first >= 48) & (first <= 57)], minlength=n) / safe
    code = count(_CODE[data]) / safe
    separators = count(_SEPARATOR[data]) / safe
    # The first byte that is no space: digit, list mark or tag, bracket or the like, else (letters).
    visible = np.flatnonzero(~_SPACE[data])
    lead = data[visible[np.minimum(np.searchsorted(visible, begins), max(0, len(visible) - 1))]] if len(visible) else np.zeros(n, np.uint8)
    lead = np.where((lead >= 48) & (lead <= 57), 1, np.where(np.isin(lead, np.frombuffer(b"-*+#", np.uint8)), 2, np.where(_ALNUM[lead], 0, 3)))
    solid = np.maximum.accumulate(np.where(_SPACE[data], 0, index))[breaks]
    stop = _STOP[data[solid]] & (words >= 5)

    levels = np.stack(
        [
            np.digitize(links, [1e-9, 0.3, 0.6]),
            np.digitize(tags, [1e-9, 0.3, 0.7]),
            np.where(words < 6, 0, 1 + np.digitize(-distinct, [-0.75, -0.55, -0.35])),
            np.where(words < 4, 0, 1 + np.digitize(functional, [1e-9, 0.12])),
            np.digitize(numeric, [1e-9, 0.3, 0.6]),
            np.digitize(code, [1e-9, 0.4]),
            stop.astype(np.int64),
            np.digitize(separators, [1e-9, 0.25]),
            np.digitize(again_share, [0.25, 0.5, 0.8]),
            lead,
            kind,
        ],
        1,
    ).astype(np.int8)
    keep = (words > 0) & ~heading
    return Lines(page[keep], words[keep], levels[keep])


def _span_words(mark: np.ndarray, data: np.ndarray, starts: np.ndarray, in_line: np.ndarray, n: int) -> np.ndarray:
    """Per line, words between a mark and the next space."""
    index = np.arange(len(data))
    on = np.maximum.accumulate(np.where(mark, index, -1)) > np.maximum.accumulate(np.where(_SPACE[data], index, 0 if not mark[:1].any() else -1))
    return np.bincount(in_line[on[starts]], minlength=n)


def sure_labels(lines: Lines) -> np.ndarray:
    """The plain rule's label of each line: what its levels say by themselves."""
    link, tag, repeat, function, number, code, stop, separator, again, lead, kind = lines.levels.T
    out = np.full(len(lines.page), WORK)
    out[(function == 3) & (repeat <= 2) & (code < 2)] = PROSE
    out[(function >= 2) & (stop == 1) & (repeat <= 2) & (code < 2)] = PROSE
    out[(separator == 2) & (function <= 1) & (code == 0) & (number <= 2) & (lines.words >= 4)] = MENU
    out[(repeat == 4) & (lines.words >= 12) & (number <= 1)] = MENU
    out[(repeat >= 3) & (lines.words >= 30) & (number == 0) & (function <= 2)] = MENU
    out[(again == 3) & (lines.words >= 2) & (code == 0) & (number == 0) & (function <= 1) & (stop == 0) & (kind == 0)] = MENU
    out[tag == 3] = TAGS
    out[(link >= 2) & (lead != 1)] = LINKS
    return out


@dataclass
class Model:
    """Log probabilities: start (states), step (states x states), and per feature states x levels."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def scores(self, lines: Lines) -> np.ndarray:
        out = np.zeros((len(lines.page), len(STATES)))
        for k, table in enumerate(self.emit):
            out += table.T[lines.levels[:, k]]
        return out


def fit(lines: Lines, labels: np.ndarray) -> Model:
    """Relative frequencies of labelled lines, each count raised by one half; features are counted by words."""
    s = len(STATES)
    heads = np.concatenate([[True], lines.page[1:] != lines.page[:-1]]) if len(lines.page) else np.zeros(0, bool)
    weight = np.minimum(lines.words, WEIGHT)
    start = np.bincount(labels[heads], minlength=s) + 0.5
    follow = ~heads
    pair = labels[:-1][follow[1:]] * s + labels[1:][follow[1:]] if len(labels) else labels
    step = np.bincount(pair, minlength=s * s).reshape(s, s) + 0.5
    emit = []
    for k, n in enumerate(LEVELS):
        table = np.bincount(labels * n + lines.levels[:, k], weights=weight, minlength=s * n).reshape(s, n) + 0.5
        emit.append(np.log(table / table.sum(1, keepdims=True)))
    return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), emit)


def viterbi(model: Model, lines: Lines) -> np.ndarray:
    """The likeliest label of every line, all pages in step: line k of every page that has one at once."""
    n = len(lines.page)
    if not n:
        return np.zeros(0, np.int64)
    scores = model.scores(lines)
    heads = np.flatnonzero(np.concatenate([[True], lines.page[1:] != lines.page[:-1]]))
    sizes = np.diff(np.append(heads, n))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    best = model.start + scores[heads]
    back = np.zeros((n, len(STATES)), np.int8)
    last = np.zeros((len(heads), len(STATES)))
    active = len(heads)
    for k in range(1, int(sizes[0])):
        still = int(np.searchsorted(-sizes, -k))
        last[still:active] = best[still:active]
        active = still
        ways = best[:active, :, None] + model.step
        rows = heads[:active] + k
        back[rows] = ways.argmax(1)
        best = ways.max(1) + scores[rows]
    last[:active] = best[:active]
    labels = np.zeros(n, np.int64)
    state = last.argmax(1)
    labels[heads + sizes - 1] = state
    for k in range(int(sizes[0]) - 1, 0, -1):
        active = int(np.searchsorted(-sizes, -k))
        rows = heads[:active] + k
        state[:active] = np.where(True, back[rows, labels[rows]], 0)
        labels[rows - 1] = state[:active]
    return labels


def train(texts: list[str], rounds: int = ROUNDS) -> Model:
    """A model from sample pages: the plain rule's labels first, then Viterbi labels again and again."""
    lines = describe([t.encode("utf-8", "replace") for t in texts] or [b""])
    model = fit(lines, sure_labels(lines))
    for _ in range(rounds):
        model = fit(lines, viterbi(model, lines))
    return model


def _label_pages(model: Model):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at, held, size = 0, [], 0
            for k in range(len(ids)):
                held.append(texts[k].as_py() or b"")
                size += len(held[-1])
                if size >= SLICE or k + 1 == len(ids):
                    yield _counts(model, ids.slice(at, len(held)), held)
                    at, held, size = k + 1, [], 0

    return make


def _counts(model: Model, ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    lines = describe(texts)
    labels = viterbi(model, lines)
    table = np.bincount(lines.page * len(STATES) + labels, weights=lines.words, minlength=len(texts) * len(STATES)).astype(np.int64).reshape(-1, len(STATES))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *[pa.array(table[:, k]) for k in range(len(STATES))]], ["id", *STATES])


def sample(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> list[str]:
    """Whole texts of about ``sample_pages`` pages (id, text): those with the smallest hashes of their ids, until they have ``sample_bytes`` bytes."""
    total = pages.count()
    chance = min(1.0, sample_pages / max(1, total))
    hashed = pages.select("text", F.xxhash64("id").alias("h")).filter((F.col("h") / F.lit(2.0**64) + 0.5) < chance).filter("text is not null")
    hashed = written(hashed.limit(2 * sample_pages), "sample")
    # The sizes of at most twice as many pages go to the driver first, then only texts within the bound.
    sizes = sorted((r[0], r[1]) for r in hashed.select("h", F.octet_length("text")).collect())
    last, held = None, 0
    for h, size in sizes:
        held += size
        if held > sample_bytes:
            break
        last = h
    if last is None:
        return []
    within = sum(h <= last for h, _ in sizes)
    # Pages of one id share a hash: those beyond the bound are left out as well.
    return [r[0] for r in hashed.filter(F.col("h") <= last).orderBy("h", F.octet_length("text")).limit(within).select("text").collect()]


def page_labels(df: DataFrame, model: Model | None = None, sample_pages: int = SAMPLE_PAGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, prose, work, links, tags, menu, share)``: words of each page by line label, and the share of the last three.

    The model is fitted on the pages ``sample`` gives, unless one is given. Null and empty texts and texts without words have a null share. Repeated ids are pages of
    their own. An empty table gives an empty result.
    """
    pages = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        model = train(sample(pages, sample_pages))
    out = pages.mapInArrow(_label_pages(model), "id bigint, " + ", ".join(f"{s} bigint" for s in STATES))
    total = sum((F.col(s) for s in STATES[1:]), F.col(STATES[0]))
    spam = F.col("links") + F.col("tags") + F.col("menu")
    return out.select(F.col("id").alias(id_col), *STATES, F.when(total > 0, spam / total).alias("share"))


def stuffed(labelled: DataFrame, share: float = SHARE) -> DataFrame:
    return labelled.filter(F.col("share") > share)
