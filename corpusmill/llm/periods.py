"""Runs of repeating words: stretches with a smallest period that they hold several times over, found by a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, 8, … words. Equal factors of one text share a name, and the names of one
length follow from those of half the length, two at a time. For each length the occurrences of a name are chained to their
successors; where the next occurrence is at most twice the length away, neighbouring positions that share that distance form an
arithmetic progression, and the distance is proposed as a period. Proposals long enough are extended to either side and
deduplicated over the lengths.

Factors that occur once in a text are dropped before the next length, so ordinary prose is done after a few lengths. A slice of texts is
worked on at once; every text is handled alone by its positions, whole, in the task that reads it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import pieces

MIN_WORDS = 24
MIN_POWERS = 3
SLICE_BYTES = 4 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"

#: Gives the words of a text, from its id and the words as they stand in it.
WordsOf = Callable[[int | None, list[bytes]], list[bytes]]


def _proposals(at: np.ndarray, gap: np.ndarray, factor: int, min_words: int, min_powers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the progressions long enough: neighbouring positions whose successors are equally far."""
    near = np.flatnonzero((gap > 0) & (gap <= 2 * factor))
    if not len(near):
        return near, near, near
    where, d = at[near], gap[near]
    head = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1] + 1) | (d[1:] != d[:-1]))))
    count = np.diff(np.append(head, len(near)))
    period = d[head]
    length = count + factor - 1 + period
    enough = length >= np.maximum(min_words, min_powers * period)
    return where[head][enough], length[enough], period[enough]


def _extended(code: np.ndarray, low: int, high: int, start: int, length: int, period: int) -> tuple[int, int]:
    """A stretch with a period, as far as it goes to either side within [low, high)."""
    end = start + length
    while start > low and code[start - 1] == code[start - 1 + period]:
        start -= 1
    while end < high and code[end] == code[end - period]:
        end += 1
    return start, end - start


def runs(code: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_powers: int = MIN_POWERS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period. ``code`` holds the words of all texts, one after another."""
    total = len(code)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    found: list[set[tuple[int, int, int]]] = [set() for _ in sizes]
    at = np.flatnonzero(sizes[text] >= min_words)
    name = np.unique(text[at] * (int(code.max(initial=0)) + 1) + code[at], return_inverse=True)[1]
    named = np.full(total, -1, np.int64)
    factor, longest = 1, int(sizes.max(initial=0))
    while len(at):
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        gap = np.zeros(len(at), np.int64)
        gap[order[:-1]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
        for start, length, period in zip(*(x.tolist() for x in _proposals(at, gap, factor, min_words, min_powers)), strict=True):
            k = int(text[start])
            low = int(ends[k] - sizes[k])
            start, length = _extended(code, low, int(ends[k]), start, length, period)
            found[k].add((start - low, length, period))
        # A period of p shows at the first length of p or more.
        if factor * min_powers >= longest:
            break
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        at, name = at[again], name[again]
        named[at] = name
        ahead = np.minimum(at + factor, total - 1)
        follows = (at + factor < total) & (named[ahead] >= 0) & (text[ahead] == text[at])
        key = name[follows] * (int(name.max(initial=0)) + 1) + named[ahead[follows]]
        named[at] = -1
        at, name = at[follows], np.unique(key, return_inverse=True)[1]
        factor *= 2
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], spans: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that only repeat: in a run, all after its first period."""
    if spans:
        keep = np.ones(len(words), bool)
        for start, length, period in spans:
            keep[start + period : start + length] = False
        words = list(itertools.compress(words, keep))
    return b" ".join(words)


def as_they_stand(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def periodic_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_powers: int = MIN_POWERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_of: WordsOf = as_they_stand,
) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period), collapsed.

    A run is a stretch of words with smallest period q of at least ``min_words`` words and ``min_powers`` * q words that no neighbouring
    word carries on. ``collapsed`` is the text without the words that lie in a run after its first period, joined by single
    spaces. Words are separated by ASCII white space; ``words_of`` may put others in their place.

    Null, empty and blank texts have no words and no runs, and an empty ``collapsed``; null ids stay null and repeated rows are
    answered each; other columns are ignored, whatever their names; an empty table gives no rows. Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in pieces.slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(lo, len(texts))
                held = [words_of(i, (t or "").encode("utf-8", "surrogatepass").split()) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                flat = pa.array(itertools.chain.from_iterable(held), pa.large_binary(), size=int(sizes.sum())).dictionary_encode()
                spans = runs(np.asarray(flat.indices).astype(np.int64), sizes, min_words, min_powers)
                made = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in s] for s in spans]
                joined = pa.array([collapsed(w, s) for w, s in zip(held, spans, strict=True)], pa.binary()).cast(pa.string())
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(made, kind), joined], ["id", "n_words", "runs", "collapsed"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string")
