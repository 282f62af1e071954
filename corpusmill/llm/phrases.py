"""Collocations: phrases whose words meet far more often than their parts would by chance, mined over a weighted de Bruijn graph.

A text is split into pieces and those into words. An edge of the graph is a gram of ``longest`` words (five, say), from the node of its
first four to the node of its last four, weighted by its occurrences. Where a piece ends, the shorter grams that reach its end
are kept as corrections. The count of any shorter phrase is then the flow out of its node, the sum over edges that start with it,
plus the corrections that start with it: texts are never counted once per length.

A phrase all of whose flow goes on along a single edge, or comes in along one, lies on a unary path; it is compacted into the longer
phrase, that is, it is not reported. Longer phrases never occur more often than what they hold, so looking one word to either
side is enough.

Only words and grams that occur ``min_count`` times can be part of a phrase that does. Words are counted first, then the pairs of frequent
words, then the longer grams of what is left; pieces are broken at rare pairs and edges cut short before they hold a longer rare gram, which
loses no phrase and leaves hardly an edge that is no phrase. Grams are counted by a hash of bounded width: a task holds one table of
counters and shuffles that, not its grams. Grams that share a hash share a counter, so a rare one may pass, and a frequent one always does. The list
of words reaches the tasks only behind a size check; without it the edges are more and the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import pieces
from corpusmill.operators.arrivals import number_in_order
from corpusmill.session import broadcast_if_small, is_small, materialize

LONGEST = 5
SLICE_BYTES = 4 << 20
NO_LANGUAGE = "und"
#: Counters of a table: as many as 2 to one of these bits, the more the more words, and those that travel as one row.
FEWEST_BITS, MOST_BITS = 16, 25
BLOCK = 1 << 16
#: Odd numbers that spread a hash over its 64 bits.
MIX, LAST_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What separates words (1) and ends pieces (2), by byte; letters A-Z are lowered.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\v\f\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = pa.scalar(" ", pa.large_string())
FIELDS = ["lang", "phrase", "size", "n"]
SCHEMA = "lang string, phrase string, size int, n long"


class Words:
    """The words of a slice of texts: their codes, the language of each, and where their piece ends."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        flat = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = KIND[raw]
        inside = kind == 0
        text_start = np.zeros(len(raw) + 1, bool)
        text_start[offsets[:-1]] = True
        text_start = text_start[:-1]
        before = np.concatenate(([False], inside[:-1]))[: len(raw)]
        first = inside & (~before | text_start)
        after = np.concatenate((inside[1:] & ~first[1:], [False]))[: len(raw)]
        starts, ends = np.flatnonzero(first), np.flatnonzero(inside & ~after) + 1
        sizes = np.concatenate(([0], np.cumsum(ends - starts)))
        buffers = [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(LOWER[raw[inside]])]
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
        self.code = np.asarray(coded.indices).astype(np.int64)
        self.spelt = coded.dictionary
        languages = pc.fill_null(langs, NO_LANGUAGE).cast(pa.string()).dictionary_encode()
        self.languages = languages.dictionary
        text = np.searchsorted(offsets[1:], starts, side="right")
        self.lang = np.asarray(languages.indices).astype(np.int64)[text] if len(starts) else np.zeros(0, np.int64)
        piece = np.cumsum((kind == 2) | text_start)[starts]
        #: whether the next word stands in the same piece
        self.linked = np.concatenate((piece[1:] == piece[:-1], [False]))[: len(starts)]

    def grams(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words at some positions."""
        return pc.binary_join_element_wise(*(self.spelt.take(pa.array(self.code[at + j])) for j in range(size)), SPACE)

    def numbers(self, words: dict[str, tuple[int, pa.Array]]) -> np.ndarray:
        """The number of each word in the list of its language, -1 where it has none."""
        table = np.full((len(self.languages), len(self.spelt)), -1, np.int64)
        for k, name in enumerate(self.languages.to_pylist()):
            if name in words:
                first, spelt = words[name]
                at = pc.fill_null(pc.index_in(self.spelt, value_set=spelt), -1).to_numpy(zero_copy_only=False)
                table[k] = np.where(at < 0, -1, first + at)
        return table[self.lang, self.code] if len(self.code) else np.zeros(0, np.int64)

    def linked_by(self, number: np.ndarray) -> np.ndarray:
        """Whether each word stands with the next one in a piece, both of them numbered."""
        known = number >= 0
        return self.linked & known & np.concatenate((known[1:], [False]))[: len(known)]

    def room(self, linked: np.ndarray) -> np.ndarray:
        """How many words there are from each word on until a link is missing."""
        here = np.arange(len(linked))
        stops = np.flatnonzero(~linked) + 1
        return stops[np.searchsorted(stops, here, side="right")] - here

    def counted(self, at: np.ndarray, room: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(positions, size, counts) of the distinct grams at some positions, each as long as its room allows."""
        width = len(self.spelt)
        key = np.unique(self.lang[at] * width + self.code[at], return_inverse=True)[1]
        for size in range(1, longest + 1):
            ready = room[at] <= size if size < longest else np.ones(len(at), bool)
            if ready.any():
                _, first, n = np.unique(key[ready], return_index=True, return_counts=True)
                yield at[ready][first], size, n
            at, key = at[~ready], key[~ready]
            if not len(at):
                return
            key = np.unique(key * width + self.code[at + size], return_inverse=True)[1]

    def rows(self, at: np.ndarray, size: int, n: np.ndarray) -> pa.RecordBatch:
        names = self.languages.take(pa.array(self.lang[at]))
        columns = [names, self.grams(at, size).cast(pa.string()), pa.array(np.full(len(at), size, np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, FIELDS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for lo, texts in pieces.slices(batch.column(1), SLICE_BYTES):
            found = Words(batch.column(0).slice(lo, len(texts)), texts)
            if len(found.code):
                yield found


def _hashed(number: np.ndarray, room: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, hash) of the grams of two words and more that have room."""
    at = np.flatnonzero(number >= 0)
    key = number[at].astype(np.uint64)
    for size in range(2, longest + 1):
        more = room[at] >= size
        at, key = at[more], key[more]
        key = (key ^ key >> np.uint64(29)) * MIX + number[at + size - 1].astype(np.uint64)
        yield size, at, (key ^ key >> np.uint64(32)) * LAST_MIX


class Marks(NamedTuple):
    """One bit for each counter of a table: whether it reached its bound."""

    bits: int
    packed: np.ndarray

    def hold(self, key: np.ndarray) -> np.ndarray:
        at = key >> np.uint64(64 - self.bits)
        return (self.packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _links(found: Words, number: np.ndarray, pairs: Marks | None) -> np.ndarray:
    """Whether each word is followed in its piece by one with which it may be part of a phrase."""
    linked = found.linked_by(number)
    if pairs is not None:
        for _, at, key in _hashed(number, found.room(linked), 2):
            linked[at] = pairs.hold(key)
    return linked


def _marks(docs: DataFrame, words, min_count: int, sizes: Sequence[int], bits: int, pairs=None):
    """Marks of the grams of some sizes that may occur ``min_count`` times, for all tasks.

    Counters stop at the bound, so they are narrow. Each task sends one table at most, so as many tasks as cores do the counting.
    """
    bound = max(1, min_count)
    kind = np.min_scalar_type(bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, kind)
        for found in _slices(batches):
            number = found.numbers(words.value)
            linked = _links(found, number, None if pairs is None else pairs.value)
            for size, _, key in _hashed(number, found.room(linked), max(sizes)):
                if size in sizes:
                    at, n = np.unique(key >> np.uint64(64 - bits), return_counts=True)
                    table[at] = np.minimum(table[at] + n, bound)
        for at in range(0, len(table), BLOCK):
            part = table[at : at + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part.tobytes()], pa.binary())], ["at", "counters"])

    def reach(parts: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for part in parts.column("counters"):
            total += np.frombuffer(part.as_buffer(), kind)
        packed = pa.array([np.packbits(total >= bound).tobytes()], pa.binary())
        return pa.table({"at": parts.column("at").slice(0, 1), "packed": packed})

    spark = docs.sparkSession
    rows = docs.select("lang", "text").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(count, "at long, counters binary")
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.groupBy("at").applyInArrow(reach, "at long, packed binary").collect():
        packed[row["at"] // 8 : (row["at"] + BLOCK) // 8] = np.frombuffer(row["packed"], np.uint8)
    return spark.sparkContext.broadcast(Marks(bits, packed))


def _grams(docs: DataFrame, longest: int, words=None, pairs=None, longer=None) -> DataFrame:
    """Grams of ``longest`` words, and shorter ones where a piece ends, with their counts in a slice of texts.

    Words outside ``words`` are left out, pieces are broken where a pair is not in ``pairs``, and grams end before they hold one that is not in
    ``longer``. All three are broadcasts, or None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _slices(batches):
            here = np.arange(len(found.code))
            at, room = here, found.room(found.linked)
            if words is not None:
                number = found.numbers(words.value)
                at = np.flatnonzero(number >= 0)
                room = found.room(_links(found, number, None if pairs is None else pairs.value))
                if longer is not None:
                    end = here + room
                    for size, first, key in _hashed(number, room, longest):
                        if size > 2:
                            rare = first[~longer.value.hold(key)]
                            end[rare] = np.minimum(end[rare], rare + size - 1)
                    room = np.minimum.accumulate(end[::-1])[::-1] - here
            for row in found.counted(at, room, longest):
                yield found.rows(*row)

    return docs.select("lang", "text").mapInArrow(run, SCHEMA)


def _summed(rows: DataFrame) -> DataFrame:
    """Counts per language and phrase; a frequent phrase costs one row per task."""
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _word_lists(frequent: DataFrame):
    """The words of a written table by language, numbered through, for all tasks; None where they are too many for that."""
    if not is_small(frequent):
        return None
    table = frequent.select("lang", "phrase").toArrow()
    names, words = np.array(table.column("lang").to_pylist(), object), table.column("phrase").combine_chunks().cast(pa.large_string())
    lists, first = {}, 0
    for name in sorted(set(names.tolist())):
        mine = words.filter(pa.array(names == name))
        lists[name], first = (first, mine), first + len(mine)
    return frequent.sparkSession.sparkContext.broadcast(lists)


def _first(phrase: Column, n: Column) -> Column:
    """The first n words of a phrase, or the last ones for a negative n."""
    return F.call_function("substring_index", phrase, F.lit(" "), n)


def _cuts(phrase: Column, size: Column, longest: int) -> Column:
    """(cut, first part, rest) of a phrase after each of its words but the last."""
    cut = [
        F.when(
            size > k,
            F.struct(
                F.lit(k).alias("cut"),
                _first(phrase, F.lit(k)).alias("head"),
                _first(phrase, F.lit(k) - size).alias("tail"),
            ),
        )
        for k in range(1, longest)
    ]
    return F.array_compact(F.array(*cut))


def collocations(
    docs: DataFrame,
    min_count: int = 100,
    top: int = 2_000,
    longest: int = LONGEST,
    cover_percent: int = 100,
    scale: int = 1_000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, cut.

    A phrase has 2 to ``longest`` words and a >= ``min_count`` occurrences. Cut after its first words, its parts occur l and r times among the n
    words of the language; its score is the least floor(scale * a * n / (l * r)) over its cuts, at equal scores of the earliest cut.
    Phrases inside a longer phrase with at least ``cover_percent`` percent of their occurrences are left out. Ranks follow
    score, then a, both falling, then the phrase by its bytes.

    A null language is ``und``; null, empty and blank texts have no words; repeated rows count each time; texts are read whole, however
    long; other columns are ignored, whatever their names. An empty table, or one without frequent phrases, gives no rows.
    """
    slim = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    spelt = materialize(_summed(_grams(slim, 1)), "words")
    totals = spelt.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = F.col("n") >= min_count
    words = _word_lists(materialize(spelt.where(frequent), "frequent-words"))
    pairs = longer = None
    if words is not None:
        n_words = spelt.agg(F.sum("n").alias("n")).first()["n"] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(1 + 8 * n_words / max(1, min_count)))))
        pairs = _marks(slim, words, min_count, [2], bits)
        if longest > 2:
            longer = _marks(slim, words, min_count, range(3, longest + 1), bits, pairs)
    edges = _summed(_grams(slim, longest, words, pairs, longer))
    # The flow out of the node of each shorter phrase, and the pieces that end with it.
    heads = [F.when(F.col("size") >= k, F.struct(_first(F.col("phrase"), F.lit(k)).alias("phrase"), F.lit(k).alias("size"))) for k in range(1, longest + 1)]
    flow = edges.select("lang", "n", F.explode(F.array_compact(F.array(*heads))).alias("g")).select("lang", "g.phrase", "g.size", "n")
    known = materialize(_summed(flow).where(frequent), "phrases")

    found = known.where("size > 1")
    ends = F.array(*[_first(F.col("phrase"), n) for n in (F.col("size") - 1, 1 - F.col("size"))])
    covers = found.where("size > 2").select("lang", F.explode(ends).alias("phrase"), F.col("n").alias("cover"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    covered = F.coalesce(100 * F.col("cover") >= cover_percent * F.col("n"), F.lit(False))
    open_ends = found.join(covers, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "size", "n")

    cut = open_ends.select("lang", "phrase", F.col("n").alias("a"), F.explode(_cuts(F.col("phrase"), F.col("size"), longest)).alias("c"))
    cut = cut.select("lang", "phrase", "a", "c.cut", "c.head", "c.tail")
    counts = known.select("lang", "phrase", "n")
    cut = cut.join(counts.toDF("lang", "head", "l"), ["lang", "head"]).join(counts.toDF("lang", "tail", "r"), ["lang", "tail"])
    cut = cut.join(broadcast_if_small(materialize(totals, "totals")), "lang")
    wide = [F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")]
    over = (F.lit(scale).cast("decimal(9,0)") * (wide[0] * wide[1])).alias("over")
    cut = cut.select("lang", "phrase", "a", "cut", "l", "r", F.col("total").alias("n"), over, (wide[2] * wide[3]).alias("under"))
    cut = cut.withColumn("score", F.expr("over div under"))
    least = F.min_by(F.struct("l", "r", "n", "score", "cut"), F.struct("score", "cut")).alias("c")
    scored = materialize(cut.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "c.*"), "scored")

    # Ranks by a range sort: no task holds a whole language.
    ranked = materialize(number_in_order(scored, "lang", F.desc("score"), F.desc("a"), "phrase"), "in-order")
    first = ranked.groupBy("lang").agg(F.min("ord").alias("first"))
    ranked = ranked.join(broadcast_if_small(materialize(first, "first")), "lang")
    ranked = ranked.withColumn("rank", (F.col("ord") - F.col("first") + 1).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
