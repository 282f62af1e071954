"""Packing of token sequences as a cutting-stock problem, solved by column generation.

Documents longer than a sequence are cut into full sequences and a rest. All pieces are counted by length class, so the
problem that the driver solves has at most ``CLASSES`` rows however large the corpus is: a linear program over patterns
(how many pieces of each class share a sequence), whose new columns a knapsack dynamic program prices until a bound
proves that they cannot save another ten-thousandth. Pattern counts are rounded down; what is left over, at most the pieces of one
sequence per pattern, is packed first-fit by decreasing length. Pieces are ranked inside their class by a range-partitioned sort
and take the places of the patterns in that order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import pieces
from corpusmill.session import materialize

SEQUENCE = 2_048
CLASSES = 256
GAP = 1e-4
#: Bytes of text that a task works on at once; this bounds its memory.
SLICE_BYTES = 2 << 20


def pieces_of(docs: DataFrame, path: str, end_id: int, sequence: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens; a null text has the end id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.kept("library", path, pieces.library_encoder)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            for lo, texts in pieces.slices(batch.column(1), SLICE_BYTES):
                ids, offsets = pieces.with_end(*encoder.ids(texts), end_id)
                sizes = np.diff(offsets)
                n = -(-sizes // sequence)
                row = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * sequence
                length = np.minimum(sizes[row] - start, sequence)
                raw, at = ids.astype("<u4").tobytes(), 4 * (offsets[row] + start)
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                doc = batch.column(0).slice(lo, len(texts)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in (start, length, crc, sizes[row]))], names)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: values[k] is that of a piece of size k + 1; sizes add up to the capacity at most."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = values[:c] + best[c - 1 :: -1]
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], take[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts) of the linear program: counts @ patterns meets the demand of each size with least sum."""
    present = np.flatnonzero(demand)
    m = len(present)
    if not m:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    fits = capacity // (present + 1)
    columns = np.diag(fits).astype(float)
    inverse = np.diag(1.0 / fits)
    x = demand[present] / fits
    for turn in range(1, 100 * m + 1):
        dual = inverse.sum(axis=0)
        values = np.full(len(demand), -1.0)
        values[present] = dual
        value, pattern = price(values, capacity)
        if value <= 1 + gap:
            break
        column = pattern[present].astype(float)
        # Not a matrix product: on small matrices the threads of a BLAS cost far more than the sums.
        direction = (inverse * column).sum(axis=1)
        up = direction > 1e-9
        step = np.full(m, np.inf)
        step[up] = x[up] / direction[up]
        out = int(step.argmin())
        x -= step[out] * direction
        x[out] = step[out]
        x = np.maximum(x, 0)
        columns[:, out] = column
        if turn % 200:
            inverse[out] /= direction[out]
            rest = direction.copy()
            rest[out] = 0
            inverse -= np.outer(rest, inverse[out])
        else:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ demand[present], 0)
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, present] = np.rint(columns.T).astype(np.int64)
    return patterns, x


def first_fit(demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Bins for a bounded rest: sizes k + 1 in falling order, each into the first bin with room."""
    room: list[int] = []
    held: list[np.ndarray] = []
    for k in range(len(demand) - 1, -1, -1):
        at = 0
        for _ in range(int(demand[k])):
            while at < len(room) and room[at] < k + 1:
                at += 1
            if at == len(room):
                room.append(capacity)
                held.append(np.zeros(len(demand), np.int64))
            room[at] -= k + 1
            held[at][k] += 1
    return held


def plan(demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, whole counts) that place every piece exactly once."""
    patterns, x = solve(demand, capacity, gap)
    counts = np.floor(x + 1e-6).astype(np.int64)
    left = demand - counts @ patterns
    while (left < 0).any():  # rounding noise only
        over = int(np.flatnonzero((patterns[:, left < 0] > 0).any(axis=1) & (counts > 0))[0])
        counts[over] -= 1
        left += patterns[over]
    rest = first_fit(left, capacity)
    if rest:
        patterns, counts = np.concatenate((patterns, np.stack(rest))), np.concatenate((counts, np.ones(len(rest), np.int64)))
    used = counts > 0
    return patterns[used], counts[used]


class Places:
    """Which sequence takes the piece of a given rank in its class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        base = np.cumsum(counts) - counts
        self.first, self.base, self.many = {}, {}, {}
        for k in np.flatnonzero(patterns.any(axis=0)).tolist():
            at = np.flatnonzero(patterns[:, k])
            many = patterns[at, k]
            taken = many * counts[at]
            self.first[k], self.base[k], self.many[k] = np.cumsum(taken) - taken, base[at], many

    def __call__(self, size_class: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        for k in np.unique(size_class).tolist():
            rows = size_class == k
            p = np.searchsorted(self.first[k], rank[rows], side="right") - 1
            out[rows] = self.base[k][p] + (rank[rows] - self.first[k][p]) // self.many[k][p]
        return out


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with the writing task and their number inside (task, class), in an order that a retry repeats."""
    keys = ["size_class", "doc_id", "start", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            k = batch.column("size_class").to_numpy()
            local = np.zeros(len(k), np.int64)
            for c in np.unique(k).tolist():
                at = np.flatnonzero(k == c)
                local[at] = seen.get(c, 0) + np.arange(len(at))
                seen[c] = seen.get(c, 0) + len(at)
            columns = [*batch.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "local"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{fields}, part int, local long")


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    sequence: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id lies in exactly one piece; the pieces of a sequence stand without gaps from offset 0 and hold ``sequence`` ids
    at most. Null and empty texts have one piece with the end id. Repeated rows and null ids are packed like any other; an
    empty table gives no rows. Other columns are dropped.
    """
    unit = max(1, sequence // CLASSES)
    capacity = sequence // unit
    if capacity * unit != sequence:
        raise ValueError(f"the sequence length must be at most {CLASSES} or a multiple of {sequence // CLASSES}")
    cut = pieces_of(docs, path, end_id, sequence, id_col, text_col)
    cut = cut.withColumn("size_class", F.ceil((F.col("length") - unit) / unit).cast("int"))
    ranked = materialize(_ranked(materialize(cut, "pieces")), "ranked")
    # A row per writing task and class; tasks hold ranges of classes, so about as many as tasks and classes together.
    counted = sorted(map(tuple, ranked.groupBy("part", "size_class").count().collect()))
    demand, before = np.zeros(capacity, np.int64), {}
    for part, k, n in counted:
        before[part, k] = int(demand[k])
        demand[k] += n
    places = Places(*plan(demand, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, k = batch.column("part").to_numpy(), batch.column("size_class").to_numpy()
            base = np.fromiter((before[key] for key in zip(part.tolist(), k.tolist(), strict=True)), np.int64, len(k))
            found = places(k, base + batch.column("local").to_numpy())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, "sequence_id"])

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = ranked.mapInArrow(place, fields)
    # A sequence holds at most as many pieces as ids.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    before_it = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return placed.withColumn("offset", before_it)
