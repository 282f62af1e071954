"""SimHash near-duplicates: 64-bit fingerprints linked within a bit distance, found by a Gray-order index.

Fingerprints are hashed per document in Arrow batches. Two fingerprints that differ in at most ``d`` bits agree
on at least one of ``d + 1`` bit masks that share out the word, so rows are dealt by (mask, masked bits) and
only meet inside such a group. A group is sorted by Gray rank; runs that share their leading bits become the upper
nodes of a tree, and the tree is joined with itself level by level: a pair of nodes whose shared patterns already
differ in more than ``d`` bits is dropped with everything below it.

A group of more than ``GROUP_ROWS`` distinct fingerprints is dealt again by masks that also fix a share of its
remaining bits. Once ``log2(GROUP_ROWS)`` bits or fewer remain free a group cannot be larger, so a task holds a bounded
group whatever the corpus, and no link is lost. Exact copies are one node: they never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import star_components
from corpusmill.session import broadcast_if_small, materialize

SEED = 42
GROUP_ROWS = 16_384
STEP_BITS = 4
PAIR_BLOCK = 1 << 20
SHINGLE_BLOCK = 1 << 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLE_BLOCK):
        spans = zip(starts[at : at + SHINGLE_BLOCK].tolist(), ends[at : at + SHINGLE_BLOCK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) per input row. A null or blank text has fingerprint 0; a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _shares(free: list[int], parts: int) -> list[int]:
    """Masks that share out the given bit positions in runs of nearly equal length."""
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _finer(mask: int, parts: int) -> list[int]:
    return [mask | share for share in _shares([b for b in range(64) if not mask >> b & 1], parts)]


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _expand(counts_u: np.ndarray, counts_v: np.ndarray):
    """Row and pair offsets of the children of node pairs."""
    sizes = counts_u * counts_v
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, at // counts_v[row], at % counts_v[row]


def linked_pairs(group: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal group whose fingerprints differ in at most ``max_bits`` bits.

    ``group`` and ``fp`` are sorted by group and, inside it, by Gray rank.
    """
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(fp) else np.zeros(0, np.int64)
    levels = [heads]
    for bits in range(STEP_BITS, 65, STEP_BITS):
        prefix = fp >> np.uint64(64 - bits)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])))
        levels.append(np.flatnonzero(new))
    # The children of a node are the nodes of the next level that start inside it.
    first = [np.searchsorted(low, high) for high, low in zip(levels, levels[1:], strict=False)]
    last = [np.append(f[1:], len(low)) for f, low in zip(first, levels[1:], strict=False)]
    sizes = np.diff(np.append(heads, len(fp)))
    roots = np.flatnonzero(sizes > 1)
    stack = [(0, roots, roots)]
    while stack:
        level, u, v = stack.pop()
        if level == len(first):
            apart = u != v
            yield levels[level][u[apart]], levels[level][v[apart]]
            continue
        counts = last[level] - first[level]
        total = np.cumsum(counts[u] * counts[v])
        if len(u) > 1 and total[-1] > PAIR_BLOCK:
            cut = max(1, len(u) // 2)
            stack += [(level, u[cut:], v[cut:]), (level, u[:cut], v[:cut])]
            continue
        row, i, j = _expand(counts[u], counts[v])
        a, b = first[level][u[row]] + i, first[level][v[row]] + j
        bits = np.uint64(64 - STEP_BITS * (level + 1))
        starts = levels[level + 1]
        differ = np.bitwise_count((fp[starts[a]] >> bits) ^ (fp[starts[b]] >> bits))
        keep = (differ <= max_bits) & (a <= b)
        if keep.any():
            stack.append((level + 1, a[keep], b[keep]))


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the given pairs."""
    label = np.arange(n)
    while len(u):
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _link_groups(max_bits: int):
    """Read rows sorted by (mask, bits); emit a spanning forest of the links of the groups of one run."""

    def solve(mask: np.ndarray, key: np.ndarray, fp: np.ndarray):
        order = np.lexsort((_gray_rank(fp), key, mask))
        mask, key, fp = mask[order], key[order], fp[order]
        group = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        names, node = np.unique(fp, return_inverse=True)
        label = np.arange(len(names))
        for u, v in linked_pairs(group, fp, max_bits):
            # One block of pairs at a time joins what the earlier ones found.
            a, b = np.concatenate((node[u], np.arange(len(names)))), np.concatenate((node[v], label))
            label = _forest(a, b, len(names))
        moved = np.flatnonzero(label != np.arange(len(names)))
        arrays = [pa.array(names[moved].view(np.int64)), pa.array(names[label[moved]].view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(3)]))
            rows += batch.num_rows
            if rows < 4 * GROUP_ROWS:
                continue
            table = np.concatenate(held, axis=1)
            # The last group may go on in the next batch: keep it back.
            tail = int(np.flatnonzero((table[0] != table[0, -1]) | (table[1] != table[1, -1]))[-1:].sum() + 1)
            if tail == 1 and (table[:2, 0] == table[:2, -1]).all():
                held = [table]
                continue
            yield solve(*table[:, :tail])
            held, rows = [table[:, tail:]], table.shape[1] - tail
        if rows:
            yield solve(*np.concatenate(held, axis=1))

    return run


def _dealt(nodes: DataFrame, max_bits: int, group_rows: int) -> DataFrame:
    """Rows (mask, bits, fp) such that every link shares a group and no group is larger than the bound."""
    parts = max_bits + 1
    masks = _shares(list(range(64)), parts)
    key = (F.col("fp").bitwiseAND(F.col("mask"))).alias("bits")
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).select("mask", key, "fp")
    done: list[DataFrame] = []
    while True:
        large = rows.groupBy("mask", "bits").count().where(F.col("count") > group_rows).select("mask", "bits")
        large = materialize(large, "large-groups")
        still = [row["mask"] & (1 << 64) - 1 for row in large.select("mask").distinct().collect()]
        if not still:
            return _all([*done, rows])
        done.append(rows.join(large, ["mask", "bits"], "left_anti"))
        finer = {_signed(m): [_signed(x) for x in _finer(m, parts)] for m in still}
        table = F.create_map(*[F.lit(x) for m, f in finer.items() for x in (m, f)])
        hot = rows.join(large, ["mask", "bits"], "left_semi")
        rows = hot.select("fp", F.explode(table[F.col("mask")]).alias("mask")).select("mask", key, "fp")
        rows = materialize(rows, "finer-groups")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def links(nodes: DataFrame, max_bits: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (u, v) whose connected components are those of all links between distinct fingerprints ``fp``."""
    dealt = _dealt(nodes, max_bits, group_rows).repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInArrow(_link_groups(max_bits), "u long, v long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row (id, fp, component) per input row; the component is the smallest id reachable over links.

    Links join fingerprints that differ in at most ``max_bits`` bits. Null, blank and empty texts have
    fingerprint 0 and link like any other. A null id names no component: it is null only where every id of the
    component is. Repeated rows are copies. Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    stars = star_components(links(nodes, max_bits, group_rows))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document per component, the one of smallest id, with their columns unchanged.

    Rows that repeat that id count as copies of it: one of them stays, the first by the hash of its columns.
    Rows of null id cannot be named as members and all stay.
    """
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col).where("id IS NOT NULL")
    stays = F.count_if(F.col("id") == F.col("component")).alias("n")
    fates = materialize(found.groupBy(F.col("id").alias(id_col)).agg(stays).where("n <> 1"), "fates")
    # Those that go are few beside those that stay: texts stay where they are while the ids to drop fit a broadcast.
    kept = docs.join(broadcast_if_small(fates.select(id_col)), id_col, "left_anti").select(*docs.columns)
    twice = fates.where("n > 1").select(id_col)
    if twice.isEmpty():
        return kept
    again = docs.join(broadcast_if_small(twice), id_col, "left_semi")
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    return kept.unionAll(again.groupBy(id_col).agg(row).select("_row.*"))
