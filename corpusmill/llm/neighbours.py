"""Approximate nearest neighbours through learned partitions.

A bounded sample of vectors gives a nearest-neighbour graph. The graph is cut into balanced parts with few edges
between them, and a small classifier learns which parts a vector and its neighbours lie in. Every row of the table is filed under its
most probable part; a query goes to the several most probable parts, and all rows of those parts are ranked by exact distance.
How many parts that are is measured: ``TRIALS`` rows are searched for in the whole table by brute force, and enough parts are visited
to find ``TARGET`` of their true neighbours. Parts grow in number with the square root of the rows, up to ``MAX_PARTS``.

A part is searched in pairs of bounded blocks of rows and queries, one group per pair, so a part that holds a third of all rows, or
very many copies of one vector, is spread over tasks, and nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Bounds of the training sample and of what is learned from it; a part needs some rows of the sample to be learned.
SAMPLE_ROWS, MAX_PARTS, PART_SAMPLE, GRAPH_DEGREE, HIDDEN = 8_192, 256, 32, 10, 128
#: Rows searched for by brute force, and the share of their true neighbours that the routed parts must hold.
TRIALS, TARGET = 64, 0.97
ROW_BLOCK, QUERY_BLOCK = 16_384, 16_384
COMPARE_BLOCK = 1 << 21


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows whose vector is not null, not zero, and finite in every component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & good & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        d = _distances(x[lo : lo + 512], x)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, slack: float = 1.1, rounds: int = 15) -> np.ndarray:
    """A part for each node: halved along principal directions, then nodes move to where their neighbours are
    while no part passes ``slack`` times its fair share."""
    part = np.zeros(len(x), np.int64)
    groups, label = [(np.arange(len(x)), n_parts)], 0
    while groups:
        rows, n = groups.pop()
        if n == 1:
            part[rows] = label
            label += 1
            continue
        own = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ axis, kind="stable")]
        half = n // 2
        cut = len(rows) * half // n
        groups += [(order[:cut], half), (order[cut:], n - half)]
    room = int(slack * len(x) / n_parts) + 1
    both = np.concatenate((np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()))
    other = np.concatenate((graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])))
    for _ in range(rounds):
        votes = np.zeros((len(x), n_parts), np.int32)
        np.add.at(votes, (both, part[other]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=n_parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier with one hidden layer from vectors to parts, and how many parts a query visits."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def size(self) -> int:
        return len(self.mean)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def _trained(x: np.ndarray, target: np.ndarray, rng, rounds: int = 60, batch: int = 256, rate: float = 0.01) -> Router:
    size, n_parts = x.shape[1], target.shape[1]
    r = Router(
        x.mean(axis=0), float(x.std()) or 1.0,
        rng.standard_normal((size, HIDDEN)) * size**-0.5, np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, n_parts)) * HIDDEN**-0.5, np.zeros(n_parts),
    )
    names = ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(getattr(r, k)) for k in names} for _ in range(2))
    step = 0
    for turn in range(rounds):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            inside = (x[rows] - r.mean) / r.scale
            hidden = np.tanh(inside @ r.w1 + r.b1)
            logits = hidden @ r.w2 + r.b2
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = d @ r.w2.T * (1 - hidden * hidden)
            grads = {"w2": hidden.T @ d, "b2": d.sum(axis=0), "w1": inside.T @ dh, "b1": dh.sum(axis=0)}
            step += 1
            now = rate * (1 - turn / rounds) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                setattr(r, name, getattr(r, name) - now * first[name] / (np.sqrt(second[name]) + 1e-8))
    return r


def fit(sample: np.ndarray, n_rows: int, seed: int = 1) -> Router:
    """Learn parts for a table of ``n_rows`` vectors from a sample of them."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    n_parts = int(min(MAX_PARTS, n_rows**0.5 / 2, len(x) // PART_SAMPLE))
    size = x.shape[1]
    if n_parts < 2:
        return Router(np.zeros(size), 1.0, np.zeros((size, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, min(GRAPH_DEGREE, len(x) - 1))
    part = balanced_parts(x, graph, n_parts)
    # Half the weight is a vector's own part, half those of its neighbours.
    target = np.zeros((len(x), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.5
    return _trained(x, target, rng)


def true_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour's vector) of the k nearest other rows of a few vectors, by comparing them with every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, row, score = nearest_in(x, ids, _matrix(batch.column(1), x.shape[1]), batch.column(0).to_numpy(), k)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(score), *taken.columns], ["query", "score", "id", "vector"])

    hits = rows.select("id", "vector").mapInArrow(run, "query int, score double, id long, vector array<double>")
    best = Window.partitionBy("query").orderBy("score", "id")
    table = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "vector").toArrow()
    return table["query"].to_numpy(), _matrix(table["vector"].combine_chunks(), x.shape[1])


def probes_needed(router: Router, queries: np.ndarray, neighbours: np.ndarray) -> int:
    """How many parts the queries must visit, so that a share of ``TARGET`` of their neighbours is filed in one of them."""
    n_parts = len(router.b2)
    if not len(queries):
        return n_parts
    order = np.argsort(-router.logits(queries), axis=1, kind="stable")
    at = (order == router.part(neighbours)[:, None]).argmax(axis=1)
    reached = np.cumsum(np.bincount(at, minlength=n_parts)) / len(at)
    return int(np.argmax(reached >= TARGET)) + 1


def learn(rows: DataFrame, k: int = 10) -> Router | None:
    """Learn from a hash-chosen sample of (id, vector) rows of one length; None where there are none."""
    n = rows.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("neighbours"), "id"), F.lit(1 << 30))
    rate = min(1.0, SAMPLE_ROWS / n)
    drawn = rows.where(draw <= int(rate * (1 << 30))).select("id", "vector").toArrow()
    if not drawn.num_rows:
        drawn = rows.limit(1).toArrow()
    x, ids = _matrix(drawn["vector"].combine_chunks(), len(drawn["vector"][0])), drawn["id"].to_numpy()
    order = np.lexsort((*x.T[::-1], ids))
    x, ids = x[order], ids[order]
    router = fit(x, n)
    if len(router.b2) > 1:
        trials = np.random.default_rng(2).permutation(len(x))[:TRIALS]
        found, near = true_neighbours(rows, ids[trials], x[trials], k)
        router.probes = probes_needed(router, x[trials][found], near)
    return router


def _filed(rows: DataFrame, router: Router) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.part(_matrix(batch.column(1), router.size)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["id", "vector", "part"])

    return rows.mapInArrow(run, "id long, vector array<double>, part int")


def _routed(queries: DataFrame, router: Router) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = router.parts(_matrix(batch.column(1), router.size))
                found = pa.array(parts.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], ["id", "vector", "parts"])

    return queries.mapInArrow(run, "id long, vector array<double>, parts array<int>")


def nearest_in(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query, row, distance) of the k nearest rows of each query in double precision, ties to smaller ids."""
    out = []
    size = rows.shape[1]
    block = max(1, COMPARE_BLOCK // max(1, len(rows)))
    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        d = _distances(q, rows)
        same = query_ids[lo : lo + block, None] == ids
        d[same] = np.inf
        n = min(k, len(rows))
        kth = np.partition(d, n - 1, axis=1)[:, n - 1 :n]
        # What rounding could hide stays in; exact distances decide.
        scale = (q * q).sum(axis=1)[:, None] + (rows * rows).sum(axis=1).max()
        near = (d <= kth + 1e-12 * size * scale) & ~same
        qi, ri = np.nonzero(near)
        exact = np.empty(len(qi))
        for at in range(0, len(qi), 1 << 16):
            difference = q[qi[at : at + (1 << 16)]] - rows[ri[at : at + (1 << 16)]]
            exact[at : at + (1 << 16)] = np.sqrt((difference * difference).sum(axis=1))
        order = np.lexsort((ids[ri], exact, qi))
        qi, ri, exact = qi[order], ri[order], exact[order]
        first = np.searchsorted(qi, qi)
        best = np.arange(len(qi)) - first < k
        out.append((lo + qi[best], ri[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every query its k nearest rows found, by Euclidean distance.

    A row with the query's own id is no candidate. Vectors that are null, zero or hold null, NaN or infinite
    components take no part on either side, nor do those whose length is not the most frequent one (ties: the longest), nor null ids. Ties
    go to the smaller id; repeated rows are ranked each. Fewer candidates give fewer rows, an empty table none.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = lengths["n"] if lengths else 0
    rows = rows.where(F.size("vector") == size)
    asked = usable(queries, id_col, vector_col).where(F.size("vector") == size)
    rows = materialize(rows, "usable")
    router = learn(rows, max(1, k))
    if router is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filed, routed = materialize(_filed(rows, router), "filed"), materialize(_routed(asked, router), "routed")
    # At most MAX_PARTS rows each: how many blocks a part needs.
    row_blocks = {r["part"]: -(-r["count"] // ROW_BLOCK) for r in filed.groupBy("part").count().collect()}
    to = routed.select("id", "vector", F.explode("parts").alias("part"))
    query_blocks = {r["part"]: -(-r["count"] // QUERY_BLOCK) for r in to.groupBy("part").count().collect()}
    both = sorted(set(row_blocks) & set(query_blocks))
    if not both:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def blocks(counts: dict[int, int]):
        return F.create_map(*[F.lit(x) for p in both for x in (p, counts[p])])[F.col("part")]

    def every(counts: dict[int, int]):
        return F.explode(F.sequence(F.lit(0), blocks(counts) - 1))

    inside = F.col("part").isin(both)
    own_row = F.pmod(F.xxhash64("id", F.spark_partition_id()), blocks(row_blocks)).cast("int")
    own_query = F.pmod(F.xxhash64("id"), blocks(query_blocks)).cast("int")
    left = filed.where(inside).select("id", "vector", "part", own_row.alias("rb"), every(query_blocks).alias("qb"))
    right = to.where(inside).select("id", "vector", "part", own_query.alias("qb"), every(row_blocks).alias("rb"))

    def run(mine: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not mine.num_rows or not asking.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64())], names)
        ids, query_ids = mine["id"].to_numpy(), asking["id"].to_numpy()
        x, q = (_matrix(t["vector"].combine_chunks(), size) for t in (mine, asking))
        found, row, score = nearest_in(q, query_ids, x, ids, k)
        return pa.table([pa.array(query_ids[found]), pa.array(ids[row]), pa.array(score)], names)

    keys = ("part", "rb", "qb")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    # Each query brings at most k rows from each pair of blocks.
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
