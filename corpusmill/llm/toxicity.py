"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs, in numpy.

A word is the learned vector of its hash plus the mean of the learned vectors of its character 3- to 5-grams. Windows of
``WINDOW`` words overlap by a quarter and cover the whole text; the score of a text is that of its worst window. Learning takes a
bounded, hash-chosen sample of labelled rows. A label belongs to a text and not to a window, so a toxic text teaches by its
worst window after the first round, a clean one by all windows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.appended import with_columns

#: Bounds of the training sample: texts of each label, each of them whole.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_000, 2_000
WINDOW, STRIDE = 48, 36
WORD_BUCKETS, CHAR_BUCKETS, WORD_SIZE, CHAR_SIZE = 1 << 13, 1 << 14, 8, 12
HIDDEN, ATTENTION = 12, 12
ROUNDS, BATCH, RATE, ROUND_STEPS = 6, 192, 0.01, 12
#: Windows and words that are worked on at once, and bytes of text: these bound a task's memory.
WINDOW_BLOCK, GRAM_BLOCK, SLICE_BYTES = 2_048, 4_096, 1 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_starts(n: int) -> list[int]:
    """Where the windows of n words begin: the last one reaches the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the 3- to 5-grams of the UTF-8 bytes of ``<word>``."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    rows, buckets = [], []
    for n in (3, 4, 5):
        if len(data) < n:
            continue
        last = len(data) - n + 1
        mixed = np.full(last, n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(1_000_003) + data[k : k + last]
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        whole = row[:last] == row[n - 1 :]
        rows.append(row[:last][whole])
        buckets.append((mixed[whole] % np.uint64(CHAR_BUCKETS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, buckets = np.concatenate(rows), np.concatenate(buckets)
    order = np.argsort(rows, kind="stable")
    return rows[order], buckets[order]


@dataclass
class Words:
    """The inputs of distinct words: hash bucket, n-grams sorted by word, their number."""

    bucket: np.ndarray
    gram_word: np.ndarray
    gram: np.ndarray
    n_grams: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words), np.int64, len(words))
        gram_word, gram = _gram_buckets(words)
        return Words(bucket, gram_word, gram, np.maximum(np.bincount(gram_word, minlength=len(words)), 1))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        size = WORD_SIZE + CHAR_SIZE
        p = {
            "word": normal(WORD_BUCKETS, WORD_SIZE, scale=0.01),
            "char": normal(CHAR_BUCKETS, CHAR_SIZE, scale=0.05),
            "wx": normal(size, 6 * HIDDEN, scale=size**-0.5),
            "bx": np.zeros(6 * HIDDEN, np.float32),
            "u": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "bu": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "wa": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5),
            "ba": np.zeros(ATTENTION, np.float32),
            "va": normal(ATTENTION, scale=ATTENTION**-0.5),
            "wo": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5),
            "bo": np.full(1, -1.0, np.float32),
        }
        return Network(p)

    def embed(self, words: Words) -> np.ndarray:
        p = self.p
        chars = np.zeros((len(words.bucket), CHAR_SIZE), np.float32)
        heads = np.flatnonzero(np.diff(words.gram_word, prepend=-1))
        for lo in range(0, len(heads), GRAM_BLOCK):
            first = heads[lo : lo + GRAM_BLOCK]
            end = heads[lo + GRAM_BLOCK] if lo + GRAM_BLOCK < len(heads) else len(words.gram)
            sums = np.add.reduceat(p["char"][words.gram[first[0] : end]], first - first[0], axis=0)
            chars[words.gram_word[first]] = sums
        return np.concatenate((p["word"][words.bucket], chars / words.n_grams[:, None].astype(np.float32)), axis=1)

    def run(self, gates: np.ndarray, mask: np.ndarray, trace: list | None = None):
        """Logits of windows from input gates [steps, windows, 6 * HIDDEN]; the backward half reads from the end."""
        p, (steps, n, _) = self.p, gates.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((steps, n, 2 * HIDDEN), np.float32)
        k = HIDDEN
        x = np.empty((2, n, 3 * k), np.float32)
        for t in range(steps):
            x[0], x[1] = gates[t, :, : 3 * k], gates[steps - 1 - t, :, 3 * k :]
            m = np.stack((mask[t], mask[steps - 1 - t]))[:, :, None]
            inner = h @ p["u"] + p["bu"]
            zr = _sigmoid(x[:, :, : 2 * k] + inner[:, :, : 2 * k])
            z, r = zr[:, :, :k], zr[:, :, k:]
            new = np.tanh(x[:, :, 2 * k :] + r * inner[:, :, 2 * k :])
            step = m * (1 - z) * (new - h)
            if trace is not None:
                trace.append((h, z, r, new, inner[:, :, 2 * k :], m))
            h = h + step
            out[t, :, :k], out[steps - 1 - t, :, k:] = h[0], h[1]
        act = np.tanh(out @ p["wa"] + p["ba"])
        energy = np.where(mask > 0, act @ p["va"], -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, out)
        logit = pooled @ p["wo"] + p["bo"][0]
        return logit, (out, act, weight, pooled)

    def gradient(self, words: Words, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, share: np.ndarray):
        """Gradients of the weighted mean log loss of windows ids [steps, windows]."""
        p, k = self.p, HIDDEN
        embedded = self.embed(words)
        x = embedded[ids]
        gates = x @ p["wx"] + p["bx"]
        trace: list = []
        logit, (out, act, weight, pooled) = self.run(gates, mask, trace)
        g = {}
        dlogit = ((_sigmoid(logit) - target) * share / share.sum()).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["wo"]
        dout = weight[:, :, None] * dpool
        dweight = np.einsum("tnh,nh->tn", out, dpool)
        denergy = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", denergy, act)
        dact = denergy[:, :, None] * p["va"] * (1 - act * act)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", out, dact), dact.sum(axis=(0, 1))
        dout += dact @ p["wa"].T
        dgates = np.zeros_like(gates)
        g["u"], g["bu"] = np.zeros_like(p["u"]), np.zeros_like(p["bu"])
        dh = np.zeros((2, ids.shape[1], k), np.float32)
        steps = len(ids)
        for t in range(steps - 1, -1, -1):
            h, z, r, new, hn, m = trace[t]
            dh = dh + np.stack((dout[t, :, :k], dout[steps - 1 - t, :, k:]))
            dnew = dh * m * (1 - z) * (1 - new * new)
            dz = dh * m * (h - new) * z * (1 - z)
            dr = dnew * hn * r * (1 - r)
            dinner = np.concatenate((dz, dr, dnew * r), axis=2)
            dx = np.concatenate((dz, dr, dnew), axis=2)
            dgates[t, :, : 3 * k], dgates[steps - 1 - t, :, 3 * k :] = dx[0], dx[1]
            g["u"] += np.einsum("dnh,dng->dhg", h, dinner)
            g["bu"] += dinner.sum(axis=1, keepdims=True)
            dh = dh * (1 - m * (1 - z)) + dinner @ p["u"].transpose(0, 2, 1)
        flat = dgates.reshape(-1, 6 * k)
        g["wx"], g["bx"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        dx = flat @ p["wx"].T
        dword = np.zeros_like(embedded)
        np.add.at(dword, ids.ravel(), dx)
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.bucket, dword[:, :WORD_SIZE])
        np.add.at(g["char"], words.gram, (dword[:, WORD_SIZE:] / words.n_grams[:, None].astype(np.float32))[words.gram_word])
        return g

    def gates(self, words: Words) -> np.ndarray:
        return self.embed(words) @ self.p["wx"] + self.p["bx"]

    def window_logits(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows ids [windows, steps] over the gates of distinct words, in blocks."""
        found = [
            self.run(gates[ids[lo : lo + WINDOW_BLOCK].T], mask[lo : lo + WINDOW_BLOCK].T)[0]
            for lo in range(0, len(ids), WINDOW_BLOCK)
        ]
        return np.concatenate(found) if found else np.zeros(0, np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the worst window of each text; a text without words is one empty window, scored 0."""
        split = [words_of(t) for t in texts]
        number: dict[str, int] = {}
        codes = [np.fromiter((number.setdefault(w, len(number)) for w in s), np.int64, len(s)) for s in split]
        best = np.full(len(texts), -np.inf, np.float32)
        if not number:
            return np.zeros(len(texts))
        gates = self.gates(Words.of(list(number)))
        row, ids, mask = windows_of(codes)
        np.maximum.at(best, row, self.window_logits(gates, ids, mask))
        return np.where(np.isfinite(best), _sigmoid(best.astype(np.float64)), 0.0)


def windows_of(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, ids, mask) of all windows; shorter ones are filled up with masked steps."""
    row, ids, mask = [], [], []
    for i, own in enumerate(codes):
        if not len(own):
            continue
        starts = window_starts(len(own))
        row += [i] * len(starts)
        if len(own) < WINDOW:
            ids.append(np.pad(own, (0, WINDOW - len(own)))[None])
            mask.append((np.arange(WINDOW) < len(own))[None])
        else:
            ids.append(own[np.array(starts)[:, None] + np.arange(WINDOW)])
            mask.append(np.ones((len(starts), WINDOW), bool))
    return np.array(row, np.int64), np.concatenate(ids), np.concatenate(mask).astype(np.float32)


def fit(bags: list[tuple[int, list[list[str]]]], seed: int = 1) -> Network:
    """Learn from (label, windows as lists of words). Without both labels the network scores all texts low."""
    network = Network.new(seed)
    bags = [(label, [w for w in windows if w]) for label, windows in bags]
    bags = [(label, windows) for label, windows in bags if windows]
    if len({label for label, _ in bags}) < 2:
        network.p["wo"][:] = 0
        return network
    number: dict[str, int] = {}
    owner, label, ids, mask = [], [], [], []
    for i, (toxic, windows) in enumerate(bags):
        for w in windows:
            own = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
            owner.append(i)
            label.append(toxic)
            ids.append(np.pad(own, (0, WINDOW - len(own))))
            mask.append(np.arange(WINDOW) < len(own))
    owner, label = np.array(owner), np.array(label, np.float32)
    ids, mask = np.stack(ids), np.stack(mask).astype(np.float32)
    words = Words.of(list(number))
    grams_of = np.searchsorted(words.gram_word, np.arange(len(number) + 1))
    rng = np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in network.p.items()}, {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    taught = label > 0
    for turn in range(ROUNDS):
        if turn:
            logits = network.window_logits(network.gates(words), ids, mask)
            worst = np.full(len(bags), -np.inf)
            np.maximum.at(worst, owner, logits)
            taught = (label > 0) & (logits >= worst[owner])
            # Clean windows: the most suspect half of a round's share, the rest by chance.
            chance = rng.random(len(logits)) + (logits > np.quantile(logits[label == 0], 0.9))
        else:
            chance = rng.random(len(label))
        clean = np.flatnonzero(label == 0)
        clean = clean[np.argsort(-chance[clean], kind="stable")[: 2 * max(BATCH, int(taught.sum()))]]
        chosen = np.concatenate((np.flatnonzero(taught), clean))
        # Few windows are gone through several times, so that each round makes some steps.
        passes = -(-ROUND_STEPS * BATCH // max(len(chosen), ROUND_STEPS * BATCH // 30))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for lo in range(0, len(chosen), BATCH):
            part = chosen[lo : lo + BATCH]
            own, local = np.unique(ids[part], return_inverse=True)
            local = local.reshape(ids[part].shape)
            sizes = grams_of[own + 1] - grams_of[own]
            at = np.repeat(grams_of[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            few = Words(words.bucket[own], np.repeat(np.arange(len(own)), sizes), words.gram[at], np.maximum(sizes, 1))
            share = np.where(label[part] > 0, 1.0, 0.7).astype(np.float32)
            grads = network.gradient(few, local.T, mask[part].T, label[part], share)
            step += 1
            rate = RATE * (1 - 0.8 * turn / ROUNDS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                network.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return network


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Learn from labelled rows; the caller leaves out what is held out. An id with several labels is toxic if one is.

    Rows are drawn by a hash of their id at a rate set by the count of their label, about ``SAMPLE_TOXIC`` and
    ``SAMPLE_CLEAN`` at most; all windows of their texts teach.
    """
    label = F.col(label_col).cast("int")
    one = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return fit([])
    rates = [min(1.0, bound / counts[kind]) for kind, bound in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), id_col), F.lit(1_000_000))
    ids = one.where(draw < F.when(F.col("toxic") == 1, int(1_000_000 * rates[1]) + 1).otherwise(int(1_000_000 * rates[0]) + 1))
    # The drawn ids are bounded by the sample's size, so their broadcast is.
    drawn = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), id_col)
    # Arrival order is chance; fitting must not depend on it.
    sample = sorted((r["toxic"], words_of(r["text"])) for r in drawn.select("text", "toxic").collect())
    return fit([(toxic, [words[s : s + WINDOW] for s in window_starts(len(words))]) for toxic, words in sample])


def judge(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """All rows and columns with score (0 to 1) and predicted (1 where the score is 0.5 or more).

    Null texts and texts without a word score 0. Columns of those names are replaced; repeated rows are judged alike.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        score = network.score(texts.to_pylist())
        return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]

    return with_columns(docs, text_col, {"score": "double", "predicted": "integer"}, compute, SLICE_BYTES)
