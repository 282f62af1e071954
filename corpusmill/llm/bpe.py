"""Byte-level BPE by replaying all merges over the distinct words of a batch.

An inverted index maps each token pair to the positions where it stands. Ranks are taken in order; all positions of
a rank are merged at once, and only the pairs beside them are looked up again. Should a merge ever uncover a pair of lower
rank, the word is encoded alone by the plain rule (lowest rank first, then leftmost), so results are exact.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import pieces

NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain rule for one word: merge the pair of lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    queue = [(ranks.get(word[i : i + 2], NONE), i, 2) for i in range(len(word) - 1)]
    heapq.heapify(queue)
    while queue:
        rank, i, size = heapq.heappop(queue)
        if rank == NONE:
            break
        j = after[i]
        if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
            pair = parts[i] + parts[after[i]]
            heapq.heappush(queue, (ranks.get(pair, NONE), i, len(pair)))
        if before[i] >= 0:
            pair = parts[before[i]] + parts[i]
            heapq.heappush(queue, (ranks.get(pair, NONE), before[i], len(pair)))
    return [ranks[p] for p in parts if p]


class Replay:
    """Merges of a vocabulary, ready to be replayed over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is no token."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(w) for w in words]
        todo = [i for i, r in enumerate(whole) if r is None and words[i]]
        out = [[] if r is None else [r] for r in whole]
        for i, ids in zip(todo, self._replayed([words[i] for i in todo]), strict=True):
            out[i] = ids
        return out

    def _replayed(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        # Position n stands for "none" on either side; its word is that of no position.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends - 1] = n
        before[ends - sizes] = n
        after, before = np.append(after, n), np.append(before, n)
        sym = np.append(sym, 0)
        rank = np.full(n + 1, NONE, np.int32)
        alive, here = np.ones(n + 1, bool), np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        odd: set[int] = set()

        def file(at: np.ndarray) -> np.ndarray:
            """Look up the pairs that start at the positions and enter them; returns their ranks."""
            found = np.where(after[at] < n, self._rank(sym[at], sym[after[at]]), NONE)
            rank[at] = found
            hit = found != NONE
            at, r = at[hit], found[hit]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part, k in zip(np.split(at, cuts), r[np.concatenate(([0], cuts))].tolist() if len(r) else [], strict=False):
                if k not in index:
                    index[k] = []
                    heapq.heappush(queue, k)
                index[k].append(part)
            return found

        file(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            here[at] = True
            chained = here[after[at]]
            if chained.any():
                # Overlapping places of one pair, as in aaa: from the left, every other one.
                skip: set[int] = set()
                for p, c in zip(at.tolist(), chained.tolist(), strict=True):
                    if p not in skip and c:
                        skip.add(int(after[p]))
                here[list(skip)] = False
                at = at[here[at]]
            right = after[at]
            # Between two merged places side by side the plain rule might have found a pair of lower rank.
            beside = here[after[right]]
            if beside.any():
                passing = self._rank(np.full(int(beside.sum()), r), sym[after[right][beside]]) < r
                odd.update(word[at[beside][passing]].tolist())
            here[at] = False
            sym[at] = r
            alive[right] = False
            rank[right] = NONE
            after[at] = after[right]
            behind = after[at] < n
            before[after[at][behind]] = at[behind]
            left = before[at]
            touched = np.unique(np.concatenate((at, left[left < n])))
            lower = file(touched) < r
            if lower.any():
                odd.update(word[touched[lower]].tolist())
        kept = np.flatnonzero(alive[:n])
        counts = np.bincount(word[kept], minlength=len(words))
        flat, cuts = sym[kept].tolist(), np.concatenate(([0], np.cumsum(counts))).tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in odd:
            out[i] = encode_word(words[i], self.ranks)
        return out


def replay_encoder(path: str, pattern: str):
    """Encode pieces: their matches of the pattern, distinct ones replayed together."""
    import regex

    replay, matches = Replay(read_ranks(path)), regex.compile(pattern).findall

    def encode(texts: list[str]):
        found = [matches(t) for t in texts]
        words = list({w for f in found for w in f})
        ids = dict(zip(words, replay.encode([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        return pieces.from_lists(texts, [ids[f[0]] if len(f) == 1 else [i for w in f for i in ids[w]] for f in found])

    return encode


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row; null and empty texts have none, repeated rows stay, others columns go."""
    return _encoded(docs, path, pattern, id_col, text_col, "id long, ids array<int>", _id_lists)


def _id_lists(ids: np.ndarray, offsets: np.ndarray, tokens):
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))]


def _digests(ids: np.ndarray, offsets: np.ndarray, tokens):
    """n_tokens, digest of the ids in decimal, digest of the bytes they decode to."""
    text, raw = tokens
    cuts = offsets.tolist()
    shown, bytes_of = text[ids].tolist(), raw[ids].tolist()
    spans = list(zip(cuts, cuts[1:], strict=False))
    named = [hashlib.sha256(" ".join(shown[a:b]).encode()).hexdigest() for a, b in spans]
    decoded = [hashlib.sha256(b"".join(bytes_of[a:b])).hexdigest() for a, b in spans]
    return [pa.array(np.diff(offsets)), pa.array(named), pa.array(decoded)]


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row, from encoding and then decoding its text."""
    fields = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, path, pattern, id_col, text_col, fields, _digests)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """id and the bytes of its ids, from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {r: t for t, r in read_ranks(path).items()}
        for batch in batches:
            found = [b"".join(raw[i] for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "bytes"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, bytes binary")


_TOKENS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: its decimal form and its bytes."""
    if path not in _TOKENS:
        ranks = read_ranks(path)
        raw = np.full(max(ranks.values()) + 1, b"", object)
        for token, rank in ranks.items():
            raw[rank] = token
        _TOKENS[path] = np.array([str(i) for i in range(len(raw))], object), raw
    return _TOKENS[path]


def _encoded(docs, path, pattern, id_col, text_col, fields, form) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.kept("replay", path, lambda p: replay_encoder(p, pattern))
        for batch in batches:
            for lo, texts in pieces.slices(batch.column(1)):
                ids, offsets = encoder.ids(texts)
                columns = form(ids, offsets, _tokens(path))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *columns], names)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, fields)
