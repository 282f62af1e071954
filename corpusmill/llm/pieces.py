"""Texts as ids, by way of distinct short pieces.

A byte-level tokenizer never joins a character that is no white space to white space after it, nor an ASCII letter or digit to a
mark after it, nor a single line break to what follows; so a text may be cut there: the ids of the text are those of its pieces in
order. A batch is cut by its bytes, its distinct pieces are encoded once, and ids are gathered by numpy. A worker keeps
encoded pieces of up to ``CACHE_BYTES`` between batches and tasks; that is a matter of speed only.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 192 << 20
#: What a kept piece takes beside its own bytes and ids: a key, a number and their places.
PIECE_BYTES = 160
SLICE_BYTES = 16 << 20
#: By byte: ASCII that is no white space to any tokenizer, letters and digits, and the marks that a cut may precede.
SOLID, WORD, MARK = (np.zeros(256, bool) for _ in range(3))
SOLID[33:127] = True
SOLID[[*range(9), *range(14, 28), 127]] = True
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARK[list(b".,;:!?")] = True
#: The characters beyond ASCII that some tokenizer takes for white space.
WHITE = [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
WHITE_ENDS = np.array(sorted(int.from_bytes(chr(c).encode()[-3:], "big") for c in WHITE))
#: Stands between pieces that are encoded in one go: a token of its own beside letters, digits and spaces. Only Latin pieces are
#: joined, on whose letters all versions of Unicode agree.
BAR = "|"
JOINED = 64
LATIN_END = "\u0250"

#: Encodes pieces: gives them in an order of its own, all their ids, and how many each has.
Encode = Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``limit`` bytes, each with its first row; a longer text stands alone."""
    if not len(texts):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    run = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for lo, hi in itertools.pairwise(cuts):
        yield lo, texts.slice(lo, hi - lo)


def _after_solid(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is no white space."""
    solid = SOLID[raw[at - 1]]
    wide = np.flatnonzero(raw[at - 1] >= 0x80)
    if len(wide):
        p = at[wide]
        two = raw[p - 2].astype(np.int64) << 8 | raw[p - 1]
        three = raw[np.maximum(p - 3, 0)].astype(np.int64) << 16 | two
        solid[wide] = ~(np.isin(two, WHITE_ENDS) | np.isin(three, WHITE_ENDS))
    return solid


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, offsets, distinct pieces): row i has the pieces codes[offsets[i]:offsets[i + 1]]. Null is empty."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = np.zeros(len(raw) + 1, bool)
    # White space after something solid, a mark after a letter or digit, and something solid after a single line break.
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[at > 0]
    begins[at[_after_solid(raw, at)]] = True
    begins[1:-1] |= MARK[raw[1:]] & WORD[raw[:-1]]
    line = np.flatnonzero(begins[:-2] & (raw[:-1] == 10)) if len(raw) > 1 else at[:0]
    begins[line[SOLID[raw[line + 1]]] + 1] = True
    begins[ends] = True
    begins[-1] = False
    starts = np.flatnonzero(begins)
    buffers = [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
    return np.asarray(coded.indices), np.searchsorted(starts, ends), coded.dictionary.to_pylist()


def from_lists(encoded: list[str], found: Sequence[Sequence[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return encoded, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


class PieceIds:
    """Ids of pieces, encoded once each while they are kept."""

    def __init__(self, encode: Encode, limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        """Forget all pieces."""
        self.slot: dict[str, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        return np.concatenate((array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)))

    def slots(self, pieces: list[str]) -> np.ndarray:
        if self.held > self.limit:
            self.clear()
        slot = self.slot
        new = [p for p in pieces if p not in slot]
        if new:
            new, ids, sizes = self.encode(new)
            n = len(slot)
            self.flat = self._room(self.flat, self.used + len(ids))
            self.start, self.size = self._room(self.start, n + len(new)), self._room(self.size, n + len(new))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(new)] = sizes
            self.used += len(ids)
            self.held += PIECE_BYTES * len(new) + sum(map(len, new)) + 4 * len(ids)
            slot.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(slot.__getitem__, pieces), np.int64, len(pieces))

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        codes, offsets, pieces = cut(texts)
        slots = self.slots(pieces)[codes]
        total = np.concatenate(([0], np.cumsum(self.size[slots])))
        return total[offsets[1:]] - total[offsets[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        codes, offsets, pieces = cut(texts)
        slots = self.slots(pieces)[codes]
        sizes = self.size[slots]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.start[slots] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[at], ends[offsets]


_KEPT: dict[tuple, PieceIds] = {}


def kept(kind: str, path: str, build: Callable[[str], Encode]) -> PieceIds:
    """The encoder of this worker for a tokenizer file, made on first use."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = PieceIds(build(path))
    return _KEPT[kind, path]


def library_encoder(path: str) -> Encode:
    """Encode pieces by the tokenizers library with its defaults, without begin or end ids.

    Pieces of letters and digits are encoded many at once, with a bar between them, where the tokenizer keeps the bar apart.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def several(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    bar, *parts = several([BAR, "ab", " cd", "1", BAR.join(("ab", " cd", "1"))])
    apart = len(bar) == 1 and [*parts[0], *bar, *parts[1], *bar, *parts[2]] == parts[3]

    def encode(pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        plain, other = [], []
        for p in pieces:
            (plain if apart and p.lower().removeprefix(" ").isalnum() and max(p) < LATIN_END else other).append(p)
        _, joined, _ = from_lists([], several([BAR.join(plain[i : i + JOINED]) + BAR for i in range(0, len(plain), JOINED)]))
        stops = np.flatnonzero(joined == bar[0]) if plain else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate(([-1], stops))) - 1
        _, rest, rest_sizes = from_lists([], several(other))
        ids = np.concatenate((np.delete(joined, stops), rest))
        return plain + other, ids, np.concatenate((sizes, rest_sizes))

    return encode


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with an end id behind each."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
