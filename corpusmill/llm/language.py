"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Learning takes a bounded, hash-chosen sample: at most about ``SAMPLE_ROWS`` whole texts, shared out evenly over the languages.
Each language gets several centroids by spherical k-means. A text is compared with all of them by cosine, whole; it is rejected
where its distance to the nearest is out of what windows of its own length show in the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.appended import with_columns

#: Bounds of the training sample: windows in all, windows of one language, characters of a window.
SAMPLE_ROWS, LANGUAGE_ROWS = 20_000, 1_000
N_GRAMS, BUCKET_BITS, TERMS, CENTROIDS = (1, 2, 3), 20, 4_096, 4
#: A text is rejected below this share of the similarity that all but a thousandth of windows of its length reach.
TAIL, SLACK = 0.001, 0.7
LENGTHS = [8, 16, 32, 64, 128, 256, 512, 1024, 2048]
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the lower-cased texts, and the letters of each row; what is no letter is one class."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = _letters()[codes]
    code = np.where(letter, codes, 32).astype(np.uint64)
    rows, buckets = [], []
    for n in N_GRAMS:
        if len(code) < n:
            continue
        last = len(code) - n + 1
        mixed = np.full(last, n, np.uint64)
        some = np.zeros(last, bool)
        for k in range(n):
            mixed = mixed * _FACTORS[k] + code[k : k + last]
            some |= letter[k : k + last]
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        whole = some & (row[:last] == row[n - 1 :])
        rows.append(row[:last][whole])
        buckets.append(mixed[whole].astype(np.int32))
    n_letters = np.bincount(row[letter], minlength=len(texts))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), n_letters
    return np.concatenate(rows), np.concatenate(buckets), n_letters


@dataclass
class Model:
    languages: list[str]
    term: np.ndarray  # bucket -> term or -1
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    of: np.ndarray  # language of each centroid
    least: np.ndarray  # similarity by length class below which a text is rejected

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of square-rooted counts times idf, and the letters of each text."""
        row, bucket, letters = grams(texts)
        term = self.term[bucket]
        row, term = row[term >= 0].astype(np.int64), term[term >= 0]
        width = len(self.idf)
        counts = np.bincount(row * width + term, minlength=len(texts) * width).reshape(len(texts), width)
        out = np.sqrt(counts, dtype=np.float32) * self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), letters

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, similarity, rejected) of each text."""
        names, scores, refused = [], [], []
        for lo, hi in _runs(texts):
            vectors, letters = self.vectors(texts[lo:hi])
            if not self.languages:
                names += [UNKNOWN] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                refused.append(np.ones(hi - lo, bool))
                continue
            near = vectors @ self.centroids.T
            best = near.argmax(axis=1)
            score = np.clip(near[np.arange(len(best)), best], 0, 1)
            known = letters > 0
            names += [self.languages[self.of[b]] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, score, 0))
            refused.append(~known | (score < self.least[_length_class(letters)]))
        if not names:
            return [], np.zeros(0), np.zeros(0, bool)
        return names, np.concatenate(scores), np.concatenate(refused)


def _runs(texts: list[str], chars: int = 1 << 21, rows: int = 512):
    lo = held = 0
    for i, text in enumerate(texts):
        if i > lo and (held + len(text) > chars or i - lo >= rows):
            yield lo, i
            lo, held = i, 0
        held += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, letters, side="right")


def fit(texts: list[str], langs: list[str], seed: int = 1) -> Model:
    """Learn from windows and their languages. Without any, every text is unknown and rejected."""
    languages = sorted(set(langs))
    which = np.searchsorted(languages, langs) if langs else np.zeros(0, np.int64)
    seen = np.zeros(1 << BUCKET_BITS, np.int64)
    for lo, hi in _runs(texts):
        row, bucket, _ = grams(texts[lo:hi])
        seen += np.bincount(np.unique(row.astype(np.int64) << BUCKET_BITS | bucket) & (1 << BUCKET_BITS) - 1, minlength=len(seen))
    top = np.argsort(-seen, kind="stable")[:TERMS]
    top = top[seen[top] > 0]
    term = np.full(1 << BUCKET_BITS, -1, np.int16)
    term[top] = np.arange(len(top))
    idf = (np.log((1 + len(texts)) / (1 + seen[top])) + 1).astype(np.float32)
    model = Model(languages, term, idf, np.zeros((0, len(idf)), np.float32), np.zeros(0, np.int64), np.zeros(len(LENGTHS) + 1))
    if not languages:
        return model
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([model.vectors(texts[lo:hi])[0] for lo, hi in _runs(texts)])
    found, of = [], []
    for i in range(len(languages)):
        own = vectors[which == i]
        centres = _spherical_means(own, min(CENTROIDS, len(own)), rng)
        found.append(centres)
        of += [i] * len(centres)
    model.centroids, model.of = np.concatenate(found), np.array(of)
    # Similarities that windows of each length reach, their own language's centroids only.
    for k, chars in enumerate([4, *LENGTHS]):
        cut = [t[: max(chars, 4) * 3 // 2] for t in texts if len(t) >= chars] or texts
        _, score, _ = model.judge(cut)
        model.least[k] = SLACK * np.quantile(score, TAIL) if chars >= 32 else 0
    return model


def _spherical_means(vectors: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the text and non-null language of a bounded sample of the rows; the caller leaves out what is held out.

    Rows are drawn by a hash of their id at a rate set by the count of their language, so that no group is gathered; their
    texts are taken whole.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    counts = {r[0]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    want = min(LANGUAGE_ROWS, SAMPLE_ROWS // max(1, len(counts)))
    if not counts:
        return fit([], [])
    draw = F.pmod(F.xxhash64(F.lit("sample"), id_col, F.crc32(F.col(text_col))), F.lit(1_000_000))
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(1_000_000 * min(1.0, want / n)) + 1)])
    drawn = rows.where(draw < rates[F.col(lang_col)]).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # The order of arrival is left to chance by Spark; fitting must not depend on it.
    sample = sorted((r["t"], r["l"]) for r in drawn.collect())
    return fit([t for t, _ in sample], [lang for _, lang in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns with lang_pred, score (0 to 1) and rejected.

    A null text or one without a letter is ``und`` with score 0 and rejected. A text none of whose n-grams is known goes
    to the first language with score 0. Repeated rows are judged alike; columns of those names are replaced.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        names, scores, refused = model.judge([t or "" for t in texts.to_pylist()])
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused)]

    return with_columns(docs, text_col, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, compute)
