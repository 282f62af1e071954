"""Token counts of whole texts; a text longer than one chunk is encoded in overlapping chunks that resynchronise.

Neighbouring chunks overlap. Both encodings carry offsets; they are spliced at a boundary that both have and that is
stable whatever stands around it: a space after a character that is no white space, which byte-level patterns never
cross and special tokens never hold. Tokens behind it must agree in both up to the next such boundary. Where an overlap has no
such place it is widened, at worst over the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import pieces

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512


def _splice(text: str, left, left_at: int, right, right_at: int) -> int | None:
    """The first stable boundary of two encodings, as a position in the text."""
    left_ends = {left_at + start: i for i, (start, _) in enumerate(left.offsets)}
    limit = left_at + left.offsets[-1][1] if left.offsets else left_at
    right_ids, left_ids = right.ids, left.ids
    stable = []
    for j, (start, _) in enumerate(right.offsets):
        at = right_at + start
        if at >= limit:
            break
        if at in left_ends and at > right_at and text[at] == " " and not text[at - 1].isspace():
            stable.append((at, left_ends[at], j))
    for (at, i, j), (_, i_next, j_next) in zip(stable, stable[1:], strict=False):
        if left_ids[i:i_next] == right_ids[j:j_next]:
            return at
    return None


def count_by_chunks(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text by overlapping chunks; ``encode`` gives ids and character offsets."""
    total, begin, start, end = 0, 0, 0, min(len(text), chunk)
    left = encode(text[start:end])
    while end < len(text):
        width = overlap
        while True:
            right_start = max(start, end - width)
            if right_start == start:
                # The overlap has reached the chunk's start: take one longer chunk in its place.
                end = min(len(text), start + 2 * (end - start))
                left = encode(text[start:end])
                break
            right_end = min(len(text), right_start + chunk)
            if right_end <= end:
                right_end = min(len(text), end + chunk)
            right = encode(text[right_start:right_end])
            at = _splice(text, left, start, right, right_start)
            if at is not None and at > begin:
                total += sum(1 for s, _ in left.offsets if begin <= start + s < at)
                begin, start, end, left = at, right_start, right_end, right
                break
            width *= 2
    return total + sum(1 for s, _ in left.offsets if start + s >= begin)


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row.

    Counts are those of the tokenizers library for the .json file at ``path`` with its defaults, without begin or end
    ids. Texts of up to ``chunk`` characters are one chunk: they are cut at stable boundaries only, so that a piece that many
    of them share is encoded once. Null and empty texts have none. Repeated rows stay; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        counter = pieces.kept("library", path, pieces.library_encoder)
        whole = None
        for batch in batches:
            for lo, texts in pieces.slices(batch.column(1)):
                long = pc.fill_null(pc.greater(pc.utf8_length(texts), chunk), False)
                rest = pc.if_else(long, "", texts)
                n = counter.sizes(rest)
                for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)):
                    whole = whole or Tokenizer.from_file(path)
                    n[i] = count_by_chunks(texts[i].as_py(), lambda t: whole.encode(t, add_special_tokens=False), chunk, overlap)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                ids = batch.column(0).slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([ids, size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = slim.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
