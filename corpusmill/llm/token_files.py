"""Token ids on disk: blocks of ids cut into byte or bit planes, each plane compressed by zstandard.

A folder of token files has two Parquet tables. ``chunks`` holds rows (shard, chunk, start, n_docs, n_ids, n_bytes, payload); ``index``
holds the same without the payload, so that a reader finds documents and positions without touching ids.
A payload is: a header, the compressed document table (ids, null flags, lengths), then the planes of
each block with their sizes. Chunks end at document boundaries, so any task can decode any chunk alone.

Shards are ranges of ascending document id; one task writes one shard, and its chunks carry running starts inside it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import pieces

BLOCK_IDS = 8_192
CHUNK_IDS = 1 << 20
#: magic, format version, bytes of an id, 1 if bit planes, ids of a block, documents, ids, bytes of the document table
HEADER = struct.Struct("<4sHBBIIQI")
MAGIC, VERSION = b"CMTK", 1


def _planes(block: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block, lowest byte or highest bit first."""
    raw = block.view(np.uint8).reshape(len(block), block.itemsize)
    if bits:
        raw = np.unpackbits(raw, axis=1)
        return [np.packbits(raw[:, k]).tobytes() for k in range(raw.shape[1])]
    return [raw[:, k].tobytes() for k in range(raw.shape[1])]


def _joined(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if bits:
        raw = np.packbits(np.stack([np.unpackbits(r, count=n) for r in rows], axis=1), axis=1)
    else:
        raw = np.stack(rows, axis=1)
    return np.ascontiguousarray(raw).reshape(-1).view(f"<u{width}")


def encode_chunk(ids: np.ndarray, names: list[int | None], sizes: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """Ids of whole documents, with their document ids and lengths, as one payload."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ids = np.ascontiguousarray(ids.astype(f"<u{width}"))
    pack = zstandard.ZstdCompressor(level=level)
    known = np.array([n is not None for n in names], bool)
    table = np.array([n or 0 for n in names], "<i8").tobytes() + known.tobytes() + sizes.astype("<i8").tobytes()
    table = pack.compress(table)
    out = [HEADER.pack(MAGIC, VERSION, width, bits, BLOCK_IDS, len(names), len(ids), len(table)), table]
    for at in range(0, len(ids), BLOCK_IDS):
        planes = [pack.compress(p) for p in _planes(ids[at : at + BLOCK_IDS], bits)]
        out.append(struct.pack(f"<{len(planes)}I", *map(len, planes)))
        out += planes
    return b"".join(out)


def decode_chunk(payload: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, document ids, lengths) of a payload."""
    magic, version, width, bits, block, n_docs, n_ids, table_size = HEADER.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of token ids of this version")
    unpack = zstandard.ZstdDecompressor()
    at = HEADER.size
    table = unpack.decompress(payload[at : at + table_size])
    at += table_size
    names = np.frombuffer(table, "<i8", n_docs).tolist()
    known = np.frombuffer(table, bool, n_docs, 8 * n_docs)
    sizes = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
    parts = []
    for first in range(0, n_ids, block):
        count = 8 * width if bits else width
        lengths = struct.unpack_from(f"<{count}I", payload, at)
        at += 4 * count
        planes = []
        for length in lengths:
            planes.append(unpack.decompress(payload[at : at + length]))
            at += length
        parts.append(_joined(planes, min(block, n_ids - first), width, bits))
    ids = np.concatenate(parts) if parts else np.zeros(0, f"<u{width}")
    return ids, [n if k else None for n, k in zip(names, known, strict=True)], sizes


def _write_shard(path: str, end_id: int, bits: bool, chunk_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.kept("library", path, pieces.library_encoder)
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        ids, names, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = encode_chunk(np.concatenate(ids), names, np.concatenate(sizes), bits)
            row = [[shard], [chunk], [start], [len(names)], [held], [len(payload)], [payload]]
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            fields = ["shard", "chunk", "start", "n_docs", "n_ids", "n_bytes", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], fields)

        for batch in batches:
            for lo, texts in pieces.slices(batch.column(1), 4 * chunk_ids):
                found, offsets = pieces.with_end(*encoder.ids(texts), end_id)
                ids.append(found)
                sizes.append(np.diff(offsets))
                names += batch.column(0).slice(lo, len(texts)).to_pylist()
                held += len(found)
                if held >= chunk_ids:
                    yield close()
                    chunk, start, held = chunk + 1, start + held, 0
                    ids, names, sizes = [], [], []
        if names:
            yield close()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    folder: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: bool = False,
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Encode every whole text by the tokenizer at ``path``, with an end id, in ascending order of document id.

    Null texts are empty: their only id is the end id. Null ids come first; rows of one id are ordered by text. Other
    columns are dropped. An empty table gives empty files.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The hash shares out an id that many rows repeat.
    ranged = slim.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    fields = "shard int, chunk long, start long, n_docs long, n_ids long, n_bytes long, payload binary"
    ranged.mapInArrow(_write_shard(path, end_id, bits, chunk_ids), fields).write.parquet(f"{folder}/chunks")
    docs.sparkSession.read.parquet(f"{folder}/chunks").drop("payload").write.parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: id, start over the whole corpus, n_tokens, ids (array<int>)."""
    return _documents(spark, folder, "id long, start long, n_tokens long, ids array<int>", lambda ids: ids.astype(np.int32))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As read_tokens, with the crc32 of the ids as little-endian unsigned 32-bit integers in their place."""
    fields = "id long, start long, n_tokens long, ids_crc32 long"
    return _documents(spark, folder, fields, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _documents(spark: SparkSession, folder: str, fields: str, form) -> DataFrame:
    index = spark.read.parquet(f"{folder}/index")
    # One row per shard, which is one per task that wrote.
    totals = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in totals])
    base = {shard: int(at) for (shard, _), at in zip(totals, before, strict=False)}
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()) if "array" in fields else pa.int64()]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, docs, sizes = decode_chunk(payload.as_py())
                ends = np.cumsum(sizes)
                starts = base[shard.as_py()] + start.as_py() + ends - sizes
                made = [form(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [docs, starts, sizes, made]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spark.read.parquet(f"{folder}/chunks").select("shard", "start", "payload").mapInArrow(run, fields)
