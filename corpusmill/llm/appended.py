"""Columns computed from the texts of Arrow batches and set beside all columns of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm import pieces


def with_columns(docs: DataFrame, text_col: str, fields: dict[str, str], compute: Callable[[pa.Array], list[pa.Array]], slice_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with the new fields; columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in fields]
    source = docs.select(*keep, docs[text_col].cast("string").alias("_text_to_score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in pieces.slices(batch.column(len(keep)), slice_bytes):
                old = [batch.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*old, *compute(texts)], [*keep, *fields])

    schema = docs.select(*keep).schema
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)
