"""Continuous ingest: record files appearing below a root merge into the corpus as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusmill.encoders import Encoder
from corpusmill.plans.jobs import Importer, import_files, index_batch
from corpusmill.schema import RECORD_FILE
from corpusmill.session import streaming_copy
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.folders import qualified
from corpusmill.sources.records import WHOLE_FILES, located


def ingest_stream(
    store: CorpusStore,
    root: str,
    checkpoint: str,
    importer: str | Importer = "directory",
    encoder: Encoder | None = None,
    max_files: int | None = None,
    pattern: str = RECORD_FILE,
    **options,
) -> StreamingQuery:
    """Merge every file not seen before, then stop; the checkpoint remembers which those are.

    The merge skips what the corpus already holds at equal priority, so a batch delivered twice
    after a failure changes no record. Stored postings, and given an encoder an existing index, follow
    each batch at the cost of that batch; where a batch died before they did, the next one brings them in step in
    full. The curated importer's licence gate and the encoder are checked before a batch writes anything. The query runs in a
    copy of the store's session.
    """
    spark = store.spark
    base = qualified(spark, root)
    store.init()
    # A stream needs the columns of its files told.
    reader = streaming_copy(spark).readStream.format(WHOLE_FILES).schema("path string, modificationTime timestamp, length long, content binary")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(root, recursiveFileLookup=True, pathGlobFilter=pattern)

    def take(batch: DataFrame, _: int) -> None:
        follows = encoder is not None and store.index.exists()
        if follows:
            store.index.require(encoder)
        in_step = store.in_step("index")
        result = import_files(store, batch, importer, **options)
        if store.postings.exists() and not store.in_step("postings"):
            store.update_postings()
        if follows:
            index_batch(store, result, encoder, in_step)

    return (
        located(files, base)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
