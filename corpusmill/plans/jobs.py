"""Corpus jobs: import, sync, duplicate removal, indexing, status and search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import replace as replace_fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.encoders import Encoder, encoder_for
from corpusmill.operators import dedup, drift, kept_counts, lookup, merge
from corpusmill.operators.gates import admit, manifest_frame, one_per_record, require_known_sources, require_vetted
from corpusmill.operators.keyword import attach_records, keyword_search, search_postings
from corpusmill.operators.retrieval import search_summaries
from corpusmill.schema import CORPUS, DEFAULT_MANIFEST, SUMMARY, conform
from corpusmill.session import broadcast_if_small, is_small, materialize, small_files
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.records import parse_records, present_slugs, scan_record_files, with_slug
from corpusmill.sources.vector_index import EncoderMismatchError, VectorIndex, published_location

FIELDS = [f.name for f in CORPUS.fields]


@dataclass
class MergeResult:
    """What a merge did.

    `counts`: total, added, replaced, skipped_duplicate. `rejects`: ord, id, name, source, reason.
    `accepted` are the records it took in, `displaced` the ids they replaced, None when nothing changed. `probe` tells, where
    filters were in step, how many body hashes came, passed the filters, and were stored indeed.
    """

    counts: dict[str, int]
    rejects: DataFrame
    accepted: DataFrame | None = None
    displaced: DataFrame | None = None
    probe: dict[str, int] | None = None

    @property
    def stats(self) -> DataFrame:
        row = tuple(self.counts[c] for c in merge.STATS)
        spark = self.rejects.sparkSession
        return spark.createDataFrame([row], ", ".join(f"{c} long" for c in merge.STATS))

    def changed(self) -> bool:
        return bool(self.counts["added"] or self.counts["replaced"])


def merge_batch(store: CorpusStore, batch: DataFrame) -> MergeResult:
    """Merge corpus rows with `ord` into the store as one version, under the priority rule."""
    return _merge_written(store, materialize(batch, "batch"))


def _merge_written(store: CorpusStore, batch: DataFrame) -> MergeResult:
    stored = store.read().select("id", "content_hash", "source")
    small = is_small(batch.select("id", "content_hash"))
    sound, rejects = admit(stored, batch, small)
    held, probe = _held(store, stored, sound)
    outcomes = materialize(merge.hash_outcomes(held, sound, small), "outcomes")
    counts = merge.merge_stats(outcomes).first().asDict()
    # Every record of the batch is either sound, and then an arrival, or rejected.
    total = batch.count()
    counts["skipped_duplicate"] += total - counts["total"]
    counts["total"] = total
    if not counts["added"] and not counts["replaced"]:
        return MergeResult(counts, rejects, probe=probe)
    taken = merge.accepted(sound, outcomes)
    # Written before the store changes: `stored` is read from it.
    gone = materialize(merge.displaced(stored, outcomes), "displaced") if counts["replaced"] else None
    store.apply(taken, gone)
    return MergeResult(counts, rejects, taken, gone, probe)


def _held(store: CorpusStore, stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, dict[str, int] | None]:
    """The stored rows that share a body hash with the batch, and what the filters told.

    Where no hash passes them, no stored row is read.
    """
    passing = store.may_hold(batch)
    if passing is None:
        return stored, None
    passing = materialize(passing, "possible")
    n_passing = passing.count()
    if n_passing:
        held = materialize(stored.join(broadcast_if_small(passing), "content_hash", "left_semi").select(*stored.columns), "held")
    else:
        held = store.spark.createDataFrame([], stored.schema)
    n_found = held.select("content_hash").distinct().count() if n_passing else 0
    probe = {"hashes": batch.select("content_hash").distinct().count(), "passing": n_passing, "found": n_found}
    return held, probe


Importer = Callable[[DataFrame], DataFrame]


def import_files(store: CorpusStore, files: DataFrame, importer: str | Importer, **options) -> MergeResult:
    """Merge scanned record files; files that do not decode are rejected with their reason.

    An importer of your own turns (path, location, text) into corpus rows with `ord`, unique and in
    arrival order, and `error`, null for a sound row. The curated importer refuses the files as a whole, before
    anything is written, when a repository among them is not vetted.
    """
    if importer == "curated":
        if options.get("manifest") is None:
            options["manifest"] = manifest_frame(store.spark, DEFAULT_MANIFEST)
        require_vetted(with_slug(files).select("slug"), options["manifest"])
    rows = importer(files) if callable(importer) else parse_records(files, importer, keep_malformed=True, **options)
    with small_files(rows.sparkSession):
        parsed = materialize(rows, "parsed")
    broken = parsed.where("error IS NOT NULL").select(
        "ord", "id", "name", "source", F.concat(F.lit("front matter: "), "error").alias("reason")
    )
    result = _merge_written(store, parsed.where("error IS NULL").select(*FIELDS, "ord"))
    return replace_fields(result, rejects=result.rejects.unionByName(broken))


def import_tree(
    store: CorpusStore,
    root: str,
    importer: str | Importer,
    manifest: list[tuple[str, str, str]] | None = None,
    encoder: Encoder | None = None,
    **options,
) -> MergeResult:
    """Import a tree of record files and, given an encoder, bring an existing index in step.

    The curated importer refuses the whole tree when a repository in it is not vetted.
    """
    store.init()
    if importer == "curated":
        vetted = manifest_frame(store.spark, manifest or DEFAULT_MANIFEST)
        require_vetted(present_slugs(store.spark, root), vetted)
        options["manifest"] = vetted
    result = import_files(store, scan_record_files(store.spark, root), importer, **options)
    if encoder is not None and result.changed():
        auto_index(store, encoder)
    return result


def auto_index(store: CorpusStore, encoder: Encoder) -> str:
    """Index what an import brought: nothing without an index, nothing under another encoder."""
    if not store.index.exists():
        return "no index"
    try:
        counts = store.index.update(store.read(), encoder)
    except EncoderMismatchError:
        return "other encoder"
    store.note_step("index")
    return "updated" if counts["added"] or counts["removed"] else "current"


def index_batch(store: CorpusStore, result: MergeResult, encoder: Encoder, in_step: bool) -> None:
    """Index just what one merge brought, at the cost of that batch.

    An index that was not in step before the merge is compared with the whole corpus instead.
    """
    if not in_step:
        store.index.update(store.read(), encoder)
    elif result.changed():
        store.index.apply(result.accepted, result.displaced, encoder)
    store.note_step("index")


def sync_snapshot(store: CorpusStore, snapshot: DataFrame, replace: bool = False) -> MergeResult | None:
    """Take a published snapshot in: replace an absent or empty corpus, or on demand; else merge.

    An explicit replace also invalidates the index, which covered the old records. Equal rows enter once and count
    as skipped; records that miss a required field, or whose id another body holds, stay out either way.
    """
    require_known_sources(snapshot)
    snapshot, repeated = one_per_record(conform(snapshot))
    # A snapshot has no order of its own; id and body give it one, and are unique by now.
    snapshot = snapshot.withColumn("ord", F.concat_ws(":", "id", "content_hash"))
    if replace or not store.records.exists() or store.read().isEmpty():
        if replace:
            store.index.vectors.retire()
        none = store.spark.createDataFrame([], CORPUS)
        sound, _ = admit(none, materialize(snapshot, "snapshot"))
        store.records.replace(sound)
        if store.counts.exists():
            store.build_aids()
        store.rebuild_postings()
        return None
    result = merge_batch(store, snapshot)
    result.counts["total"] += repeated
    result.counts["skipped_duplicate"] += repeated
    return result


def dedup_store(store: CorpusStore) -> dict[str, int]:
    """Remove all but the winner of each content hash."""
    records = store.read().select("id", "content_hash", "source", F.col("id").alias("ord"))
    gone = materialize(dedup.losers(records), "losers")
    before, removed = records.count(), gone.count()
    if removed:
        store.remove(gone)
    return {"before": before, "after": before - removed, "removed": removed}


def delete_records(store: CorpusStore, doomed: DataFrame) -> int:
    """Delete by id; returns how many records went."""
    gone = materialize(lookup.deleted_ids(store.read(), doomed), "deleted")
    count = gone.count()
    if count:
        store.remove(gone)
    return count


def build_or_update(store: CorpusStore, encoder: Encoder, force: bool = False) -> dict[str, int]:
    """Update the index if there is one, build it otherwise; `force` rebuilds under any encoder."""
    if store.index.exists() and not force:
        counts = store.index.update(store.read(), encoder)
    else:
        counts = {"added": store.index.build(store.read(), encoder), "removed": 0}
    store.note_step("index")
    return counts


def adopt_index(store: CorpusStore, published_root: str, encoder: Encoder) -> DataFrame:
    """Take over the published index of an encoder; returns how well it covers the corpus."""
    location = published_location(published_root, encoder.backend, encoder.model)
    store.index.adopt(VectorIndex(store.spark, location), encoder)
    return drift.index_status(store.read(), store.index.read())


def category_source_counts(store: CorpusStore) -> DataFrame:
    """(category, source, n), from kept counts that cover the newest records, else from the records."""
    if store.in_step("counts"):
        return kept_counts.totals(store.counts.read())
    return kept_counts.changes(store.read())


def status(store: CorpusStore) -> DataFrame:
    """One row: records, vectors, drift and the number of categories in use, which `lookup.categories` lists."""
    records = store.read()
    vectors = store.index.read() if store.index.exists() else store.spark.createDataFrame([], "id string")
    labels = lookup.categories(category_source_counts(store)).agg(F.count("*").alias("n_categories"))
    # Two one-row frames.
    return drift.index_status(records, vectors).join(labels, F.lit(True))


def keyword_hits(store: CorpusStore, queries: DataFrame, mode: str = "all", limit: int = 10, **options) -> DataFrame:
    """Keyword hits in short form, from stored postings that cover the newest records, else from the records."""
    records = store.read()
    if store.in_step("postings"):
        terms = store.terms.read() if store.terms.exists() else None
        hits = search_postings(store.postings.read(), queries, mode, limit=limit, push_grams=True, terms=terms, **options)
    else:
        hits = keyword_search(records, queries, mode, limit=limit, **options)
    return attach_records(hits, records, SUMMARY).select("query_id", "rank", *SUMMARY, "score")


def search(
    store: CorpusStore, queries: DataFrame, encoder: Encoder | None = None, k: int = 5, fallback: str | None = None
) -> DataFrame:
    """Semantic hits in short form; without an index an error, or keyword hits on fallback="keyword".

    The encoder is by default the one the index was built with.
    """
    if store.index.exists():
        encoder = encoder or encoder_for(store.index.meta()["embedding"])
        store.index.require(encoder)
        return search_summaries(store.read(), store.index.read(), queries, encoder, k)
    if fallback != "keyword":
        raise FileNotFoundError("no vector index; build one, or pass fallback='keyword'")
    return keyword_hits(store, queries, limit=k)
