"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.encoders import Encoder, encode, hash_encoder
from corpusmill.functions import text as tx
from corpusmill.functions.identity import embedding_text
from corpusmill.functions.record_json import from_json_columns, to_documents, to_json_columns
from corpusmill.functions.vector import norm, unit_row
from corpusmill.operators import composite, dedup, drift, evaluation, gates, lookup, merge, quality_score, usage
from corpusmill.operators import keyword as kw
from corpusmill.operators.arrivals import number_in_order
from corpusmill.operators.bounded_vectors import bounded_topk
from corpusmill.operators.nearest import vector_topk
from corpusmill.operators.retrieval import SCORE_DIGITS, retrieve_vectors
from corpusmill.operators.snapshot_diff import snapshot_diff
from corpusmill.plans import jobs
from corpusmill.plans import tables as tb
from corpusmill.schema import CORPUS, SUMMARY, source_priority
from corpusmill.session import fresh_path, materialize
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.records import parse_records, provenance, scan_record_files, split_records, with_slug
from corpusmill.sources.snapshots import read_snapshot, write_snapshot
from corpusmill.sources.vector_index import EncoderMismatchError, VectorIndex, dimension_report, published_location
from corpusmill.streaming.ingest import ingest_stream
from corpusmill.streaming.usage import streamed_usage, usage_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FIELDS = [f.name for f in CORPUS.fields]
ENCODER = hash_encoder()


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _joined(column: str = "tags"):
    return F.array_join(column, ",").alias(column)


# --- derived columns ------------------------------------------------------------------------------


@query
def content_identity(spark, sf_dir):
    return tb.corpus(spark, sf_dir).select("doc_id", "id", "content_hash")


@query
def embedding_texts(spark, sf_dir):
    text = embedding_text(F.col("name"), F.col("description"), F.col("instructions"))
    rows = tb.corpus(spark, sf_dir).select("id", text.alias("text"))
    return rows.select("id", F.md5("text").alias("text_hash"), F.length("text").alias("n_chars"))


@query
def frontmatter_split(spark, sf_dir):
    rows = split_records(tb.record_files(spark, sf_dir))
    return rows.select("path", "front", F.md5("body").alias("body_hash"), F.length("body").alias("body_chars"))


@query
def category_from_path(spark, sf_dir):
    rows = tb.documents(spark, sf_dir).select("doc_id", tb.record_path().alias("path"))
    path = F.col("path")
    return rows.select(
        "doc_id",
        tx.category_by_parent(path).alias("by_parent"),
        tx.category_by_group(path).alias("by_group"),
        tx.category_by_grouping_level(path).alias("by_level"),
    )


@query
def tag_normalise(spark, sf_dir):
    tags = tb.documents(spark, sf_dir).select("doc_id", tx.split_tags(F.col("text")).alias("tags"))
    return tags.select("doc_id", F.size("tags").alias("n_tags"), F.md5(F.array_join("tags", "|")).alias("tags_hash"))


@query
def provenance_fields(spark, sf_dir):
    manifest = F.broadcast(gates.manifest_frame(spark, tb.VETTED)).drop("source")
    # Records of repositories that nobody vetted have no provenance.
    rows = tb.corpus(spark, sf_dir).join(manifest, "slug", "left")
    inner = F.concat(F.lit("skills/"), F.col("name"), F.lit("/SKILL.md"))
    declared = F.when(F.col("category") == "fr", F.lit(" BSD-3-Clause ")).otherwise(F.lit(" "))
    rows = rows.select("id", "source_id", F.when(F.col("spdx").isNotNull(), provenance(F.col("slug"), F.col("spdx"), inner, declared)).alias("m"))
    keys = ["repo", "repo_url", "license", "path", "url", "declared_license"]
    return rows.select("id", "source_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in keys])


@query
def source_priorities(spark, sf_dir):
    rows = tb.corpus(spark, sf_dir).select("id", "slug", "source")
    unknown = source_priority(F.col("slug")).alias("slug_priority")
    return rows.select("id", source_priority(F.col("source")).alias("priority"), unknown)


@query
def vector_norms(spark, sf_dir):
    vectors = tb.embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("e"))
    return vectors.select(
        "vec_id", F.round(norm(F.col("e")), 6).alias("norm"), F.round(norm(unit_row(F.col("e"))), 6).alias("unit_norm")
    )


@query
def record_json(spark, sf_dir):
    """Records to JSON columns, back, and out again."""
    restored = from_json_columns(to_json_columns(tb.corpus(spark, sf_dir).select(*FIELDS)))
    flat = to_json_columns(restored)
    created = F.unix_timestamp(F.to_timestamp("created_at")).alias("created_epoch")
    return flat.select("id", "tags", F.get_json_object("metadata", "$.chars").alias("chars"), created)


@query
def record_documents(spark, sf_dir):
    """Each record as one JSON document, its fields read back from the text."""
    documents = to_documents(tb.corpus(spark, sf_dir).select(*FIELDS))
    read = [F.get_json_object("document", f"$.{c}").alias(c) for c in ("name", "source", "content_hash")]
    return documents.select("id", *read)


# --- gates and filters ----------------------------------------------------------------------------


@query
def reject_malformed(spark, sf_dir):
    rows = parse_records(tb.record_files(spark, sf_dir), "directory", on_error="quarantine", keep_malformed=True)
    return rows.where("error IS NOT NULL").select("path", "error")


@query
def field_defaults(spark, sf_dir):
    """Records of vetted repositories, and the files of others with the reason they stay out."""
    files, manifest = tb.record_files(spark, sf_dir), gates.manifest_frame(spark, tb.VETTED)
    rows = parse_records(files, "curated", manifest)
    declared = F.try_element_at("metadata", F.lit("declared_license")).alias("declared_license")
    none = F.lit(None).cast("string")
    kept = rows.select("id", "name", "description", "source", "source_id", "category", _joined(), declared, none.alias("reason"))
    outside = with_slug(files).join(F.broadcast(manifest.select("slug")), "slug", "left_anti")
    refused = outside.select(F.concat("slug", F.lit(":"), "inner").alias("source_id"), F.lit("no vetted licence").alias("reason"))
    return kept.unionByName(refused, allowMissingColumns=True)


@query
def directory_records(spark, sf_dir):
    rows = parse_records(tb.record_files(spark, sf_dir), "directory")
    return rows.select("path", "id", "name", "description", "category", F.size("tags").alias("n_tags"))


@query
def grouped_records(spark, sf_dir):
    rows = parse_records(tb.record_files(spark, sf_dir), "anthropic")
    return rows.select("path", "id", "name", "source", "category", _joined())


@query
def source_domain_check(spark, sf_dir):
    known = F.when(tb.source_number() < 16, F.lit("community")).otherwise(F.col("source"))
    return gates.source_violations(tb.documents(spark, sf_dir).select(known.alias("source")))


def _with_gaps(spark, sf_dir):
    quality = tb.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = tb.corpus(spark, sf_dir).join(quality, "doc_id", "left")
    return rows.withColumn("description", F.when(F.coalesce("quality", F.lit(1)) == 1, F.col("description")))


@query
def required_fields_check(spark, sf_dir):
    checked = gates.with_reject_reason(_with_gaps(spark, sf_dir))
    return checked.where("reason IS NOT NULL").select("id", "reason")


@query
def id_clash_check(spark, sf_dir):
    """Ids cut to the record's source and language on purpose, so that bodies do clash."""
    rows = tb.corpus(spark, sf_dir).withColumn("id", F.concat_ws("/", "source", "category"))
    stored, batch = tb.labelled(rows, spark, sf_dir), tb.unlabelled(rows, spark, sf_dir)
    # Of the stored bodies of one cut id the smallest hash stands for all: the store has unique ids.
    stored = stored.groupBy("id").agg(F.min("content_hash").alias("content_hash"))
    return gates.id_clashes(stored, batch)


@query
def license_gate(spark, sf_dir):
    rows = tb.corpus(spark, sf_dir).select("slug")
    return gates.unvetted(rows, gates.manifest_frame(spark, tb.VETTED))


# --- store algebra --------------------------------------------------------------------------------


@query
def dedup_winner(spark, sf_dir):
    slim = tb.corpus(spark, sf_dir).select("id", "ord", "content_hash", "source")
    return dedup.keep_winners(slim).select("content_hash", "id", "source")


@query
def dedup_losers(spark, sf_dir):
    return dedup.losers(tb.corpus(spark, sf_dir).select("id", "ord", "content_hash", "source"))


@query
def dedup_report(spark, sf_dir):
    return dedup.dedup_report(tb.corpus(spark, sf_dir).select("ord", "content_hash", "source"))


def _store_and_batch(spark, sf_dir):
    rows = tb.corpus(spark, sf_dir)
    stored = dedup.keep_winners(tb.labelled(rows, spark, sf_dir))
    return stored, tb.unlabelled(rows, spark, sf_dir)


def _slim(rows):
    return rows.select("id", "name", "content_hash", "source", "ord")


@query
def merge_stats(spark, sf_dir):
    stored, batch = _store_and_batch(spark, sf_dir)
    return merge.merge_stats(merge.hash_outcomes(_slim(stored), _slim(batch)))


@query
def merge_outcomes(spark, sf_dir):
    stored, batch = _store_and_batch(spark, sf_dir)
    outcomes = materialize(merge.hash_outcomes(_slim(stored), _slim(batch)), "outcomes")
    return merge.classify(_slim(batch), outcomes).select("ord", "id", "outcome")


@query
def merge_store(spark, sf_dir):
    stored, batch = (rows.select(*FIELDS, "ord") for rows in _store_and_batch(spark, sf_dir))
    merged = merge.merge_corpus(materialize(stored, "stored"), materialize(batch, "batch"))
    chars = F.try_element_at("metadata", F.lit("chars")).alias("chars")
    fields = ["id", "name", "content_hash", "source", "description", "source_id", "category"]
    return merged.select(*fields, _joined(), chars, F.md5("instructions").alias("body"))


@query
def record_count(spark, sf_dir):
    return lookup.record_count(tb.table(spark, sf_dir, "documents"))


@query
def category_counts(spark, sf_dir):
    return lookup.category_counts(tb.corpus(spark, sf_dir))


@query
def distinct_categories(spark, sf_dir):
    return lookup.categories(tb.corpus(spark, sf_dir))


@query
def by_category(spark, sf_dir):
    return lookup.by_category(tb.corpus(spark, sf_dir), "fr").select("id", "name", "content_hash")


@query
def id_scan(spark, sf_dir):
    """The ids of a stored corpus: the scan reads that column alone."""
    return lookup.all_ids(_store(spark, sf_dir, tb.corpus(spark, sf_dir)).read())


@query
def fetch_by_id(spark, sf_dir):
    known = tb.labelled(tb.corpus(spark, sf_dir), spark, sf_dir).select("id")
    unknown = tb.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("none-"), "item_id").alias("id"))
    found = lookup.fetch_by_id(tb.corpus(spark, sf_dir), known.unionByName(unknown))
    return found.withColumn("tags", F.array_join("tags", ","))


@query
def delete_by_id(spark, sf_dir):
    labels = tb.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    rows = tb.corpus(spark, sf_dir).select("doc_id", "id", "name")
    doomed = rows.join(labels, "doc_id", "left_semi").select("id")
    return lookup.delete_by_id(rows, doomed).select("id", "name")


@query
def summaries(spark, sf_dir):
    return lookup.summaries(tb.corpus(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query
def arrival_order(spark, sf_dir):
    """Records numbered by repository, then path part by part."""
    rows = tb.documents(spark, sf_dir).select("doc_id", "source", tb.record_path().alias("path"))
    return number_in_order(rows, "source", tx.path_parts(F.col("path"))).select("doc_id", "ord")


# --- keyword search -------------------------------------------------------------------------------


@query
def doc_tokens(spark, sf_dir):
    postings = kw.build_postings(tb.corpus(spark, sf_dir), pairs=False)
    return postings.where("words = 0").select("id", "n_tokens")


@query
def postings_build(spark, sf_dir):
    """The whole postings table, summed per record: rows, positions and distinct grams."""
    postings = kw.build_postings(kw.by_record(tb.corpus(spark, sf_dir)))
    per_gram = postings.groupBy("id", "words", "gram").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))
    return per_gram.groupBy("id", "words").agg(
        F.sum("n").alias("n_rows"), F.sum("positions").alias("positions"), F.count("*").alias("n_grams")
    )


@query
def term_stats(spark, sf_dir):
    return kw.term_stats(kw.build_postings(kw.by_record(tb.corpus(spark, sf_dir)), pairs=False))


@query
def keyword_stats(spark, sf_dir):
    stats = kw.corpus_stats(kw.build_postings(tb.corpus(spark, sf_dir), pairs=False))
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


def _keyword(spark, sf_dir, mode, queries=None, **options):
    queries = tb.passages(spark, sf_dir) if queries is None else queries
    hits = kw.keyword_search(tb.corpus(spark, sf_dir), queries, mode, **options)
    return hits.withColumn("score", F.round("score", 6))


@query
def kw_all(spark, sf_dir):
    return _keyword(spark, sf_dir, "all")


@query
def kw_any(spark, sf_dir):
    return _keyword(spark, sf_dir, "any")


@query
def kw_not(spark, sf_dir):
    return _keyword(spark, sf_dir, "any", exclude=F.lit("the de"))


@query
def kw_phrase(spark, sf_dir):
    return _keyword(spark, sf_dir, "phrase")


@query
def kw_prefix(spark, sf_dir):
    return _keyword(spark, sf_dir, "prefix")


@query
def kw_column(spark, sf_dir):
    return _keyword(spark, sf_dir, "any", columns=["name", "description"])


@query
def kw_literal(spark, sf_dir):
    """Passages wrapped in query syntax are searched literally; one without any word finds nothing."""
    passages = tb.passages(spark, sf_dir)
    wrapped = passages.withColumn("query", F.concat(F.lit('("'), "query", F.lit('" +*')))
    wordless = passages.select(-F.col("query_id") - 1, F.lit('("+*)')).toDF("query_id", "query")
    return _keyword(spark, sf_dir, "phrase", wrapped.unionByName(wordless))


@query
def kw_batch(spark, sf_dir):
    rows = tb.corpus(spark, sf_dir)
    hits = kw.attach_records(kw.keyword_search(rows, tb.passages(spark, sf_dir), "any"), rows, SUMMARY)
    return hits.select("query_id", "rank", *SUMMARY[:-1], _joined(), F.round("score", 6).alias("score"))


@query
def postings_upkeep(spark, sf_dir):
    """Stored postings kept in step through an insert and a delete, then searched."""
    rows = tb.corpus(spark, sf_dir)
    store = CorpusStore(spark, fresh_path(spark, "store"))
    store.records.replace(tb.labelled(rows, spark, sf_dir))
    store.rebuild_postings()
    store.records.append(tb.unlabelled(rows, spark, sf_dir), dedup.losers(tb.labelled(rows, spark, sf_dir)))
    store.update_postings()
    hits = kw.search_postings(store.postings.read(), tb.passages(spark, sf_dir), "any")
    return hits.withColumn("score", F.round("score", 6))


# --- vectors --------------------------------------------------------------------------------------


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", SCORE_DIGITS))


def _stored(spark, sf_dir):
    return tb.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding")


@query
def embedding_dimension(spark, sf_dir):
    return dimension_report(tb.embeddings(spark, sf_dir))


@query
def vector_topk_labels(spark, sf_dir):
    """The nearest vectors of every label centroid."""
    return _rounded(vector_topk(_stored(spark, sf_dir), tb.label_centroids(spark, sf_dir), 5))


@query
def vector_topk_batch(spark, sf_dir):
    """Every vector as a query against all vectors."""
    queries = tb.embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(vector_topk(_stored(spark, sf_dir), queries, 5))


@query
def vector_topk_bounded(spark, sf_dir):
    """The same through pivots and their bounds."""
    queries = tb.embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(bounded_topk(_stored(spark, sf_dir), queries, 5)[0])


def _live(spark, sf_dir):
    return dedup.keep_winners(tb.corpus(spark, sf_dir))


@query
def retrieve_live(spark, sf_dir):
    """An index older than a duplicate removal: hits on removed records drop out."""
    hits = retrieve_vectors(
        _live(spark, sf_dir), tb.corpus_vectors(spark, sf_dir), tb.label_centroids(spark, sf_dir), 10,
        columns=["id", "name"], model="given",
    )
    tags = [F.try_element_at("retrieval", F.lit(k)).alias(k) for k in ("method", "model")]
    return _rounded(hits).select("query_id", "rank", "id", "name", "score", *tags)


@query
def retrieve_live_only(spark, sf_dir):
    hits = retrieve_vectors(
        _live(spark, sf_dir), tb.corpus_vectors(spark, sf_dir), tb.label_centroids(spark, sf_dir), 10,
        columns=["id", "name"], live_only=True,
    )
    return _rounded(hits).select("query_id", "rank", "id", "name", "score")


@query
def search_summaries(spark, sf_dir):
    hits = retrieve_vectors(
        tb.corpus(spark, sf_dir), tb.corpus_vectors(spark, sf_dir), tb.label_centroids(spark, sf_dir), 5,
        columns=SUMMARY,
    )
    return _rounded(hits).select("query_id", "rank", *SUMMARY[:-1], _joined(), "score")


@query
def index_missing(spark, sf_dir):
    """Against an index that lacks the vectors of one label."""
    return drift.missing_ids(tb.corpus(spark, sf_dir), tb.corpus_vectors(spark, sf_dir, without_label=0))


@query
def index_stale(spark, sf_dir):
    return drift.stale_ids(_live(spark, sf_dir), tb.corpus_vectors(spark, sf_dir))


@query
def index_status(spark, sf_dir):
    return drift.index_status(_live(spark, sf_dir), tb.corpus_vectors(spark, sf_dir))


@query
def index_append(spark, sf_dir):
    """The ids an index holds after an update: those kept and those encoded anew."""
    rows, vectors = tb.corpus(spark, sf_dir), tb.corpus_vectors(spark, sf_dir)
    text = embedding_text(F.col("name"), F.col("description"), F.col("instructions"))
    fresh = rows.select("id", text.alias("text")).join(vectors.select("id"), "id", "left_anti")
    added = encode(fresh, F.col("text"), ENCODER).select("id", F.size("embedding").alias("dim"))
    return vectors.select("id", F.size("embedding").alias("dim")).unionByName(added)


@query
def hash_encode(spark, sf_dir):
    rows = tb.corpus(spark, sf_dir)
    text = embedding_text(F.col("name"), F.col("description"), F.col("instructions"))
    vectors = encode(rows.select("id", text.alias("text")), F.col("text"), ENCODER)
    return vectors.select("id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 4).alias("norm"))


@query
def retrieve_texts(spark, sf_dir):
    """Text queries through the encoder: every record's own embedding text finds that record first."""
    rows = tb.corpus(spark, sf_dir)
    text = embedding_text(F.col("name"), F.col("description"), F.col("instructions"))
    texts = rows.select("id", text.alias("text"))
    vectors = materialize(encode(texts, F.col("text"), ENCODER).select("id", "embedding"), "vectors")
    hits = vector_topk(vectors, vectors.withColumnRenamed("id", "query_id"), 1)
    return _rounded(hits)


# --- jobs on a stored corpus ----------------------------------------------------------------------


def _store(spark, sf_dir, rows: DataFrame) -> CorpusStore:
    store = CorpusStore(spark, fresh_path(spark, "store"))
    store.records.replace(rows.select(*FIELDS))
    return store


@query
def import_job(spark, sf_dir):
    stored, batch = _store_and_batch(spark, sf_dir)
    store = _store(spark, sf_dir, stored)
    store.build_aids()
    return jobs.merge_batch(store, batch.select(*FIELDS, "ord")).stats


@query
def kept_category_counts(spark, sf_dir):
    """Counts per category and source after an import, a duplicate removal and a delete, from the kept changes alone."""
    rows = tb.corpus(spark, sf_dir)
    store = _store(spark, sf_dir, tb.labelled(rows, spark, sf_dir))
    store.build_aids()
    jobs.dedup_store(store)
    jobs.merge_batch(store, tb.unlabelled(rows, spark, sf_dir).select(*FIELDS, "ord"))
    bad = tb.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    jobs.delete_records(store, rows.join(bad, "doc_id", "left_semi").select("id"))
    return jobs.category_source_counts(store)


@query
def import_rejects(spark, sf_dir):
    """A batch into an empty corpus, some of its records lacking a required field."""
    store = CorpusStore(spark, fresh_path(spark, "store"))
    store.init()
    result = jobs.merge_batch(store, _with_gaps(spark, sf_dir).select(*FIELDS, "ord"))
    return result.stats.join(result.rejects.agg(F.count("*").alias("n_rejects")), F.lit(True))


@query
def snapshot_merge(spark, sf_dir):
    """A JSON snapshot of the unlabelled documents merged into the rest; the corpus afterwards."""
    stored, batch = _store_and_batch(spark, sf_dir)
    location = fresh_path(spark, "snapshot")
    write_snapshot(dedup.keep_winners(batch).select(*FIELDS), location, "json")
    store = _store(spark, sf_dir, stored)
    jobs.sync_snapshot(store, read_snapshot(spark, location, "json"))
    return store.read().select("id", "content_hash", "source", _joined())


@query
def snapshot_replace(spark, sf_dir):
    """An explicit replace: the snapshot takes the corpus over and the index goes."""
    stored, batch = _store_and_batch(spark, sf_dir)
    location = fresh_path(spark, "snapshot")
    write_snapshot(batch.select(*FIELDS), location)
    store = _store(spark, sf_dir, stored)
    store.index.build(store.read(), ENCODER)
    jobs.sync_snapshot(store, read_snapshot(spark, location), replace=True)
    return store.read().select("id", "name").withColumn("has_index", F.lit(store.index.exists()))


@query
def dedup_job(spark, sf_dir):
    store = _store(spark, sf_dir, tb.corpus(spark, sf_dir))
    counts = jobs.dedup_store(store)
    left = store.read().agg(F.count("*").alias("n_left"), F.count_distinct("content_hash").alias("n_bodies"))
    return left.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "n_left", "n_bodies")


@query
def status_report(spark, sf_dir):
    """Status after an index build over the labelled documents and an import of the others."""
    stored, batch = _store_and_batch(spark, sf_dir)
    store = _store(spark, sf_dir, stored)
    jobs.build_or_update(store, ENCODER)
    jobs.merge_batch(store, batch.select(*FIELDS, "ord"))
    return jobs.status(store)


@query
def build_or_update(spark, sf_dir):
    """Build, update after an import, update again, with what each step encoded and dropped."""
    stored, batch = _store_and_batch(spark, sf_dir)
    store = _store(spark, sf_dir, stored)
    steps = [("build", jobs.build_or_update(store, ENCODER))]
    jobs.merge_batch(store, batch.select(*FIELDS, "ord"))
    steps += [("update", jobs.build_or_update(store, ENCODER)), ("again", jobs.build_or_update(store, ENCODER))]
    rows = [(step, counts["added"], counts["removed"]) for step, counts in steps]
    held = store.index.read().agg(F.count("*").alias("n_vectors"))
    return spark.createDataFrame(rows, "step string, added long, removed long").join(held, F.lit(True))


@query
def index_roundtrip(spark, sf_dir):
    """The given vectors saved and read back with their description."""
    index = VectorIndex(spark, fresh_path(spark, "index"))
    vectors = tb.embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), "embedding")
    index.save(vectors.withColumn("text_hash", F.lit("")), {"backend": "given", "model": "64d"})
    meta = index.meta()
    return index.read().select(
        "id",
        F.round(norm(F.col("embedding")), 4).alias("norm"),
        F.lit(meta["dimension"]).alias("dimension"),
        F.lit(meta["embedding"]["backend"]).alias("backend"),
        F.lit(meta["embedding"]["model"]).alias("model"),
    )


@query
def encoder_gate(spark, sf_dir):
    """An index asked for under its own encoder, under another one, and after a forced rebuild."""
    store = _store(spark, sf_dir, _live(spark, sf_dir))
    other = hash_encoder("another")
    jobs.build_or_update(store, ENCODER)
    rows = [("own", _gate(store, ENCODER)), ("other", _gate(store, other))]
    jobs.build_or_update(store, other, force=True)
    rows.append(("forced", _gate(store, other)))
    held = store.index.read().agg(F.count("*").alias("n_vectors"))
    return spark.createDataFrame(rows, "case string, outcome string").join(held, F.lit(True))


def _gate(store: CorpusStore, encoder: Encoder) -> str:
    try:
        store.index.require(encoder)
    except EncoderMismatchError:
        return "refused"
    return "accepted"


@query
def adopt_index(spark, sf_dir):
    """A published index over the labelled documents adopted by the whole corpus."""
    rows = tb.corpus(spark, sf_dir)
    published = fresh_path(spark, "published")
    location = published_location(published, ENCODER.backend, ENCODER.model)
    VectorIndex(spark, location).build(tb.labelled(rows, spark, sf_dir), ENCODER)
    return jobs.adopt_index(_store(spark, sf_dir, rows), published, ENCODER)


@query
def search_fallback(spark, sf_dir):
    """A corpus without a vector index answers by keywords."""
    store = _store(spark, sf_dir, _live(spark, sf_dir))
    hits = jobs.search(store, tb.passages(spark, sf_dir), ENCODER, k=5, fallback="keyword")
    return hits.select("query_id", "rank", *SUMMARY[:-1], _joined(), F.round("score", 6).alias("score"))


@query
def ingest_files(spark, sf_dir):
    """Record files written, scanned, parsed, gated and merged; the corpus afterwards."""
    root = fresh_path(spark, "tree")
    tb.write_record_tree(spark, sf_dir, root)
    store = CorpusStore(spark, fresh_path(spark, "store"))
    store.init()
    result = jobs.import_files(store, scan_record_files(spark, root, "part-*"), "directory")
    counts = [F.lit(result.counts[c]).cast("long").alias(c) for c in ("total", "added", "skipped_duplicate")]
    return store.read().select("content_hash", "source", F.length("instructions").alias("body_chars"), *counts)


@query
def continuous_ingest(spark, sf_dir):
    """The same files as a stream of small batches; the corpus afterwards."""
    root = fresh_path(spark, "tree")
    tb.write_record_tree(spark, sf_dir, root)
    store = CorpusStore(spark, fresh_path(spark, "store"))
    batch = max(1, tb.documents(spark, sf_dir).count() // 3)
    stream = ingest_stream(store, root, fresh_path(spark, "progress"), pattern="part-*", max_files=batch)
    stream.awaitTermination()
    return store.read().select("content_hash", "source", F.length("instructions").alias("body_chars"))


# --- references, usage, measures, versions, quality -----------------------------------------------


@query
def composite_records(spark, sf_dir):
    """What every record needs over its references: how many, how far, what is missing, and whether it needs itself."""
    rows = tb.composite_corpus(spark, sf_dir)
    roots = rows.select("id")
    return composite.dependency_report(roots, composite.dependencies(composite.references(rows), roots))


@query
def composite_fetch(spark, sf_dir):
    """The labelled records of quality 0 with all they need."""
    rows = tb.composite_corpus(spark, sf_dir)
    labels = tb.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    found = composite.fetch_with_dependencies(rows, rows.join(labels, "doc_id", "left_semi").select("id"))
    return found.select("root", "id", "depth", "name", "source")


@query
def usage_daily(spark, sf_dir):
    return usage.daily_usage(tb.usage_events(spark, sf_dir))


@query
def usage_streamed(spark, sf_dir):
    """The same counts from a stream of event files, oldest first."""
    root, location = fresh_path(spark, "events"), fresh_path(spark, "usage")
    events = tb.usage_events(spark, sf_dir)
    events.repartitionByRange(4, "ts").write.parquet(root)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(root)
    # Files of one second come in any order, so no day may close between them.
    usage_stream(stream, location, fresh_path(spark, "progress"), lateness="60 days").awaitTermination()
    return streamed_usage(spark, location)


@query
def usage_rerank(spark, sf_dir):
    """Twenty hits for every label centroid, the best five once use counts."""
    hits = vector_topk(tb.corpus_vectors(spark, sf_dir), tb.label_centroids(spark, sf_dir), 20)
    daily = usage.daily_usage(tb.usage_events(spark, sf_dir))
    ranked = usage.rerank(hits, usage.decayed_usage(daily, F.lit("2024-01-31").cast("date")), 5)
    return ranked.withColumns({c: F.round(c, SCORE_DIGITS) for c in ("score", "usage")})


def _judged(spark, sf_dir):
    """Every vector as a query: its five nearest others, relevant if of its label."""
    vectors = materialize(tb.embeddings(spark, sf_dir).select("vec_id", "label", "embedding"), "judged-vectors")
    hits = vector_topk(
        vectors.select(F.col("vec_id").alias("id"), "embedding"), vectors.select(F.col("vec_id").alias("query_id"), "embedding"), 6
    )
    others = hits.where("id <> query_id")
    labels = vectors.select("vec_id", "label")
    own = labels.toDF("query_id", "own")
    # A query's place among its hits gives the others theirs.
    place = materialize(hits, "judged-hits").where("id = query_id").select("query_id", F.col("rank").alias("at"))
    others = others.join(place, "query_id", "left").withColumn("rank", F.col("rank") - F.coalesce((F.col("at") < F.col("rank")).cast("int"), F.lit(0)))
    judged = others.join(labels.toDF("id", "label"), "id").join(own, "query_id")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    totals = labels.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return evaluation.per_query(judged.select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant")), totals, 5)


@query
def retrieval_measures(spark, sf_dir):
    measured = _judged(spark, sf_dir)
    return measured.withColumns({m: F.round(m, 6) for m in evaluation.MEASURES})


@query
def retrieval_eval(spark, sf_dir):
    means = evaluation.averages(_judged(spark, sf_dir))
    return means.withColumns({m: F.round(m, 6) for m in evaluation.MEASURES})


@query
def retrieval_intervals(spark, sf_dir):
    return evaluation.intervals(materialize(_judged(spark, sf_dir), "measured"))


@query
def snapshot_changes(spark, sf_dir):
    """The labelled records against all records a version later."""
    rows = tb.corpus(spark, sf_dir)
    return snapshot_diff(tb.labelled(rows, spark, sf_dir), tb.next_snapshot(rows))


@query
def quality_filter(spark, sf_dir):
    found = quality_score.of_quality(tb.corpus(spark, sf_dir), 0.6)
    return found.select("id", "source", "quality")
