"""Keyword search: postings, match modes and BM25 ranking for a table of queries.

Everything reads one flat table, `postings(gram, words, id, field, pos, n_tokens)`:

    words = 1   one row per token
    words = 2   one row per adjacent token pair, which phrases are matched on
    words = 0   one row per record with an empty gram, carrying its length

Matching joins postings with the query grams on `gram`, so only grams that are asked for leave the
scan; the length rows fold into one row per map task. Record length and record count therefore come
out of the same pass as the hits, and text is tokenised once per search. A prefix stands for a range of the sorted
dictionary of terms, see `terms`. Which records are scored is up to `bounded_topk`.

Postings are stored as `folded` rows, one per token and one per record: a token's row names the token that follows, and so
stands for the pair as well. Records are dealt by id and each task sorts the rows of its own: the text is shuffled, its grams
are not. Files lie in the order of a bucket of the gram, so a search reads the pages its own grams fall into. A pair lies in
the bucket of its first word. `unfolded` makes the flat table of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators import bounded_topk
from corpusmill.operators.terms import distinct_terms, prefix_terms
from corpusmill.session import broadcast_if_small, is_small, materialize, measured

# The indexed columns, BM25 constants and the floor under the inverse frequency.
FIELDS = ("name", "description", "instructions")
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

MODES = ("all", "any", "phrase", "prefix")
LENGTH_UNIT = -1
TIE_DIGITS = 9
# Bytes of text whose postings a task aggregates in memory.
PART_TEXT = 8 * 1024 * 1024
# Stored postings are laid out by a bucket of their gram, the top bits of its hash; a search reads the buckets of its own grams.
BUCKET_BITS = 6
HASH_BITS = 64
# Prefixes meet tokens by their first characters, so many at most.
KEY_CHARS = 3
# The bits of a layout key above the hash.
WORDS_BITS = 3


def record_tokens(corpus: DataFrame) -> DataFrame:
    """(id, n_tokens, field, tokens): one row per record and indexed column, plus the length row."""
    split = corpus.select("id", *[tokens(F.col(c)).alias(c) for c in FIELDS])
    total = sum((F.size(c) for c in FIELDS), F.lit(0)).cast("long")
    rows = [F.struct(F.lit(i).alias("field"), F.col(c).alias("tokens")) for i, c in enumerate(FIELDS)]
    rows.append(F.struct(F.lit(-1).alias("field"), F.array(F.lit("")).alias("tokens")))
    # The length is taken before the explode, which then carries no second copy of the tokens.
    counted = split.withColumn("n_tokens", total)
    return counted.select("id", "n_tokens", F.explode(F.array(*rows)).alias("r")).select(
        "id", "n_tokens", "r.field", "r.tokens"
    )


def by_record(corpus: DataFrame) -> DataFrame:
    """What postings need of a corpus, the rows of one id in one task, in as many parts as the text asks for.

    Sums per record and gram of the postings built from it need no other shuffle: the text moves once, its grams never.
    """
    slim = corpus.select("id", *FIELDS)
    _, n_bytes = measured(slim)
    return slim.repartition(max(slim.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // PART_TEXT)), "id")


def build_postings(corpus: DataFrame, pairs: bool = True) -> DataFrame:
    """The postings of a corpus; `pairs=False` leaves out the rows only phrases need."""
    per_field = record_tokens(corpus)
    if not pairs:
        flat = per_field.select("id", "n_tokens", "field", F.posexplode("tokens").alias("pos", "gram"))
        return flat.select(
            "gram", F.when(F.col("field") < 0, 0).otherwise(1).alias("words"), "id", "field", "pos", "n_tokens"
        )
    flat = _followed(per_field)
    single = F.struct("gram", "words")
    pair = F.struct(_pair().alias("gram"), F.lit(2).alias("words"))
    return (
        flat.select("id", "n_tokens", "field", "pos", F.explode(F.array(single, F.when(F.col("next").isNotNull(), pair))).alias("g"))
        .where("g IS NOT NULL")
        .select("g.gram", "g.words", "id", "field", "pos", "n_tokens")
    )


def _pair() -> Column:
    return F.concat_ws(" ", "gram", "next")


def _followed(per_field: DataFrame) -> DataFrame:
    """(gram, next, words, id, field, pos, n_tokens): tokens with the one that follows, null at the end of a field."""
    shifted = F.slice("tokens", F.lit(2), F.size("tokens"))
    zipped = F.arrays_zip(F.col("tokens").alias("word"), shifted.alias("next"))
    flat = per_field.select("id", "n_tokens", "field", F.posexplode(zipped).alias("pos", "w"))
    words = F.when(F.col("field") < 0, 0).otherwise(1)
    return flat.select(
        F.col("w")["word"].alias("gram"), F.col("w")["next"].alias("next"), words.alias("words"), "id", "field", "pos", "n_tokens"
    )


def folded(corpus: DataFrame) -> DataFrame:
    """The postings of a corpus as they are stored, (gram, next, words, id, field, pos, n_tokens, bucket), dealt by record."""
    return _followed(record_tokens(by_record(corpus))).withColumn("bucket", gram_bucket())


def unfolded(stored: DataFrame) -> DataFrame:
    """The flat table, with `bucket`, of `folded` rows. A search without phrases drops the pairs before it reads them."""
    rest = ["id", "field", "pos", "n_tokens", "bucket"]
    pairs = stored.where("next IS NOT NULL").select(_pair().alias("gram"), F.lit(2).alias("words"), *rest)
    return stored.select("gram", "words", *rest).unionByName(pairs)


def _gram_hash() -> Column:
    return F.xxhash64(F.substring_index("gram", " ", 1))


def gram_bucket() -> Column:
    return F.shiftrightunsigned(_gram_hash(), HASH_BITS - BUCKET_BITS).cast("int")


def layout_order() -> Column:
    """Length rows, then tokens by bucket and hash. One number: Spark sorts those by radix, strings by comparing."""
    words = F.shiftleft(F.col("words").cast("long"), HASH_BITS - WORDS_BITS)
    return words + F.shiftrightunsigned(_gram_hash(), WORDS_BITS)


def in_buckets(buckets: Iterable[int]) -> Column:
    """Whether a row lies in one of some buckets, as ranges: a scan skips pages by these, by a long list it does not."""
    ranges = []
    for bucket in sorted(buckets):
        if ranges and ranges[-1][1] == bucket - 1:
            ranges[-1][1] = bucket
        else:
            ranges.append([bucket, bucket])
    return reduce(lambda a, b: a | b, [F.col("bucket").between(*r) for r in ranges], F.lit(False))


def term_stats(postings: DataFrame) -> DataFrame:
    """Per term: records holding it and occurrences. Postings dealt `by_record` shuffle one row per term and task."""
    per_record = postings.where("words = 1").groupBy("gram", "id").agg(F.count("*").alias("n"))
    return per_record.groupBy(F.col("gram").alias("term")).agg(
        F.count("*").alias("n_records"), F.sum("n").alias("n_occurrences")
    )


def corpus_stats(postings: DataFrame) -> DataFrame:
    """One row: records, tokens, mean length."""
    return postings.where("words = 0").agg(
        F.count("*").alias("n_records"),
        F.sum("n_tokens").alias("n_tokens"),
        F.avg("n_tokens").alias("mean_tokens"),
    )


def _query_units(queries: DataFrame, mode: str, exclude: Column | None) -> DataFrame:
    """(query_id, unit, grams, prefix, negated, weight): what each query asks for.

    A unit is what BM25 scores as one phrase. A term repeated in a query keeps its multiplicity as
    weight.
    """
    found = queries.select("query_id", tokens(F.col("query")).alias("grams"), F.lit(False).alias("negated"))
    if mode == "phrase":
        units = found.where(F.size("grams") > 0)
    else:
        units = found.withColumn("grams", F.explode("grams")).withColumn("grams", F.array("grams"))
    units = units.withColumn("prefix", F.lit(mode == "prefix"))
    if exclude is not None:
        barred = queries.select("query_id", F.explode(tokens(exclude)).alias("gram"))
        units = units.unionByName(
            barred.select(
                "query_id",
                F.array("gram").alias("grams"),
                F.lit(True).alias("negated"),
                F.lit(False).alias("prefix"),
            )
        )
    # No token holds "*" or "#". A phrase is keyed by its digest: every one of its slots carries the key.
    joined = F.concat_ws(" ", "grams")
    text = F.when(F.size("grams") > 1, F.concat(F.lit("#"), F.md5(joined))).otherwise(
        F.concat(joined, F.when(F.col("prefix"), F.lit("*")).otherwise(F.lit("")))
    )
    asked = units.withColumn("name", text).groupBy("query_id", "name", "grams", "prefix", "negated")
    asked = materialize(asked.agg(F.count("*").alias("weight")), "asked")
    # Units are numbered when written, so that every later step reads the same numbers.
    names = materialize(asked.select("name").distinct().withColumn("unit", F.monotonically_increasing_id()), "units")
    return materialize(asked.join(names, "name").drop("name"), "asked-units")


def _unit_slots(units: DataFrame) -> DataFrame:
    """(unit, gram, words, offset, n_slots): the grams a unit is recognised by.

    A phrase of n words is covered by the pairs at 0, 2, 4, … and the pair ending the phrase.
    """
    size = F.size("grams")
    last = F.greatest(size - 2, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(2)), F.array(last)))
    placed = units.select("unit", "grams", F.size(starts).alias("n_slots"), F.explode(starts).alias("offset"))
    span = F.least(F.lit(2), F.size("grams"))
    gram = F.concat_ws(" ", F.slice("grams", F.col("offset") + 1, span))
    return placed.select("unit", gram.alias("gram"), span.alias("words"), "offset", "n_slots")


def _prefix_slots(units: DataFrame, terms: DataFrame) -> DataFrame:
    """The slots of prefixes: one for every term that a unit begins."""
    wanted = units.select("unit", F.element_at("grams", 1).alias("prefix"))
    found = prefix_terms(terms, wanted.select("prefix").distinct())
    slots = found.join(wanted, "prefix").select("unit", F.col("term").alias("gram"), F.lit(1).alias("words"))
    return slots.withColumn("offset", F.lit(0)).withColumn("n_slots", F.lit(1))


def _begun(postings: DataFrame, wanted: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Postings joined with slots by gram, and with units (unit, prefix) by what their gram begins with.

    A prefix stands for ever more terms as a corpus grows, while the prefixes of the queries stay few: they are handed to every task,
    and meet a token by its first characters. No posting is shuffled.
    """
    exact = wanted.withColumn("text", F.col("gram")).withColumn("whole", F.lit(True)).drop("gram")
    begins = prefixes.select(
        "unit", F.lit(1).alias("words"), F.lit(0).alias("offset"), F.lit(1).alias("n_slots"), F.col("prefix").alias("text"), F.lit(False).alias("whole")
    )
    asked = exact.unionByName(begins).withColumn("key", F.substring("text", 1, KEY_CHARS))
    keys = F.array_distinct(F.array(*[F.substring("gram", 1, n) for n in range(1, KEY_CHARS + 1)]))
    met = postings.withColumn("key", F.explode(keys)).join(F.broadcast(asked), ["key", "words"])
    return met.where(F.when(F.col("whole"), F.col("gram") == F.col("text")).otherwise(F.startswith("gram", "text")))


def _matches(
    postings: DataFrame, slots: DataFrame, phrases: bool, fields: Sequence[int] | None, small: bool, prefixes: DataFrame | None = None
) -> DataFrame:
    """(id, unit, n_hits, n_tokens, total_tokens) for every record holding a unit.

    The row with an empty unit and null id counts the records and their tokens. `prefixes` are units that have no slots.
    """
    length_slot = slots.sparkSession.createDataFrame(
        [(LENGTH_UNIT, "", 0, 0, 1)], "unit long, gram string, words int, offset int, n_slots int"
    )
    wanted = slots.select(*length_slot.columns)
    if fields is not None:
        postings = postings.where(F.col("field").isin([-1, *fields]))
    if not phrases:
        postings = postings.where("words <> 2")
    if prefixes is not None:
        joined = _begun(postings, wanted.unionByName(length_slot), prefixes)
    elif small:
        joined = postings.join(F.broadcast(wanted.unionByName(length_slot)), ["gram", "words"])
    else:
        # The length rows share one gram, so they stay out of the shuffle.
        lengths = postings.where("words = 0").join(F.broadcast(length_slot), ["gram", "words"])
        joined = postings.where("words > 0").join(wanted, ["gram", "words"]).unionByName(lengths)
    is_length = F.col("unit") == LENGTH_UNIT
    found = joined.select(
        "unit",
        F.when(~is_length, F.col("id")).alias("id"),
        "field",
        (F.col("pos") - F.col("offset")).alias("start"),
        "n_slots",
        "n_tokens",
    )
    hits = F.count("*")
    if phrases:
        # All grams of a phrase present at one start: one occurrence.
        found = (
            found.groupBy("unit", "id", "field", "start", "n_slots")
            .agg(
                F.count("*").alias("present"),
                F.max("n_tokens").alias("n_tokens"),
                F.sum("n_tokens").alias("total_tokens"),
            )
            .where((F.col("unit") == LENGTH_UNIT) | (F.col("present") == F.col("n_slots")))
        )
        hits = F.sum(F.when(is_length, F.col("present")).otherwise(F.lit(1)))
    total = F.sum("total_tokens" if phrases else "n_tokens")
    return found.groupBy("id", "unit").agg(
        hits.cast("long").alias("n_hits"), F.max("n_tokens").alias("n_tokens"), total.alias("total_tokens")
    )


def _corpus_size(hits: DataFrame) -> tuple[int, float]:
    """Records and their mean length, from the row of lengths."""
    lengths = hits.where(F.col("unit") == LENGTH_UNIT)
    stats = lengths.agg(F.sum("n_hits").alias("n"), F.sum("total_tokens").alias("t")).first()
    n_records, n_tokens = stats["n"] or 0, stats["t"] or 0
    return n_records, n_tokens / n_records if n_tokens else 1.0


def _gains(hits: DataFrame, mean_tokens: float) -> DataFrame:
    """(unit, id, class, gain): what each unit adds to a record's score, before its rarity."""
    length_part = K1 * ((1 - B) + B * F.col("n_tokens") / F.lit(mean_tokens))
    gain = F.col("n_hits") * (K1 + 1) / (F.col("n_hits") + length_part)
    held = hits.where("id IS NOT NULL")
    return held.select("unit", "id", bounded_topk.length_class(F.col("n_tokens")).alias("class"), gain.alias("gain"))


def _plan(asked: DataFrame, gains: DataFrame, n_records: int) -> DataFrame:
    """(query_id, unit, negated, weight, n_records, needed) for the units that occur."""
    n = F.count("*")
    rarity = F.greatest(F.log((F.lit(n_records) - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
    weights = gains.groupBy("unit").agg(rarity.alias("idf"), n.alias("n_records"))
    needed = asked.groupBy("query_id").agg(F.count_if(~F.col("negated")).alias("needed"))
    found = asked.join(weights, "unit").join(needed, "query_id").withColumn("weight", F.col("weight") * F.col("idf"))
    return found.select("query_id", "unit", "negated", "weight", "n_records", "needed")


def search_postings(
    postings: DataFrame,
    queries: DataFrame,
    mode: str = "all",
    exclude: Column | None = None,
    columns: Sequence[str] | None = None,
    limit: int = 10,
    push_grams: bool = False,
    terms: DataFrame | None = None,
) -> DataFrame:
    """Top hits per query, (query_id, rank, id, score), best BM25 score first, ties by id.

    `queries` holds query_id and query. `exclude` is a column of `queries` with words a hit must not
    hold; `columns` restricts matching, though record length always counts all columns. Modes: all
    words, any word, the words as one phrase, every word as a prefix. `push_grams` prunes stored postings, which
    have a column `bucket`, to the buckets of the grams asked for, however many those are. `terms` is a stored dictionary
    of the terms of the postings; without it prefixes look them up in the postings.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if limit < 0:
        raise ValueError("limit must not be negative")
    found = matched(postings, queries, mode, exclude, columns, limit, push_grams, terms)
    best = Window.partitionBy("query_id").orderBy(F.desc("order_score"), "id")
    found = found.withColumn("order_score", F.round("score", TIE_DIGITS))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "id", "score")


def matched(
    postings: DataFrame,
    queries: DataFrame,
    mode: str,
    exclude: Column | None,
    columns: Sequence[str] | None,
    limit: int,
    push_grams: bool,
    terms: DataFrame | None,
) -> DataFrame:
    """(query_id, id, score) of the pairs that reach their query's bound: all those among the `limit` best, and few others."""
    asked = _query_units(queries, mode, exclude)
    wanted = asked.select("unit", "grams", "prefix").distinct()
    slots = _unit_slots(wanted.where("NOT prefix"))
    if mode == "prefix":
        known = distinct_terms(postings) if terms is None else terms
        slots = slots.unionByName(_prefix_slots(wanted.where("prefix"), known))
    slots = materialize(slots, "slots")
    if push_grams:
        # At most as many rows as there are buckets.
        grams = slots.select("gram").unionByName(slots.sparkSession.createDataFrame([("",)], "gram string"))
        buckets = [r["bucket"] for r in grams.select(gram_bucket().alias("bucket")).distinct().collect()]
        postings = postings.where(in_buckets(buckets))
    fields = None if columns is None else [FIELDS.index(c) for c in columns]
    small, prefixes = is_small(slots), None
    if mode == "prefix" and not small:
        # The terms of the prefixes are too many for a broadcast, where the prefixes themselves and what is excluded are not.
        begins = wanted.where("prefix").select("unit", F.element_at("grams", 1).alias("prefix"))
        whole = _unit_slots(wanted.where("NOT prefix"))
        if is_small(begins) and is_small(whole):
            slots, prefixes = whole, begins
    hits = materialize(_matches(postings, slots, mode == "phrase", fields, small, prefixes), "hits")

    n_records, mean_tokens = _corpus_size(hits)
    gains = _gains(hits, mean_tokens)
    plan = materialize(_plan(asked, gains, n_records), "plan")
    n_pairs = n_records * plan.select("query_id").distinct().count()
    if mode == "any":
        return bounded_topk.likely(gains, plan, max(1, limit), n_pairs)
    scored = bounded_topk.scored(bounded_topk.pairs_with_all(gains, plan), gains, plan, n_pairs)
    return scored.where("present = needed").drop("present", "needed")


def keyword_search(corpus: DataFrame, queries: DataFrame, mode: str = "all", **options) -> DataFrame:
    """`search_postings` straight over a corpus, without a stored index."""
    return search_postings(build_postings(corpus, pairs=mode == "phrase"), queries, mode, **options)


def attach_records(hits: DataFrame, corpus: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join ranked hits with their records after the ranking, so bodies never take part in it.

    Hits whose record is gone drop out. The hits are written first: their size decides the join.
    """
    return corpus.select(*columns).join(broadcast_if_small(materialize(hits, "ranked")), "id")
