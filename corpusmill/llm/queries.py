"""The registered queries of this folder, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    bpe,
    exact_dedup,
    language,
    neighbours,
    packing,
    periods,
    phrases,
    quality,
    simhash,
    token_counts,
    token_files,
    toxicity,
    url_filter,
)
from corpusmill.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SITE_RULES = [
    url_filter.SiteRule("com", "/", "allow"),
    url_filter.SiteRule("example.com", "/en/", "block"),
    url_filter.SiteRule("www.example.com", "/en/", "allow"),
    url_filter.SiteRule("net", "/es/", "block"),
    url_filter.SiteRule("net", "/fr/", "block"),
]
PATTERN_RULES = [
    url_filter.PatternRule(text, "block")
    for text in ("^casino-win^", "^free-bets^", "^cheap-pills^", "^ads-track^", "^doubleclick^", "*/ads/*")
]


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), SITE_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


ORACLES["op1_url_filter"] = r"""
WITH site(rule, host, path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
pats(text, re) AS (VALUES
  ('^casino-win^', '(^|[^a-z0-9])casino-win([^a-z0-9]|$)'), ('^free-bets^', '(^|[^a-z0-9])free-bets([^a-z0-9]|$)'),
  ('^cheap-pills^', '(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)'), ('^ads-track^', '(^|[^a-z0-9])ads-track([^a-z0-9]|$)'),
  ('^doubleclick^', '(^|[^a-z0-9])doubleclick([^a-z0-9]|$)'), ('*/ads/*', '/ads/')),
p AS (SELECT page_id, url, row_number() OVER () AS r,
  lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS (SELECT p.r, max(struct_pack(size := length(site.rule), rule := site.rule, verdict := site.verdict)) AS best
  FROM p JOIN site ON (p.host = site.host OR ends_with(p.host, '.' || site.host)) AND starts_with(p.path, site.path)
  GROUP BY p.r),
g AS (SELECT p.r, max(struct_pack(size := length(pats.text), text := pats.text)) AS best
  FROM p JOIN pats ON regexp_matches(lower(p.url), pats.re) GROUP BY p.r)
SELECT p.page_id, p.host, p.path, s.best.rule AS rule,
  coalesce(s.best.verdict, CASE WHEN g.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, g.best.text AS pattern
FROM p LEFT JOIN s USING (r) LEFT JOIN g USING (r)
"""


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


END_ID = 1


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


@_query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, END_ID)
    return token_files.read_digests(spark, folder).withColumnRenamed("id", "doc_id")


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def in_fold(docs: DataFrame, n: int, fold: int) -> Column:
    """Whether crc32 of the document id as text, modulo n, is the fold; a null id is in none."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % n == fold, F.lit(False))


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(docs, 3, 1)
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(docs, 5, 0)
    network = toxicity.learn(docs.where(~held_out), _table(spark, sf_dir, "labels"))
    found = toxicity.judge(docs.select("doc_id", "text", held_out.alias("held_out")), network)
    return found.select("doc_id", "held_out", "score", "predicted")


@_query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@_query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), min_count=100, top=2_000)


ORACLES["op11_phrases"] = r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
found AS (SELECT * FROM f WHERE m > 1),
open_ends AS (SELECT * FROM found c WHERE NOT EXISTS (SELECT 1 FROM found d WHERE d.lang = c.lang AND d.m > c.m
  AND 100 * d.f >= 100 * c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM open_ends),
scores AS (SELECT c.lang, c.phrase, c.a, c.k, p.f AS l, q.f AS r, t.n,
    CAST(1000::HUGEINT * c.a * t.n // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score,
  CAST(k AS INT) AS cut FROM least QUALIFY rank <= 2000
"""


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten made periodic from some word on, as the contract of op12 says; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + [cycle[i % p] for i in range(n - a)]


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_table(spark, sf_dir, "documents"), words_of=planted)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # Runs come by start and period, so at equal exponents the first one stays.
    best = F.reduce("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


@_query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op13_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
