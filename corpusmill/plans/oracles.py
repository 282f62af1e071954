"""The catalogue's queries in DuckDB SQL, over the whole given tables."""

from __future__ import annotations

# The code points Python's str.strip removes.
WHITESPACE = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SPACES = "||".join(f"chr({c})" for c in WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def tokens(x: str) -> str:
    broken = rf"regexp_split_to_array(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}\p{{M}}\p{{Co}}]+')"
    return f"list_filter({broken}, lambda x: x <> '')"


def embedding_text(r: str = "") -> str:
    body = f"CASE WHEN {r}instructions <> '' THEN chr(10) || substr({r}instructions, 1, 500) ELSE '' END"
    return f"{r}name || chr(10) || {r}description || {body}"


PATH = """CASE lang WHEN 'en' THEN 'skills/doc-' || doc_id || '/SKILL.md'
  WHEN 'de' THEN 'Document Skills/' || source || '/doc-' || doc_id || '/SKILL.md'
  WHEN 'fr' THEN 'skills/fr/doc-' || doc_id || '/SKILL.md' ELSE 'doc-' || doc_id || '/SKILL.md' END"""


def record_id(source: str, name: str, content_hash: str) -> str:
    return f"substr(sha256({source} || ':' || {name} || ':' || substr({content_hash}, 1, 8)), 1, 16)"


def priority(source: str) -> str:
    levels = "WHEN 'anthropic' THEN 4 WHEN 'community' THEN 3 WHEN 'langskills' THEN 2 WHEN 'skillnet' THEN 1"
    return f"CASE {source} {levels} ELSE 0 END"


NAMES = "['anthropic', 'community', 'langskills', 'skillnet']"
CORPUS = f"""raw_corpus AS (
  SELECT doc_id, doc_id AS ord, 'doc-' || doc_id AS name, lang || ' text from ' || source AS description,
    text AS instructions, {NAMES}[CAST(substr(source, 4) AS INT) % 4 + 1] AS source, 'org/' || source AS slug,
    'org/' || source || ':skills/doc-' || doc_id || '/SKILL.md' AS source_id,
    CASE WHEN lang = 'en' THEN '' ELSE lang END AS category, lang || ',' || source AS tags,
    lang, source AS folder, n_chars, md5(text) AS content_hash
  FROM documents),
corpus AS MATERIALIZED (SELECT *, {record_id('source', 'name', 'content_hash')} AS id, {priority('source')} AS level
  FROM raw_corpus)"""

# The merge as the sequential rule reads: what was held before each arrival.
WINNERS = """winners AS (SELECT * FROM corpus
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY level DESC, ord) = 1)"""
MERGE = """labelled AS (SELECT * FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels)),
batch AS (SELECT * FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
stored AS (SELECT * FROM labelled
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY level DESC, ord) = 1),
sequence AS (
  SELECT * EXCLUDE (ord), ord, 1 AS arriving FROM batch UNION ALL SELECT * EXCLUDE (ord), -1, 0 FROM stored),
seen AS (SELECT *, max(level) OVER (PARTITION BY content_hash ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM sequence),
outcomes AS (SELECT *, CASE WHEN held IS NULL THEN 'added' WHEN level > held THEN 'replaced' ELSE 'skipped' END
    AS outcome FROM seen WHERE arriving = 1),
merged AS (SELECT * FROM sequence
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY level DESC, ord) = 1)"""
MERGE_COUNTS = """count(*) AS total, count(*) FILTER (outcome = 'added') AS added,
  count(*) FILTER (outcome = 'replaced') AS replaced, count(*) FILTER (outcome = 'skipped') AS skipped_duplicate"""

VECTORS = """vectors AS (SELECT coalesce(c.id, 'vec-' || e.vec_id) AS id, e.embedding::DOUBLE[] AS embedding
  FROM embeddings e LEFT JOIN corpus c ON c.doc_id = e.vec_id)"""
CENTROIDS = """cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL),
centroids AS (SELECT label AS query_id, list(x ORDER BY pos) AS embedding FROM means GROUP BY label),
unit_centroids AS (SELECT query_id,
  list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS embedding FROM centroids)"""


def topk(queries: str, vectors: str, k: int) -> str:
    return f"""scored AS (SELECT q.query_id, v.id, round(list_dot_product(q.embedding, v.embedding), 10) AS s
  FROM {queries} q CROSS JOIN {vectors} v),
ranked AS (SELECT query_id, id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INT) AS rank
  FROM scored),
hits AS (SELECT query_id, rank, id, round(s, 4) AS score FROM ranked WHERE rank <= {k})"""


FILES = f"""text_of AS (SELECT doc_id, source, lang, 'org/' || source || '/' || {PATH} AS path, {PATH} AS inner_path,
  CASE lang
    WHEN 'en' THEN '---' || chr(10) || 'name: doc-' || doc_id || chr(10) || 'description: en text from ' || source
      || chr(10) || 'tags: ''en , ' || source || ',''' || chr(10) || 'license: '' BSD-3-Clause '''
      || chr(10) || '---' || chr(10) || chr(10) || text
    WHEN 'de' THEN '---' || chr(10) || 'description: de text from ' || source || chr(10) || 'tags: ''de , ' || source
      || ',''' || chr(10) || '---' || chr(10) || chr(10) || text
    WHEN 'fr' THEN '---' || chr(10) || 'name: doc-' || doc_id || chr(10) || 'description:' || chr(10)
      || 'tags: ''fr , ' || source || ',''' || chr(10) || '---' || chr(10) || chr(10) || text
    ELSE text END AS text FROM documents),
stripped AS (SELECT *, {strip("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS s
  FROM text_of),
fenced AS (SELECT *, CASE WHEN starts_with(s, '---') AND strpos(substr(s, 4), '---') > 0
    THEN strpos(substr(s, 4), '---') + 3 END AS close FROM stripped),
split AS (SELECT *, {strip("substr(s, 4, close - 4)")} AS front, {strip("substr(s, close + 3)")} AS body FROM fenced)"""


def keyword(
    mode: str,
    queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark",
    exclude: str = "",
    fields: tuple[int, ...] = (0, 1, 2),
    limit: int = 10,
    records: str = "corpus",
) -> str:
    """CTEs ending in hits(query_id, rank, id, score): BM25 over three columns."""
    listed = ", ".join(map(str, fields))
    barred = ", ".join(f"'{w}'" for w in exclude.split()) or "''"
    if mode == "phrase":
        units = """units AS (SELECT query_id, toks, array_to_string(toks, ' ') AS unit, 1 AS weight
  FROM asked WHERE len(toks) > 0),
tf AS (SELECT u.unit, t.id, sum(len(list_filter(range(1, len(t.toks) - len(u.toks) + 2),
    lambda i: list_slice(t.toks, i, i + len(u.toks) - 1) = u.toks))) AS f
  FROM (SELECT DISTINCT unit, toks FROM units) u JOIN toks t
    ON contains(' ' || array_to_string(t.toks, ' ') || ' ', ' ' || u.unit || ' ') GROUP BY u.unit, t.id)"""
    else:
        match = "starts_with(w.gram, u.unit)" if mode == "prefix" else "w.gram = u.unit"
        units = f"""units AS (SELECT query_id, unit, count(*) AS weight
  FROM (SELECT query_id, unnest(toks) AS unit FROM asked) GROUP BY ALL),
tf AS (SELECT u.unit, w.id, sum(w.n) AS f FROM (SELECT DISTINCT unit FROM units) u
  JOIN words w ON {match} GROUP BY u.unit, w.id)"""
    keep = "" if mode == "any" else "HAVING count(*) = any_value(needed)"
    return f"""asked AS (SELECT query_id, {tokens('query')} AS toks FROM ({queries})),
all_toks AS MATERIALIZED (SELECT id, 0 AS field, {tokens('name')} AS toks FROM {records}
  UNION ALL SELECT id, 1, {tokens('description')} FROM {records}
  UNION ALL SELECT id, 2, {tokens('instructions')} FROM {records}),
lens AS (SELECT id, sum(len(toks)) AS n FROM all_toks GROUP BY id),
stats AS (SELECT count(*) AS total, avg(n) AS mean FROM lens),
toks AS (SELECT * FROM all_toks WHERE field IN ({listed})),
words AS (SELECT id, gram, count(*) AS n FROM (SELECT id, unnest(toks) AS gram FROM toks) GROUP BY ALL),
{units},
df AS (SELECT unit, greatest(ln((any_value(total) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf
  FROM tf, stats GROUP BY unit),
needs AS (SELECT query_id, count(*) AS needed FROM units GROUP BY query_id),
barred AS (SELECT DISTINCT id FROM words WHERE gram IN ({barred})),
scores AS (SELECT query_id, tf.id, sum(weight * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens.n / mean))) AS score
  FROM units JOIN needs USING (query_id) JOIN tf USING (unit) JOIN df USING (unit)
    JOIN lens ON lens.id = tf.id, stats
  WHERE tf.id NOT IN (SELECT id FROM barred) GROUP BY query_id, tf.id {keep}),
hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT)
    AS rank, id, round(score, 6) AS score FROM scores QUALIFY rank <= {limit})"""


ALL_TOKENS = f"list_concat({tokens('name')}, {tokens('description')}, {tokens('instructions')})"
HITS = "SELECT query_id, rank, id, score FROM hits"
SUMMARY = "query_id, rank, id, name, description, category, tags, score"


def _with(*parts: str) -> str:
    """The last part is the closing SELECT, with or without CTEs of its own before it."""
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + ("\n" if last.startswith("SELECT") else ",\n") + last


# References by language, and one of a record that does not exist.
REFERENCES = """refs AS (SELECT c.id, t.id AS ref, TRUE AS known FROM corpus c JOIN corpus t ON t.doc_id <> c.doc_id AND t.doc_id =
    CASE c.lang WHEN 'fr' THEN c.doc_id + 1 WHEN 'es' THEN c.doc_id + 1 - 2 * (c.doc_id % 2) ELSE c.doc_id // 2 END
  UNION ALL SELECT id, '0000000000000000', FALSE FROM corpus WHERE lang = 'de'),
reach AS (SELECT id AS root, ref AS id, known, 1 AS depth FROM refs
  UNION SELECT r.root, e.ref, e.known, r.depth + 1 FROM reach r JOIN refs e ON e.id = r.id
  WHERE r.known AND r.id <> r.root AND r.depth < 64),
needed AS (SELECT root, id, known, min(depth) AS depth FROM reach GROUP BY root, id, known)"""
USES = """uses AS (SELECT CAST(e.ts AS DATE) AS day, c.id FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents)
  JOIN corpus c ON c.doc_id = (e.user_id * 100 + CAST(json_extract(e.props, '$.k') AS BIGINT)) % n
  WHERE e.event_type IN ('view', 'click')),
daily AS (SELECT day, id, count(*) AS n FROM uses GROUP BY day, id)"""
JUDGED = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label = v.label AS relevant,
  round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 10) AS s
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs QUALIFY rank <= 5),
sums AS (SELECT query_id, count(*) FILTER (relevant) / 5 AS precision,
  coalesce(1 / min(rank) FILTER (relevant), 0) AS reciprocal_rank,
  coalesce(sum(1 / log2(rank + 1)) FILTER (relevant), 0) AS found FROM ranked GROUP BY query_id),
totals AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings),
measured AS (SELECT query_id, precision, reciprocal_rank, CASE WHEN n > 0 THEN
  found / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS gain
  FROM sums JOIN totals USING (query_id))"""
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("precision", "reciprocal_rank", "gain"))
COMPARED = ["name", "description", "content_hash", "source", "source_id", "category", "tags"]
CHANGED = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN o.{c} IS DISTINCT FROM w.{c} THEN '{c}' END" for c in COMPARED
) + "], lambda x: x IS NOT NULL), ',') AS changed"


def matched(key: str, old: str, new: str, name: str) -> str:
    """CTEs: pairs of one key in the order of their ids, and what both sides have left."""
    side = "(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY id) AS place FROM {side})"
    return f"""{name} AS (SELECT o.id AS old_id, w.id AS new_id, {CHANGED} FROM {side.format(key=key, side=old)} o
  JOIN {side.format(key=key, side=new)} w ON o.{key} = w.{key} AND o.place = w.place),
{name}_old AS (SELECT * FROM {old} WHERE id NOT IN (SELECT old_id FROM {name})),
{name}_new AS (SELECT * FROM {new} WHERE id NOT IN (SELECT new_id FROM {name}))"""


ORACLES = {
    "content_identity": _with(CORPUS, "SELECT doc_id, id, content_hash FROM corpus"),
    "embedding_texts": _with(
        CORPUS,
        f"SELECT id, md5({embedding_text()}) AS text_hash, CAST(length({embedding_text()}) AS INT) AS n_chars FROM corpus",
    ),
    "frontmatter_split": _with(
        FILES,
        "SELECT path, front, md5(body) AS body_hash, CAST(length(body) AS INT) AS body_chars FROM split",
    ),
    "category_from_path": f"""SELECT doc_id, 'doc-' || doc_id AS by_parent,
  CASE lang WHEN 'de' THEN 'Document Skills' ELSE 'doc-' || doc_id END AS by_group,
  CASE lang WHEN 'de' THEN source WHEN 'fr' THEN 'fr' ELSE '' END AS by_level FROM documents""",
    "tag_normalise": f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','),
  lambda x: {strip('x')}), lambda x: x <> '') AS tags FROM documents)
SELECT doc_id, CAST(len(tags) AS INT) AS n_tags, md5(array_to_string(tags, '|')) AS tags_hash FROM t""",
    "provenance_fields": _with(
        CORPUS,
        """vetted AS (SELECT *, CAST(substr(folder, 4) AS INT) AS n FROM corpus WHERE CAST(substr(folder, 4) AS INT) < 15)
SELECT c.id, c.source_id, v.slug AS repo, 'https://github.com/' || v.slug AS repo_url,
  CASE v.n % 2 WHEN 1 THEN 'MIT' WHEN 0 THEN 'Apache-2.0' END AS license, 'skills/' || v.name || '/SKILL.md' AS path,
  'https://github.com/' || v.slug || '/blob/main/skills/' || v.name || '/SKILL.md' AS url,
  CASE WHEN v.category = 'fr' THEN 'BSD-3-Clause' END AS declared_license
FROM corpus c LEFT JOIN vetted v USING (doc_id)""",
    ),
    "source_priorities": _with(CORPUS, "SELECT id, CAST(level AS INT) AS priority, 0 AS slug_priority FROM corpus"),
    "vector_norms": """WITH v AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings) SELECT vec_id, round(n, 6) AS norm, round(n / greatest(n, 1e-10), 6) AS unit_norm FROM v""",
    "record_json": _with(
        CORPUS,
        """SELECT id, '["' || lang || '","' || folder || '"]' AS tags, CAST(n_chars AS VARCHAR) AS chars,
  epoch(TIMESTAMP '2024-01-01 00:00:00')::BIGINT AS created_epoch FROM corpus""",
    ),
    "record_documents": _with(CORPUS, "SELECT id, name, source, content_hash FROM corpus"),
    "reject_malformed": _with(FILES, "SELECT path, 'none' AS error FROM split WHERE front IS NULL"),
    "field_defaults": _with(
        FILES,
        f"""s AS (SELECT *, 'doc-' || doc_id AS name, {NAMES}[CAST(substr(source, 4) AS INT) % 4 + 1] AS origin,
  md5(body) AS h FROM split WHERE front IS NOT NULL AND CAST(substr(source, 4) AS INT) < 15)
SELECT {record_id('origin', 'name', 'h')} AS id, name,
  CASE lang WHEN 'fr' THEN '' ELSE lang || ' text from ' || source END AS description, origin AS source,
  'org/' || source || ':' || inner_path AS source_id,
  CASE lang WHEN 'de' THEN source WHEN 'fr' THEN 'fr' ELSE '' END AS category, lang || ',' || source AS tags,
  CASE lang WHEN 'en' THEN 'BSD-3-Clause' END AS declared_license, NULL AS reason FROM s
UNION ALL SELECT NULL, NULL, NULL, NULL, 'org/' || source || ':' || inner_path, NULL, NULL, NULL, 'no vetted licence'
  FROM split WHERE CAST(substr(source, 4) AS INT) >= 15""",
    ),
    "directory_records": _with(
        FILES,
        f"""s AS (SELECT *, CASE lang WHEN 'de' THEN 'SKILL' ELSE 'doc-' || doc_id END AS name, md5(body) AS h
  FROM split WHERE front IS NOT NULL)
SELECT path, {record_id("'community'", 'name', 'h')} AS id, name,
  CASE lang WHEN 'fr' THEN NULL ELSE lang || ' text from ' || source END AS description,
  'doc-' || doc_id AS category, 0 AS n_tags FROM s""",
    ),
    "grouped_records": _with(
        FILES,
        f"""s AS (SELECT *, CASE lang WHEN 'de' THEN 'SKILL' ELSE 'doc-' || doc_id END AS name, md5(body) AS h
  FROM split WHERE front IS NOT NULL)
SELECT path, {record_id("'anthropic'", 'name', 'h')} AS id, name, 'anthropic' AS source,
  CASE lang WHEN 'de' THEN 'Document Skills' ELSE 'doc-' || doc_id END AS category, lang || ',' || source AS tags
FROM s""",
    ),
    "source_domain_check": """SELECT source, count(*) AS n_records FROM documents
WHERE CAST(substr(source, 4) AS INT) >= 16 GROUP BY source""",
    "required_fields_check": _with(
        CORPUS,
        """SELECT id, 'missing description' AS reason FROM corpus
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""",
    ),
    "id_clash_check": _with(
        CORPUS,
        """cut AS (SELECT *, source || '/' || category AS cut_id, doc_id IN (SELECT doc_id FROM labels) AS held
  FROM corpus),
arrivals AS (SELECT cut_id, min(content_hash) AS content_hash, -1 AS ord FROM cut WHERE held GROUP BY cut_id
  UNION ALL SELECT cut_id, content_hash, ord FROM cut WHERE NOT held),
owners AS (SELECT cut_id, arg_min(content_hash, ord) AS owner FROM arrivals GROUP BY cut_id)
SELECT DISTINCT cut_id AS id, content_hash FROM arrivals JOIN owners USING (cut_id)
WHERE ord >= 0 AND content_hash <> owner""",
    ),
    "license_gate": """SELECT DISTINCT 'org/' || source AS slug FROM documents
WHERE CAST(substr(source, 4) AS INT) >= 15""",
    "dedup_winner": _with(CORPUS, WINNERS, "SELECT content_hash, id, source FROM winners"),
    "dedup_losers": _with(CORPUS, WINNERS, "SELECT id FROM corpus WHERE id NOT IN (SELECT id FROM winners)"),
    "dedup_report": _with(
        CORPUS,
        """SELECT count(*) AS before, count(DISTINCT content_hash) AS after,
  count(*) - count(DISTINCT content_hash) AS removed FROM corpus""",
    ),
    "merge_stats": _with(CORPUS, MERGE, f"SELECT {MERGE_COUNTS} FROM outcomes"),
    "merge_outcomes": _with(CORPUS, MERGE, "SELECT ord, id, outcome FROM outcomes"),
    "merge_store": _with(
        CORPUS,
        MERGE,
        """SELECT id, name, content_hash, source, description, source_id, category, tags, CAST(n_chars AS VARCHAR) AS chars,
  md5(instructions) AS body FROM merged""",
    ),
    "record_count": "SELECT count(*) AS n_records FROM documents",
    "category_counts": "SELECT lang AS category, count(*) AS n_records FROM documents WHERE lang <> 'en' GROUP BY lang",
    "distinct_categories": "SELECT DISTINCT lang AS category FROM documents WHERE lang <> 'en'",
    "by_category": _with(CORPUS, "SELECT id, name, content_hash FROM corpus WHERE category = 'fr'"),
    "id_scan": _with(CORPUS, "SELECT id FROM corpus"),
    "fetch_by_id": _with(
        CORPUS,
        """SELECT id, name, description, instructions, category, tags, source, CAST(NULL AS VARCHAR) AS error
FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'none-' || item_id, NULL, NULL, NULL, NULL, NULL, NULL, 'record not found' FROM benchmark""",
    ),
    "delete_by_id": _with(
        CORPUS, "SELECT id, name FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"
    ),
    "summaries": _with(CORPUS, "SELECT id, name, description, category, tags FROM corpus"),
    "arrival_order": f"""SELECT doc_id, row_number() OVER (ORDER BY source, string_split({PATH}, '/')) AS ord
FROM documents""",
    "doc_tokens": _with(CORPUS, f"SELECT id, CAST(len({ALL_TOKENS}) AS BIGINT) AS n_tokens FROM corpus"),
    "postings_build": _with(
        CORPUS,
        f"""t AS (SELECT id, {tokens('name')} AS toks FROM corpus UNION ALL SELECT id, {tokens('description')} FROM corpus
  UNION ALL SELECT id, {tokens('instructions')} FROM corpus),
singles AS (SELECT id, toks, unnest(toks) AS gram, generate_subscripts(toks, 1) AS i FROM t),
grams AS (SELECT id, 1 AS words, gram, i - 1 AS pos FROM singles
  UNION ALL SELECT id, 2, gram || ' ' || toks[i + 1], i - 1 FROM singles WHERE i < len(toks)
  UNION ALL SELECT id, 0, '', 0 FROM corpus)
SELECT id, words, count(*) AS n_rows, CAST(sum(pos) AS BIGINT) AS positions, count(DISTINCT gram) AS n_grams
FROM grams GROUP BY id, words""",
    ),
    "term_stats": _with(
        CORPUS,
        f"""w AS (SELECT id, unnest({ALL_TOKENS}) AS term FROM corpus)
SELECT term, count(DISTINCT id) AS n_records, count(*) AS n_occurrences FROM w GROUP BY term""",
    ),
    "keyword_stats": _with(
        CORPUS,
        f"""w AS (SELECT len({ALL_TOKENS}) AS n FROM corpus)
SELECT count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS mean_tokens FROM w""",
    ),
    "kw_all": _with(CORPUS, keyword("all"), HITS),
    "kw_any": _with(CORPUS, keyword("any"), HITS),
    "kw_not": _with(CORPUS, keyword("any", exclude="the de"), HITS),
    "kw_phrase": _with(CORPUS, keyword("phrase"), HITS),
    "kw_prefix": _with(CORPUS, keyword("prefix"), HITS),
    "kw_column": _with(CORPUS, keyword("any", fields=(0, 1)), HITS),
    "kw_literal": _with(CORPUS, keyword("phrase"), HITS),
    "kw_batch": _with(CORPUS, keyword("any"), f"SELECT {SUMMARY} FROM hits JOIN corpus USING (id)"),
    "postings_upkeep": _with(
        CORPUS,
        MERGE,
        """kept AS (SELECT * FROM corpus WHERE id NOT IN
  (SELECT id FROM labelled WHERE id NOT IN (SELECT id FROM stored)))""",
        keyword("any", records="kept"),
        HITS,
    ),
    "embedding_dimension": """SELECT count(*) AS n_vectors, CAST(min(len(embedding)) AS INT) AS min_dim,
  CAST(max(len(embedding)) AS INT) AS max_dim, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings""",
    "vector_topk_labels": _with(
        CENTROIDS,
        "stored AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings)",
        topk("centroids", "stored", 5),
        HITS,
    ),
    "vector_topk_batch": _with(
        "stored AS (SELECT vec_id AS id, vec_id AS query_id, embedding::DOUBLE[] AS embedding FROM embeddings)",
        topk("stored", "stored", 5),
        HITS,
    ),
    "vector_topk_bounded": _with(
        "stored AS (SELECT vec_id AS id, vec_id AS query_id, embedding::DOUBLE[] AS embedding FROM embeddings)",
        topk("stored", "stored", 5),
        HITS,
    ),
    "retrieve_live": _with(
        CORPUS,
        WINNERS,
        VECTORS,
        CENTROIDS,
        topk("unit_centroids", "vectors", 10),
        """SELECT query_id, rank, id, name, score, 'vector' AS method, 'given' AS model
FROM hits JOIN winners USING (id)""",
    ),
    "retrieve_live_only": _with(
        CORPUS,
        WINNERS,
        VECTORS,
        CENTROIDS,
        "live AS (SELECT * FROM vectors WHERE id IN (SELECT id FROM winners))",
        topk("unit_centroids", "live", 10),
        "SELECT query_id, rank, id, name, score FROM hits JOIN winners USING (id)",
    ),
    "search_summaries": _with(
        CORPUS, VECTORS, CENTROIDS, topk("unit_centroids", "vectors", 5), f"SELECT {SUMMARY} FROM hits JOIN corpus USING (id)"
    ),
    "index_missing": _with(CORPUS, "SELECT id FROM corpus WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 0)"),
    "index_stale": _with(
        CORPUS, WINNERS, VECTORS, "SELECT id FROM vectors WHERE id NOT IN (SELECT id FROM winners)"
    ),
    "index_status": _with(
        CORPUS,
        WINNERS,
        VECTORS,
        """SELECT count(w.id) AS n_records, count(v.id) AS n_vectors, count(*) FILTER (v.id IS NULL) AS n_missing,
  count(*) FILTER (w.id IS NULL) AS n_stale, count(*) = count(w.id) AND count(*) = count(v.id) AS in_step
FROM winners w FULL JOIN vectors v ON v.id = w.id""",
    ),
    "index_append": _with(
        CORPUS,
        VECTORS,
        """SELECT id, CAST(len(embedding) AS INT) AS dim FROM vectors UNION ALL
SELECT id, 128 FROM corpus WHERE id NOT IN (SELECT id FROM vectors)""",
    ),
    "hash_encode": _with(CORPUS, "SELECT id, 128 AS dim, CAST(1 AS DOUBLE) AS norm FROM corpus"),
    "retrieve_texts": _with(
        CORPUS, "SELECT id AS query_id, 1 AS rank, id, CAST(1 AS DOUBLE) AS score FROM corpus"
    ),
    "import_job": _with(CORPUS, MERGE, f"SELECT {MERGE_COUNTS} FROM outcomes"),
    "kept_category_counts": _with(
        CORPUS,
        MERGE,
        """SELECT category, source, count(*) AS n FROM merged
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY category, source""",
    ),
    "import_rejects": _with(
        CORPUS,
        """sound AS (SELECT * FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
seen AS (SELECT *, max(level) OVER (PARTITION BY content_hash ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM sound),
counts AS (SELECT count(*) FILTER (held IS NULL) AS added, count(*) FILTER (level > held) AS replaced,
  count(*) AS n_sound FROM seen),
everything AS (SELECT count(*) AS total FROM corpus)
SELECT total, added, replaced, total - added - replaced AS skipped_duplicate, total - n_sound AS n_rejects
FROM everything, counts""",
    ),
    "snapshot_merge": _with(CORPUS, MERGE, "SELECT id, content_hash, source, tags FROM merged"),
    "snapshot_replace": _with(CORPUS, MERGE, "SELECT id, name, FALSE AS has_index FROM batch"),
    "dedup_job": _with(
        CORPUS,
        """SELECT count(*) AS before, count(DISTINCT content_hash) AS after,
  count(*) - count(DISTINCT content_hash) AS removed, count(DISTINCT content_hash) AS n_left,
  count(DISTINCT content_hash) AS n_bodies FROM corpus""",
    ),
    "status_report": _with(
        CORPUS,
        MERGE,
        """SELECT (SELECT count(*) FROM merged) AS n_records, (SELECT count(*) FROM stored) AS n_vectors,
  (SELECT count(*) FROM merged WHERE id NOT IN (SELECT id FROM stored)) AS n_missing,
  (SELECT count(*) FROM stored WHERE id NOT IN (SELECT id FROM merged)) AS n_stale,
  (SELECT count(*) FROM merged WHERE id NOT IN (SELECT id FROM stored)) = 0 AS in_step,
  (SELECT count(DISTINCT lang) FROM documents WHERE lang <> 'en') AS n_categories""",
    ),
    "build_or_update": _with(
        CORPUS,
        MERGE,
        """n AS (SELECT (SELECT count(*) FROM stored) AS built, (SELECT count(*) FROM merged) AS n_vectors,
  (SELECT count(*) FROM merged WHERE id NOT IN (SELECT id FROM stored)) AS fresh,
  (SELECT count(*) FROM stored WHERE id NOT IN (SELECT id FROM merged)) AS gone)
SELECT 'build' AS step, built AS added, 0::BIGINT AS removed, n_vectors FROM n
UNION ALL SELECT 'update', fresh, gone, n_vectors FROM n UNION ALL SELECT 'again', 0, 0, n_vectors FROM n""",
    ),
    "index_roundtrip": """SELECT CAST(vec_id AS VARCHAR) AS id,
  round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm,
  CAST(len(embedding) AS INT) AS dimension, 'given' AS backend, '64d' AS model FROM embeddings""",
    "encoder_gate": _with(
        CORPUS,
        """n AS (SELECT count(DISTINCT content_hash) AS n_vectors FROM corpus)
SELECT 'own' AS "case", 'accepted' AS outcome, n_vectors FROM n
UNION ALL SELECT 'other', 'refused', n_vectors FROM n UNION ALL SELECT 'forced', 'accepted', n_vectors FROM n""",
    ),
    "adopt_index": """SELECT (SELECT count(*) FROM documents) AS n_records, (SELECT count(*) FROM labels) AS n_vectors,
  (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS n_missing, 0::BIGINT AS n_stale,
  (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS in_step""",
    "search_fallback": _with(
        CORPUS,
        WINNERS,
        keyword("all", limit=5, records="winners"),
        f"SELECT {SUMMARY} FROM hits JOIN winners USING (id)",
    ),
    # A French record's description is null, so the required-field gate turns it away.
    "ingest_files": _with(
        FILES,
        """parsed AS (SELECT *, md5(body) AS h FROM split WHERE front IS NOT NULL),
counts AS (SELECT count(*) AS total, count(DISTINCT h) FILTER (lang <> 'fr') AS added FROM parsed)
SELECT DISTINCT h AS content_hash, 'community' AS source, CAST(length(body) AS INT) AS body_chars,
  total, added, total - added AS skipped_duplicate FROM parsed, counts WHERE lang <> 'fr'""",
    ),
    "continuous_ingest": _with(
        FILES,
        """SELECT DISTINCT md5(body) AS content_hash, 'community' AS source, CAST(length(body) AS INT) AS body_chars
FROM split WHERE front IS NOT NULL AND lang <> 'fr'""",
    ),
    "composite_records": _with(
        CORPUS,
        REFERENCES,
        """SELECT c.id, count(*) FILTER (n.known AND n.id <> n.root) AS n_needed, count(*) FILTER (NOT n.known) AS n_missing,
  CAST(coalesce(max(n.depth) FILTER (n.id <> n.root), 0) AS INT) AS depth, coalesce(bool_or(n.id = n.root), FALSE) AS in_cycle
FROM corpus c LEFT JOIN needed n ON n.root = c.id GROUP BY c.id""",
    ).replace("WITH", "WITH RECURSIVE", 1),
    "composite_fetch": _with(
        CORPUS,
        REFERENCES,
        """asked AS (SELECT id AS root FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
wanted AS (SELECT root, root AS id, 0 AS depth FROM asked
  UNION ALL SELECT root, id, depth FROM needed JOIN asked USING (root) WHERE known AND id <> root)
SELECT root, id, depth, name, source FROM wanted JOIN corpus USING (id)""",
    ).replace("WITH", "WITH RECURSIVE", 1),
    "usage_daily": _with(CORPUS, USES, "SELECT day, id, n FROM daily"),
    "usage_streamed": _with(CORPUS, USES, "SELECT day, id, n FROM daily"),
    "usage_rerank": _with(
        CORPUS,
        VECTORS,
        CENTROIDS,
        topk("centroids", "vectors", 20),
        USES,
        """used AS (SELECT id, sum(n * pow(2, -date_diff('day', day, DATE '2024-01-31') / 7.0)) AS usage FROM daily GROUP BY id),
lifted AS (SELECT r.query_id, r.id, coalesce(u.usage, 0) AS usage, 1 + 0.1 * ln(1 + coalesce(u.usage, 0)) AS factor, r.s
  FROM ranked r LEFT JOIN used u USING (id) WHERE r.rank <= 20),
final AS (SELECT query_id, id, usage, CASE WHEN s < 0 THEN s / factor ELSE s * factor END AS s FROM lifted)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS INT) AS rank, id,
  round(s, 4) AS score, round(usage, 4) AS usage FROM final QUALIFY rank <= 5""",
    ),
    "retrieval_measures": _with(
        JUDGED,
        """SELECT query_id, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(gain, 6) AS gain
FROM measured""",
    ),
    "retrieval_eval": _with(JUDGED, f"SELECT count(*) AS n_queries, {MEANS} FROM measured"),
    "snapshot_changes": _with(
        CORPUS,
        f"""old AS (SELECT * FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels)),
later AS (SELECT name, source_id, category, tags, description || CASE lang WHEN 'de' THEN ' (revised)' ELSE '' END AS description,
  md5(instructions || CASE lang WHEN 'es' THEN chr(10) || 'revised' ELSE '' END) AS content_hash,
  CASE lang WHEN 'fr' THEN {NAMES}[list_position({NAMES}, source) % 4 + 1] ELSE source END AS source FROM corpus),
new AS (SELECT *, {record_id('source', 'name', 'content_hash')} AS id FROM later),
same AS (SELECT o.id AS old_id, w.id AS new_id, {CHANGED} FROM old o JOIN new w ON o.id = w.id),
old_left AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)),
new_left AS (SELECT * FROM new WHERE id NOT IN (SELECT id FROM old))""",
        matched("content_hash", "old_left", "new_left", "moved"),
        matched("name", "moved_old", "moved_new", "rewritten"),
        """SELECT CASE WHEN changed = '' THEN 'unchanged' ELSE 'updated' END AS status, old_id, new_id, changed FROM same
UNION ALL SELECT 'moved', old_id, new_id, changed FROM moved UNION ALL SELECT 'rewritten', old_id, new_id, changed FROM rewritten
UNION ALL SELECT 'removed', id, NULL, '' FROM rewritten_old UNION ALL SELECT 'new', NULL, id, '' FROM rewritten_new""",
    ),
    "quality_filter": _with(
        CORPUS,
        """eighths AS (SELECT source, quantile_disc(length(instructions), [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e
  FROM corpus GROUP BY source),
scored AS (SELECT id, source, round(0.5 * CASE WHEN length(instructions) > 0
    THEN len(list_filter(e, lambda x: length(instructions) >= x)) / 7 ELSE 0 END
  + 0.2 * least(len(string_split(tags, ',')), 3) / 3 + 0.3 * level / 4, 6) AS quality FROM corpus JOIN eighths USING (source))
SELECT id, source, quality FROM scored WHERE quality >= 0.6""",
    ),
}
