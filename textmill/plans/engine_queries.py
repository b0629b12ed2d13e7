"""Queries of the search engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.functions.text import STRANGE, TAG_WEIGHTS, TAGS, is_strange, raw_terms, safe_name, similarity, terms, tokens
from textmill.operators import postings as po
from textmill.operators import search as se
from textmill.operators import simhash as sh
from textmill.operators import words as wo
from textmill.plans.engine import Engine
from textmill.session import ensure_checkpoint_dir
from textmill.sources.index_store import IndexOptions
from textmill.sources.json_pages import catalogue, first_urls
from textmill.sources.tables import table

QUERY = "the index of the query"
INDEX_QUERIES = ("page course", "query index", "the debugger", "token page the")
LOOKUP = ("index", "query", "missingtoken")
MISSPELT_QUERY = "the indexx of the qeury aaaa"
MISSPELT = ("debuger", "indexx", "qeury", "semafore", "tokn")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _plain(spark, d):
    return po.plain_postings(po.word_frequencies(_docs(spark, d)))


def _n(df):
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _one(spark, text=QUERY):
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(text).alias("text"))


def _found(spark, d, queries):
    postings = _plain(spark, d)
    return se.matches(queries, postings, po.document_frequencies(postings), _n(_docs(spark, d)))


def _ranked(spark, d, queries):
    counts = po.word_frequencies(_docs(spark, d))
    return se.rerank(se.top(_found(spark, d, queries)), queries, counts, po.norms(counts))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _indexed(spark, d):
    return po.indexed_postings(table(spark, d, "postings"))


def _index_queries(spark):
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, INDEX_QUERIES))).alias("query_id", "text")).withColumn("query_id", F.col("query_id").cast("bigint"))


def _weighted(spark, d, mode="tokens"):
    postings = _indexed(spark, d)
    return se.top(se.matches(_index_queries(spark), postings, po.document_frequencies(postings), _n(postings.select("doc_id").distinct()), mode))


def tokenize_docs(spark, d):
    ts = tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(ts).cast("bigint").alias("n_tokens"), F.array_join(ts, " ").alias("joined"))


def doc_freq_idf(spark, d):
    return _rounded(po.with_idf(po.document_frequencies(_plain(spark, d)), _n(_docs(spark, d))), "idf")


def nested_topterms(spark, d):
    return po.nested_entries(_plain(spark, d), 20).select(
        "token", "df", F.col("postings")[0]["doc_id"].alias("first_doc"), F.aggregate("postings", F.lit(0).cast("bigint"), lambda a, p: a + p["frequency"]).alias("total"))


def weighted_urls(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "path").unionByName(table(spark, d, "text_pages").select("page_id", "url", "path")).withColumnRenamed("page_id", "doc_id")
    return _rounded(se.with_urls(_weighted(spark, d), first_urls(pages, "doc_id", "path")), "tfidf")


def _asked(spark, words=MISSPELT):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("word"))


def spell_search(spark, d):
    postings = _plain(spark, d)
    queries = se.respelled(_one(spark, MISSPELT_QUERY), po.document_frequencies(postings))
    return _rounded(se.top(_found(spark, d, queries)), "tfidf")


def page_catalogue(spark, d):
    return catalogue(table(spark, d, "pages").select("path", "page_id").distinct()).select("doc_id", "page_id", "path")


_STORED: dict[tuple[str, str], str] = {}


def stored(spark, d) -> Engine:
    """The index of the documents' texts, built once per session in the checkpoint folder and opened from its files."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        pages = table(spark, d, "documents").select("doc_id", F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "url", F.col("text").alias("content"))
        Engine.build(spark, pages, path, IndexOptions(name="documents", plain_text=True))
        _STORED[key] = path
    return Engine(spark, _STORED[key])


def stored_statistics(spark, d):
    engine = stored(spark, d)
    files = engine.partition_statistics().agg(F.min("first_token").alias("first_token"), F.max("last_token").alias("last_token"), F.sum("postings").alias("in_files"))
    return engine.statistics().crossJoin(files)


def query_forms(spark, d):
    forms = {name: F.array_join(F.sort_array(f(F.col("text"))), " ") for name, f in (("terms", terms), ("strict", raw_terms))}
    return table(spark, d, "benchmark").select("item_id", *(c.alias(n) for n, c in forms.items()))


def near_dup_similarity(spark, d):
    pairs = sh.near_class_pairs(sh.classes(_hashes(spark, d)))
    return pairs.select("id_a", "id_b", F.round(similarity(F.col("distance")), 6).alias("similarity"))


def _batch(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hashes(spark, d):
    return sh.simhashes(table(spark, d, "pages").select("page_id", "content").distinct(), "page_id", "content")


def lemma_counts(spark, d):
    counts = po.word_frequencies(_docs(spark, d))
    lemmas = wo.lemma_map(counts.select("token").distinct())
    return wo.lemmatized(counts, lemmas).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))


QUERIES = {
    "tokenize_docs": tokenize_docs,
    "word_freq": lambda spark, d: po.word_frequencies(_docs(spark, d)),
    "doc_freq_idf": doc_freq_idf,
    "vocab_stats": lambda spark, d: po.statistics(_docs(spark, d), _plain(spark, d)),
    "doc_norms": lambda spark, d: _rounded(po.norms(po.word_frequencies(_docs(spark, d))), "norm"),
    "postings_nested_topterms": nested_topterms,
    "tfidf_and_search": lambda spark, d: _rounded(se.top(_found(spark, d, _one(spark))), "tfidf"),
    "cosine_rerank": lambda spark, d: _rounded(_ranked(spark, d, _one(spark)), "tfidf", "cosine"),
    "search_page_2": lambda spark, d: _rounded(se.page(_ranked(spark, d, _one(spark)), 2), "tfidf", "cosine"),
    "search_counts": lambda spark, d: se.counts(_found(spark, d, _one(spark))),
    "batch_search_topk": lambda spark, d: _rounded(_ranked(spark, d, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")), "tfidf", "cosine"),
    "token_lookup": lambda spark, d: _plain(spark, d).where(F.col("token").isin(*LOOKUP)).select("token", "doc_id", "tf"),
    "strange_words": lambda spark, d: _plain(spark, d).select("token").distinct().withColumn("strange", is_strange(F.col("token"))),
    "first_url_wins": lambda spark, d: first_urls(table(spark, d, "pages"), "page_id"),
    "exact_dup": lambda spark, d: sh.exact_classes(_docs(spark, d), "doc_id", "text"),
    "simhash_words": lambda spark, d: _hashes(spark, d).where("w0 IS NOT NULL"),
    "near_dup_pairs": lambda spark, d: sh.near_class_pairs(sh.classes(_hashes(spark, d))),
    "dedup_kept": lambda spark, d: sh.kept(_hashes(spark, d)),
    "html_tag_freq": lambda spark, d: po.tag_frequencies(table(spark, d, "pages").select("page_id", "content").distinct()),
    "index_postings": _indexed,
    "stale_frequencies": lambda spark, d: po.stale_frequencies(table(spark, d, "postings")).withColumn("frequency", F.coalesce("frequency", F.lit(-1).cast("bigint"))),
    "weighted_search": lambda spark, d: _rounded(_weighted(spark, d), "tfidf"),
    "weighted_search_urls": weighted_urls,
    "lemma_map": lambda spark, d: wo.lemma_map(_plain(spark, d).select("token").distinct()),
    "lemma_counts": lemma_counts,
    "spell_candidates": lambda spark, d: wo.spelling_candidates(_asked(spark), po.document_frequencies(_plain(spark, d))),
    "spell_corrected": lambda spark, d: wo.corrected(_asked(spark), po.document_frequencies(_plain(spark, d))),
    "spell_search": spell_search,
    "page_catalogue": page_catalogue,
    "query_forms": query_forms,
    "near_dup_similarity": near_dup_similarity,
    "safe_names": lambda spark, d: table(spark, d, "pages").where("url <> ''").select("url", safe_name(F.col("url")).alias("name")).distinct(),
    "bad_residuals": lambda spark, d: po.bad_residuals(po.tag_frequencies(table(spark, d, "pages").select("page_id", "content").distinct())).select("doc_id", "token"),
    "stored_lookup": lambda spark, d: stored(spark, d).lookup(*LOOKUP).select("token", "doc_id", "tf"),
    "stored_statistics": stored_statistics,
    "stored_search": lambda spark, d: _rounded(stored(spark, d).search(QUERY).withColumn("query_id", F.col("query_id").cast("bigint")), "tfidf", "cosine"),
    "stored_spell_search": lambda spark, d: _rounded(stored(spark, d).search(MISSPELT_QUERY, spellcheck=True).withColumn("query_id", F.col("query_id").cast("bigint")), "tfidf", "cosine"),
    "stored_batch_search": lambda spark, d: _rounded(stored(spark, d).search(_batch(spark, d)), "tfidf", "cosine"),
    "json_extract": lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
}

# ---- SQL ------------------------------------------------------------------------------------------------------------

_T = r"list_transform(regexp_extract_all({}, '[a-zA-Z\p{{Nd}}]+'), lambda w: lower(w))"
_WORDS = f"words AS (SELECT doc_id, unnest({_T.format('text')}) AS token FROM documents), freq AS (SELECT doc_id, token, count(*) AS n FROM words GROUP BY ALL), dfs AS (SELECT token, count(*) AS df FROM freq GROUP BY token), total AS (SELECT count(*) AS n_docs FROM documents)"
_NORMS = "norms AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM freq GROUP BY doc_id)"


def _search_sql(queries: str, total: str = "") -> str:
    return f"""{_WORDS}{total}, {_NORMS},
queries AS ({queries}),
qwords AS (SELECT query_id, unnest({_T.format('text')}) AS token FROM queries),
q AS (SELECT query_id, token, count(*) AS qn FROM qwords GROUP BY ALL),
need AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id),
found AS (
  SELECT q.query_id, f.doc_id, sum(ln(CAST(n_docs AS DOUBLE) / df) * (1 + {TAG_WEIGHTS['other']} * ln(f.n))) AS tfidf
  FROM q JOIN freq f ON f.token = q.token JOIN dfs ON dfs.token = q.token JOIN need ON need.query_id = q.query_id CROSS JOIN {"total_with_text" if total else "total"}
  GROUP BY q.query_id, f.doc_id, n_terms HAVING count(*) = n_terms),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(tfidf, 9) DESC, doc_id) <= {se.DEPTH}),
cos AS (
  SELECT b.query_id, b.doc_id, b.tfidf, CAST(sum(q.qn * f.n) AS DOUBLE) / (any_value(m.norm) * (SELECT sqrt(CAST(sum(qn * qn) AS DOUBLE)) FROM q x WHERE x.query_id = b.query_id)) AS cosine
  FROM best b JOIN q ON q.query_id = b.query_id JOIN freq f ON f.doc_id = b.doc_id AND f.token = q.token JOIN norms m ON m.doc_id = b.doc_id GROUP BY b.query_id, b.doc_id, b.tfidf),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, round(tfidf, 9) DESC, doc_id) AS rank, doc_id, tfidf, cosine FROM cos)"""


_WITH_TEXT = ", total_with_text AS (SELECT count(*) AS n_docs FROM documents WHERE text IS NOT NULL)"
_RESPELT = f"""SELECT CAST(0 AS BIGINT) AS query_id, string_agg(kept, ' ') AS text FROM (
  SELECT DISTINCT CASE WHEN EXISTS (SELECT 1 FROM dfs WHERE dfs.token = w) THEN w WHEN {' OR '.join(f"regexp_matches(w, '{p}')" for p in STRANGE)} THEN NULL
    ELSE coalesce((SELECT arg_min(token, (levenshtein(w, token), -df, token)) FROM dfs WHERE levenshtein(w, token) <= 2), w) END AS kept
  FROM (SELECT unnest(string_split('{MISSPELT_QUERY}', ' ')) AS w)) WHERE kept IS NOT NULL"""
_STORED_RANKED = """SELECT query_id, rank, doc_id, round(tfidf, 6) AS tfidf, round(cosine, 6) AS cosine, url, 'documents/' || doc_id AS path
FROM ranked JOIN (SELECT url, min(doc_id) AS doc_id FROM documents WHERE url <> '' AND text IS NOT NULL GROUP BY url) USING (doc_id)"""
_ONE = f"SELECT CAST(0 AS BIGINT) AS query_id, '{QUERY}' AS text"
_RANKED = "SELECT query_id, rank, doc_id, round(tfidf, 6) AS tfidf, round(cosine, 6) AS cosine FROM ranked"
_TAGS = ", ".join(f"coalesce(tag_frequencies['{t}'], 0) AS f_{t}" for t in TAGS)
_LAST = f"""latest AS (SELECT token, doc_id, {_TAGS} FROM postings WHERE token <> '' AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY token, doc_id ORDER BY run_id DESC, {', '.join(f'f_{t} DESC' for t in TAGS)}) = 1)"""
_SCORE = " + ".join(f"CASE WHEN f_{t} >= 1 THEN {TAG_WEIGHTS[t]} * ln(f_{t}) ELSE 0 END" for t in TAGS)
_INDEX_SEARCH = f"""{_LAST},
dfs AS (SELECT token, count(*) AS df FROM latest GROUP BY token), total AS (SELECT count(DISTINCT doc_id) AS n_docs FROM latest),
q AS (SELECT DISTINCT query_id, unnest(string_split(text, ' ')) AS token FROM (VALUES {', '.join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in enumerate(INDEX_QUERIES))}) v(query_id, text)),
need AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id),
found AS (SELECT q.query_id, l.doc_id, sum(ln(CAST(n_docs AS DOUBLE) / df) * (1 + {_SCORE})) AS tfidf
  FROM q JOIN latest l ON l.token = q.token JOIN dfs ON dfs.token = q.token JOIN need ON need.query_id = q.query_id CROSS JOIN total GROUP BY q.query_id, l.doc_id, n_terms HAVING count(*) = n_terms),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(tfidf, 9) DESC, doc_id) <= {se.DEPTH})"""
_LEMMAS = """vocabulary AS (SELECT DISTINCT token FROM freq),
tried AS (
  SELECT v.token, left(v.token, len(v.token) - len(r.a)) || r.b AS form
  FROM vocabulary v JOIN (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in wo.NOUN_RULES) + """) r(a, b) ON ends_with(v.token, r.a)
  WHERE len(v.token) > 2 AND NOT ends_with(v.token, 'ss') AND NOT ends_with(v.token, 'us')),
known AS (SELECT t.token, t.form FROM tried t JOIN vocabulary v ON v.token = t.form),
lemmas AS (SELECT v.token, coalesce((SELECT min((len(k.form), k.form)) FROM known k WHERE k.token = v.token)[2], v.token) AS lemma FROM vocabulary v)"""  # fmt: skip
_HASHES = """contents AS (SELECT DISTINCT page_id AS doc_id, content FROM pages),
hw AS (SELECT doc_id, unnest(regexp_extract_all(content, '[a-zA-Z\\p{Nd}]+')) AS w FROM contents),
hc AS (SELECT doc_id, md5(regexp_replace(lower(w), '[^\\x00-\\x7F]', '?', 'g')) AS h, count(*) AS n FROM hw GROUP BY ALL),
parts AS (SELECT doc_id, k, CAST('0x' || substr(h, 25 - 8 * k, 8) AS BIGINT) AS v, n FROM hc, (SELECT unnest(range(4)) AS k)),
votes AS (SELECT doc_id, k, b, sum(CASE WHEN (v >> b) & 1 = 1 THEN n ELSE -n END) AS s FROM parts, (SELECT CAST(unnest(range(32)) AS INT) AS b) GROUP BY doc_id, k, b),
ws AS (SELECT doc_id, k, CAST(sum(CASE WHEN s > 0 THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS w FROM votes GROUP BY doc_id, k),
hashes AS (SELECT c.doc_id, max(CASE WHEN k = 0 THEN w END) AS w0, max(CASE WHEN k = 1 THEN w END) AS w1, max(CASE WHEN k = 2 THEN w END) AS w2, max(CASE WHEN k = 3 THEN w END) AS w3
  FROM contents c LEFT JOIN ws ON ws.doc_id = c.doc_id GROUP BY c.doc_id),
classes AS (SELECT w0, w1, w2, w3, min(doc_id) AS first_id FROM hashes WHERE w0 IS NOT NULL GROUP BY ALL),
near AS (SELECT a.first_id AS id_a, b.first_id AS id_b, CAST(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) AS BIGINT) AS distance
  FROM classes a JOIN classes b ON a.first_id < b.first_id)"""
_NEAR = "vocabulary AS (SELECT token AS candidate, df FROM dfs), asked AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in MISSPELT) + "]) AS word), near AS (SELECT word, candidate, CAST(levenshtein(word, candidate) AS BIGINT) AS distance, df FROM asked, vocabulary WHERE levenshtein(word, candidate) <= 2)"

def _named(names: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names.split()) + "]"


# The tree rules of the HTML reader, a piece (tag or text) at a time over a stack of open elements; entities hold no token characters.
_VOID = "area base br col embed hr img input link meta param source track wbr"
_SELF = "li tr td th dt dd option"
_ATTR = r"""(?:[^<>"'']|"[^"]*"|''[^'']*'')*"""
_PIECE = rf"""(?s)<!--.*?(?:-->|\z)|<![^>]*(?:>|\z)|<\?[^>]*(?:>|\z)|<(?i:script)(?:[^A-Za-z0-9<>"'']{_ATTR})?(?:>|\z).*?(?:(?i:</script)\s*>?|\z)|<(?i:style)(?:[^A-Za-z0-9<>"'']{_ATTR})?(?:>|\z).*?(?:(?i:</style)\s*>?|\z)|</?[A-Za-z][A-Za-z0-9]*{_ATTR}(?:>|\z)|[^<]+|<"""
_CUT = "list_slice(acc.stack, 1, len(acc.stack) - list_position(list_reverse(acc.stack), {0}))"
_HTML_TAGS = f"""WITH contents AS (SELECT DISTINCT page_id AS doc_id, content FROM pages WHERE content IS NOT NULL),
pieces AS (SELECT doc_id, list_transform(regexp_extract_all(content, '{_PIECE}'), lambda t: {{
    'stack': CAST([] AS VARCHAR[]), 'nodes': CAST([] AS STRUCT(tag VARCHAR, text VARCHAR)[]), 't': t,
    'name': CASE WHEN regexp_matches(t, '^</?[A-Za-z]') AND len(t) > 1 THEN lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE '' END}}) AS ps FROM contents),
read AS (SELECT doc_id, list_reduce(ps, lambda acc, x: {{
    'stack': CASE
      WHEN x.name = '' OR x.name IN ('script', 'style') OR list_contains({_named(_VOID)}, x.name) THEN acc.stack
      WHEN x.t[2] = '/' THEN CASE WHEN list_contains(acc.stack, x.name) THEN {_CUT.format('x.name')} ELSE acc.stack END
      ELSE list_concat(CASE WHEN x.name = 'p' AND list_contains(acc.stack, 'p') THEN {_CUT.format("'p'")}
          WHEN list_contains({_named(_SELF)}, x.name) AND acc.stack[-1] = x.name THEN list_slice(acc.stack, 1, len(acc.stack) - 1) ELSE acc.stack END,
        CASE WHEN regexp_matches(x.t, '/>?$') THEN [] ELSE [x.name] END) END,
    'nodes': CASE WHEN x.t[1] = '<' AND len(x.t) > 1 THEN acc.nodes ELSE list_append(acc.nodes, {{'tag': coalesce(acc.stack[-1], ''), 'text': x.t}}) END,
    't': '', 'name': ''}}, {{'stack': CAST([] AS VARCHAR[]), 'nodes': CAST([] AS STRUCT(tag VARCHAR, text VARCHAR)[]), 't': '', 'name': ''}}).nodes AS nodes FROM pieces),
nodes AS (SELECT doc_id, unnest(nodes) AS n FROM read),
words AS (SELECT doc_id, n.tag AS tag, lower(unnest(regexp_extract_all(regexp_replace(n.text, '&#?\\w+;?', ' ', 'g'), '[a-zA-Z\\p{{Nd}}]+'))) AS token FROM nodes)
SELECT doc_id, token, {', '.join(f"count(*) FILTER (tag = '{t}') AS f_{t}" for t in TAGS[:-1])}, count(*) FILTER (tag NOT IN {TAGS[:-1]}) AS f_other, count(*) AS tf FROM words GROUP BY doc_id, token"""

SQL = {
    "html_tag_freq": _HTML_TAGS,
    "tokenize_docs": f"SELECT doc_id, CAST(coalesce(len(ts), 0) AS BIGINT) AS n_tokens, coalesce(array_to_string(ts, ' '), '') AS joined FROM (SELECT doc_id, {_T.format('text')} AS ts FROM documents)",
    "word_freq": f"WITH {_WORDS} SELECT * FROM freq",
    "doc_freq_idf": f"WITH {_WORDS} SELECT token, df, round(ln(CAST(n_docs AS DOUBLE) / df), 6) AS idf FROM dfs CROSS JOIN total",
    "vocab_stats": f"WITH {_WORDS} SELECT (SELECT count(*) FROM dfs) AS n_tokens, (SELECT count(*) FROM freq) AS n_postings, (SELECT count(*) FROM words) AS n_words, n_docs FROM total",
    "doc_norms": f"WITH {_WORDS}, {_NORMS} SELECT doc_id, round(norm, 6) AS norm FROM norms",
    "postings_nested_topterms": f"WITH {_WORDS} SELECT token, count(*) AS df, min(doc_id) AS first_doc, CAST(sum(n) AS BIGINT) AS total FROM freq GROUP BY token ORDER BY df DESC, token LIMIT 20",
    "tfidf_and_search": f"WITH {_search_sql(_ONE)} SELECT query_id, doc_id, round(tfidf, 6) AS tfidf FROM best",
    "cosine_rerank": f"WITH {_search_sql(_ONE)} {_RANKED}",
    "search_page_2": f"WITH {_search_sql(_ONE)} {_RANKED} WHERE rank BETWEEN 6 AND 10",
    "search_counts": f"WITH {_search_sql(_ONE)} SELECT query_id, count(*) AS n_matched, least(count(*), {se.DEPTH}) AS n_ranked, CAST(ceil(least(count(*), {se.DEPTH}) / {se.PAGE_SIZE}.0) AS BIGINT) AS pages FROM found GROUP BY query_id",
    "batch_search_topk": f"WITH {_search_sql('SELECT item_id AS query_id, text FROM benchmark')} {_RANKED}",
    "token_lookup": f"WITH {_WORDS} SELECT token, doc_id, n AS tf FROM freq WHERE token IN {LOOKUP}",
    "strange_words": f"WITH {_WORDS} SELECT token, {' OR '.join(f'''regexp_matches(token, '{p}')''' for p in STRANGE)} AS strange FROM dfs",
    "first_url_wins": "SELECT url, min(page_id) AS page_id FROM pages WHERE url <> '' GROUP BY url",
    "exact_dup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL",
    "simhash_words": f"WITH {_HASHES} SELECT doc_id, w0, w1, w2, w3 FROM hashes WHERE w0 IS NOT NULL",
    "near_dup_pairs": f"WITH {_HASHES} SELECT id_a, id_b, distance FROM near WHERE distance <= {sh.NEAR}",
    "dedup_kept": f"""WITH {_HASHES},
pairs AS (SELECT id_a, id_b FROM near WHERE distance <= {sh.NEAR}), least_of AS (SELECT first_id, least(first_id, (SELECT min(p.id_a) FROM pairs p WHERE p.id_b = c.first_id), (SELECT min(p.id_b) FROM pairs p WHERE p.id_a = c.first_id)) AS earliest, w0, w1, w2, w3 FROM classes c)
SELECT h.doc_id FROM hashes h LEFT JOIN least_of l ON l.w0 = h.w0 AND l.w1 = h.w1 AND l.w2 = h.w2 AND l.w3 = h.w3 WHERE l.earliest IS NULL OR h.doc_id <= l.earliest""",
    "index_postings": f"WITH {_LAST} SELECT doc_id, token, {', '.join(f'f_{t}' for t in TAGS)}, {' + '.join(f'f_{t}' for t in TAGS)} AS tf FROM latest",
    "stale_frequencies": "SELECT token, doc_id, run_id, coalesce(frequency, -1) AS frequency, tf FROM (SELECT *, CAST(coalesce(list_sum(map_values(tag_frequencies)), 0) AS BIGINT) AS tf FROM postings) WHERE frequency IS DISTINCT FROM tf",
    "weighted_search": f"WITH {_INDEX_SEARCH} SELECT query_id, doc_id, round(tfidf, 6) AS tfidf FROM best",
    "weighted_search_urls": f"WITH {_INDEX_SEARCH}, urls AS (SELECT url, min(page_id) AS doc_id, arg_min(path, page_id) AS path FROM (SELECT page_id, url, path FROM pages UNION ALL SELECT page_id, url, path FROM text_pages) WHERE url <> '' GROUP BY url) SELECT query_id, b.doc_id, round(tfidf, 6) AS tfidf, url, path FROM best b JOIN urls u ON u.doc_id = b.doc_id",
    "lemma_map": f"WITH {_WORDS}, {_LEMMAS} SELECT token, lemma FROM lemmas",
    "lemma_counts": f"WITH {_WORDS}, {_LEMMAS}, lc AS (SELECT doc_id, lemma AS token, sum(n) AS n FROM freq f JOIN lemmas l ON l.token = f.token GROUP BY doc_id, lemma) SELECT token, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM lc GROUP BY token",
    "spell_candidates": f"WITH {_WORDS}, {_NEAR} SELECT * FROM near",
    "spell_corrected": f"WITH {_WORDS}, {_NEAR} SELECT word, arg_min(candidate, (distance, -df, candidate)) AS corrected FROM near GROUP BY word",
    "spell_search": f"WITH {_search_sql(_RESPELT)} SELECT query_id, doc_id, round(tfidf, 6) AS tfidf FROM best",
    "page_catalogue": "SELECT dense_rank() OVER (ORDER BY path) AS doc_id, page_id, path FROM (SELECT DISTINCT page_id, path FROM pages WHERE path IS NOT NULL)",
    "query_forms": f"SELECT item_id, coalesce(array_to_string(list_sort(list_distinct({_T.format('text')})), ' '), '') AS terms, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim(lower(text)), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))), ' ') AS strict FROM benchmark",
    "near_dup_similarity": f"WITH {_HASHES} SELECT id_a, id_b, round(1 - distance / 128.0, 6) AS similarity FROM near WHERE distance <= {sh.NEAR}",
    "safe_names": "SELECT DISTINCT url, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM pages WHERE url <> ''",
    "bad_residuals": f"SELECT doc_id, token FROM ({_HTML_TAGS}) WHERE f_other < 0",
    "stored_lookup": f"WITH {_WORDS} SELECT token, doc_id, n AS tf FROM freq WHERE token IN {LOOKUP}",
    "stored_statistics": f"WITH {_WORDS} SELECT (SELECT count(*) FROM dfs) AS n_tokens, (SELECT count(*) FROM freq) AS n_postings, (SELECT count(*) FROM words) AS n_words, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_docs, (SELECT min(token) FROM dfs) AS first_token, (SELECT max(token) FROM dfs) AS last_token, (SELECT count(*) FROM freq) AS in_files",
    "stored_search": f"WITH {_search_sql(_ONE, _WITH_TEXT)} {_STORED_RANKED}",
    "stored_spell_search": f"WITH {_search_sql(_RESPELT, _WITH_TEXT)} {_STORED_RANKED}",
    "stored_batch_search": f"WITH {_search_sql('SELECT item_id AS query_id, text FROM benchmark', _WITH_TEXT)} {_STORED_RANKED}",
    "json_extract": "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events",
}
