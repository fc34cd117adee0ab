"""Queries over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.operators import evaluate, search, structure, vectors
from corposcope.plans import hybrid
from corposcope.sources import corpus, html, index
from corposcope.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLOCKS = "b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_index, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> '')"
PAGES = BLOCKS + ", p AS (SELECT doc_id, (block_index // 5 + 1)::INT AS page_no, string_agg(text, ' ' ORDER BY block_index) AS text FROM b GROUP BY ALL)"
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
PHRASE = "t AS (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents), q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS q FROM benchmark), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS m FROM t), df AS (SELECT token, count(*) AS df FROM (SELECT row_id, unnest(list_distinct(tokens)) AS token FROM t) GROUP BY 1), met AS (SELECT query_id, row_id, tokens, q FROM q JOIN t ON contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ')), parts AS (SELECT query_id, row_id, len(tokens) AS len, token, len(list_filter(tokens, lambda x: x = token)) AS tf FROM (SELECT *, unnest(list_distinct(q)) AS token FROM met)), scored AS (SELECT query_id, row_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / m))), 6) AS bm25 FROM parts JOIN df USING (token), stats GROUP BY ALL), ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, row_id))::INT AS rank, row_id, bm25 FROM scored)"

TFIDF = "tf AS (SELECT row_id, token, count(*) AS tf FROM (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL), idf AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), w AS (SELECT row_id, token, tf * idf AS w FROM tf JOIN idf USING (token)), rn AS (SELECT row_id, sqrt(sum(w * w)) AS rn FROM w GROUP BY 1), a AS (SELECT query_id, token, n * idf AS qw FROM (SELECT query_id, token, count(*) AS n FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL) JOIN idf USING (token)), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM a GROUP BY 1), s AS (SELECT query_id, row_id, round(sum(w * qw) / any_value(rn) / any_value(qn), 6) AS cosine FROM w JOIN a USING (token) JOIN rn USING (row_id) JOIN qn USING (query_id) GROUP BY ALL)"

def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.read_table(spark, d, "documents")


def pages(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.pages_of(docs(spark, d))
    return p.withColumn("row_id", F.col("doc_id") * 1_000_000 + F.col("page_no"))


def batch(spark: SparkSession, d: str) -> DataFrame:
    return corpus.read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("row_id"), "text")


def doc_index(spark: SparkSession, d: str) -> index.Index:
    """The written index of documents, built where these files have none yet."""
    return index.index_for(texts(spark, d), docs(spark, d), "documents")


def page_index(spark: SparkSession, d: str) -> index.Index:
    return index.index_for(pages(spark, d).select("row_id", "text"), docs(spark, d), "pages of five blocks", normed=False)


def ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return search.keyword_search(batch(spark, d), doc_index(spark, d), k)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a query verbatim, wherever in their words it begins and ends."""
    return search.rows_containing(batch(spark, d), texts(spark, d), doc_index(spark, d)).withColumnRenamed("row_id", "doc_id")


@query(f"WITH {BLOCKS} SELECT doc_id, block_index::INT AS block_index, (block_index // 5 + 1)::INT AS page_no, text FROM b")
def s1_blocks(spark, d):
    return corpus.blocks_of(docs(spark, d))


_STRIPPED = "html"
for _tag in ("script", "style", "noscript", "header", "footer", "nav", "aside", "form", "svg", "canvas"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'g')"
_PLAIN = "regexp_replace(t, '(?s)<[^>]*>', ' ', 'g')"
# A character reference may end without its semicolon; a number goes on with its digits.
for _written, _sign in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39(;|$)", "''"), ("&#39([^0-9;])", "''\\1"), ("&nbsp;?", " "), ("&amp;?", "&")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_written}', '{_sign}', 'g')"


@query(f"""WITH h AS (SELECT page_id, regexp_extract({_STRIPPED}, '(?is)<article\\b[^>]*>(.*)</article>', 1) AS body FROM pages),
m AS (SELECT page_id, string_split(regexp_replace(regexp_replace(body, '(?is)<(h[1-6]|p|li|blockquote|pre)\\b[^>]*>', chr(1) || '\\1' || chr(2), 'g'), '(?is)</(h[1-6]|p|li|blockquote|pre|ul|ol)>', chr(3), 'g'), chr(1))[2:] AS parts FROM h),
u AS (SELECT page_id, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM m),
b AS (SELECT page_id, i, lower(string_split(part, chr(2))[1]) AS tag, string_split(string_split(part, chr(2))[2], chr(3))[1] AS t FROM u),
s AS (SELECT page_id, i, tag, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::INT AS block_no, tag, text FROM s WHERE text <> ''""")
def s2_html_blocks(spark, d):
    return html.html_blocks(corpus.read_table(spark, d, "pages"))


@query(f"SELECT page_id, coalesce(nullif(trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace({_PLAIN.replace('(t, ', '(h, ')}, '\\s+', ' ', 'g')), '')) AS title FROM (SELECT page_id, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1) AS t, regexp_extract({_STRIPPED}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) AS h FROM pages)")
def s2_html_titles(spark, d):
    return html.html_titles(corpus.read_table(spark, d, "pages"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'pdf' WHEN regexp_matches(lower(url), '^https?://') THEN 'web' ELSE 'local' END AS kind FROM pages")
def s3_source_kind(spark, d):
    return corpus.read_table(spark, d, "pages").select("page_id", X.source_kind(F.col("url")).alias("kind"))


@query("WITH m AS (SELECT conv_id, turn, role, turn % 2 AS idx FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, idx ORDER BY turn) > 1 AS again, max(idx) OVER (PARTITION BY conv_id) AS top FROM m) SELECT conv_id, turn, (CASE WHEN again THEN top + sum(again::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) ELSE idx END)::BIGINT AS idx, idx AS source_index FROM r")
def s6_unique_index(spark, d):
    rows = corpus.read_table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 2).alias("idx"))
    return corpus.unique_index(rows, ["conv_id"], "idx", ["turn"])


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled', 'new', quality FROM labels")
def s7_upsert(spark, d):
    new = corpus.read_table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("lang"), F.lit("new").alias("source"), F.col("quality").cast("long").alias("n_chars"))
    return corpus.upsert(docs(spark, d).select("doc_id", "lang", "source", "n_chars"), new, ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s9_delete_documents(spark, d):
    gone = corpus.read_table(spark, d, "labels").filter("toxic = 1")
    return corpus.delete_documents(docs(spark, d).select("doc_id", "source"), gone)


@query("SELECT CASE WHEN l.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE l.doc_id END AS doc_id, n_chars FROM documents l")
def s9_detach_documents(spark, d):
    gone = corpus.read_table(spark, d, "labels").filter("toxic = 1")
    return corpus.delete_documents(docs(spark, d).select("doc_id", "n_chars"), gone, detach=True)


@query("SELECT o_orderkey, new_id AS custkey FROM orders JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS new_id FROM customer) ON o_custkey = c_custkey")
def s11_remap_ids(spark, d):
    ids = corpus.remap_ids(corpus.read_table(spark, d, "customer"), "c_custkey")
    return corpus.read_table(spark, d, "orders").join(ids, F.col("o_custkey") == F.col("old_id")).select("o_orderkey", F.col("new_id").alias("custkey"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def s13_latest(spark, d):
    return corpus.latest(corpus.read_table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("WITH n AS (SELECT url, (row_number() OVER (ORDER BY url) - 1) // 16 AS group_no FROM (SELECT DISTINCT url FROM pages)) SELECT group_no, count(*) AS n_paths, sha1(string_agg(url, '' ORDER BY url)) AS hash FROM n GROUP BY 1")
def s19_pending_work(spark, d):
    paths = corpus.read_table(spark, d, "pages").select(F.col("url").alias("path"))
    return corpus.pending_work(paths, spark.sql("SELECT '' AS hash"), 16)


@query(f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY ALL")
def s20_postings(spark, d):
    return corpus.build_postings(docs(spark, d), "doc_id", X.index_tokens(F.col("text")))


@query(f"WITH {PAGES}, s AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p) SELECT doc_id, string_agg(start || ':' || (start + length(text)) || ':' || page_no, ',' ORDER BY page_no) AS spans, count(*)::INT AS n_pages, sha1(string_agg(text, chr(10) ORDER BY page_no)) AS sha1 FROM s GROUP BY doc_id")
def s22_assemble(spark, d):
    return corpus.assemble_documents(corpus.pages_of(docs(spark, d))).select("doc_id", "spans", "n_pages", "sha1")


@query(f"WITH m AS (SELECT doc_id, text, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) > 2), lambda x: lower(x))) AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, len(list_filter(t, lambda x: contains(lower(text), x)))::INT AS hits, trim(regexp_replace(regexp_replace(lower(text), '[‐-―−]', '-', 'g'), '[^a-z0-9]+', ' ', 'g')) AS loose, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::INT AS words FROM m")
def p1_tokens(spark, d):
    t = X.query_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), X.lex_hits(t, F.col("text")).alias("hits"), X.loose_norm(F.col("text")).alias("loose"), X.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g')) AS wer_text, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 320) AS preview FROM documents")
def p28_wer_text(spark, d):
    return docs(spark, d).select("doc_id", X.wer_normalize(F.col("text")).alias("wer_text"), X.preview(F.col("text")).alias("preview"))


@query("WITH m AS (SELECT doc_id, lang, text, length(text) AS n, length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) AS letters, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, NOT (n < 200 OR letters < 0.5 * n) AND (lang <> 'en' OR len(list_filter(w, lambda x: x IN ('download', 'pdf', 'epub', 'mobi', 'free', 'ebook', 'file', 'save', 'casino', 'viagra', 'cialis', 'ciprofloxacin'))) > 0.004 * len(w)) AS dropped, length(regexp_replace(text, '[\\p{L}\\p{N}]', '', 'g')) > 0.9 * n AS garbled FROM m")
def p32_doc_filter(spark, d):
    return docs(spark, d).select("doc_id", X.doc_filtered(F.col("text"), F.col("lang")).alias("dropped"), X.is_garbled(F.col("text")).alias("garbled"))


@query()
def p29_prediction_flags(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(X.prediction_flags(F.col("text")), ",").alias("flags"))


@query()
def p13_headings(spark, d):
    line = F.col("text")
    return corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", "page_no", X.canonical_heading(line).alias("canonical"), X.md_line_kind(line).alias("kind"), X.boilerplate(line).alias("boilerplate"), X.section_bucket(line, F.col("page_no"), F.lit("")).alias("bucket"))


@query(f"WITH {PHRASE} SELECT query_id, rank, row_id, bm25 FROM ranked WHERE rank <= 10")
def j1_keyword_search(spark, d):
    return ranked(spark, d)


@query("WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS row_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0) SELECT query_id, rank, row_id, similarity FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id))::INT AS rank FROM s) WHERE rank <= 10")
def j4_vector_topk(spark, d):
    v = corpus.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))
    return vectors.vector_topk(v.filter("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), v, 10)


@query(f"WITH {PHRASE}, {TFIDF}, l AS (SELECT query_id, row_id, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id))::INT AS rank FROM s), f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.row_id, y.row_id) AS row_id, round(coalesce(0.5 / (60 + x.rank), 0) + coalesce(0.5 / (60 + y.rank), 0), 6) AS hybrid_score, concat_ws('+', CASE WHEN x.rank IS NOT NULL THEN 'vector' END, CASE WHEN y.rank IS NOT NULL THEN 'text' END) AS sources FROM (SELECT * FROM l WHERE rank <= 10) x FULL JOIN (SELECT * FROM ranked WHERE rank <= 10) y ON x.query_id = y.query_id AND x.row_id = y.row_id) SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, row_id))::INT AS rank FROM f) WHERE rank <= 5")
def j6_rrf_fuse(spark, d):
    """Keyword and tf-idf rankings, each twice as deep as the fused list."""
    vectors = search.tfidf_search(batch(spark, d), doc_index(spark, d), 10)
    return search.rrf_fuse(vectors, ranked(spark, d, 10), 5)


SUBSTRINGS = "asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN substr(text, 2, 2) ELSE substr(text, 3, 11) END AS query FROM benchmark)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Queries that begin and end inside words: characters 3 to 13 of the passages, of every fifth two characters."""
    b = batch(spark, d)
    return b.select("query_id", F.when(F.col("query_id") % 5 == 0, F.substring("query", 2, 2)).otherwise(F.substring("query", 3, 11)).alias("query"))


@query(f"WITH {SUBSTRINGS} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY doc_id))::INT AS rank, doc_id AS row_id FROM asked JOIN documents ON trim(query) <> '' AND contains(lower(text), lower(query)) QUALIFY rank <= 25")
def j1_substring_search(spark, d):
    return search.substring_search(parts(spark, d), texts(spark, d), 25, index.grams_for(texts(spark, d), docs(spark, d), "documents"))


PAGE_PHRASE = PAGES + ", pg AS (SELECT doc_id * 1000000 + page_no AS row_id, doc_id, page_no, text FROM p), " + PHRASE.replace("SELECT doc_id AS row_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents", "SELECT row_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM pg")
# The twin's word boundaries see ASCII alone, so other letters are q there.
_ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', 'q', 'g')"
_SAMPLE = _ASCII.format("substr(trim(replace(text, chr(0), ' ')), 1, 1200)")
_COUNT = lambda pattern, x: f"len(regexp_extract_all({x}, '{pattern}'))"
BUCKET = f"""CASE WHEN trim(text) = '' THEN 'body' WHEN regexp_matches(substr({_SAMPLE}, 1, 120), '(?i)^\\s*(references|bibliography)\\b') OR {_COUNT(X.REFERENCE_SIGNAL, _SAMPLE)} >= 8 THEN 'references' WHEN page_no = 1 AND {_COUNT(X.FRONT_SIGNAL, f'substr({_SAMPLE}, 1, 600)')} >= 2 THEN 'front_matter' ELSE 'body' END"""
_STOPS = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOKENS_OF = "list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) > 2), lambda x: lower(x)))"
_VECTOR = "list_transform(range(64), lambda b: coalesce(list_sum(list_transform(list_filter(c, lambda x: x % 64 = b), lambda x: CASE WHEN (x // 64) % 2 = 0 THEN 1 ELSE -1 END)), 0)::DOUBLE)"
_CODES = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 3))::INT)"
_ASKED = f"qq AS (SELECT item_id AS query_id, text AS query, {_TOKENS_OF} AS qt FROM benchmark)"
_STATS = f"""ts AS (
  SELECT query_id, token, round(ln((n + 1) / (coalesce(df, 0) + 1)) + 1, 6) AS weight, coalesce(df, 0) <= greatest(3, floor(n * 0.06)) AS rare
  FROM (SELECT query_id, unnest(qt) AS token FROM qq) LEFT JOIN df USING (token), (SELECT count(*) AS n FROM t) WHERE token NOT IN ({_STOPS})),
tl AS (SELECT query_id, list({{'t': token, 'w': weight, 'r': rare}}) AS ts FROM ts GROUP BY 1)"""
_KEPT = """e AS (SELECT *, content >= CASE WHEN content_count <= 2 THEN 1 ELSE 2 END AND lex >= least_hits AS enough FROM c),
kept AS (SELECT * FROM e WHERE CASE WHEN bucket = 'references' THEN false WHEN exact THEN true WHEN content_count = 0 AND lex >= least_hits THEN true WHEN bucket = 'front_matter' THEN keyword_score >= 0.12e0 AND content >= 1
  WHEN enough THEN nrare = 0 OR rare >= CASE WHEN nrare <= 2 THEN 1 ELSE 2 END OR (weighted >= 0.78e0 AND match_score >= 0.1e0) WHEN nrare > 0 AND rare = 0 THEN false WHEN content >= 1 AND weighted < 0.52e0 THEN false
  ELSE match_score >= 0.085e0 AND content >= 1 AND (nrare = 0 OR rare >= 1) AND (lex >= greatest(1, least_hits - 1) OR lex + CASE WHEN exact THEN 8 ELSE 0 END >= 4.5e0 OR keyword_score >= 0.05e0 OR raw >= 0.012e0) END)"""


def gated_sql(met: str, match: str) -> str:
    """CTEs from the page hits ``met`` (query_id, row_id, rank, semantic_score, raw) to ``kept``, with ``match`` as match_score."""
    return f"""mm AS ({met}),
f AS (
  SELECT m.*, doc_id, page_no, text, bucket, query, qt, len(list_filter(qt, lambda x: contains(lower(text), x))) AS lex, length(trim(query)) >= 3 AND contains(lower(text), lower(trim(query))) AS exact
  FROM mm m JOIN pb USING (row_id) JOIN qq USING (query_id)),
g AS (SELECT *, CASE WHEN rank IS NULL THEN 0 ELSE 1 / (10 + rank) + CASE WHEN exact THEN 0.08e0 ELSE 0 END + least(lex, 4) * 0.015e0 END AS keyword_score, CASE bucket WHEN 'references' THEN 0.18e0 WHEN 'front_matter' THEN 0.6e0 ELSE 1 END AS factor FROM f),
h AS (SELECT *, {match} AS match_score FROM g),
{_STATS},
a AS (SELECT h.*, coalesce(ts, []) AS ts FROM h LEFT JOIN tl USING (query_id)),
c AS (
  SELECT *, len(list_filter(ts, lambda x: contains(lower(text), x.t))) AS content, len(ts) AS content_count, len(list_filter(ts, lambda x: x.r AND contains(lower(text), x.t))) AS rare, len(list_filter(ts, lambda x: x.r)) AS nrare,
    coalesce(list_sum(list_transform(list_filter(ts, lambda x: contains(lower(text), x.t)), lambda x: x.w)) / list_sum(list_transform(ts, lambda x: x.w)), 0) AS weighted, CASE WHEN len(qt) <= 2 THEN 1 ELSE 2 END AS least_hits FROM a),
{_KEPT}"""


_PAGE_BASE = f"WITH {PAGE_PHRASE}, {_ASKED}, pb AS (SELECT row_id, doc_id, page_no, text, {BUCKET} AS bucket FROM pg)"
HYBRID = f"""{_PAGE_BASE},
pv AS (SELECT row_id, {_VECTOR} AS v FROM (SELECT row_id, {_CODES.format('text')} AS c FROM pg)),
qv AS (SELECT query_id, {_VECTOR} AS v FROM (SELECT query_id, {_CODES.format('query')} AS c FROM qq)),
sim AS (SELECT query_id, row_id, round(list_dot_product(q.v, p.v) / greatest(sqrt(list_dot_product(q.v, q.v)), 1e-300) / greatest(sqrt(list_dot_product(p.v, p.v)), 1e-300), 6) AS s FROM qv q, pv p),
near AS (SELECT query_id, row_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM sim),
sem AS (SELECT query_id, row_id, round(1 / (15 + rank) + greatest(0, least(1, s)) * 0.15e0, 6) AS semantic_score, s AS raw FROM near WHERE rank <= 20 AND s > 0),
kw AS (SELECT query_id, row_id, rank FROM ranked WHERE rank <= 20),
{gated_sql("SELECT query_id, row_id, rank, coalesce(semantic_score, 0) AS semantic_score, coalesce(raw, 0) AS raw FROM kw FULL JOIN sem USING (query_id, row_id)",
           "(keyword_score + semantic_score + CASE WHEN keyword_score > 0 AND semantic_score > 0 THEN 0.05e0 ELSE 0 END + CASE WHEN exact THEN 0.05e0 ELSE 0 END + least(lex, 4) * 0.01e0) * factor")}
SELECT query_id, row_id, doc_id, page_no, round(keyword_score, 6) AS keyword_score, round(semantic_score, 6) AS semantic_score, round(match_score, 6) AS match_score, lex AS lex_hits, exact AS exact_phrase, bucket AS search_bucket FROM kept"""
KEYWORD_DOCUMENTS = f"""{_PAGE_BASE},
{gated_sql("SELECT query_id, row_id, rank, 0e0 AS semantic_score, 0e0 AS raw FROM ranked WHERE rank <= 20", "keyword_score * factor")},
top3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY match_score DESC, row_id) AS i FROM kept QUALIFY i <= 3),
dg AS (
  SELECT query_id, doc_id, sum(CASE i WHEN 1 THEN 1e0 WHEN 2 THEN 0.6e0 ELSE 0.35e0 END * match_score) AS s, count(DISTINCT page_no) AS np, count(*) AS n_support, bool_and(bucket = 'references') AS ar, bool_or(i = 1 AND bucket = 'references') AS fr,
    bool_or(bucket = 'body') AS ab, bool_and(bucket = 'front_matter') AS af, bool_or(i = 1 AND bucket = 'front_matter') AS ff FROM top3 GROUP BY ALL),
ds AS (
  SELECT query_id, doc_id, n_support, round((s + CASE WHEN np > 1 THEN least(np - 1, 2) * 0.02e0 ELSE 0 END) * CASE WHEN ar THEN 0.12e0 WHEN fr AND NOT ab THEN 0.22e0 WHEN af THEN 0.5e0 WHEN ff AND NOT ab THEN 0.7e0 ELSE 1 END, 6) AS score FROM dg)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score, n_support FROM ds QUALIFY rank <= 20"""
TITLES = f"""WITH {PHRASE}, {_ASKED}, {_STATS},
ti AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents), tw AS (SELECT doc_id, lower(title) AS title, regexp_extract_all(lower(title), '[a-z0-9]+') AS words FROM ti),
qc AS (SELECT query_id, query, qt, list_filter(qt, lambda x: x NOT IN ({_STOPS})) AS content, coalesce(list_transform(list_filter(ts, lambda x: x.r), lambda x: x.t), []) AS rare FROM qq LEFT JOIN tl USING (query_id)),
pr AS (SELECT query_id, doc_id, title, contains(title, lower(trim(query))) AS phrase, len(list_filter(qt, lambda x: contains(title, x))) AS o, len(list_filter(content, lambda x: contains(title, x))) AS c, len(list_filter(rare, lambda x: contains(title, x))) AS r, len(content) AS nc, len(rare) AS nr
  FROM qc JOIN tw ON list_has_any(qt, words))
SELECT query_id, doc_id, round(CASE WHEN phrase THEN 0.18e0 ELSE 0 END + least(o, 5) * 0.015e0 + least(c, 5) * 0.05e0 + r * 0.07e0 + CASE WHEN nc > 0 THEN c / nc * 0.1e0 ELSE 0 END + CASE WHEN nr > 0 THEN r / nr * 0.1e0 ELSE 0 END, 6) AS bonus
FROM pr WHERE phrase OR c > 0 OR r > 0 OR o >= 2"""


@query(KEYWORD_DOCUMENTS)
def j8_search_documents(spark, d):
    return hybrid.search_documents(batch(spark, d), pages(spark, d), page_index(spark, d))


@query(HYBRID)
def j10_hybrid_hits(spark, d):
    """Pages by words and by vectors, merged and gated."""
    h = hybrid.hybrid_hits(batch(spark, d), pages(spark, d), page_index(spark, d))
    scores = (F.round(c, 6).alias(c) for c in ("keyword_score", "semantic_score", "match_score"))
    return h.select("query_id", "row_id", "doc_id", "page_no", *scores, "lex_hits", "exact_phrase", "search_bucket")


@query()
def j10_hybrid_documents(spark, d):
    titled = docs(spark, d).select("doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))
    return hybrid.hybrid_documents(batch(spark, d), pages(spark, d), titled, page_index(spark, d))


def page_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hits inside each query's first document, and the pages of that document that hold the query verbatim; a page's bucket stands for its section."""
    p = pages(spark, d)
    found = search.keyword_search(batch(spark, d), page_index(spark, d), 20).join(p, "row_id")
    top = found.filter("rank = 1").select("query_id", F.col("doc_id").alias("top_"))
    within = found.join(top, "query_id").filter(F.col("doc_id") == F.col("top_"))
    bucket = X.section_bucket(F.col("text"), F.col("page_no"), F.lit(None).cast("string"))
    hits = within.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place"), "page_no", bucket.alias("canonical"))
    held = p.join(top, F.col("doc_id") == F.col("top_")).join(batch(spark, d), "query_id").filter(F.contains("text", "query"))
    gold = held.groupBy("query_id").agg(F.collect_set("page_no").alias("pages"), F.collect_set(bucket).alias("sections"))
    return hits, batch(spark, d).select("query_id").join(gold, "query_id", "left")


@query(f"""WITH {PAGE_PHRASE}, fb AS (SELECT r.query_id, r.rank, g.*, {BUCKET} AS bucket FROM ranked r JOIN pg g USING (row_id) WHERE rank <= 20),
tp AS (SELECT query_id, doc_id AS top FROM fb WHERE rank = 1), lo AS (SELECT query_id, page_no, bucket, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fb JOIN tp USING (query_id) WHERE doc_id = top),
gd AS (SELECT query_id, list(DISTINCT page_no) AS pages, list(DISTINCT bucket) AS sections FROM (SELECT query_id, page_no, {BUCKET} AS bucket FROM tp JOIN pg ON doc_id = top JOIN (SELECT item_id, text AS passage FROM benchmark) ON item_id = query_id WHERE contains(text, passage)) GROUP BY 1),
ag AS (SELECT query_id, coalesce(list(page_no) FILTER (WHERE place <= 1), []) AS p1, coalesce(list(page_no) FILTER (WHERE place <= 3), []) AS p3, coalesce(list(bucket) FILTER (WHERE place <= 1), []) AS s1, coalesce(list(bucket) FILTER (WHERE place <= 3), []) AS s3, coalesce(list(bucket) FILTER (WHERE place <= 5), []) AS s5 FROM lo GROUP BY 1)
SELECT b.item_id AS query_id, list_has_any(pages, coalesce(p1, [])) AS page_hit1, list_has_any(pages, coalesce(p3, [])) AS page_hit3, list_has_any(sections, coalesce(s1, [])) AS section_hit1, list_has_any(sections, coalesce(s3, [])) AS section_hit3, list_has_any(sections, coalesce(s5, [])) AS section_hit5
FROM benchmark b LEFT JOIN gd ON gd.query_id = item_id LEFT JOIN ag ON ag.query_id = item_id""".replace("{BUCKET}", BUCKET))
def a12_page_hits(spark, d):
    return evaluate.localized_eval(*page_sides(spark, d))


@query(TITLES)
def j11_title_bonus(spark, d):
    titled = docs(spark, d).select("doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))
    stats = search.token_stats(batch(spark, d), doc_index(spark, d))
    return search.title_bonus(batch(spark, d), titled, stats)


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(f"WITH q AS (SELECT query_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: length(x) > 2), lambda x: lower(x)))) AS token FROM (SELECT item_id AS query_id, text AS query FROM benchmark)), df AS (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token FROM documents) GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT query_id, q.token, coalesce(df, 0) AS df, round(ln((n + 1) / (coalesce(df, 0) + 1)) + 1, 6) AS weight, coalesce(df, 0) <= greatest(3, floor(n * 0.06)) AS rare FROM q LEFT JOIN df USING (token), n WHERE q.token NOT IN ({STOP})")
def a1_token_stats(spark, d):
    return search.token_stats(batch(spark, d), doc_index(spark, d))


GOLD = PHRASE + ", gold AS (SELECT item_id AS query_id, doc_id AS row_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), firsts AS (SELECT r.query_id, min(CASE WHEN g.row_id IS NOT NULL THEN rank END) AS first, count(*) AS n FROM (SELECT * FROM ranked WHERE rank <= 10) r LEFT JOIN gold g ON r.query_id = g.query_id AND r.row_id = g.row_id GROUP BY 1), e AS (SELECT b.item_id AS query_id, b.item_id NOT IN (SELECT query_id FROM gold) AS is_no_match, first, n FROM benchmark b LEFT JOIN firsts f ON b.item_id = f.query_id), ev AS (SELECT query_id, is_no_match, CASE WHEN is_no_match THEN n IS NULL ELSE coalesce(first <= 1, false) END AS hit1, CASE WHEN is_no_match THEN n IS NULL ELSE coalesce(first <= 3, false) END AS hit3, CASE WHEN is_no_match THEN n IS NULL ELSE coalesce(first <= 5, false) END AS hit5, round(CASE WHEN is_no_match THEN (n IS NULL)::INT ELSE coalesce(1 / first, 0) END, 6)::DOUBLE AS rr FROM e)"


@query(f"WITH {GOLD} SELECT * FROM ev")
def a12_retrieval_eval(spark, d):
    return evaluate.retrieval_eval(ranked(spark, d), gold(spark, d), batch(spark, d))


@query(f"WITH {GOLD} SELECT count(*) AS n_queries, round(avg(hit1::INT), 6) AS hit1, round(avg(hit3::INT), 6) AS hit3, round(avg(hit5::INT), 6) AS hit5, round(avg(rr), 6) AS mrr, round(avg(hit1::INT) FILTER (WHERE is_no_match), 6) AS no_match_accuracy, round(quantile_cont(rr, 0.5), 6) AS rr_p50 FROM ev")
def a13_retrieval_summary(spark, d):
    return evaluate.retrieval_summary(a12_retrieval_eval(spark, d))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))")
def a16_label_summary(spark, d):
    return evaluate.label_summary(docs(spark, d))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as references, by role; predictions lose every seventh word, have another for every fifth, echo the prompt or loop; every ninth run failed."""
    t = corpus.read_table(spark, d, "conversations").select(F.col("role").alias("dataset"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("reference"), (F.col("conv_id") * 31 + F.col("turn")).alias("k"))
    words = F.split(F.trim("reference"), r"\s+")
    heard = F.array_join(F.filter(F.transform(words, lambda w, i: F.when((i + F.col("k")) % 7 == 6, F.lit(None)).when((i + F.col("k")) % 5 == 4, F.lit("uh")).otherwise(w)), lambda w: w.isNotNull()), " ")
    said = F.when(F.col("k") % 6 == 0, F.concat(F.lit("Transcribe this audio: "), F.lit("\n"), heard)).when(F.col("k") % 10 == 1, F.concat(heard, F.lit(" " + "0" * 30))).when(F.col("k") % 13 == 2, "").otherwise(heard)
    return t.select("dataset", "id", "reference", said.alias("prediction"), F.when(F.col("k") % 9 == 4, "error").otherwise("ok").alias("status"))


@query()
def a17_asr_summary(spark, d):
    return evaluate.asr_summary(evaluate.scored_predictions(transcripts(spark, d)))


@query()
def a17_worst_predictions(spark, d):
    return evaluate.worst_predictions(evaluate.scored_predictions(transcripts(spark, d)), 10)


@query(f"WITH {BLOCKS}, s AS (SELECT doc_id, block_index // 5 + 1 AS page_no, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM b) SELECT doc_id, line, count(DISTINCT page_no) AS n_pages FROM s WHERE length(line) >= 6 GROUP BY ALL HAVING count(DISTINCT page_no) > 1")
def a18_line_repeats(spark, d):
    return structure.line_repeats(corpus.blocks_of(docs(spark, d)), "doc_id", "page_no")


@query(f"SELECT source, token, count(*) AS n FROM (SELECT source, unnest({TOKENS}) AS token FROM documents) WHERE length(token) > 2 AND token NOT IN ({STOP}) GROUP BY ALL")
def a30_term_frequency(spark, d):
    words = docs(spark, d).select("source", F.explode(X.index_tokens(F.col("text"))).alias("token")).filter((F.length("token") > 2) & ~F.col("token").isin(X.STOPWORDS))
    return words.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))


@query()
def w1_chunk_blocks(spark, d):
    return structure.chunk_blocks(corpus.blocks_of(docs(spark, d)))


@query()
def w2_split_text(spark, d):
    return structure.split_text(docs(spark, d).select("doc_id", "text"), 900, 100, 100).select("doc_id", "piece_no", "piece")


@query(f"WITH RECURSIVE {BLOCKS}, r(doc_id, block_index, chunk_no, n) AS (SELECT doc_id, block_index, 0, length(text) FROM b WHERE block_index = 0 UNION ALL SELECT b.doc_id, b.block_index, CASE WHEN n > 0 AND n + length(text) <= 1200 THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN n > 0 AND n + length(text) <= 1200 THEN n + 1 + length(text) ELSE length(text) END FROM r JOIN b ON b.doc_id = r.doc_id AND b.block_index = r.block_index + 1) SELECT doc_id, block_index::INT AS block_index, chunk_no FROM r")
def w3_pack_simple(spark, d):
    return structure.pack_simple(corpus.blocks_of(docs(spark, d)))


RUNS = "m AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM m), r AS (SELECT user_id, run_no::BIGINT AS run_no, min(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM s GROUP BY user_id, run_no)"


@query(f"WITH {RUNS} SELECT * FROM r")
def w4_runs(spark, d):
    return structure.runs(corpus.read_table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query(f"WITH {RUNS} SELECT *, CASE WHEN n = 1 AND lag(n) OVER w IS NOT NULL AND lead(n) OVER w IS NOT NULL THEN CASE WHEN lag(event_type) OVER w = lead(event_type) OVER w THEN lag(event_type) OVER w WHEN lead(n) OVER w > lag(n) OVER w THEN lead(event_type) OVER w ELSE lag(event_type) OVER w END ELSE event_type END AS label FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run_no)")
def w5_smooth_runs(spark, d):
    return structure.smooth_runs(w4_runs(spark, d), ["user_id"], "event_type")


@query(f"WITH {BLOCKS} SELECT doc_id, block_index::INT AS block_index, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY block_index) AS before FROM b) WHERE before IS NULL OR before <> text")
def w9_drop_repeated_lines(spark, d):
    return structure.drop_repeated_lines(corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", "text"), "doc_id", "block_index")


@query("SELECT (time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(5) t(k) GROUP BY ALL")
def st3_rolling_metrics(spark, d):
    return streams.rolling_metrics(corpus.read_table(spark, d, "events"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def st5_status(spark, d):
    return streams.stream_status(corpus.read_table(spark, d, "events"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source, coalesce(d.n_chars, l.quality) AS n_chars FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def s10_upsert_keeping(spark, d):
    new = corpus.read_table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("source"), F.col("quality").cast("long").alias("n_chars"))
    return corpus.upsert_keeping(docs(spark, d).select("doc_id", "source", "n_chars"), new, "doc_id", "n_chars")


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'conversations', count(*) FROM conversations")
def s12_table_counts(spark, d):
    return corpus.counts_of({n: corpus.read_table(spark, d, n) for n in ("documents", "pages", "embeddings", "conversations")})


@query(f"WITH t AS (SELECT doc_id, len({TOKENS}) > 0 AS ok FROM documents) SELECT count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_indexed, count(*) FILTER (WHERE NOT ok) AS n_missing FROM t")
def s25_index_check(spark, d):
    return corpus.index_check(docs(spark, d), s20_postings(spark, d), "doc_id")


@query("SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, round(100.0 * count(l.doc_id) / count(*), 4) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def a10_label_coverage(spark, d):
    joined = docs(spark, d).select("doc_id", "source").join(corpus.read_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled")).withColumn("coverage", F.round(100.0 * F.col("n_labelled") / F.col("n_docs"), 4))


@query("SELECT doc_id, lang, source, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INT AS place FROM documents QUALIFY place <= 5")
def t2_longest_per_source(spark, d):
    ranked_docs = docs(spark, d).withColumnRenamed("source", "query_id")
    return search.top_per_query(ranked_docs, 5, F.desc("n_chars"), "doc_id").select("doc_id", "lang", F.col("query_id").alias("source"), F.col("rank").alias("place"))


@query("SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM conversations WHERE trim(text) <> '' GROUP BY ALL")
def a34_joined_turns(spark, d):
    rows = corpus.read_table(spark, d, "conversations").filter("trim(text) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "role").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_turns"))


@query("SELECT 'document' AS result_type, doc_id AS id, length(text) AS n_chars FROM documents UNION ALL SELECT 'passage', item_id, length(text) FROM benchmark UNION ALL SELECT 'turn', conv_id, length(text) FROM conversations")
def u1_union_of_kinds(spark, d):
    kind = lambda name, table, key: corpus.read_table(spark, d, table).select(F.lit(name).alias("result_type"), F.col(key).alias("id"), F.length("text").cast("long").alias("n_chars"))
    return kind("document", "documents", "doc_id").unionByName(kind("passage", "benchmark", "item_id")).unionByName(kind("turn", "conversations", "conv_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u2_except_known(spark, d):
    return docs(spark, d).select("doc_id").join(corpus.read_table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti")
