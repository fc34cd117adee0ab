"""Queries of single text rules over all documents, lines and passages; they join the queries of ``corposcope.queries``.

Where the tables have nothing for a rule to do, the input is derived from them: hyphens at the ends of lines, NULs, captions, JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.heading_queries import _CANONICAL
from corposcope.queries import BLOCKS, BUCKET, PAGES, STOP, batch, docs, pages, query
from corposcope.sources import corpus

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '^(?:\\d+(?:\\.\\d+)*|[ivxlc]+)[.)]?\\s+', ''), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_QUERY_TOKENS = "list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: length(x) > 2), lambda x: lower(x)))"


@query(f"SELECT query_id, string_agg(token, ' ' ORDER BY token) AS tokens FROM (SELECT item_id AS query_id, unnest(list_filter({_QUERY_TOKENS.format('text')}, lambda x: x NOT IN ({STOP}))) AS token FROM benchmark) GROUP BY 1")
def p2_content_tokens(spark, d):
    return batch(spark, d).select("query_id", F.array_join(F.array_sort(X.content_tokens(F.col("query"))), " ").alias("tokens")).filter("tokens <> ''")


@query(f"WITH {BLOCKS}, n AS (SELECT doc_id, block_index, {_NORM} AS norm FROM b) SELECT doc_id, block_index::INT AS block_index, CASE WHEN norm = '' THEN 'other' ELSE coalesce({_CANONICAL}, array_to_string(string_split(norm, ' ')[1:10], '_')) END AS canonical FROM n")
def p13_canonical_lines(spark, d):
    return corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", X.canonical_heading(F.col("text")).alias("canonical"))


@query(f"WITH {PAGES}, k AS (SELECT doc_id, page_no, {BUCKET} AS bucket FROM p) SELECT doc_id, page_no, bucket, CASE bucket WHEN 'references' THEN 0.18e0 WHEN 'front_matter' THEN 0.6e0 ELSE 1e0 END AS multiplier FROM k")
def p11_page_buckets(spark, d):
    bucket = X.section_bucket(F.col("text"), F.col("page_no"), F.lit(None).cast("string"))
    return pages(spark, d).select("doc_id", "page_no", bucket.alias("bucket")).withColumn("multiplier", X.bucket_multiplier(F.col("bucket")).cast("double"))


_DASHED = "regexp_replace(lower({0}), '[‐-―−]', '-', 'g')"
_LOOSE = "trim(regexp_replace(" + _DASHED + ", '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT doc_id, string_split(text, chr(10))[1] AS query, string_split(text, chr(10))[-1] AS text FROM documents), m AS (SELECT *, {_QUERY_TOKENS.format('query')} AS t FROM s)
SELECT doc_id, len(list_filter(t, lambda x: contains(lower(text), x)))::INT AS lex_hits, {_LOOSE.format('query')} <> '' AND contains({_LOOSE.format('text')}, {_LOOSE.format('query')}) AS exact, length(trim(query)) >= 3 AND contains(lower(text), lower(trim(query))) AS page_exact, CASE WHEN len(t) <= 2 THEN 1 ELSE 2 END AS least_hits FROM m""")
def p3_match_features(spark, d):
    """The first line of each document as a query to its last line."""
    lines = F.split("text", "\n", -1)
    m = docs(spark, d).select("doc_id", F.get(lines, F.lit(0)).alias("query"), F.element_at(lines, -1).alias("text")).withColumn("t", X.query_tokens(F.col("query")))
    return m.select(
        "doc_id", X.lex_hits(F.col("t"), F.col("text")).alias("lex_hits"), X.exact_phrase(F.col("query"), F.col("text")).alias("exact"),
        X.page_exact(F.col("query"), F.col("text")).alias("page_exact"), X.min_hits(F.size("t")).alias("least_hits"),
    )


@query("SELECT doc_id, replace(regexp_replace(replace(text, 'e' || chr(10), 'e-' || chr(10) || 'x'), '(\\p{L})[-‐‑‒–][ \\t]*\\n[ \\t]*(\\p{Ll})', '\\1\\2', 'g'), chr(10), ' ') AS text FROM documents")
def p35_dehyphenated(spark, d):
    """Texts in which every line that ends in e is broken after a hyphen."""
    broken = F.replace("text", F.lit("e\n"), F.lit("e-\nx"))
    return docs(spark, d).select("doc_id", X.dehyphenated(broken).alias("text"))


@query("WITH m AS (SELECT doc_id, list_transform(range(1, 8), lambda i: 'Fig' || CASE WHEN (doc_id * i) % 3 = 0 THEN 'ure ' WHEN (doc_id * i) % 3 = 1 THEN '. ' ELSE 's ' END || ((doc_id * i) % 11)) AS c FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(c, lambda x: regexp_extract(x, '[0-9]+')::INT))), ',') AS figures FROM m")
def p38_figure_mentions(spark, d):
    """Texts with seven mentions of figures put behind them."""
    i = F.sequence(F.lit(1), F.lit(7))
    said = F.transform(i, lambda x: F.concat(F.lit(" Fig"), F.when(F.col("doc_id") * x % 3 == 0, "ure ").when(F.col("doc_id") * x % 3 == 1, ". ").otherwise("s "), (F.col("doc_id") * x % 11).cast("string")))
    return docs(spark, d).select("doc_id", F.array_join(X.figure_mentions(F.concat("text", F.array_join(said, ","))), ",").alias("figures"))


@query("SELECT doc_id, replace(text, ' ', '') AS text FROM documents")
def s5_sanitized(spark, d):
    """Texts whose blanks became NULs."""
    return docs(spark, d).select("doc_id", X.sanitized(F.translate("text", " ", "\0")).alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 0 THEN to_timestamp(epoch(date_trunc('second', ts)))::TIMESTAMP ELSE date_trunc('second', ts) END AS at FROM events")
def s24_timestamps(spark, d):
    """Times of events written as seconds, with a T, with a blank, and as a word."""
    t = F.date_trunc("second", "ts")
    epoch = F.unix_timestamp(t.cast("timestamp")).cast("string")
    written = F.when(F.col("event_id") % 4 == 0, epoch).when(F.col("event_id") % 4 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return corpus.read_table(spark, d, "events").select("event_id", X.timestamp_of(written).cast("timestamp_ntz").alias("at"))


@query("SELECT doc_id, array_to_string(list_filter([trim(lang), trim(source), CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END], lambda x: x <> ''), ',') AS tags FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id % 4 = 1")
def p21_tags(spark, d):
    """Language, source and a tag or blank as a JSON array; of every fourth document no JSON."""
    tags = F.to_json(F.array(F.concat(F.lit(" "), "lang"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("x ")))
    return docs(spark, d).select("doc_id", F.array_join(X.json_strings(F.when(F.col("doc_id") % 4 == 1, "[oops").otherwise(tags)), ",").alias("tags"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars::DOUBLE WHEN 1 THEN doc_id + 0.5 END AS score FROM documents")
def p20_first_score(spark, d):
    """The first of three fields that is a number."""
    third = F.when(F.col("doc_id") % 3 == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".5"))).otherwise("none")
    return docs(spark, d).select("doc_id", X.first_score(F.lit("n/a"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")), third).alias("score"))
