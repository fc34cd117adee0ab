"""Queries of reading order, tables, headings, listings and word search; they join the queries of ``corposcope.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.library_queries import BOXES, HEADS, SECTIONED, boxes, headings, lines, sectioned
from corposcope.operators import layout, search, sections, tables
from corposcope.queries import PAGES, PHRASE, TFIDF, batch, doc_index, docs, page_index, pages, query, ranked
from corposcope.sources import corpus

ROWS = "t AS (SELECT doc_id AS row_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens FROM documents), q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark)"


def texts(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("row_id"), "text")


def two_columns(spark, d):
    """Lines as boxes in two columns; long ones run across the page."""
    x0 = F.when(F.length("text") >= 100, 0.0).otherwise((F.col("block_index") % 2) * 210.0)
    x1 = F.when(F.length("text") >= 100, 400.0).otherwise(x0 + F.least(F.length("text"), F.lit(190)))
    box = F.struct(x0.alias("x0"), F.col("box.y0").alias("y0"), x1.alias("x1"), F.col("box.y1").alias("y1"))
    return boxes(spark, d).withColumn("box", box)


@query()
def s4_clean_transcripts(spark, d):
    return corpus.clean_transcript(lines(spark, d).select("doc_id", "pos", "text"))


@query("SELECT event_id, ts, event_type FROM events")
def t1_list_newest(spark, d):
    return corpus.list_newest(corpus.read_table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id")


@query(f"WITH {PAGES} SELECT doc_id, 2 AS first_page, 3 AS last_page, substr(string_agg(text, chr(10) ORDER BY page_no), 1, 4000) AS text FROM p WHERE page_no BETWEEN 2 AND 3 GROUP BY 1")
def t4_page_excerpts(spark, d):
    return corpus.page_excerpt(pages(spark, d), docs(spark, d).select("doc_id", F.lit(2).alias("first_page"), F.lit(3).alias("last_page")))


@query(f"WITH {PHRASE} SELECT query_id, rank, row_id FROM ranked WHERE rank <= 10 UNION ALL SELECT -1 - item_id, 1::INT, item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)")
def t3_find_rows(spark, d):
    asked = batch(spark, d)
    every = asked.unionByName(asked.select((-1 - F.col("query_id")).alias("query_id"), F.col("query_id").cast("string").alias("query")))
    return search.find_rows(every, ranked(spark, d), texts(spark, d))


@query(f"WITH {PHRASE}, o AS (SELECT query_id, row_id, list_transform(list_filter(list_transform(list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]+'), lambda t: length(t) > 2)), lambda t: [strpos(lower(d.text), t) - 1, strpos(lower(d.text), t) - 1 + length(t)]), lambda p: p[1] >= 0), lambda p: p) AS f FROM ranked JOIN benchmark b ON query_id = b.item_id JOIN documents d ON row_id = d.doc_id WHERE rank <= 10) SELECT query_id, row_id, list_sort(f)[1][1]::INT AS start, list_sort(f)[-1][2]::INT AS stop, len(f)::INT AS n FROM o WHERE len(f) > 0")
def p8_token_windows(spark, d):
    met = ranked(spark, d).join(batch(spark, d), "query_id").join(texts(spark, d), "row_id")
    return met.select("query_id", "row_id", X.best_token_window(X.query_tokens(F.col("query")), F.col("text")).alias("w")).filter("w IS NOT NULL").select("query_id", "row_id", "w.*")


NORM = r"trim(regexp_replace(lower(regexp_replace({0}, '^\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXLC]+)[.)]?\s+', '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {HEADS}, n AS (SELECT doc_id, pos, {NORM.format('title')} AS norm FROM h) SELECT doc_id, pos, norm, CASE WHEN trim(regexp_replace(norm, '^(?:appendix )?[a-z] ', '')) = norm THEN 1 ELSE 2 END AS n_variants FROM n")
def p27_heading_variants(spark, d):
    found = headings(spark, d).select("doc_id", "pos", X.heading_variants(F.col("title")).alias("v"))
    return found.select("doc_id", "pos", F.get("v", F.lit(0)).alias("norm"), F.size("v").alias("n_variants"))


@query(f"WITH {ROWS}, m AS (SELECT query_id, row_id, round(list_sum(list_transform(q, lambda x: ln(1 + len(list_filter(tokens, lambda y: y = x))))), 6) AS score FROM q JOIN t ON list_has_all(tokens, q)) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id))::INT AS rank, row_id, score FROM m QUALIFY rank <= 10")
def j3_full_text_search(spark, d):
    return search.full_text_search(batch(spark, d), doc_index(spark, d), 10)


@query(f"WITH {TFIDF} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id))::INT AS rank, row_id, cosine FROM s QUALIFY rank <= 10")
def a31_tfidf_search(spark, d):
    return search.tfidf_search(batch(spark, d), doc_index(spark, d), 10)


@query(f"WITH {PHRASE} SELECT query_id, rank AS source_no, row_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 1200) AS context FROM ranked JOIN documents ON row_id = doc_id WHERE rank <= 10")
def a28_rag_context(spark, d):
    return search.rag_context(ranked(spark, d), texts(spark, d))


@query()
def w13_reading_order(spark, d):
    return layout.reading_order(two_columns(spark, d), 400.0, margin=0.0).select("doc_id", "page_no", "block_index", "reading_no")


@query()
def w15_box_clusters(spark, d):
    return layout.box_clusters(two_columns(spark, d), 12.0)


@query(f"WITH {BOXES}, m AS (SELECT *, CASE WHEN lag(length(text) % 2) OVER (PARTITION BY doc_id, page_no ORDER BY y0) IS NOT DISTINCT FROM length(text) % 2 THEN 0 ELSE 1 END AS n FROM x), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_no ORDER BY y0) AS run FROM m) SELECT doc_id, page_no, min(block_index) AS piece_id, count(*) AS n_pieces, (2 + length(any_value(text)) % 2)::INT AS n_cols, max(x1) AS x1, min(y0) AS y0 FROM r GROUP BY doc_id, page_no, run")
def w21_merge_fragments(spark, d):
    pieces = boxes(spark, d).select("doc_id", "page_no", F.col("block_index").alias("piece_id"), (2 + F.length("text") % 2).cast("int").alias("n_cols"), "box")
    return layout.merge_fragments(pieces).select("doc_id", "page_no", "piece_id", "n_pieces", "n_cols", "box.x1", "box.y0")


@query(f"WITH {BOXES} SELECT doc_id, page_no, block_index AS table_id FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, trim(lower(substr(text, 1, 3))) ORDER BY length(text) DESC, block_index) = 1 OR trim(lower(substr(text, 1, 3))) = ''")
def a29_dedupe_tables(spark, d):
    found = boxes(spark, d).select("doc_id", "page_no", F.col("block_index").alias("table_id"), F.substring("text", 1, 3).alias("caption"), F.length("text").alias("quality"))
    return tables.dedupe_tables(found).select("doc_id", "page_no", "table_id")


@query()
def w17_table_chunks(spark, d):
    """Each document's lines as rows of words, under a header row."""
    row = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.array(F.substring_index(x, " ", 1), x))
    found = docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.lit(0).alias("table_id"), F.concat(F.array(F.array(F.lit("word"), F.lit("line"))), row).alias("rows"))
    return tables.rows_to_chunks(found)


@query(f"WITH {SECTIONED}, g AS (SELECT DISTINCT doc_id, section, page_no FROM s), a2 AS (SELECT doc_id, page_no, min(pos) AS asset_id, CASE WHEN page_no % 3 = 0 THEN arg_min(section, pos) ELSE 'Other' END AS section FROM s GROUP BY doc_id, page_no), own AS (SELECT DISTINCT g.doc_id, g.section, asset_id FROM g JOIN a2 ON g.doc_id = a2.doc_id AND g.section = a2.section) SELECT * FROM own UNION ALL SELECT DISTINCT g.doc_id, g.section, asset_id FROM g JOIN a2 ON g.doc_id = a2.doc_id AND g.page_no = a2.page_no WHERE lower(trim(a2.section)) IN ('', 'other', 'unknown') AND NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = g.doc_id AND own.section = g.section)")
def j20_section_assets(spark, d):
    every = sectioned(spark, d)
    found = every.groupBy("doc_id", "page_no").agg(F.min("block_index").alias("asset_id"), F.min_by("section", "block_index").alias("first"))
    found = found.select("doc_id", "page_no", "asset_id", F.when(F.col("page_no") % 3 == 0, F.col("first")).otherwise("Other").alias("section"))
    return sections.section_assets(every.select("doc_id", "section", "page_no").distinct(), found)


LOOSE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {SECTIONED}, g AS (SELECT doc_id, section AS title, string_agg(text, chr(10) ORDER BY pos) AS text FROM s GROUP BY ALL), a AS (SELECT doc_id, substr(text, 1, 30) AS anchor, section AS expected FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1), m AS (SELECT a.doc_id, anchor, contains({LOOSE.format('text')}, {LOOSE.format('anchor')}) AS holds, title, expected FROM a JOIN g ON a.doc_id = g.doc_id) SELECT doc_id, anchor, count(*) FILTER (WHERE holds) AS n_found, bool_or(holds AND len(list_intersect([{NORM.format('title')}, trim(regexp_replace({NORM.format('title')}, '^(?:appendix )?[a-z] ', ''))], [{NORM.format('expected')}, trim(regexp_replace({NORM.format('expected')}, '^(?:appendix )?[a-z] ', ''))])) > 0) AS correct FROM m GROUP BY doc_id, anchor, expected")
def j21_anchor_in_section(spark, d):
    every = sectioned(spark, d)
    parts = every.groupBy("doc_id", F.col("section").alias("title")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda p: p["text"]), "\n").alias("text"))
    last = every.groupBy("doc_id").agg(F.max_by(F.struct("text", "section"), "block_index").alias("l"))
    return sections.anchor_in_section(last.select("doc_id", F.substring("l.text", 1, 30).alias("anchor"), F.col("l.section").alias("expected")), parts)


HEADED = "w AS (SELECT doc_id, pos, text, length(text) % 3 > 0 AS hd FROM l), f AS (SELECT *, hd AND coalesce(lead(hd) OVER v, true) AS empty, NOT (hd AND coalesce(lag(hd) OVER v, false)) AS new FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f WHERE hd), z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS size FROM r)"


@query(f"WITH {HEADS}, {HEADED} SELECT doc_id, count(*) AS n_headings, count(*) - count(DISTINCT {NORM.format('text')}) AS n_duplicates, count(*) FILTER (WHERE empty) AS n_empty, count(*) FILTER (WHERE size > 1 AND new) AS n_runs, max(size) AS longest_run FROM z GROUP BY 1")
def a14_heading_figures(spark, d):
    return sections.heading_figures(lines(spark, d).withColumn("is_heading", F.length("text") % 3 > 0))


@query("SELECT item_id AS query_id, list_has_any(t, ['approach', 'architecture', 'cache', 'curvature', 'defense', 'design', 'framework', 'mechanism', 'method', 'model', 'objective', 'pipeline', 'reuse', 'router', 'training']) AS method, list_has_any(t, ['benchmark', 'dataset', 'evaluation']) AS benchmark FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2) AS t FROM benchmark)")
def p15_query_profiles(spark, d):
    found = batch(spark, d).select("query_id", X.query_profile(F.col("query")).alias("k"))
    return found.select("query_id", F.array_contains("k", "method").alias("method"), F.array_contains("k", "benchmark").alias("benchmark"))


@query()
def p10_query_match_scores(spark, d):
    """Each query against all pages that hold it, with the best sentence."""
    p = pages(spark, d)
    held = search.phrase_rows(batch(spark, d).select("query_id", X.index_tokens(F.col("query")).alias("q")), page_index(spark, d)).select("query_id", "row_id")
    met = held.join(batch(spark, d), "query_id").join(p.select("row_id", "text"), "row_id")
    focused = met.withColumn("tokens", X.query_tokens(F.col("query"))).withColumn("focus", X.sentence_focus(F.col("query"), F.col("tokens"), F.col("text")))
    score = X.query_match_score(F.col("query"), F.col("tokens"), F.col("text"), F.col("focus"))
    return focused.select("query_id", "row_id", F.round(score, 6).alias("score"), "focus.hits", F.round("focus.compactness", 6).alias("compactness"))


@query()
def a6_doc_gate(spark, d):
    p = pages(spark, d)
    found = search.keyword_hits(search.keyword_search(batch(spark, d), page_index(spark, d), 20), batch(spark, d), p)
    stats = search.token_stats(batch(spark, d), page_index(spark, d))
    hits = search.annotate_hits(found, stats).withColumn("canonical", F.lit(None).cast("string")).withColumn("semantic_raw_score", F.lit(None).cast("double"))
    titled = docs(spark, d).select("doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))
    return search.doc_gate(hits, search.title_bonus(batch(spark, d), titled, stats))
