"""Queries of page furniture, fonts, heading scores, counts and approximate vector search; they join the queries of ``corposcope.queries``.

As in ``library_queries``, boxes, fonts and headings are derived from the lines of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.library_queries import BOXES, HEADS, boxes, headings, lines
from corposcope.operators import evaluate, layout, library, pages, search, structure, vectors
from corposcope.queries import BLOCKS, docs, query
from corposcope.sources import corpus

FONT = "(8 + length(text) % 7 + (block_index % 3) * 0.5e0)"


def fonts(spark, d):
    b = boxes(spark, d)
    return b.withColumn("font", 8 + F.length("text") % 7 + (F.col("block_index") % 3) * F.lit(0.5))


@query(f"WITH {BOXES}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM x), r AS (SELECT doc_id, key, count(DISTINCT page_no) AS n FROM k GROUP BY ALL), p AS (SELECT doc_id, page_no, min(y0) AS a0, max(y1) AS a1 FROM x GROUP BY ALL) SELECT k.doc_id, k.block_index, regexp_matches(trim(text), '(?i)^(page\\s+)?[0-9]{{1,4}}(\\s*(of|/)\\s*[0-9]{{1,4}})?$') OR regexp_matches(trim(text), '(?i)^arxiv:[0-9]{{4}}\\.[0-9]{{4,5}}') OR n >= 4 OR (n >= 2 AND (y1 <= a0 + 0.08e0 * (a1 - a0) OR y0 >= a0 + 0.93e0 * (a1 - a0))) AS furniture FROM k JOIN r ON k.doc_id = r.doc_id AND k.key = r.key JOIN p ON k.doc_id = p.doc_id AND k.page_no = p.page_no")
def a19_page_furniture(spark, d):
    return pages.page_furniture(boxes(spark, d)).select("doc_id", "block_index", "furniture")


@query(f"WITH {BLOCKS}, f AS (SELECT doc_id, {FONT} AS font, length(trim(text)) >= 40 AS body FROM b), g AS (SELECT doc_id, list_sort(list(font) FILTER (WHERE body)) AS a, list_sort(list(font)) AS e FROM f GROUP BY 1) SELECT doc_id, CASE WHEN a IS NOT NULL THEN a[len(a) // 2 + 1] ELSE e[len(e) // 2 + 1] END AS body_font FROM g")
def a22_body_font(spark, d):
    return pages.body_font(fonts(spark, d))


@query(f"WITH {BLOCKS}, f AS (SELECT doc_id, round_even({FONT}, 0)::DOUBLE AS size, count(*) AS n FROM b GROUP BY ALL) SELECT doc_id, size AS base_font FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) = 1")
def a22_base_font(spark, d):
    return pages.base_font(fonts(spark, d))


@query("SELECT c_custkey AS set_id, count(o_orderkey) AS n_questions FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a26_question_set_counts(spark, d):
    sets = corpus.read_table(spark, d, "customer").select(F.col("c_custkey").alias("set_id"))
    return library.question_set_counts(sets, corpus.read_table(spark, d, "orders").select(F.col("o_custkey").alias("set_id")), "set_id")


@query("WITH n AS (SELECT conv_id, turn, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 80), 'Untitled') AS title FROM conversations) SELECT doc_id, count(turn) AS n_notes, arg_max(title, turn) AS newest_title FROM documents LEFT JOIN n ON doc_id = conv_id GROUP BY 1")
def a26_note_counts(spark, d):
    notes = corpus.read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("note_id"), F.lit(" ").alias("title"), F.col("text").alias("body"))
    return library.note_counts(corpus.read_table(spark, d, "documents").select("doc_id"), notes, "doc_id")


def heading_sides(spark, d):
    """Headings at even positions of eight as predicted, all as gold, by their first word in lower case."""
    h = headings(spark, d).select("doc_id", "pos", F.array(F.lower(F.substring_index(F.trim("title"), " ", 1))).alias("variants"))
    return h.filter("pos % 8 = 0"), h


@query(f"WITH {HEADS}, v AS (SELECT doc_id, pos, lower(string_split(trim(title), ' ')[1]) AS v FROM h), g AS (SELECT doc_id, v, count(*) AS n, count(*) FILTER (WHERE pos % 8 = 0) AS p FROM v GROUP BY ALL), m AS (SELECT doc_id, sum(p) AS n_pred, sum(n) AS n_gold, sum(least(n, p)) AS hit FROM g GROUP BY 1) SELECT doc_id, n_pred::BIGINT AS n_pred, n_gold::BIGINT AS n_gold, hit::BIGINT AS n_matched FROM m")
def j22_heading_match(spark, d):
    return evaluate.heading_match(*heading_sides(spark, d)).select("doc_id", "n_pred", "n_gold", "n_matched")


@query(f"WITH {HEADS}, v AS (SELECT doc_id, pos, lower(string_split(trim(title), ' ')[1]) AS v FROM h), g AS (SELECT doc_id, v, count(*) AS n, count(*) FILTER (WHERE pos % 8 = 0) AS p FROM v GROUP BY ALL), m AS (SELECT doc_id, sum(p) AS p, sum(n) AS g, sum(least(n, p)) AS hit FROM g GROUP BY 1) SELECT doc_id, round(hit / nullif(p, 0), 6) AS precision, round(hit / nullif(g, 0), 6) AS recall, round(2 * hit / nullif(p + g, 0), 6) AS f1 FROM m")
def a15_md_eval(spark, d):
    return evaluate.md_eval(evaluate.heading_match(*heading_sides(spark, d))).select("doc_id", "precision", "recall", "f1")


def vector_sides(spark, d):
    e = corpus.read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), e.select(F.col("vec_id").alias("row_id"), "v")


@query()
def j5_vector_topk_lsh(spark, d):
    return vectors.vector_topk_lsh(*vector_sides(spark, d), 10)


@query()
def j5_lsh_recall(spark, d):
    """Every fiftieth vector as a query, exact and approximate."""
    queries, rows = vector_sides(spark, d)
    return vectors.topk_recall(vectors.vector_topk(queries, rows, 10), vectors.vector_topk_lsh(queries, rows, 10))


@query(f"WITH {BLOCKS} SELECT doc_id, block_index::INT AS block_index, regexp_matches(trim(text), '(?i)^(page\\s+)?\\d{{1,4}}$|^[ivxlc]+$|doi\\.org|^doi:|^arxiv:|^https?://|copyright|all rights reserved') OR NOT regexp_matches(trim(text), '[A-Za-z0-9]') AS boilerplate FROM b")
def p33_boilerplate_lines(spark, d):
    return corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", X.boilerplate(F.col("text")).alias("boilerplate"))


@query(f"WITH {BLOCKS}, m AS (SELECT doc_id, block_index::INT AS block_index, trim(text) AS t FROM b) SELECT doc_id, block_index, CASE WHEN regexp_matches(t, '^#{{1,6}}\\s+\\S') THEN 'heading' WHEN regexp_matches(t, '(?i)^\\**(figure|fig\\.?)\\s+([0-9]+|[ivxlc]+)\\b') THEN 'figure_caption' WHEN regexp_matches(t, '(?i)^\\**table\\s+([0-9]+|[ivxlc]+)\\b') THEN 'table_caption' WHEN regexp_matches(t, '^!\\[[^\\]]*\\]\\([^)]*\\)') THEN 'image' WHEN regexp_matches(t, '^<!--.*-->$') THEN 'comment' WHEN len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) >= 3 OR length(t) >= 30 THEN 'prose' WHEN t = '' THEN 'blank' ELSE 'short' END AS kind FROM m")
def p25_line_kinds(spark, d):
    return corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", X.md_line_kind(F.col("text")).alias("kind"))


ROLE_SQL = "CASE WHEN c IN (" + ", ".join(f"'{x}'" for x in sorted(X.LOW_SALIENCE)) + ") THEN 'low_salience' WHEN c = 'abstract' THEN 'abstract' WHEN c = 'front_matter' THEN 'front_matter' WHEN contains(c, 'introduction') THEN 'intro' WHEN contains(c, 'conclusion') THEN 'conclusion' WHEN regexp_matches(c, 'result|experiment|evaluation|discussion') THEN 'evaluation' WHEN regexp_matches(c, 'method|approach|implementation|construction') THEN 'method' ELSE 'body' END"


@query(f"SELECT item_id, word, {ROLE_SQL} AS role FROM (SELECT item_id, word, lower(trim(word)) AS c FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark)) WHERE word <> ''")
def p14_section_roles(spark, d):
    words = corpus.read_table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return words.select("item_id", "word", X.section_role(F.col("word")).alias("role"))


@query("SELECT doc_id, contains(t, ' ' || lower(lang) || ' ') OR contains(t, ' ' || lower(lang) || 's ') AS met FROM (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)")
def p18_boundary_terms(spark, d):
    return docs(spark, d).select("doc_id", X.boundary_match(F.col("lang"), F.col("text")).alias("met"))


def hinted(spark, d):
    return lines(spark, d).select("doc_id", F.col("pos").cast("int").alias("pos"), F.when(F.col("pos") % 3 == 1, (F.length("text") % 9 + 1).cast("int")).alias("hint"), F.lit(8).alias("n_pages"))


@query(f"WITH {BLOCKS}, h AS (SELECT doc_id, block_index::INT AS pos, CASE WHEN block_index % 3 = 1 THEN length(text) % 9 + 1 END AS hint FROM b), c AS (SELECT *, last_value(hint IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS last, first_value(hint IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM h), g AS (SELECT doc_id, pos, CASE WHEN hint IS NOT NULL THEN hint WHEN last IS NULL AND after IS NULL THEN 1 WHEN last IS NULL THEN greatest(1, after - 1) WHEN after IS NULL THEN last ELSE least(last + 1, after) END AS guess FROM c) SELECT doc_id, pos, least(max(guess) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 8)::INT AS page FROM g")
def w6_fill_page_hints(spark, d):
    return structure.fill_hints(hinted(spark, d), ["doc_id"], "pos", "hint", "n_pages").select("doc_id", "pos", "page")


@query(f"WITH {BLOCKS} SELECT doc_id, block_index::INT AS block_index, coalesce(last_value(CASE WHEN block_index % 4 = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING), 'front_matter') AS section FROM b")
def w7_heading_spans(spark, d):
    b = corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", "text")
    return structure.heading_spans(b.filter("block_index % 4 = 2").select("doc_id", "block_index", F.col("text").alias("title")), b)


@query(f"WITH {BOXES}, w AS (SELECT *, length(text) AS score, y0 * 0.25e0 AS t0, y0 * 0.25e0 + 16 AS t1 FROM x), o AS (SELECT m.doc_id, m.block_index FROM w m JOIN w n ON m.doc_id = n.doc_id AND m.page_no = n.page_no AND (n.score > m.score OR (n.score = m.score AND n.block_index < m.block_index)) AND greatest(0, least(m.x1, n.x1) - greatest(m.x0, n.x0)) * greatest(0, least(m.t1, n.t1) - greatest(m.t0, n.t0)) >= 0.5e0 * ((m.x1 - m.x0) * (m.t1 - m.t0) + (n.x1 - n.x0) * (n.t1 - n.t0) - greatest(0, least(m.x1, n.x1) - greatest(m.x0, n.x0)) * greatest(0, least(m.t1, n.t1) - greatest(m.t0, n.t0)))) SELECT w.doc_id, w.block_index AS box_id FROM w ANTI JOIN o ON w.doc_id = o.doc_id AND w.block_index = o.block_index")
def j28_iou_dedupe(spark, d):
    y = F.col("box.y0") * 0.25
    b = boxes(spark, d).select("doc_id", "page_no", F.col("block_index").alias("box_id"), F.length("text").alias("score"), F.col("box.x0").alias("x0"), y.alias("y0"), F.col("box.x1").alias("x1"), (y + 16).alias("y1"))
    return structure.iou_dedupe(b).select("doc_id", "box_id")


@query(f"WITH {BOXES} SELECT doc_id, page_no, block_index AS asset_id FROM (SELECT *, CASE WHEN length(text) % 4 > 0 THEN length(text) % 4 END AS number FROM x) QUALIFY number IS NULL OR row_number() OVER (PARTITION BY doc_id, page_no, number ORDER BY length(text) DESC, block_index) = 1")
def a33_best_figures(spark, d):
    n = F.length("text") % 4
    figures = boxes(spark, d).select("doc_id", "page_no", F.col("block_index").alias("asset_id"), F.when(n > 0, n).alias("number"), F.length("text").alias("score"))
    return layout.best_per_number(figures).select("doc_id", "page_no", "asset_id")


@query(f"WITH {BLOCKS} SELECT doc_id, text FROM b WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new ' || i FROM labels, (VALUES (1), (2)) v(i)")
def s8_replace_documents(spark, d):
    new = corpus.read_table(spark, d, "labels").select("doc_id", F.explode(F.array(F.lit("new 1"), F.lit("new 2"))).alias("text"))
    return corpus.replace_documents(corpus.blocks_of(docs(spark, d)).select("doc_id", "text"), new)


@query("SELECT * FROM (SELECT doc_id, n_chars, 'en' AS lang FROM documents WHERE lang = 'en' ORDER BY n_chars, doc_id LIMIT 60) UNION ALL SELECT * FROM (SELECT doc_id, n_chars, 'de' FROM documents WHERE lang = 'de' ORDER BY n_chars, doc_id LIMIT 30)")
def s21_sample_per_category(spark, d):
    return corpus.sample_per_category(docs(spark, d), "lang", "doc_id", "n_chars", {"en": 60, "de": 30}).select("doc_id", "n_chars", "lang")
