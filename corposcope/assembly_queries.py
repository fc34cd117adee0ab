"""Queries of block candidates, page assembly, page classes, table regions, questions and reference lines.

As in ``library_queries``, boxes, types and marks follow from the lines of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.library_queries import BOXES, boxes
from corposcope.operators import assembly, library
from corposcope.queries import BLOCKS, PAGES, docs, query
from corposcope.sources import corpus

CANDIDATES = BLOCKS + (
    ", c AS (SELECT doc_id, block_index::INT AS block_index, text, block_index % 4 AS k, length(text) % 3 > 0 AS valid, trim(CASE WHEN block_index % 4 = 1 AND length(text) % 2 = 0 THEN '<table><tr><td>' || text || '</td></tr></table>'"
    " WHEN block_index % 4 = 2 AND length(text) % 2 = 0 THEN '$' || text || '$' WHEN block_index % 4 = 3 AND length(text) % 2 = 0 THEN '# ' || text ELSE text END) AS t FROM b)"
)


def candidates(spark, d):
    """Every line as a candidate, a table, equation, heading or text by its place; every other one as a reader would mark it."""
    k, even = F.col("block_index") % 4, F.length("text") % 2 == 0
    marked = lambda place, before, after: F.when((k == place) & even, F.concat(F.lit(before), F.col("text"), F.lit(after)))
    content = F.coalesce(marked(1, "<table><tr><td>", "</td></tr></table>"), marked(2, "$", "$"), marked(3, "# ", ""), "text")
    kind = F.when(k == 1, "table").when(k == 2, "equation").when(k == 3, "heading").otherwise("text")
    return corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", kind.alias("block_type"), content.alias("content"), F.col("text").alias("source_text"), (F.length("text") % 3 > 0).alias("syntax_valid"))


@query(
    f"WITH {CANDIDATES}, s AS (SELECT *, length(regexp_replace(t, '[^{{]', '', 'g')) = length(regexp_replace(t, '[^}}]', '', 'g')) AS balanced, length(trim(text)) AS n, valid::INT AS v FROM c), r AS (SELECT *, CASE k WHEN 1 THEN contains(lower(t), '<table') AND contains(lower(t), '</table>') WHEN 2 THEN t <> '' AND regexp_matches(t, '[\\\\$^_]') AND balanced ELSE t <> '' END AS renderable FROM s),"
    " p AS (SELECT *, renderable::INT AS can, greatest(n, 1) AS g, length(t) AS m FROM r), f AS (SELECT *, CASE WHEN k IN (1, 2) THEN 0.85e0 * can ELSE least(g, m)::DOUBLE / greatest(g, m) END AS render FROM p)"
    " SELECT doc_id, block_index, renderable, round(CASE k WHEN 1 THEN 0.15e0 * can + 0.2e0 * render + 0.35e0 * least(1, 0.25e0 + 0.15e0 * len(regexp_extract_all(lower(t), '<tr')) + 0.05e0 * len(regexp_extract_all(lower(t), '<t[dh]'))) + 0.2e0 * v + 0.1e0 * 0.8e0 * can"
    " WHEN 2 THEN 0.25e0 * can + 0.3e0 * render + 0.2e0 * CASE WHEN balanced AND t <> '' THEN 0.9e0 WHEN t <> '' THEN 0.3e0 ELSE 0 END + 0.2e0 * v + 0.05e0 * 0.7e0 * can"
    " WHEN 3 THEN 0.1e0 * can + 0.2e0 * render + 0.2e0 * CASE WHEN starts_with(t, '#') THEN 0.8e0 ELSE 0.6e0 END * can + 0.2e0 * v + 0.3e0 * 0.9e0 * can ELSE 0.1e0 * can + 0.3e0 * render + 0.2e0 * 0.8e0 * can + 0.2e0 * v + 0.2e0 * 0.9e0 * can END, 6) AS score FROM f"
)
def p49_candidate_scores(spark, d):
    return assembly.candidate_scores(candidates(spark, d)).select("doc_id", "block_index", "renderable", "score")


@query(
    f"WITH {BLOCKS}, c AS (SELECT doc_id, block_index // 5 + 1 AS page_no, block_index AS pos, block_index % 5 AS k, length(text) % 7 > 0 AS emit, CASE block_index % 5 WHEN 0 THEN substr(trim(text), 1, 1) WHEN 1 THEN CASE WHEN starts_with(trim(text), '#') THEN trim(text) ELSE '## ' || trim(text) END ELSE trim(text) END AS content FROM b),"
    " n AS (SELECT *, trim(regexp_replace(lower(replace(content, '#', ' ')), '\\s+', ' ', 'g')) AS plain FROM c), r AS (SELECT DISTINCT h.doc_id, h.pos FROM n h JOIN n o ON h.doc_id = o.doc_id AND h.page_no = o.page_no WHERE h.k = 0 AND o.k <> 0 AND h.plain <> '' AND starts_with(o.plain, h.plain))"
    " SELECT doc_id, page_no::INT AS page_no, count(*) AS n_blocks, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS markdown FROM n ANTI JOIN r ON n.doc_id = r.doc_id AND n.pos = r.pos WHERE emit GROUP BY ALL"
)
def a32_assembled_pages(spark, d):
    k = F.col("block_index") % 5
    kind = F.when(k == 0, "header_footer").when(k == 1, "heading").otherwise("text")
    content = F.when(k == 0, F.substring(F.trim("text"), 1, 1)).otherwise(F.col("text"))
    b = corpus.blocks_of(docs(spark, d)).select("doc_id", "page_no", F.col("block_index").alias("pos"), kind.alias("block_type"), content.alias("content"), (F.length("text") % 7 > 0).alias("emit"), F.when(k > 0, "body").otherwise("top").alias("band"))
    return assembly.assemble_pages(b)


@query(
    f"WITH {PAGES}, s AS (SELECT doc_id, page_no, length(text) AS n, (length(text) % 60) / 100e0 AS share, length(text) % 3 = 0 AS tab, length(text) % 5 = 0 AS two, page_no % 7 = 0 AS bad FROM p),"
    " k AS (SELECT doc_id, CASE WHEN count(*) FILTER (WHERE bad) > 0.5 * count(*) OR count(*) FILTER (WHERE n < 80) > 0.6 * count(*) OR count(*) FILTER (WHERE share > 0.45e0) > 0.5 * count(*) THEN 'ocr' WHEN count(*) = 1 AND avg(n) > 500 AND NOT bool_or(tab) AND avg(share) < 0.1e0 AND NOT bool_or(two) THEN 'simple_text' ELSE 'hybrid_paper' END AS doc_class FROM s GROUP BY 1)"
    " SELECT doc_id, page_no, doc_class, CASE WHEN n < 80 OR bad OR share > 0.55e0 THEN 'ocr' WHEN doc_class = 'simple_text' THEN 'simple_text' WHEN tab OR two THEN 'hybrid_paper' WHEN n > 500 THEN 'simple_text' ELSE doc_class END AS page_class FROM s JOIN k USING (doc_id)"
)
def a23_page_classes(spark, d):
    n = F.length("text")
    p = corpus.pages_of(docs(spark, d)).select(
        "doc_id", "page_no", n.alias("text_len"), ((n % 60) / 100).alias("image_share"), (n % 3 == 0).cast("int").alias("tables"), F.lit(0).alias("images"), F.lit(0).alias("drawings"),
        (n % 5 == 0).alias("two_columns"), (F.col("page_no") % 7 == 0).alias("garbled"),
    )
    return assembly.page_classes(p).select("doc_id", "page_no", "doc_class", "page_class")


@query(
    f"WITH {BOXES}, f AS (SELECT doc_id, page_no, block_index AS pos, y0, y1, length(text) % 6 = 0 AS head, length(text) % 3 > 0 AS fits FROM x), m AS (SELECT c.doc_id, c.page_no, c.pos, c.y0, c.y1, n.pos AS place, n.y1 AS bottom, n.head OR n.fits AS ok FROM f c JOIN f n ON c.doc_id = n.doc_id AND c.page_no = n.page_no AND n.pos > c.pos WHERE c.head),"
    " s AS (SELECT *, coalesce(min(place) FILTER (WHERE NOT ok OR bottom - y0 > 80) OVER (PARTITION BY doc_id, pos), 1000000000) AS stop FROM m) SELECT doc_id, page_no, pos, any_value(y0) AS y0, max(bottom) AS y1, count(*)::INT AS n FROM s WHERE place < stop GROUP BY ALL"
)
def w25_table_regions(spark, d):
    n = F.length("text")
    b = boxes(spark, d).select("doc_id", "page_no", F.col("block_index").alias("pos"), "box", (n % 6 == 0).alias("caption"), (n % 3 > 0).alias("fits"))
    return assembly.table_regions(b, height=80.0)


@query("SELECT conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'short_answer') AS kind, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, nullif(trim(substr(text, 1, 3)), '') AS answer FROM conversations WHERE regexp_matches(text, '\\S')")
def p22_questions(spark, d):
    c = corpus.read_table(spark, d, "conversations")
    asked = c.select("conv_id", "turn", F.col("role").alias("kind"), "text", F.substring("text", 1, 3).alias("answer"), F.lit(None).cast("string").alias("explanation"), F.lit("").alias("reference"))
    return library.normalized_questions(asked).select("conv_id", "turn", "kind", "text", "answer")


@query(
    f"WITH {BLOCKS}, t AS (SELECT doc_id, block_index::INT AS block_index, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM b) SELECT doc_id, block_index, length(t) >= 40 AND (regexp_matches(t, '^\\[[0-9]+\\]') OR (regexp_matches(lower(t), '\\b(in|proceedings|conference|journal|transactions|workshop|arxiv|preprint|findings|pp\\.|pages|doi)\\b')"
    " AND len(regexp_extract_all(t, '\\b[A-Z][a-z]+([-''][A-Z]?[a-z]+)?\\b')) >= 3 AND regexp_matches(t, '\\b(19|20)[0-9]{2}[a-z]?\\b'))) AS looks FROM t"
)
def w12_reference_like_lines(spark, d):
    return corpus.blocks_of(docs(spark, d), blanks=X.SPACES).select("doc_id", "block_index", X.reference_like(F.col("text")).alias("looks"))
