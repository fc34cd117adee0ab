"""Queries of snippets, reranking, record searches, equations, doubtful tables, captions and page profiles.

As in ``library_queries``, boxes, equations, captions and counts follow from the lines of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.library_queries import assets, boxes, sectioned
from corposcope.operators import equations, layout, passages, search, sections, summaries, tables
from corposcope.operators import pages as page_operators
from corposcope.queries import BLOCKS, PAGES, PHRASE, batch, docs, page_index, pages, query, ranked
from corposcope.sources import corpus

FIELDS = PHRASE.replace("lower(text), '[a-z0-9]+') AS tokens FROM documents", "lower(concat_ws(' ', source, text)), '[a-z0-9]+') AS tokens FROM documents")
# The twin's word boundaries see ASCII alone, so other letters are Q there.
_LETTERS = "regexp_replace(text, '[^\\x00-\\x7F\\PL]', 'Q', 'g')"
WORDS = PHRASE.replace("lower(text), '[a-z0-9]+') AS q FROM benchmark", f"regexp_extract({_LETTERS}, '\\b([a-z]{{3}})s\\b', 1), '[a-z0-9]+') AS q FROM benchmark WHERE regexp_matches({_LETTERS}, '\\b[a-z]{{3}}s\\b')")

# Characters of text that one task of the summaries gets.
TASK_CHARS = 4_000_000
SHORT_PLURAL = r"(?<![\p{L}0-9_])([a-z]{3})s(?![\p{L}0-9_])"


@query()
def p19_snippets(spark, d):
    """The ten best documents of each passage, with their snippets."""
    texts = docs(spark, d).select(F.col("doc_id").alias("row_id"), "text")
    met = ranked(spark, d).join(batch(spark, d), "query_id").join(texts, "row_id")
    return passages.snippets(met).select("query_id", "rank", "row_id", "snippet")


@query()
def w20_localized(spark, d):
    """Page hits of each passage, ranked anew within their documents."""
    p = pages(spark, d)
    found = search.keyword_hits(search.keyword_search(batch(spark, d), page_index(spark, d), 20), batch(spark, d), p)
    known = search.annotate_hits(found, search.token_stats(batch(spark, d), page_index(spark, d)))
    focus = X.sentence_focus(F.col("query"), X.query_tokens(F.col("query")), F.col("text"))
    named = known.withColumns({"canonical": F.when(F.col("page_no") == 1, "abstract").otherwise("methodology"), "focus": focus})
    return passages.localized(named).select("query_id", "doc_id", "place", "row_id", "localization_score")


@query(
    f"WITH {FIELDS}, kept AS (SELECT query_id, row_id, bm25 FROM scored WHERE row_id % 3 = 0 OR row_id % 2 = 0)"
    " SELECT query_id, rank, row_id, bm25 FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, row_id))::INT AS rank, row_id, bm25 FROM kept) WHERE rank <= 20"
)
def j2_search_records(spark, d):
    """Notes of source and text, every third one of no document, searched for documents of even ids."""
    notes = docs(spark, d).select(F.col("doc_id").alias("row_id"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id"), "source", "text")
    return passages.search_records(batch(spark, d), notes, ["source", "text"], 20, docs(spark, d).filter("doc_id % 2 = 0").select("doc_id"))


@query(
    f"WITH {WORDS}, w AS (SELECT query_id, q[1] AS w FROM q WHERE query_id NOT IN (SELECT query_id FROM ranked)), o AS (SELECT DISTINCT query_id, row_id FROM w JOIN t ON list_contains(tokens, w) OR (w NOT LIKE '%s' AND list_contains(tokens, w || 's'))),"
    " n AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY row_id))::INT AS rank, row_id, NULL::DOUBLE AS bm25 FROM o) SELECT * FROM (SELECT * FROM ranked UNION ALL SELECT * FROM n) WHERE rank <= 20"
)
def j1_search_with_boundaries(spark, d):
    """Three letters before an s, of each passage that has such a word; letters beyond ASCII are letters of words too."""
    word = F.regexp_extract("query", SHORT_PLURAL, 1)
    asked = batch(spark, d).select("query_id", word.alias("query")).filter("query <> ''")
    return passages.search_with_boundaries(asked, docs(spark, d).select(F.col("doc_id").alias("row_id"), "text"), 20)


def _low(x: str) -> str:
    """Lower case as Spark has it: of a dotted capital I the dot stays."""
    return f"lower(replace({x}, 'İ', 'i' || chr(775)))"


# The lines of p42 as rows of cells. Blanks as Spark has them: only U+0020 is trimmed, and a vertical tab is one. Of lines that share their number the lesser row comes first.
TABLE_LINES = (
    "b AS (SELECT doc_id, block_index, list_transform(string_split(text, ', '), lambda c: trim(regexp_replace(c, '[\\s\\x0B]+', ' ', 'g'), ' ')) AS row FROM (SELECT doc_id, unnest(range(len(lines))) AS block_index, unnest(lines) AS text"
    " FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents)))"
)


@query(
    f"WITH {TABLE_LINES}, r AS (SELECT doc_id, list(row ORDER BY block_index, row) AS rows FROM b GROUP BY 1),"
    " s AS (SELECT doc_id, rows, list_filter(flatten(rows), lambda c: c <> '') AS cells, list_max(list_transform(rows, lambda r: len(r))) AS k, len(rows) AS h, doc_id % 3 = 0 AS tabled, doc_id % 5 = 0 AS figured, 'of ' || substr(rows[1][1], 1, 30) AS told FROM r),"
    f" m AS (SELECT *, array_to_string(cells, ' ') AS joined, list_filter(string_split(trim(regexp_replace({_low('told')}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4) AS words, list_filter(list_transform(rows, lambda r: trim({_low("array_to_string(r, '|')")}, ' ')), lambda x: x <> '') AS keys FROM s),"
    f" v AS (SELECT *, trim(regexp_replace({_low('joined')}, '[^a-z0-9]+', ' ', 'g')) AS plain, regexp_extract_all(joined, '[A-Za-z0-9_]+') AS toks, greatest(len(cells), 1) AS n FROM m),"
    " c AS (SELECT *, CASE WHEN len(toks) > 0 THEN len(list_filter(toks, lambda x: regexp_matches(x, '[0-9]'))) / len(toks) ELSE 0 END AS num, coalesce(list_sum(list_transform(cells, lambda c: length(c))), 0) / n AS mean, len(list_filter(cells, lambda c: length(c) >= 40)) / n AS long FROM v),"
    " g AS (SELECT *, figured AND doc_id % 7 > 3 AND (k <= 2 OR h <= 2 OR long > 0.25) AS nearer FROM c),"
    f" d AS (SELECT *, CASE WHEN figured AND NOT tabled THEN 2 WHEN len(cells) = 0 THEN 2 ELSE (regexp_matches(regexp_replace(joined, '[^\\x00-\\x7F\\PL]|[^\\x00-\\x7F\\PN]', '_', 'g'), '\\b[A-Za-z0-9+/]{{24,}}={{0,2}}\\b') AND NOT tabled)::INT + contains({_low('joined')}, 'figure ')::INT"
    " + (tabled AND len(list_filter(words, lambda w: contains(plain, w))) >= greatest(2, len(words) // 2))::INT + (k <= 1 AND h >= 3)::INT + (h <= 2 AND k >= 8 AND NOT tabled)::INT + (h <= 1 AND mean > 18 AND NOT tabled)::INT + (mean > 30 AND num < 0.05 AND NOT tabled)::INT"
    " + (long > 0.45 AND num < 0.08 AND NOT tabled)::INT + (len(keys) > 0 AND 1 - len(list_distinct(keys)) / len(keys) > 0.45 AND k >= 6 AND NOT tabled)::INT + nearer::INT END AS doubts FROM g)"
    " SELECT doc_id, k::INT AS n_cols, CASE WHEN (figured AND NOT tabled) OR len(cells) = 0 THEN 1 ELSE doubts END AS n_doubts, doubts >= 2 OR (nearer AND (k <= 2 OR h <= 2)) AS false_positive FROM d"
)
def p42_table_doubts(spark, d):
    """Each document as a table, a line a row, cut at commas; every third one has a table's caption, every fifth a figure's."""
    row = F.struct("block_index", F.split("text", ", ", -1).alias("r"))
    read = corpus.blocks_of(docs(spark, d)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    first = F.trim(F.regexp_replace(F.get(F.get("rows", F.lit(0)), F.lit(0)), r"\s+", " "))
    found = read.select(
        "doc_id", "rows", F.array_max(F.transform("rows", F.size)).alias("n_cols"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Table 1: of "), F.substring(first, 1, 30))).alias("caption"),
        F.when(F.col("doc_id") % 5 == 0, "Figure 2. Shape").alias("figure_caption"), (F.col("doc_id") % 7 * 16.0).alias("caption_gap"), F.lit(0.0).alias("figure_gap"),
    )
    return tables.table_doubts(found).select("doc_id", "n_cols", F.size("doubts").alias("n_doubts"), "false_positive")


def formulas(spark, d):
    """Every third line as a numbered equation, every seventh as one without a number."""
    k = F.col("block_index")
    text = F.when(k % 3 == 0, F.concat(F.substring("text", 1, 9), F.lit(" = a + b ("), k + 1, F.lit(")"))).when(k % 7 == 1, F.concat(F.lit("x = "), F.substring("text", 1, 9))).otherwise(F.col("text"))
    return boxes(spark, d).select("doc_id", "page_no", "block_index", k.alias("pos"), text.alias("text"), "box", F.lit(400.0).alias("page_width"))


@query()
def p37_equation_lines(spark, d):
    return equations.line_signals(formulas(spark, d)).select("doc_id", "page_no", "pos", "score", F.concat_ws(",", "flags").alias("flags"), "number", "accepted", "strong")


@query()
def w22_equation_groups(spark, d):
    return equations.equation_groups(equations.line_signals(formulas(spark, d))).select("doc_id", "page_no", "pos", "last_pos", "n_lines", "text", "number", "score")


@query()
def w18_equation_chunks(spark, d):
    lines = formulas(spark, d)
    return equations.equation_chunks(equations.equation_groups(equations.line_signals(lines)), lines)


@query()
def j27_assigned_captions(spark, d):
    """Two regions a page, and every line of a length that six divides as a caption."""
    first = assets(spark, d).select("doc_id", "page_no", (F.col("asset_id") * 2).cast("int").alias("region_id"), "box", F.lit(1).alias("tiles"))
    moved = F.struct((F.col("box.x0") + 150.0).alias("x0"), (F.col("box.y0") + 60.0).alias("y0"), (F.col("box.x1") + 150.0).alias("x1"), (F.col("box.y1") + 60.0).alias("y1"))
    regions = first.unionByName(first.withColumns({"box": moved, "region_id": F.col("region_id") + 1}))
    captions = boxes(spark, d).filter(F.length("text") % 6 == 0).select("doc_id", "page_no", F.col("block_index").alias("caption_id"), "box")
    return layout.assign_captions(regions, captions)


SIGNALS = PAGES + (
    ", s AS (SELECT doc_id, page_no, length(text)::INT AS n, length(text) % 5 = 0 AS abs, length(text) % 11 = 0 AS refs, length(text)::INT % 4 AS cit, (length(text)::INT // 3) % 3 AS cap, CASE WHEN length(text) % 2 = 0 THEN length(text)::INT // 2 % 5 ELSE 0 END AS aca, length(text)::INT // 7 % 2 AS num,"
    " length(text)::INT // 5 % 3 AS sec, length(text)::INT // 11 % 2 AS eq, length(text)::INT // 13 % 2 AS aff, length(text)::INT // 17 % 2 AS top FROM p), q AS (SELECT *, 3 * abs::INT + 3 * refs::INT + 2 * (cit >= 2)::INT + least(aca, 3) + least(num, 2) + 2 * (page_no = 1 AND aff > 0)::INT + (n % 6 = 0)::INT AS scholarly,"
    " 2 * (cap > 0)::INT + (sec >= 1 AND cap > 0)::INT AS visual, 2 * (sec >= 1)::INT + (top >= 1 AND aca + num + eq = 0)::INT + 2 * (n % 8 >= 4 AND cit + cap + aca + num + eq = 0)::INT + (NOT abs AND NOT refs AND aca + num + aff = 0)::INT + (n >= 400 AND eq + num = 0 AND n % 6 > 0)::INT AS report FROM s)"
)


def signals(spark, d):
    """Counts of each page, made of the length of its text."""
    n = F.length("text")
    zero = {c: F.lit(0) for c in ("images", "tables", "drawings", "part_headings", "report_headings", "roman_headings", "repeated_footers")}
    return pages(spark, d).select("doc_id", "page_no", n.alias("text_len"), n.alias("n_")).withColumns(zero | {
        "two_columns": F.col("n_") % 6 == 0, "has_abstract": F.col("n_") % 5 == 0, "has_references": F.col("n_") % 11 == 0, "citations": F.col("n_") % 4, "paragraphs": F.col("n_") % 8,
    } | {name: F.floor(F.col("n_") / by).cast("int") % mod for name, by, mod in (("captions", 3, 3), ("numbered_headings", 7, 2), ("section_headings", 5, 3), ("equations", 11, 2), ("affiliations", 13, 2), ("repeated_headers", 17, 2))}
    | {"academic_headings": F.when(F.col("n_") % 2 == 0, F.floor(F.col("n_") / 2).cast("int") % 5).otherwise(0)})


@query(f"WITH {SIGNALS} SELECT doc_id, page_no, scholarly, visual, report, CASE WHEN scholarly + visual >= report THEN 'paper' ELSE 'plain' END AS handler FROM q")
def a20_page_profiles(spark, d):
    return page_operators.page_profiles(signals(spark, d)).select("doc_id", "page_no", "scholarly", "visual", "report", "handler")


@query(
    f"WITH {SIGNALS}, t AS (SELECT doc_id, count(*) AS n_pages, sum(scholarly) AS s, sum(visual) AS v, sum(report) AS r, sum(cit) AS cit, sum(cap) AS cap, sum(aca) AS aca, sum(num) AS num, sum(sec) AS sec, sum(eq) AS eq, bool_or(abs) AS abs, bool_or(refs) AS refs, count(*) FILTER (WHERE aff > 0) AS aff, count(*) FILTER (WHERE top > 0) AS tops,"
    " count(*) FILTER (WHERE n % 8 >= 4 AND cit + cap = 0) AS prose FROM q GROUP BY 1), u AS (SELECT doc_id, n_pages, s + 3 * abs::INT + 3 * refs::INT + 2 * (cit >= 4)::INT + 2 * (aca >= 3)::INT + CASE WHEN num >= 3 THEN 4 WHEN num >= 1 THEN 2 ELSE 0 END + 2 * (aff >= 1)::INT + 2 * (aff >= 1 AND aca + num >= 1)::INT + 2 * (eq >= 8)::INT AS scholarly,"
    " v + 2 * (cap >= 2)::INT + 2 * (cap >= 4)::INT + 2 * (sec >= 2 AND cap >= 2)::INT AS visual, r + 3 * (sec >= 3)::INT + 2 * (tops >= 2 AND aca + num + eq = 0)::INT + 2 * (NOT abs AND NOT refs AND cit + aff + num + aca = 0)::INT + 2 * (prose >= greatest(1, n_pages // 2) AND cap + eq + num + aca = 0)::INT + (cap + eq + num + aca + aff = 0)::INT AS report FROM t)"
    " SELECT doc_id, n_pages, scholarly::BIGINT AS scholarly, visual::BIGINT AS visual, report::BIGINT AS report, CASE WHEN scholarly + visual >= report + 3 THEN 'paper' WHEN report >= scholarly + visual + 3 THEN 'plain' ELSE 'mixed' END AS handler FROM u"
)
def a20_doc_profiles(spark, d):
    return page_operators.doc_profiles(page_operators.page_profiles(signals(spark, d)))


@query()
def w19_section_summaries(spark, d):
    """Sections of the documents, their kind by the length of their title."""
    kinds = F.array(*map(F.lit, summaries.CUES))
    # the work on a text is many times its reading, so tasks follow the text; one deal by section serves all steps
    tasks = max(32, (docs(spark, d).agg(F.sum(F.length("text"))).first()[0] or 0) // TASK_CHARS)
    texts = sections.section_text(sectioned(spark, d).filter("section IS NOT NULL").repartition(tasks, "doc_id", "section"))
    named = texts.withColumn("canonical", F.get(kinds, F.length("section") % len(summaries.CUES)))
    return summaries.with_beginnings(named, summaries.summarize(summaries.sentence_scores(named)))


@query()
def j23_best_blocks(spark, d):
    """The line of each page hit that answers best."""
    p = pages(spark, d)
    hits = search.keyword_search(batch(spark, d), page_index(spark, d), 20).join(batch(spark, d), "query_id")
    lines = corpus.blocks_of(docs(spark, d)).withColumn("row_id", F.col("doc_id") * 1_000_000 + F.col("page_no"))
    return summaries.best_blocks(hits, lines).drop("text")
