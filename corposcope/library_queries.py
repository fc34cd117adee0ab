"""Queries of layout, sections, registries and text rules; they join the queries of ``corposcope.queries``.

The tables hold no boxes and no markup. A line's box follows from its place and
length, each page has one asset, and every fourth line of a document counts as
a heading, so that these queries still run over all documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corposcope.functions import sentences as S
from corposcope.functions import text as X
from corposcope.operators import layout, search, sections
from corposcope.queries import BLOCKS, PHRASE, TITLES, batch, doc_index, docs, pages, query, ranked
from corposcope.sources import corpus, registry

BOXES = BLOCKS + ", x AS (SELECT doc_id, block_index::INT AS block_index, (block_index // 5 + 1)::INT AS page_no, text, 0e0 AS x0, (block_index % 5) * 20e0 AS y0, least(length(text), 400)::DOUBLE AS x1, (block_index % 5) * 20e0 + 16e0 AS y1 FROM b), a AS (SELECT doc_id, page_no, page_no AS asset_id, 20e0 AS x0, (doc_id % 5) * 18e0 AS y0, 220e0 AS x1, (doc_id % 5) * 18e0 + 30e0 AS y1 FROM (SELECT DISTINCT doc_id, page_no FROM x))"
SHARED = "(greatest(0e0, least(a.x1, x.x1) - greatest(a.x0, x.x0)) * greatest(0e0, least(a.y1, x.y1) - greatest(a.y0, x.y0)))"
HEADS = BLOCKS + ", l AS (SELECT doc_id, block_index::INT AS pos, block_index % 4 = 0 AS is_heading, CASE WHEN block_index % 4 = 0 THEN (1 + length(text) % 3)::INT END AS level, text FROM b), h AS (SELECT doc_id, pos, level, text AS title FROM l WHERE is_heading)"
SECTIONED = HEADS + ", s AS (SELECT doc_id, pos, (pos // 5 + 1)::INT AS page_no, text, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)"


def boxes(spark, d):
    y = (F.col("block_index") % 5) * 20.0
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.least(F.length("text"), F.lit(400)).cast("double").alias("x1"), (y + 16.0).alias("y1"))
    return corpus.blocks_of(docs(spark, d)).withColumn("box", box)


def assets(spark, d):
    y = (F.col("doc_id") % 5) * 18.0
    box = F.struct(F.lit(20.0).alias("x0"), y.alias("y0"), F.lit(220.0).alias("x1"), (y + 30.0).alias("y1"))
    return boxes(spark, d).select("doc_id", "page_no").distinct().withColumn("asset_id", F.col("page_no")).withColumn("box", box)


def lines(spark, d):
    heading = F.col("block_index") % 4 == 0
    level = F.when(heading, 1 + F.length("text") % 3).cast("int")
    return corpus.blocks_of(docs(spark, d)).select("doc_id", F.col("block_index").alias("pos"), heading.alias("is_heading"), level.alias("level"), "text", "page_no")


def headings(spark, d):
    return lines(spark, d).filter("is_heading").select("doc_id", "pos", "level", F.col("text").alias("title"))


def sectioned(spark, d):
    marked = lines(spark, d).withColumnRenamed("pos", "block_index")
    spans = sections.propagate_heading(marked.select("doc_id", F.lit(1).alias("page_no"), "block_index", "text", F.when(F.col("is_heading"), F.col("text")).alias("heading"), F.lit("").alias("section")), least=0)
    return spans.select("doc_id", (F.col("block_index") / 5).cast("int").alias("p"), "block_index", "text", "section").select("doc_id", (F.col("p") + 1).alias("page_no"), "block_index", "text", "section")


@query("SELECT user_id, event_id, event_type = 'click' AND row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS is_primary FROM events")
def s14_demote_primary(spark, d):
    claims = corpus.read_table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("is_primary"))
    return registry.demote_primary(claims, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "is_primary")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s15_docs_with_asset(spark, d):
    flags = corpus.read_table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_primary"))
    return registry.docs_with_asset(docs(spark, d).select("doc_id", "source"), flags)


AUDIT = "far AS (SELECT DISTINCT doc_id FROM labels), near AS (SELECT doc_id FROM documents WHERE lang = 'en'), au AS (SELECT d.doc_id, CASE WHEN f.doc_id IS NOT NULL AND n.doc_id IS NOT NULL THEN 'backed' WHEN f.doc_id IS NOT NULL THEN 'remote_only' WHEN n.doc_id IS NOT NULL THEN 'local_only' ELSE 'broken' END AS state, concat_ws(',', CASE WHEN f.doc_id IS NULL THEN 'no_object' END, CASE WHEN n.doc_id IS NULL THEN 'no_local_file' END) AS issues FROM documents d LEFT JOIN far f ON d.doc_id = f.doc_id LEFT JOIN near n ON d.doc_id = n.doc_id)"


@query(f"WITH {AUDIT} SELECT doc_id, state, issues FROM au")
def s16_audit_storage(spark, d):
    return registry.audit_storage(docs(spark, d), corpus.read_table(spark, d, "labels"), docs(spark, d).filter("lang = 'en'"))


@query(f"WITH {AUDIT} SELECT doc_id, CASE state WHEN 'local_only' THEN 'upload' WHEN 'remote_only' THEN 'restore' ELSE 'unrecoverable' END AS action FROM au WHERE state <> 'backed'")
def s17_repair_plan(spark, d):
    return registry.repair_plan(s16_audit_storage(spark, d))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'error' WHEN l.quality = 1 THEN 'done' WHEN l.doc_id IS NOT NULL THEN 'processing' ELSE 'queued' END AS status, CASE WHEN l.toxic = 1 THEN 'toxic' END AS error FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def s18_ingest_status(spark, d):
    results = corpus.read_table(spark, d, "labels").select("doc_id", F.lit(True).alias("started"), (F.col("quality") == 1).alias("finished"), F.when(F.col("toxic") == 1, "toxic").alias("error"))
    return registry.ingest_status(docs(spark, d), results)


@query("SELECT doc_id, source FROM documents WHERE coalesce(source, '') <> '' AND doc_id IN (SELECT doc_id FROM labels)")
def s26_backfill_candidates(spark, d):
    return registry.backfill_candidates(docs(spark, d).select("doc_id", "source"), "source", corpus.read_table(spark, d, "labels"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 0 AND n_chars <= 2000 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def s27_first_per_config(spark, d):
    return registry.first_per_config(docs(spark, d).select("doc_id", "source", "n_chars"), "source", "n_chars", 2000, 20, "doc_id")


@query(f"WITH {BLOCKS} SELECT doc_id, block_index::INT AS block_index, regexp_matches(trim(text), '(?i)^(page\\s+)?[0-9]{{1,4}}$|^[0-9]+(\\.[0-9]+)*\\.?$|^arxiv:[0-9]{{4}}\\.[0-9]{{4,5}}|^(figure|table|fig\\.)\\s*[0-9]*[.:]?$') OR (length(trim(text)) >= 4 AND length(trim(text)) - length(regexp_replace(trim(text), '[A-Za-z]', '', 'g')) < 0.3 * length(trim(text))) AS noise FROM b")
def p36_noise_lines(spark, d):
    return corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", X.noise_line(F.col("text")).alias("noise"))


# The patterns' word boundaries see ASCII alone in the twin, so other letters are q there.
_Q = r"regexp_replace(s, '[^\x00-\x7F]', 'q', 'g')"
_N = "len(regexp_extract_all(s, '" + S.WORD.replace("'", "''") + "'))"
_PROSE = f"({_N} >= 10 OR ({_N} >= 6 AND regexp_matches(s, '[.!?;:]')))"
_HELD = "text"
for _a in S.ABBREVIATIONS:
    _HELD = f"replace({_HELD}, '{_a}', '{_a.replace('.', chr(2))}')"
SENTENCES = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace({_HELD}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), chr(2), '.')), lambda s: s <> '') AS p FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM p),
g AS (SELECT doc_id, i, s, sum((i = 1 OR length(s) > {S.TAIL} OR regexp_matches(s, '[.!?]$'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM u),
m AS (SELECT doc_id, g, string_agg(s, ' ' ORDER BY i) AS s FROM g GROUP BY ALL),
f AS (SELECT *, {_Q} AS a, regexp_replace(s, '^["''(\\[{{]+', '') AS bare, string_split(s, ' ') AS t, {_PROSE} AS prose, {_N} AS words, lower(s) IN ({', '.join(f"'{h}'" for h in S.HEADINGS)}) OR regexp_matches(s, '{S.ENTRY}') AS entry FROM m),
c AS (SELECT *, len(list_filter(t, lambda x: length(x) <= 4)) AS short, len(list_filter(t, lambda x: regexp_matches(x, '{S.NUMBERISH}'))) AS numbers, len(list_filter(t, lambda x: regexp_matches(x, '{S.COLUMN_HEAD}'))) AS heads, len(regexp_extract_all(s, '{S.METRICS}')) AS metrics, regexp_matches(a, '{S.VERBS}') AS verb FROM f),
k AS (SELECT *,
    NOT (regexp_matches(a, '{S.CAPTION}') OR starts_with(s, 'Figure ') OR (length(s) >= 220 AND prose)) AND (entry OR (regexp_matches(s, '{S.TICKS}') AND (numbers >= 1 OR short >= 4)) OR (metrics >= 2 AND (numbers >= 2 OR short >= 6)) OR (heads >= 6 AND numbers >= 1 AND NOT verb AND NOT prose)
      OR (NOT prose AND numbers >= 3) OR (length(s) <= 160 AND NOT prose AND regexp_matches(lower(a), '{S.COMPARED}') AND (numbers >= 1 OR short >= 4))) AS scaffold,
    (len(regexp_extract_all(a, '{S.CITATIONS}')) >= 2 OR (regexp_matches(a, '{S.BIBLIOGRAPHY}') AND words >= 6)) AND NOT (verb AND prose) AS bibliography,
    NOT prose AND length(s) <= 80 AND (regexp_matches(s, '{S.PANEL}') OR regexp_matches(s, '{S.LABEL}')) AS label FROM c),
r AS (SELECT doc_id, g, s FROM k WHERE length(s) BETWEEN {S.SHORTEST} AND {S.LONGEST} AND words >= {S.LEAST_WORDS} AND NOT (bare = '' OR regexp_matches(bare, '^[\\p{{Ll}},;:]') OR regexp_matches(lower(regexp_replace(bare, '[^\\x00-\\x7F]', 'q', 'g')), '{S.FRAGMENT}') OR entry)
    AND NOT regexp_matches(s, '{S.BULLETS}') AND NOT regexp_matches(a, '{S.CAPTION}') AND NOT regexp_matches(a, '{S.CODE}') AND NOT (starts_with(lower(s), 'where ') AND regexp_matches(s, '{S.EQUATION}')) AND NOT label AND NOT bibliography AND NOT scaffold)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS sentence_no, s AS sentence FROM r"""


@query(SENTENCES)
def p34_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query()
def p44_abstracts(spark, d):
    return docs(spark, d).select("doc_id", X.abstract_of(F.col("text")).alias("abstract"), F.array_join(X.figure_mentions(F.col("text")), ",").alias("figures"))


@query("SELECT page_id, nullif(regexp_extract(url, '(?i)arxiv\\.org/(?:abs|pdf|html)/([0-9]{4}\\.[0-9]{4,5})', 1), '') AS arxiv_id, nullif(regexp_extract(url, '(?i)(?:youtu\\.be/|youtube\\.com/(?:watch\\?(?:.*&)?v=|embed/|shorts/))([A-Za-z0-9_-]{11})', 1), '') AS video_id, nullif(regexp_extract(html, '(?i)arxiv\\.org/(?:abs|pdf|html)/([0-9]{4}\\.[0-9]{4,5})', 1), '') AS linked_arxiv_id FROM pages")
def p46_ids(spark, d):
    return corpus.read_table(spark, d, "pages").select("page_id", X.arxiv_id(F.col("url")).alias("arxiv_id"), X.video_id(F.col("url")).alias("video_id"), X.arxiv_id(F.col("html")).alias("linked_arxiv_id"))


@query(f"WITH {BOXES}, m AS (SELECT a.doc_id, a.page_no, asset_id, block_index, text, round(CASE WHEN {SHARED} > 0 THEN {SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0)) * 0.8e0 + {SHARED} / ((x.x1 - x.x0) * (x.y1 - x.y0)) * 0.2e0 ELSE 0.04e0 / (1 + greatest(0e0, greatest(a.y0, x.y0) - least(a.y1, x.y1))) END, 9) AS s FROM a JOIN x ON a.doc_id = x.doc_id AND a.page_no = x.page_no) SELECT doc_id, page_no, asset_id, block_index, round(least(0.98e0, greatest(0.25e0, s)), 6) AS confidence, substr(text, 1, 300) AS context FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, asset_id ORDER BY s DESC, block_index) = 1")
def j15_asset_blocks(spark, d):
    return layout.asset_blocks(assets(spark, d), boxes(spark, d))


@query()
def j17_caption_bind(spark, d):
    captions = boxes(spark, d).filter(F.length("text") <= 60).withColumn("caption_id", F.col("block_index"))
    return layout.caption_bind(assets(spark, d), captions)


@query(f"WITH {BOXES}, st AS (SELECT doc_id, page_no, y0 AS start_y, text AS section FROM x WHERE block_index % 2 = 0), pt AS (SELECT doc_id, page_no, y0 + 5e0 AS y FROM a), m AS (SELECT pt.*, start_y, section FROM pt LEFT JOIN st ON pt.doc_id = st.doc_id AND pt.page_no = st.page_no) SELECT doc_id, page_no, y, coalesce(arg_max(section, start_y) FILTER (WHERE start_y <= y + 8), arg_min(section, start_y)) AS section FROM m GROUP BY ALL")
def j18_section_at(spark, d):
    starts = boxes(spark, d).filter("block_index % 2 = 0").select("doc_id", "page_no", F.col("box.y0").alias("start_y"), F.col("text").alias("section"))
    return layout.section_at(assets(spark, d).select("doc_id", "page_no", (F.col("box.y0") + 5.0).alias("y")), starts)


@query(f"WITH {BOXES} SELECT x.doc_id, x.block_index FROM x JOIN a ON a.doc_id = x.doc_id AND a.page_no = x.page_no WHERE NOT ({SHARED} >= 0.45e0 * ((x.x1 - x.x0) * (x.y1 - x.y0)) OR ((x.x0 + x.x1) / 2 BETWEEN a.x0 AND a.x1 AND (x.y0 + x.y1) / 2 BETWEEN a.y0 AND a.y1) OR (length(text) <= 48 AND (x.x0 + x.x1) / 2 BETWEEN a.x0 - 6 AND a.x1 + 6 AND (x.y0 + x.y1) / 2 BETWEEN a.y0 - 6 AND a.y1 + 6))")
def j25_drop_owned(spark, d):
    return layout.drop_owned(boxes(spark, d), assets(spark, d)).select("doc_id", "block_index")


@query(f"WITH {BOXES}, i AS (SELECT doc_id, page_no, block_index, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_index) AS n FROM x WHERE length(text) > 60), c AS (SELECT doc_id, page_no, text, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_index) AS n FROM x WHERE length(text) <= 60) SELECT i.doc_id, i.page_no, block_index, i.n::INT AS ordinal, c.text AS caption FROM i LEFT JOIN c ON i.doc_id = c.doc_id AND i.page_no = c.page_no AND i.n = c.n")
def j26_pair_by_ordinal(spark, d):
    b = boxes(spark, d).withColumn("at", F.col("block_index"))
    return layout.pair_by_ordinal(b.filter(F.length("text") > 60), b.filter(F.length("text") <= 60)).select("doc_id", "page_no", "block_index", "ordinal", "caption")


@query(f"WITH {BOXES} SELECT doc_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM x GROUP BY ALL")
def a21_page_bounds(spark, d):
    return layout.page_bounds(boxes(spark, d))


@query(f"WITH {BOXES} SELECT doc_id, block_index, (block_index % 5)::BIGINT AS row_no FROM x")
def w14_text_rows(spark, d):
    return layout.text_rows(boxes(spark, d)).select("doc_id", "block_index", "row_no")


@query(f"WITH {HEADS} SELECT h.doc_id, h.pos, h.level, max(p.pos) FILTER (WHERE p.pos < h.pos AND p.level < h.level) AS parent, min(p.pos) FILTER (WHERE p.pos > h.pos AND p.level <= h.level) AS \"end\" FROM h JOIN h p ON h.doc_id = p.doc_id GROUP BY ALL")
def w8_section_tree(spark, d):
    return sections.section_tree(headings(spark, d).drop("title"))


@query(f"WITH {HEADS} SELECT doc_id, pos FROM (SELECT *, lead(is_heading) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM l) WHERE NOT is_heading OR after IS NOT DISTINCT FROM false")
def w10_drop_empty_headings(spark, d):
    return sections.drop_empty_headings(lines(spark, d)).select("doc_id", "pos")


RUN = "SELECT doc_id, pos, (2 + length(text) % 3)::INT AS level FROM l"


@query(f"WITH {HEADS}, r AS ({RUN}), m AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) AS island FROM r) SELECT doc_id, level, min(pos) AS first, max(pos) AS last, count(*) AS n FROM m WHERE level >= 3 GROUP BY doc_id, level, island HAVING count(*) >= 2")
def w11_heading_runs(spark, d):
    every = lines(spark, d).withColumn("level", (2 + F.length("text") % 3).cast("int"))
    return sections.heading_runs(every)


@query(f"WITH {HEADS}, t AS (SELECT doc_id, pos, length(text) % 3 > 0 AS ok FROM l QUALIFY pos >= max(pos) OVER (PARTITION BY doc_id) * 0.55e0), m AS (SELECT *, lead(ok, 1) OVER w AS o1, lead(ok, 2) OVER w AS o2 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, min(pos) AS pos FROM m WHERE ok AND o1 AND o2 GROUP BY 1")
def w12_reference_start(spark, d):
    return sections.reference_start(lines(spark, d), F.length("text") % 3 > 0)


@query(f"WITH {HEADS}, m AS (SELECT doc_id, pos, pos % 3 // 2 AS level, 't' AS title, text, CASE WHEN lag(pos % 3 // 2) OVER w IS NOT DISTINCT FROM pos % 3 // 2 THEN 0 ELSE 1 END AS n FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m) SELECT doc_id, min(pos) AS pos, level::INT AS level, title, string_agg(text, chr(10) ORDER BY pos) AS text FROM r GROUP BY doc_id, run, level, title")
def w23_merge_sections(spark, d):
    parts = lines(spark, d).select("doc_id", "pos", F.floor(F.col("pos") % 3 / 2).cast("int").alias("level"), F.lit("t").alias("title"), "text")
    return sections.merge_sections(parts)


@query(f"WITH {SECTIONED} SELECT doc_id, section, count(*) AS n_blocks, count(DISTINCT page_no) AS n_pages, arg_min(page_no, pos) AS first_page, min(pos) AS first_index FROM s GROUP BY ALL")
def a8_section_catalog(spark, d):
    rows = sectioned(spark, d).withColumn("title", F.col("section")).withColumn("confidence", F.lit(1.0))
    return sections.section_catalog(rows).drop("titles", "mean_confidence")


@query(f"WITH {SECTIONED}, o AS (SELECT doc_id, section, text, min(pos) AS pos FROM s GROUP BY ALL) SELECT doc_id, section, string_agg(text, chr(10) ORDER BY pos) AS text FROM o GROUP BY ALL")
def a9_section_text(spark, d):
    return sections.section_text(sectioned(spark, d))


@query(f"WITH {SECTIONED}, c AS (SELECT doc_id, page_no AS chunk_no, section, count(*) AS n, min(pos) AS seen FROM s GROUP BY ALL) SELECT doc_id, chunk_no, section, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY n DESC, seen) = 1")
def a11_majority_section(spark, d):
    return sections.majority_section(sectioned(spark, d).withColumn("chunk_no", F.col("page_no")))


@query(f"WITH {HEADS}, p AS (SELECT doc_id, lower(trim(title)) AS t, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT doc_id, sum(n)::BIGINT AS n_headings, max(n) AS most_repeats FROM p GROUP BY 1), g AS (SELECT doc_id, max(pos // 5 + 1) AS n_pages FROM l GROUP BY 1) SELECT doc_id, n_headings, most_repeats, concat_ws(',', CASE WHEN n_headings > greatest(24, 2 * n_pages + 6) THEN 'too_many_headings' END, CASE WHEN most_repeats > 3 THEN 'repeated_heading' END) AS issues FROM s JOIN g USING (doc_id)")
def a25_heading_audit(spark, d):
    return sections.heading_audit(headings(spark, d), lines(spark, d).groupBy("doc_id").agg(F.max("page_no").alias("n_pages")))


@query(f"WITH {HEADS} SELECT doc_id, pos, level FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), level ORDER BY pos) = 1")
def u5_dedupe_headings(spark, d):
    return sections.dedupe_headings(headings(spark, d)).select("doc_id", "pos", "level")


@query(f"WITH {PHRASE} SELECT query_id, rank, row_id FROM ranked WHERE rank <= 10 AND row_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j13_only_documents(spark, d):
    hits = ranked(spark, d).withColumnRenamed("row_id", "doc_id")
    return search.only_documents(hits, docs(spark, d).filter("lang = 'en'")).select("query_id", "rank", F.col("doc_id").alias("row_id"))


@query(f"WITH {PHRASE} SELECT query_id, rank, row_id, lang, source FROM ranked JOIN documents ON row_id = doc_id WHERE rank <= 10")
def j14_enrich_hits(spark, d):
    return ranked(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("row_id"), "lang", "source"), "row_id").select("query_id", "rank", "row_id", "lang", "source")


@query(f"WITH {PHRASE} SELECT query_id, row_id AS doc_id, max(bm25) AS bm25 FROM ranked WHERE rank <= 10 GROUP BY ALL")
def a7_doc_max_score(spark, d):
    return search.doc_max_score(ranked(spark, d).withColumnRenamed("row_id", "doc_id"), "bm25")


@query(f"WITH {PHRASE}, u AS (SELECT query_id, rank, row_id, 0 AS list_no FROM ranked WHERE rank <= 3 UNION ALL SELECT query_id, rank, row_id, 1 FROM ranked WHERE rank BETWEEN 4 AND 6) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, row_id))::INT AS rank, row_id, list_no FROM u")
def u4_rag_union(spark, d):
    top = ranked(spark, d)
    return search.rag_union(top.filter("rank <= 3"), top.filter("rank BETWEEN 4 AND 6"))


@query(f"WITH {PHRASE}, h AS (SELECT query_id, source AS doc_id, rank, text FROM ranked JOIN documents ON row_id = doc_id WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY query_id, substr(text, 1, 100) ORDER BY rank) = 1), g AS (SELECT query_id, doc_id, min(rank) AS first, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS hash FROM h GROUP BY ALL) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id))::INT AS source_no, doc_id, n, hash FROM g")
def a27_context_by_source(spark, d):
    hits = ranked(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("row_id"), F.col("source").alias("doc_id"), "text"), "row_id")
    return search.context_by_doc(hits).select("query_id", "source_no", "doc_id", "n", F.md5("context").alias("hash"))


RESCUED = TITLES.replace("\nSELECT query_id, doc_id, round(CASE WHEN phrase", ",\nbn AS (SELECT query_id, doc_id, round(CASE WHEN phrase") + (
    f"), {BLOCKS}, fp AS (SELECT doc_id, min(block_index // 5 + 1)::INT AS page_no FROM b GROUP BY 1) SELECT query_id, doc_id, bonus AS score, page_no FROM bn JOIN fp USING (doc_id) WHERE bonus >= 0.3e0 AND (query_id, doc_id) NOT IN (SELECT query_id, row_id FROM ranked WHERE rank <= 10)"
)


@query(RESCUED)
def j12_title_rescue(spark, d):
    titled = docs(spark, d).select("doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))
    stats = search.token_stats(batch(spark, d), doc_index(spark, d))
    bonus = search.title_bonus(batch(spark, d), titled, stats)
    return search.title_rescue(ranked(spark, d).withColumnRenamed("row_id", "doc_id"), bonus, pages(spark, d))


@query(f"WITH {HEADS}, r AS (SELECT doc_id, text AS title, level AS canonical, (pos // 5 + 1)::INT AS page FROM l WHERE is_heading AND pos % 8 = 0), t AS (SELECT doc_id, title, min(page) AS p FROM r GROUP BY ALL), n AS (SELECT doc_id, canonical, min(page) AS p FROM r GROUP BY ALL) SELECT h.doc_id, h.pos, coalesce(t.p, n.p) AS page FROM h LEFT JOIN t ON h.doc_id = t.doc_id AND h.title = t.title LEFT JOIN n ON h.doc_id = n.doc_id AND h.level = n.canonical")
def j24_seed_page_hints(spark, d):
    named = headings(spark, d).withColumnRenamed("level", "canonical")
    known = lines(spark, d).filter("is_heading AND pos % 8 = 0").select("doc_id", F.col("text").alias("title"), F.col("level").alias("canonical"), F.col("page_no").alias("page"))
    return sections.seed_page_hints(named, known).select("doc_id", "pos", "page")


@query(f"WITH {HEADS}, g AS (SELECT DISTINCT doc_id, text FROM l WHERE pos % 2 = 0), p AS (SELECT DISTINCT doc_id, text FROM l WHERE pos % 3 = 0), m AS (SELECT g.doc_id, p.text IS NOT NULL AS ok FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.text = p.text) SELECT doc_id, count(*) AS n_gold, count(*) FILTER (WHERE ok) AS n_found, round(count(*) FILTER (WHERE ok) / count(*), 6) AS recall FROM m GROUP BY 1")
def u3_set_recall(spark, d):
    every = lines(spark, d)
    return sections.set_recall(every.filter("pos % 3 = 0"), every.filter("pos % 2 = 0"), "text")
