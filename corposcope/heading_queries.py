"""Queries of heading shapes, places and sources; they join the queries of ``corposcope.queries``.

The tables have no outlines: every fourth line of a document serves as a heading of one of four
sources, so that these queries run over all documents.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corposcope.functions import headings as H
from corposcope.functions import text as X
from corposcope.library_queries import headings
from corposcope.operators import headings as places
from corposcope.queries import BLOCKS, docs, query
from corposcope.sources import corpus

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_KEY = "trim(regexp_replace(regexp_replace(lower(" + _SQUEEZED + "), '" + H.PREFIX + "', ''), '[^a-z0-9]+', ' ', 'g'))"
_CLEAN = "trim(regexp_replace(" + _SQUEEZED.format("translate(regexp_replace({0}, '\\\\[a-zA-Z]+\\*?(?:\\[[^\\]]*\\])?\\{{([^{{}}]*)\\}}', '\\1', 'g'), '{{}}', '')") + ", '(?i)" + H.PREFIX.replace("{", "{{").replace("}", "}}") + "', ''), ' .:-')"
_KEY = _KEY.replace("{0,3}", "{{0,3}}")
_UPPER = "(length(regexp_replace(w, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 0.8 * length(regexp_replace(w, '[^A-Za-z]', '', 'g')))"
_UNTIL = "({words})[1 : coalesce(list_min(list_filter(list_transform({words}, lambda w, i: CASE WHEN {stop} THEN i END), lambda i: i IS NOT NULL)) - 1, len({words}))]"
_BARE = "regexp_replace(w, '[^A-Za-z0-9&()/-]+', '', 'g')"
_CANONICAL = "CASE " + " ".join(f"WHEN regexp_matches(norm, '{pattern}') THEN '{name}'" for name, pattern in X.SECTION_PATTERNS) + " END"

SHAPES = f"""WITH {BLOCKS}, l AS (SELECT doc_id, block_index, text, {_SQUEEZED.format('text')} AS line FROM b),
w AS (
  SELECT *, string_split(line, ' ') AS words, list_filter(string_split(trim(regexp_replace(regexp_extract(text, '{H.NUMBERED}', 2), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:20] AS numbered,
    list_filter(string_split(trim(regexp_replace(regexp_extract(text, '{H.ROMAN}', 1), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:24] AS roman, {_CLEAN.format('text')} AS title FROM l),
s AS (SELECT *, list_filter(numbered, lambda w: regexp_matches(w, '[A-Za-z0-9&()/-]')) AS solid, {_KEY.format('title')} AS key,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), '^(?:\\d+(?:\\.\\d+)*|[ivxlc]+)[.)]?\\s+', ''), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM w),
c AS (SELECT *, {_UNTIL.format(words='solid', stop=f"i > 2 AND regexp_matches({_BARE}, '^[a-z]') AND lower({_BARE}) NOT IN ({_LIST(H.CONNECTORS)})")} AS n_words, {_UNTIL.format(words='roman', stop='NOT ' + _UPPER)} AS r_words, string_split(key, ' ') AS k, coalesce({_CANONICAL}, '') IN ({_LIST(H.CORE)}) AS core FROM s),
j AS (SELECT *, array_to_string(n_words, ' ') AS n_title, array_to_string(r_words, ' ') AS r_title FROM c)
SELECT doc_id, block_index::INT AS block_index, {_CLEAN.format('n_title')} AS numeric_title, {_CLEAN.format('r_title')} AS roman_title, regexp_matches(text, '(?i){H.MARKER}') AS marker,
  len(words) <= 12 AND line <> '' AND NOT ends_with(line, '.') AND length(line) - length(replace(line, ',', '')) <= 1 AND NOT regexp_matches(lower(line), '{H.FLOAT_TITLE}') AND len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}') OR {_UPPER})) >= greatest(2, len(words) - 2) AS phrase,
  regexp_matches(text, '[.!?]\\s') OR len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({_LIST(H.PROSE_WORDS)}))) >= 3 AS prose,
  key <> '' AND {' AND '.join(f"NOT contains(lower(title), '{a}')" for a in H.ADDRESSES)} AND NOT regexp_matches(key, '{H.FLOAT_TITLE}') AND (core OR k[1] NOT IN ({_LIST(H.NO_BEGINNING)})) AND length(replace(key, ' ', '')) >= 4
    AND NOT (len(k) > 1 AND len(list_filter(k, lambda x: length(x) <= 1)) >= len(k) // 2) AND (core OR length(regexp_replace(title, '[^0-9]', '', 'g')) < 0.28 * length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) OR length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) = 0) AS plausible
FROM j"""


@query(SHAPES)
def p47_heading_shapes(spark, d):
    """The shapes of all lines."""
    b = corpus.blocks_of(docs(spark, d)).select("doc_id", "block_index", "text")
    return places.heading_shapes(b).drop("text")


def outlines(spark, d):
    """Headings (doc_id, heading_no, title, level, source, page_hint, block_hint): the first five words of every fourth line, of every second one with its page."""
    h = headings(spark, d)
    title = F.array_join(F.slice(F.split(F.trim("title"), r"\s+"), 1, 5), " ")
    source = F.element_at(F.array(*(F.lit(s) for s, _, _ in places.SOURCES)), F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1)
    page = F.when(F.col("pos") % 8 == 0, (F.col("pos") / 5).cast("int") + 1)
    return h.select("doc_id", (F.col("pos") / 4).cast("int").alias("heading_no"), title.alias("title"), "level", source.alias("source"), page.alias("page_hint"), F.lit(None).cast("int").alias("block_hint"))


@query()
def j19_heading_align(spark, d):
    return places.heading_align(outlines(spark, d), corpus.blocks_of(docs(spark, d)))


def competing(spark, d):
    """Headings and placed spans of four sources: lines in turn, names in turn, and two of three placed."""
    h = headings(spark, d).select("doc_id", "pos", F.length("title").alias("n"))
    k = (F.col("pos") / 4).cast("int")
    source = F.element_at(F.array(*(F.lit(s) for s, _, _ in places.SOURCES)), k % 4 + 1)
    every = h.select("doc_id", "pos", "n", source.alias("source"), ((F.col("pos") / 5).cast("int") + 1).alias("page"), k.alias("k"))
    heads = every.select("doc_id", "source", F.col("page").alias("page_hint"), (F.col("n") % 5 == 0).alias("title_like"))
    name = F.element_at(F.array(*map(F.lit, (*H.CORE, "a_long_title_of_six_words", "front_matter"))), F.pmod(F.col("k") * 7 + F.col("n"), F.lit(18)).cast("int") + 1)
    after = F.lead("page").over(Window.partitionBy("doc_id", "source").orderBy("pos"))
    spans = every.filter("n % 3 <> 0").select("doc_id", "source", "pos", name.alias("canonical"), ((F.col("n") % 50) / 100 + 0.5).alias("confidence"), F.col("page").alias("start_page"), F.coalesce(after, "page").alias("end_page"))
    pages = corpus.blocks_of(docs(spark, d)).groupBy("doc_id").agg(F.max("page_no").alias("total_pages"))
    return heads, spans, pages


@query(f"""WITH {BLOCKS}, e AS (SELECT doc_id, block_index AS pos, length(text) AS n, block_index // 4 AS k, (block_index // 5 + 1) AS page, ['pdf_toc', 'arxiv_source', 'grobid', 'heuristic'][(block_index // 4) % 4 + 1] AS source FROM b WHERE block_index % 4 = 0),
t AS (SELECT doc_id, max(block_index // 5 + 1) AS pages FROM b GROUP BY 1),
sp AS (SELECT doc_id, source, pos, [{_LIST(H.CORE)}, 'a_long_title_of_six_words', 'front_matter'][(k * 7 + n) % 18 + 1] AS canonical, (n % 50) / 100 + 0.5e0 AS confidence, page AS start_page, coalesce(lead(page) OVER (PARTITION BY doc_id, source ORDER BY pos), page) - page + 1 AS len FROM e WHERE n % 3 <> 0),
hd AS (SELECT doc_id, source, count(*) AS n, count(*) FILTER (WHERE n % 5 = 0) AS title_like FROM e GROUP BY ALL),
cr AS (SELECT doc_id, source, max(c) AS on_page FROM (SELECT doc_id, source, page, count(*) AS c FROM e GROUP BY ALL) GROUP BY ALL),
ag AS (
  SELECT doc_id, source, count(*) AS m, avg(confidence) AS sure, count(*) FILTER (WHERE canonical IN ({_LIST(H.CORE)})) AS core, count(DISTINCT canonical) AS kinds, max(len) AS longest, arg_min(len, pos) FILTER (WHERE canonical = 'abstract') AS abstract,
    arg_min(start_page, pos) FILTER (WHERE canonical = 'introduction') AS intro, min(start_page) AS first, bool_or(canonical IN ({_LIST(places.EARLY)})) AS early, count(*) FILTER (WHERE canonical = 'a_long_title_of_six_words') AS slugs, count(*) FILTER (WHERE canonical = 'references') AS refs
  FROM sp WHERE canonical <> 'front_matter' GROUP BY ALL),
r AS (SELECT * FROM hd LEFT JOIN cr USING (doc_id, source) LEFT JOIN ag USING (doc_id, source) LEFT JOIN t USING (doc_id)),
x AS (SELECT *, greatest(1, round_even(n * CASE source WHEN 'arxiv_source' THEN 0.6e0 WHEN 'heuristic' THEN NULL ELSE 0.55e0 END, 0)) - m AS lacking, core / m AS cr, longest / pages AS lr, abstract / pages AS ar, greatest(3, floor(pages * 0.35e0)) AS late, on_page / n AS packed FROM r),
sc AS (
  SELECT doc_id, source, n, coalesce(m, 0) AS m, CASE WHEN coalesce(m, 0) = 0 THEN -1e0 ELSE round(
    CASE source WHEN 'pdf_toc' THEN 1.25e0 WHEN 'arxiv_source' THEN 1.1e0 WHEN 'grobid' THEN 1e0 ELSE 0.7e0 END + least(m, 8) * 0.25e0 + m / n * 1.5e0 + sure * 0.5e0 + kinds / m * 0.4e0 + cr * 0.9e0
    - CASE WHEN lacking > 0 THEN least(3.8e0, lacking * 0.75e0) ELSE 0 END - CASE WHEN lr > 0.6e0 THEN (lr - 0.6e0) * 2.4e0 ELSE 0 END - CASE WHEN abstract > 2 THEN least(1.2e0, (abstract - 2) * 0.45e0) ELSE 0 END
    - CASE WHEN pages >= 6 AND ar > 0.22e0 THEN least(5e0, (ar - 0.22e0) * 11.5e0) ELSE 0 END - CASE WHEN pages >= 8 AND intro > late THEN least(3e0, (intro - late) * 0.55e0) ELSE 0 END
    - CASE WHEN source = 'pdf_toc' THEN CASE WHEN n <= 2 THEN 1.2e0 WHEN n = 3 THEN 0.8e0 ELSE 0 END + least(3.2e0, title_like * 1.6e0) + least(2.8e0, slugs * 1.4e0) ELSE 0 END
    - CASE WHEN source = 'heuristic' THEN CASE WHEN cr < 0.55e0 THEN least(2.4e0, (0.55e0 - cr) * 4) ELSE 0 END + CASE WHEN n > 18 THEN least(4.5e0, 1 + (n - 18) * 0.35e0) WHEN n > 12 THEN (n - 12) * 0.15e0 ELSE 0 END
        + CASE WHEN on_page >= 6 THEN least(2.4e0, (on_page - 5) * 0.35e0) ELSE 0 END + CASE WHEN packed >= 0.55e0 AND n >= 8 THEN least(1.6e0, (packed - 0.5e0) * 4) ELSE 0 END + CASE WHEN refs >= 3 THEN least(1.8e0, (refs - 2) * 0.4e0) ELSE 0 END + least(3.2e0, slugs * 0.22e0) ELSE 0 END
    - CASE WHEN source = 'arxiv_source' AND pages >= 8 THEN CASE WHEN first > 3 THEN least(6e0, (first - 3) * 0.6e0) ELSE 0 END + CASE WHEN early THEN 0 ELSE 3e0 END ELSE 0 END, 6) END AS score
  FROM x)
SELECT doc_id, source, score, n AS n_headings, m AS n_placed FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CASE source WHEN 'pdf_toc' THEN 0 WHEN 'arxiv_source' THEN 1 WHEN 'grobid' THEN 2 ELSE 3 END) = 1""")
def a24_strategy_pick(spark, d):
    return places.strategy_pick(*competing(spark, d))
