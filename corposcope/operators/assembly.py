"""Candidates of page blocks: scores, choice and assembly; classes of pages and documents; table regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of (renderable, render, structure, syntax, neighbours) by block type; "" for all other types.
WEIGHTS = {
    "table": (0.15, 0.20, 0.35, 0.20, 0.10),
    "equation": (0.25, 0.30, 0.20, 0.20, 0.05),
    "heading": (0.10, 0.20, 0.20, 0.20, 0.30),
    "": (0.10, 0.30, 0.20, 0.20, 0.20),
}
# What marks text as LaTeX.
LATEX = r"[\\$^_]"

PAGE = ["doc_id", "page_no"]


def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what))


def candidate_scores(candidates: DataFrame) -> DataFrame:
    """``candidates`` (block_type, content, source_text, syntax_valid) with ``renderable``, ``render``, ``structure`` and ``score``.

    Tables need their tags, equations LaTeX marks and balanced braces, other
    types any text; the texts of these are compared by length with the source
    text where there is one. Null content counts as empty.
    """
    kind, t = F.col("block_type"), F.trim(F.coalesce("content", F.lit("")))
    low, some = F.lower(t), F.length(t) > 0
    # Braces balance if no prefix closes more than it opened and all are closed.
    depth = F.aggregate(
        F.regexp_extract_all(t, F.lit(r"([{}])"), F.lit(1)), F.struct(F.lit(0).alias("open"), F.lit(True).alias("ok")),
        lambda a, c: F.struct((a["open"] + F.when(c == "{", 1).otherwise(-1)).alias("open"), (a["ok"] & (a["open"] + F.when(c == "{", 1).otherwise(-1) >= 0)).alias("ok")),
        lambda a: a["ok"] & (a["open"] == 0),
    )
    by_kind = lambda table, equation, other: F.when(kind == "table", table).when(kind == "equation", equation).otherwise(other)
    renderable = by_kind(low.contains("<table") & low.contains("</table>"), some & t.rlike(LATEX) & depth, some)
    whole = candidates.withColumn("renderable", renderable)
    can = F.col("renderable")
    given = F.greatest(F.length(F.trim("source_text")), F.lit(1))
    ratio = F.least(given, F.length(t)) / F.greatest(given, F.length(t))
    render = F.when(kind.isin("table", "equation"), F.when(can, 0.85).otherwise(0.0)).when(F.length("source_text") > 0, ratio).otherwise(F.when(can, 0.75).otherwise(0.0))
    unmarked = (kind == "heading") & some & ~t.startswith("#")
    structure = by_kind(
        F.least(F.lit(1.0), 0.25 + 0.15 * _count(low, "<tr") + 0.05 * _count(low, "<t[dh]")),
        F.when(some & depth, 0.9).when(some, 0.3).otherwise(0.0),
        F.when(can, F.when(unmarked, 0.6).otherwise(0.8)).otherwise(0.0),
    )
    near = F.when(can, by_kind(F.lit(0.8), F.lit(0.7), F.lit(0.9))).otherwise(0.0)
    parts = (can.cast("int"), F.col("render"), F.col("structure"), F.coalesce("syntax_valid", F.lit(False)).cast("int"), near)
    total = lambda weights: reduce(lambda a, p: a + p, (w * p for w, p in zip(weights, parts)))
    named = [(k, total(w)) for k, w in WEIGHTS.items() if k]
    score = reduce(lambda acc, kt: acc.when(kind == kt[0], kt[1]), named[1:], F.when(kind == named[0][0], named[0][1])).otherwise(total(WEIGHTS[""]))
    return whole.withColumns({"render": render, "structure": structure}).withColumn("score", F.round(score, 6))


def best_candidates(scored: DataFrame, block: list[str], order: str) -> DataFrame:
    """One row of each block: the highest score, render and structure; ties to the least ``order``."""
    w = Window.partitionBy(*block).orderBy(F.desc("score"), F.desc("render"), F.desc("structure"), order)
    return scored.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def block_content(block_type: Column, content: Column, dropped: str = "<<DROP_HEADER_FOOTER>>") -> Column:
    """Trimmed content without an outer code fence; headings get their mark; ``dropped``, by which a reader drops a header or footer, becomes empty."""
    t = F.trim(F.coalesce(content, F.lit("")))
    fenced = t.rlike(r"(?i)^```(?:markdown|md)?[ \t]*(?:\n|$)")
    bare = F.when(fenced, F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"(?:^|\n)```\s*$", ""))).otherwise(t)
    return F.when(bare == dropped, "").when((block_type == "heading") & (bare != "") & ~bare.startswith("#"), F.concat(F.lit("## "), bare)).otherwise(bare)


def assemble_pages(blocks: DataFrame, dropped: str = "<<DROP_HEADER_FOOTER>>") -> DataFrame:
    """(doc_id, page_no, n_blocks, markdown) from chosen blocks (doc_id, page_no, pos, block_type, content, emit, band).

    Blocks not to be emitted and empty ones go, and so does a header or footer
    whose text begins a body block of its page. The rest is joined in order of
    pos by blank lines. Only headers and footers meet the body blocks of their
    own page.
    """
    shaped = blocks.withColumn("content", block_content(F.col("block_type"), F.col("content"), dropped)).filter(F.col("content") != "")
    shaped = shaped.withColumn("plain_", F.trim(F.regexp_replace(F.lower(F.translate("content", "#", " ")), r"\s+", " ")))
    body = shaped.filter(F.col("band") == "body").select(*PAGE, F.col("plain_").alias("body_"))
    marginal = shaped.filter((F.col("block_type") == "header_footer") & (F.col("plain_") != ""))
    repeated = marginal.join(body, PAGE).filter(F.startswith("body_", "plain_")).select(*PAGE, "pos").distinct()
    kept = shaped.filter("emit").join(repeated, [*PAGE, "pos"], "left_anti")
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return kept.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("markdown"))


def page_classes(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page_no, text_len, image_share, tables, images, drawings, two_columns, garbled) with ``doc_class`` and ``page_class``.

    Documents are summed up first; the classes come back to the pages by doc_id.
    """
    n = F.count(F.lit(1))
    read = (F.count_if("garbled") > n * 0.5) | (F.count_if(F.col("text_len") < 80) > n * 0.6) | (F.count_if(F.col("image_share") > 0.45) > n * 0.5)
    simple = (n == 1) & (F.avg("text_len") > 500) & (F.sum("tables") == 0) & (F.avg("image_share") < 0.1) & (F.count_if("two_columns") == 0)
    per_doc = pages.groupBy("doc_id").agg(F.when(read, "ocr").when(simple, "simple_text").otherwise("hybrid_paper").alias("doc_class"))
    page = (
        F.when((F.col("text_len") < 80) | F.col("garbled") | (F.col("image_share") > 0.55), "ocr").when(F.col("doc_class") == "simple_text", "simple_text")
        .when((F.col("tables") > 0) | (F.col("images") > 0) | (F.col("drawings") > 8) | F.col("two_columns"), "hybrid_paper")
        .when(F.col("text_len") > 500, "simple_text").otherwise(F.col("doc_class"))
    )
    return pages.join(per_doc, "doc_id").withColumn("page_class", page)


def table_regions(blocks: DataFrame, gap: float = 72.0, height: float = 320.0) -> DataFrame:
    """(doc_id, page_no, pos, y0, y1, n): regions below table captions, from blocks (doc_id, page_no, pos, box, caption, fits).

    From each block with ``caption`` the region goes down the page, in order of
    y0, x0 and pos, over blocks that are captions or ``fits``, as long as the gap
    to the block before is at most ``gap`` and the whole at most ``height`` high.
    A caption without a block below has no region. A caption meets the later
    blocks of its own page alone.
    """
    w = Window.partitionBy(*PAGE).orderBy("box.y0", "box.x0", "pos")
    placed = blocks.withColumns({"n_": F.row_number().over(w), "before_": F.lag("box.y1").over(w)})
    taken = (F.col("caption") | F.col("fits")) & (F.col("box.y0") - F.col("before_") <= gap)
    below = placed.select(*PAGE, F.col("n_").alias("at_"), F.col("box.y1").alias("bottom_"), F.coalesce(taken, F.lit(False)).alias("taken_"))
    heads = placed.filter("caption").select(*PAGE, "pos", "n_", F.col("box.y0").alias("y0"), F.col("box.y1").alias("own_"))
    met = heads.join(below, PAGE).filter(F.col("at_") > F.col("n_"))
    stop = F.min(F.when(~F.col("taken_") | (F.col("bottom_") - F.col("y0") > height), F.col("at_")))
    key = [*PAGE, "pos", "y0", "own_"]
    ends = met.groupBy(*key, "n_").agg(stop.alias("stop_"), F.collect_list(F.struct("at_", "bottom_")).alias("below_"))
    inside = F.filter("below_", lambda b: F.col("stop_").isNull() | (b["at_"] < F.col("stop_")))
    found = ends.withColumn("inside_", inside).filter(F.size("inside_") > 0)
    lowest = F.greatest("own_", F.array_max(F.transform("inside_", lambda b: b["bottom_"])))
    return found.select(*PAGE, "pos", "y0", lowest.alias("y1"), F.size("inside_").alias("n"))
