"""Page furniture, fonts and classes of documents, from blocks with boxes and font sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.operators import layout

# Patterns of page numbers and preprint stamps, the counts and edges of repeated lines.
PAGE_NUMBER = r"(?i)^(page\s+)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?$"
STAMP = r"(?i)^arxiv:[0-9]{4}\.[0-9]{4,5}"
REPEATED, EDGE_REPEATED, TOP, BOTTOM = 4, 2, 0.08, 0.93


def furniture_key(text: Column) -> Column:
    """A line as it repeats from page to page: lower case, digits as one mark, blanks single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " "))


def page_furniture(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page_no, text, box) with ``furniture`` (boolean).

    Furniture are page numbers, preprint stamps, lines that stand on ``REPEATED``
    or more pages of their document, and lines in a page's top or bottom margin
    that stand on ``EDGE_REPEATED`` or more.
    """
    key = furniture_key(F.col("text"))
    marked = blocks.withColumn("furniture_key_", key)
    repeats = marked.groupBy("doc_id", "furniture_key_").agg(F.count_distinct("page_no").alias("pages_"))
    bounds = layout.page_bounds(blocks).select("doc_id", "page_no", F.col("y0").alias("top_"), F.col("y1").alias("bottom_"))
    met = marked.join(repeats, ["doc_id", "furniture_key_"]).join(bounds, layout.PAGE)
    height = F.col("bottom_") - F.col("top_")
    edge = (F.col("box.y1") <= F.col("top_") + TOP * height) | (F.col("box.y0") >= F.col("top_") + BOTTOM * height)
    t = F.trim("text")
    found = t.rlike(PAGE_NUMBER) | t.rlike(STAMP) | (F.col("pages_") >= REPEATED) | (edge & (F.col("pages_") >= EDGE_REPEATED))
    return met.withColumn("furniture", found).select(*(f"`{c}`" for c in blocks.columns), "furniture")


def body_font(blocks: DataFrame, least_chars: int = 40) -> DataFrame:
    """(doc_id, body_font): the upper median of the font sizes of body-like blocks (doc_id, text, font), all blocks where none is."""
    body = F.length(F.trim("text")) >= least_chars
    sizes = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(body, F.col("font")))).alias("body"), F.array_sort(F.collect_list("font")).alias("every"))
    pick = F.when(F.size("body") > 0, F.col("body")).otherwise(F.col("every"))
    return sizes.select("doc_id", pick.alias("p")).select("doc_id", F.try_element_at("p", F.floor(F.size("p") / 2).cast("int") + 1).alias("body_font"))


def base_font(spans: DataFrame) -> DataFrame:
    """(doc_id, base_font): the commonest font size of spans (doc_id, font) rounded half to even, the least of equals."""
    counts = spans.groupBy("doc_id", F.bround("font", 0).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("base_font"))


# Signals of a page, (score, points, condition over the counts of the page).
PAGE_POINTS = (
    ("scholarly", 3, "has_abstract"), ("scholarly", 3, "has_references"), ("scholarly", 2, "citations >= 2"), ("scholarly", 2, "page_no = 1 AND affiliations > 0"),
    ("scholarly", 1, "roman_headings >= 1"), ("scholarly", 1, "equations >= 2"), ("scholarly", 1, "two_columns"),
    ("visual", 2, "captions > 0"), ("visual", 1, "images + tables > 0"), ("visual", 1, "section_headings >= 1 AND captions > 0"), ("visual", 1, "drawings > 8 AND captions > 0"),
    ("report", 2, "section_headings + part_headings >= 1"), ("report", 2, "report_headings >= 1"), ("report", 1, "repeated_edges >= 1 AND academic_headings + numbered_headings + equations = 0"),
    ("report", 2, "paragraphs >= 4 AND citations + captions + academic_headings + numbered_headings + equations = 0"),
    ("report", 1, "NOT has_abstract AND NOT has_references AND academic_headings + numbered_headings + affiliations = 0"),
    ("report", 1, "text_len >= 400 AND images + tables + equations + numbered_headings = 0 AND NOT two_columns"),
)
# Counts that add to the scholarly score up to a limit.
PAGE_COUNTS = (("academic_headings", 3), ("numbered_headings", 2))
# Signals of a document over the sums of its pages.
DOC_POINTS = (
    ("scholarly", 3, "has_abstract"), ("scholarly", 3, "has_references"), ("scholarly", 2, "citations >= 4"), ("scholarly", 2, "academic_headings >= 3"), ("scholarly", 4, "numbered_headings >= 3"),
    ("scholarly", 2, "numbered_headings BETWEEN 1 AND 2"), ("scholarly", 2, "roman_headings >= 2"), ("scholarly", 2, "affiliated_pages >= 1"),
    ("scholarly", 2, "affiliated_pages >= 1 AND academic_headings + numbered_headings >= 1"), ("scholarly", 2, "equations >= 8"),
    ("visual", 2, "captions >= 2"), ("visual", 2, "captions >= 4"), ("visual", 2, "section_headings >= 2 AND captions >= 2"),
    ("report", 3, "section_headings >= 3"), ("report", 2, "report_headings >= 3"), ("report", 2, "repeated_sides >= 2 AND academic_headings + numbered_headings + equations = 0"),
    ("report", 2, "NOT has_abstract AND NOT has_references AND citations + affiliated_pages + numbered_headings + academic_headings = 0"),
    ("report", 2, "prose_pages >= greatest(1, n_pages DIV 2) AND captions + equations + numbered_headings + academic_headings = 0"),
    ("report", 1, "captions + equations + numbered_headings + academic_headings + affiliated_pages = 0"),
)
MARGIN = 3


def _sums(points: tuple, score: str) -> Column:
    return sum((F.when(F.expr(when), value).otherwise(0) for name, value, when in points if name == score), F.lit(0))


def page_profiles(pages: DataFrame) -> DataFrame:
    """``pages`` with ``scholarly``, ``visual``, ``report`` and ``handler``, paper or plain.

    pages (doc_id, page_no, text_len, two_columns, has_abstract, has_references and the counts
    named in ``PAGE_POINTS``; repeated_edges is repeated_headers + repeated_footers). Counts must not be null.
    """
    whole = pages.withColumn("repeated_edges", F.col("repeated_headers") + F.col("repeated_footers"))
    capped = sum((F.least(F.col(c), F.lit(most)) for c, most in PAGE_COUNTS), F.lit(0))
    scored = whole.withColumns({"scholarly": _sums(PAGE_POINTS, "scholarly") + capped, "visual": _sums(PAGE_POINTS, "visual"), "report": _sums(PAGE_POINTS, "report")})
    return scored.drop("repeated_edges").withColumn("handler", F.when(F.col("scholarly") + F.col("visual") >= F.col("report"), "paper").otherwise("plain"))


def doc_profiles(profiles: DataFrame) -> DataFrame:
    """(doc_id, n_pages, scholarly, visual, report, handler): documents from ``page_profiles``; a lead under ``MARGIN`` points makes a document mixed."""
    total = {c: F.sum(c).alias(c) for c in ("citations", "captions", "academic_headings", "numbered_headings", "roman_headings", "equations", "section_headings", "report_headings")}
    some = lambda c: F.count_if(F.col(c) > 0)
    prose = F.count_if((F.col("paragraphs") >= 4) & (F.col("citations") + F.col("captions") == 0))
    sums = profiles.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), *total.values(), *(F.bool_or(c).alias(c) for c in ("has_abstract", "has_references")), some("affiliations").alias("affiliated_pages"),
        (some("repeated_headers") + some("repeated_footers")).alias("repeated_sides"), prose.alias("prose_pages"), *(F.sum(c).alias(f"{c}_") for c in ("scholarly", "visual", "report")),
    )
    scored = sums.select("doc_id", "n_pages", *((F.col(f"{c}_") + _sums(DOC_POINTS, c)).alias(c) for c in ("scholarly", "visual", "report")))
    lead = F.col("scholarly") + F.col("visual") - F.col("report")
    return scored.withColumn("handler", F.when(lead >= MARGIN, "paper").when(lead <= -MARGIN, "plain").otherwise("mixed"))
