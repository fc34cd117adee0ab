"""Table records: one of several readings, chunks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions.text import table_markdown


def dedupe_tables(tables: DataFrame, quality: str = "quality") -> DataFrame:
    """Of tables with one caption on a page (blanks and case aside) that of the best quality, ties to the smaller id; without a caption all stay."""
    key = F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce("caption", F.lit(""))), r"\s+", " ")), F.lit(""))
    w = Window.partitionBy("doc_id", "page_no", "key_").orderBy(F.desc_nulls_last(quality), "table_id")
    ranked = tables.withColumn("key_", key).withColumn("rn_", F.row_number().over(w))
    return ranked.filter("rn_ = 1 OR key_ IS NULL").drop("key_", "rn_")


def rows_to_chunks(tables: DataFrame, most_rows: int = 12, most_chars: int = 2200) -> DataFrame:
    """(doc_id, table_id, chunk_no, n_rows, text): rows of a table in chunks of Markdown, each under the header row.

    ``rows`` is an array of arrays, the first one the header. A chunk ends before
    a row that would pass either limit; a row over ``most_chars`` stands alone.
    """
    size = lambda r: F.aggregate(r, F.lit(4), lambda n, c: n + F.length(F.coalesce(c, F.lit(""))) + 3)
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["n"] > 0) & (acc["n"] < most_rows) & (acc["chars"] + n <= most_chars)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(chunk.alias("chunk"), F.when(fits, acc["n"] + 1).otherwise(1).alias("n"), F.when(fits, acc["chars"] + n).otherwise(n).alias("chars"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    body = tables.filter(F.size("rows") > 1).withColumn("body_", F.slice("rows", 2, F.size("rows") - 1))
    placed = body.withColumn("at_", F.aggregate(F.transform("body_", size), start, step, lambda a: a["out"]))
    cut = placed.withColumn("chunk_no", F.explode(F.array_distinct("at_")))
    mine = F.filter("body_", lambda r, i: F.get(F.col("at_"), i) == F.col("chunk_no"))
    cut = cut.withColumn("mine_", mine)
    return cut.select("doc_id", "table_id", "chunk_no", F.size("mine_").alias("n_rows"), table_markdown(F.concat(F.slice("rows", 1, 1), F.col("mine_"))).alias("text"))


# Captions of tables and figures, runs that look encoded, the number of signals that drop a table.
TABLE_CAPTION = r"(?i)^\s*(?:table|tab\.)\s*\d+\b"
FIGURE_CAPTION = r"(?i)^\s*(?:figure|fig\.)\s*\d+\b"
# Letters and digits of any script and _ make words; the pattern says so itself, as not every engine's \b does.
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
ENCODED = _EDGE + "[A-Za-z0-9+/]{24,}={0,2}" + _EDGE
SIGNALS = 2


def table_doubts(tables: DataFrame) -> DataFrame:
    """``tables`` (rows, n_cols, caption, figure_caption, caption_gap, figure_gap) with ``doubts`` (array) and ``false_positive``.

    ``rows`` is an array of arrays of cells. A figure's caption alone, no filled
    cell, or ``SIGNALS`` doubts make a table a false one, and so does a nearer
    figure caption where the table has at most two rows or columns.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean(c)), r"^(?:table|tab\.?)\s*\d+[a-z]?\s*[:.]?\s*", ""), "[^a-z0-9]+", " "))
    cells = F.filter(F.transform(F.flatten("rows"), clean), lambda c: c != "")
    rows = F.filter(F.transform("rows", lambda r: F.trim(F.array_join(F.transform(r, lambda c: F.lower(clean(c))), "|"))), lambda r: r != "")
    seen = tables.withColumns({
        "cells_": cells, "keys_": rows, "tabled_": F.coalesce(F.col("caption").rlike(TABLE_CAPTION), F.lit(False)),
        "figured_": F.coalesce(F.col("figure_caption").rlike(FIGURE_CAPTION), F.lit(False)), "words_": F.filter(F.split(plain(F.col("caption")), " "), lambda w: F.length(w) >= 4),
    })
    n, tabled, figured, columns, height = F.greatest(F.size("cells_"), F.lit(1)), F.col("tabled_"), F.col("figured_"), F.col("n_cols"), F.size("rows")
    joined = F.array_join("cells_", " ")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    words = F.regexp_extract_all(joined, F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    numeric = share(F.size(F.filter(words, lambda w: w.rlike("[0-9]"))), F.size(words))
    mean, long = F.aggregate("cells_", F.lit(0), lambda a, c: a + F.length(c)) / n, F.size(F.filter("cells_", lambda c: F.length(c) >= 40)) / n
    repeated = F.when(F.size("keys_") > 0, 1 - F.size(F.array_distinct("keys_")) / F.size("keys_")).otherwise(0.0)
    told = F.size(F.filter("words_", lambda w: F.contains(plain(joined), w)))
    nearer = F.coalesce(figured & (F.col("figure_gap") + 48.0 < F.col("caption_gap")) & ((columns <= 2) | (height <= 2) | (long > 0.25)), F.lit(False))
    signals = (
        ("encoded_noise", joined.rlike(ENCODED) & ~tabled), ("figure_like_content", F.contains(F.lower(joined), F.lit("figure "))), ("caption_in_rows", told >= F.greatest(F.lit(2), F.floor(F.size("words_") / 2))),
        ("single_column", (columns <= 1) & (height >= 3)), ("wide_and_shallow", (height <= 2) & (columns >= 8) & ~tabled), ("shallow", (height <= 1) & (mean > 18.0) & ~tabled),
        ("prose_like_cells", (mean > 30.0) & (numeric < 0.05) & ~tabled), ("long_cells", (long > 0.45) & (numeric < 0.08) & ~tabled), ("repeated_rows", (repeated > 0.45) & (columns >= 6) & ~tabled),
        ("figure_caption_nearer", nearer),
    )
    counted = F.array_compact(F.array(*(F.when(when, name) for name, when in signals)))
    doubts = F.when(figured & ~tabled, F.array(F.lit("figure_caption_alone"))).when(F.size("cells_") == 0, F.array(F.lit("no_cells"))).otherwise(counted)
    alone = F.array_contains("doubts", "figure_caption_alone") | F.array_contains("doubts", "no_cells") | (nearer & ((columns <= 2) | (height <= 2)))
    judged = seen.withColumn("doubts", doubts).withColumn("false_positive", alone | (F.size("doubts") >= SIGNALS))
    return judged.drop("cells_", "keys_", "tabled_", "figured_", "words_")
