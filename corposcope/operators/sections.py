"""Sections and headings of documents: trees, runs, merging, catalogues, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions.text import heading_norm, heading_variants, loose_norm

LEVELS = range(1, 7)


def section_tree(headings: DataFrame) -> DataFrame:
    """``headings`` (doc_id, pos, level 1 to 6) with ``parent`` (nearest earlier smaller level) and ``end`` (next of its level or a smaller one).

    There are six levels, so both are six running values of one window, without a self-join.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    at = lambda n: F.when(F.col("level") == n, F.col("pos"))
    wide = headings.withColumns({f"before{n}_": F.last(at(n), ignorenulls=True).over(before) for n in LEVELS} | {f"after{n}_": F.first(at(n), ignorenulls=True).over(after) for n in LEVELS})
    parent = F.greatest(*(F.when(F.col("level") > n, F.col(f"before{n}_")) for n in LEVELS))
    end = F.least(*(F.when(F.col("level") >= n, F.col(f"after{n}_")) for n in LEVELS))
    return wide.select(*headings.columns, parent.alias("parent"), end.alias("end"))


def drop_empty_headings(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, pos, is_heading, text) without headings that nothing but blanks follows before the next one."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("part_", F.sum(F.col("is_heading").cast("int")).over(w))
    filled = F.count_if(~F.col("is_heading") & (F.trim("text") != "")).over(Window.partitionBy("doc_id", "part_"))
    return grouped.withColumn("filled_", filled).filter("NOT is_heading OR filled_ > 0").select(*lines.columns)


def heading_runs(lines: DataFrame, least_level: int = 3) -> DataFrame:
    """(doc_id, level, first, last, n): two or more headings of one deep level without prose between."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    new = ~F.col("level").eqNullSafe(F.lag("level").over(w))
    marked = lines.withColumn("new_", new.cast("int"))
    marked = marked.withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.filter(F.col("level") >= least_level).groupBy("doc_id", "run_", "level")
    return found.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("run_")


def reference_start(lines: DataFrame, looks: Column, share: float = 0.55, run: int = 3) -> DataFrame:
    """(doc_id, pos): where, after ``share`` of a document, the first ``run`` lines in a row look like references."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    late = lines.withColumn("top_", F.max("pos").over(Window.partitionBy("doc_id"))).filter(F.col("pos") >= F.col("top_") * share)
    flags = late.withColumn("ok_", looks.cast("int"))
    whole = reduce(lambda a, i: a + F.lead("ok_", i, 0).over(w), range(1, run), F.col("ok_"))
    return flags.withColumn("all_", whole).filter(F.col("all_") == run).groupBy("doc_id").agg(F.min("pos").alias("pos"))


def merge_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, text): empty sections go, neighbours of equal level and title become one."""
    full = sections.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy("doc_id").orderBy("pos")
    same = F.lag("level").over(w).eqNullSafe(F.col("level")) & F.lag("title").over(w).eqNullSafe(F.col("title"))
    marked = full.withColumn("new_", (~same).cast("int")).withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return marked.groupBy("doc_id", "run_", "level", "title").agg(F.min("pos").alias("pos"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")).drop("run_")


def propagate_heading(blocks: DataFrame, weak: tuple[str, ...] = ("", "front_matter", "abstract", "other"), least: int = 40) -> DataFrame:
    """Long enough blocks whose section says little take that of the last heading above them on the page."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last("heading", ignorenulls=True).over(w)
    poor = F.coalesce("section", F.lit("")).isin(*weak) & (F.length("text") >= least)
    return blocks.withColumn("above_", above).withColumn("section", F.when(poor, F.coalesce("above_", "section")).otherwise(F.col("section"))).drop("above_")


def section_catalog(blocks: DataFrame, titles: int = 8) -> DataFrame:
    """(doc_id, section, n_blocks, n_pages, first_page, first_index, titles, mean_confidence)."""
    first = F.min(F.struct("page_no", "block_index"))
    return blocks.groupBy("doc_id", "section").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("page_no").alias("n_pages"), first.alias("at"),
        F.array_join(F.slice(F.array_sort(F.collect_set("title")), 1, titles), "|").alias("titles"), F.round(F.avg("confidence"), 3).alias("mean_confidence"),
    ).select("doc_id", "section", "n_blocks", "n_pages", F.col("at.page_no").alias("first_page"), F.col("at.block_index").alias("first_index"), "titles", "mean_confidence")


def section_text(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, section, text): distinct texts of a section in order of their first place, joined by newlines; with ``most`` its first characters alone."""
    once = blocks.groupBy("doc_id", "section", "text").agg(F.min(F.struct("page_no", "block_index")).alias("at"))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return once.groupBy("doc_id", "section").agg((text if most is None else F.substring(text, 1, most)).alias("text"))


def majority_section(blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, section, n): the section that most blocks of a chunk have; ties to the one seen first."""
    counts = blocks.groupBy("doc_id", "chunk_no", "section").agg(F.count(F.lit(1)).alias("n"), F.min("block_index").alias("seen"))
    best = counts.groupBy("doc_id", "chunk_no").agg(F.min(F.struct((-F.col("n")).alias("m"), "seen", "section")).alias("b"))
    return best.select("doc_id", "chunk_no", "b.section", (-F.col("b.m")).alias("n"))


def heading_audit(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, n_headings, most_repeats, issues) with pages (doc_id, n_pages)."""
    per = headings.groupBy("doc_id", F.lower(F.trim("title")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("doc_id").agg(F.sum("n").alias("n_headings"), F.max("n").alias("most_repeats")).join(pages, "doc_id")
    issues = F.array_compact(F.array(F.when(F.col("n_headings") > F.greatest(F.lit(24), 2 * F.col("n_pages") + 6), "too_many_headings"), F.when(F.col("most_repeats") > 3, "repeated_heading")))
    return total.select("doc_id", "n_headings", "most_repeats", F.array_join(issues, ",").alias("issues"))


def dedupe_headings(headings: DataFrame) -> DataFrame:
    """The first heading of each (document, normalised title, level)."""
    norm = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    w = Window.partitionBy("doc_id", norm, "level").orderBy("pos")
    return headings.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def seed_page_hints(headings: DataFrame, references: DataFrame) -> DataFrame:
    """``headings`` (doc_id, pos, title, canonical) with ``page`` from references (doc_id, title, canonical, page): by title, else by canonical name; the first page counts."""
    by = lambda key, name: references.groupBy("doc_id", key).agg(F.min("page").alias(name))
    met = headings.join(by("title", "by_title_"), ["doc_id", "title"], "left").join(by("canonical", "by_name_"), ["doc_id", "canonical"], "left")
    return met.select(*headings.columns, F.coalesce("by_title_", "by_name_").alias("page"))


def set_recall(predicted: DataFrame, gold: DataFrame, value: str) -> DataFrame:
    """(doc_id, n_gold, n_found, recall) of a document's distinct gold values among the predicted ones."""
    found = predicted.select("doc_id", value).distinct().withColumn("found_", F.lit(1))
    met = gold.select("doc_id", value).distinct().join(found, ["doc_id", value], "left")
    return met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("found_").alias("n_found"), F.round(F.count("found_") / F.count(F.lit(1)), 6).alias("recall"))


def section_assets(targets: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, section, asset_id): a section's assets; if it has none, those on its pages without a section.

    ``targets`` has a row (doc_id, section, page_no) for each page of a section;
    ``assets`` has doc_id, page_no, asset_id, section.
    """
    named = targets.select("doc_id", "section").distinct()
    own = named.join(assets.select("doc_id", "section", "asset_id"), ["doc_id", "section"])
    loose = assets.filter(F.lower(F.trim(F.coalesce("section", F.lit("")))).isin("", "other", "unknown")).select("doc_id", "page_no", "asset_id")
    lacking = targets.join(own.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    return own.unionByName(lacking.join(loose, ["doc_id", "page_no"]).select("doc_id", "section", "asset_id").distinct())


def anchor_in_section(anchors: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, anchor, n_found, correct): sections of the document that hold an anchor, and whether one has the expected heading.

    ``anchors``: doc_id, anchor, expected; ``parts``: doc_id, title, text.
    """
    shaped = parts.select("doc_id", heading_variants(F.col("title")).alias("titles_"), loose_norm(F.col("text")).alias("text_"))
    met = anchors.join(shaped, "doc_id", "left")
    holds = F.coalesce(F.contains("text_", loose_norm(F.col("anchor"))), F.lit(False))
    right = holds & F.arrays_overlap("titles_", heading_variants(F.col("expected")))
    return met.groupBy("doc_id", "anchor", "expected").agg(F.count_if(holds).alias("n_found"), F.coalesce(F.bool_or(right), F.lit(False)).alias("correct")).drop("expected")


def heading_figures(lines: DataFrame) -> DataFrame:
    """(doc_id, n_headings, n_duplicates, n_empty, n_runs, longest_run): headings of a document without its gold.

    A run is two headings or more with nothing but blanks between; an empty heading has no prose before the next one or the end.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    full = lines.filter(F.col("is_heading") | (F.trim("text") != ""))
    marked = full.withColumn("empty_", F.col("is_heading") & F.coalesce(F.lead("is_heading").over(w), F.lit(True)))
    marked = marked.withColumn("new_", (~(F.col("is_heading") & F.coalesce(F.lag("is_heading").over(w), F.lit(False)))).cast("int"))
    marked = marked.filter("is_heading").withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("norm_", heading_norm(F.col("text")))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "run_"))
    sized = marked.withColumn("size_", size)
    return sized.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_headings"), (F.count(F.lit(1)) - F.count_distinct("norm_")).alias("n_duplicates"), F.count_if("empty_").alias("n_empty"),
        F.count_if((F.col("size_") > 1) & (F.col("new_") == 1)).alias("n_runs"), F.max("size_").alias("longest_run"),
    )
