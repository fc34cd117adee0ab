"""Boxes on pages: measures, and joins of assets, captions and sections by place.

A box is a struct of x0, y0, x1, y1. Every join has (doc_id, page_no) as equal
keys, so what meets is one page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]


def _share(a: Column, b: Column, low: str, high: str) -> Column:
    """Common length of two boxes along one axis."""
    return F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def overlap(a: Column, b: Column) -> Column:
    return _share(a, b, "x0", "x1") * _share(a, b, "y0", "y1")


def iou(a: Column, b: Column) -> Column:
    joint = area(a) + area(b) - overlap(a, b)
    return F.when(joint > 0, overlap(a, b) / joint).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    low = lambda c: F.least(a[c], b[c]).alias(c)
    high = lambda c: F.greatest(a[c], b[c]).alias(c)
    return F.struct(low("x0"), low("y0"), high("x1"), high("y1"))


def gap(a: Column, b: Column, axis: str = "y") -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a[f"{axis}0"], b[f"{axis}0"]) - F.least(a[f"{axis}1"], b[f"{axis}1"]))


def share_of_narrower(a: Column, b: Column, axis: str = "x") -> Column:
    least = F.least(a[f"{axis}1"] - a[f"{axis}0"], b[f"{axis}1"] - b[f"{axis}0"])
    return F.when(least > 0, _share(a, b, f"{axis}0", f"{axis}1") / least).otherwise(0.0)


def page_bounds(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1) around all boxes of a page."""
    low, high = (lambda c: F.min(f"box.{c}").alias(c)), (lambda c: F.max(f"box.{c}").alias(c))
    return blocks.groupBy(*PAGE).agg(low("x0"), low("y0"), high("x1"), high("y1"))


def asset_blocks(assets: DataFrame, blocks: DataFrame, text_chars: int = 300) -> DataFrame:
    """(doc_id, page_no, asset_id, block_index, confidence, context): the best block of an asset's page.

    Overlapping blocks score by shares of both areas, others by nearness; ties to the earlier block.
    """
    b = blocks.select(*PAGE, "block_index", "text", F.col("box").alias("block_box"))
    met = assets.select(*PAGE, "asset_id", "box").join(b, PAGE)
    common = overlap(F.col("box"), F.col("block_box"))
    near = F.lit(0.04) / (1 + gap(F.col("box"), F.col("block_box")))
    score = F.when(common > 0, common / area(F.col("box")) * 0.8 + common / area(F.col("block_box")) * 0.2).otherwise(near)
    best = met.groupBy(*PAGE, "asset_id").agg(F.min(F.struct(F.round(-score, 9).alias("s"), "block_index", "text")).alias("best"))
    sure = F.least(F.lit(0.98), F.greatest(F.lit(0.25), -F.col("best.s")))
    return best.select(*PAGE, "asset_id", "best.block_index", F.round(sure, 6).alias("confidence"), F.substring("best.text", 1, text_chars).alias("context"))


def caption_bind(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, page_no, asset_id, caption_id, cost): the caption of least cost on a table's page."""
    a, b = F.col("box"), F.col("caption_box")
    met = tables.select(*PAGE, "asset_id", "box").join(captions.select(*PAGE, "caption_id", F.col("box").alias("caption_box")), PAGE)
    side = F.when(b["y1"] <= a["y0"], 0.0).when(b["y0"] >= a["y1"], 12.0).otherwise(20.0)
    centre = F.abs((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2)
    lone = ((b["x1"] - b["x0"]) < 0.35 * (a["x1"] - a["x0"])) & (centre > 0.5 * (a["x1"] - a["x0"]))
    cost = F.round(gap(a, b) + side + (1 - share_of_narrower(a, b)) * 90 + centre / 10 + F.when(lone, 55.0).otherwise(0.0), 6)
    best = met.groupBy(*PAGE, "asset_id").agg(F.min(F.struct(cost.alias("cost"), "caption_id")).alias("best"))
    return best.select(*PAGE, "asset_id", "best.caption_id", "best.cost")


def section_at(points: DataFrame, starts: DataFrame, slack: float = 8.0) -> DataFrame:
    """``points`` (doc_id, page_no, y) with the section last begun at or above y + slack on the page, else the page's first."""
    keyed = starts.select(*PAGE, "start_y", "section")
    met = points.join(keyed, PAGE, "left")
    above = F.when(F.col("start_y") <= F.col("y") + slack, F.struct("start_y", "section"))
    found = met.groupBy(*points.columns).agg(F.max(above).alias("last_"), F.min(F.struct("start_y", "section")).alias("first_"))
    return found.select(*points.columns, F.coalesce("last_.section", "first_.section").alias("section"))


def drop_owned(blocks: DataFrame, assets: DataFrame, padding: float = 6.0) -> DataFrame:
    """Blocks that no asset of the page owns: overlap of 0.45 of the block, centre inside, or short and centre in the padded box."""
    met = blocks.alias("b").join(
        assets.select(*PAGE, F.col("box").alias("asset_box")).alias("a"),
        [F.col(f"b.{c}") == F.col(f"a.{c}") for c in PAGE] + [_owned(F.col("b.box"), F.col("a.asset_box"), F.length("b.text"), padding)], "left_anti",
    )
    return met


def _owned(b: Column, a: Column, chars: Column, padding: float) -> Column:
    x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    inside = lambda p: x.between(a["x0"] - p, a["x1"] + p) & y.between(a["y0"] - p, a["y1"] + p)
    return (overlap(a, b) >= area(b) * 0.45) | inside(0.0) | ((chars <= 48) & inside(padding))


def pair_by_ordinal(images: DataFrame, captions: DataFrame) -> DataFrame:
    """``images`` with the caption that has the same place on the page, else null; both have ``at`` as their order."""
    place = lambda df: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*PAGE).orderBy("at")))
    texts = place(captions).select(*PAGE, "ordinal", F.col("text").alias("caption"))
    return place(images).join(texts, [*PAGE, "ordinal"], "left")


def text_rows(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``row_no``: a row ends where the next box begins below all boxes so far."""
    w = Window.partitionBy(*PAGE).orderBy("box.y0", "block_index")
    below = F.coalesce((F.col("box.y0") > F.max("box.y1").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    return boxes.withColumn("below_", below).withColumn("row_no", F.sum("below_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("below_")


def best_per_number(figures: DataFrame) -> DataFrame:
    """Of figures with one number on a page the one of highest score (ties to the smaller id); unnumbered ones all pass."""
    w = Window.partitionBy(*PAGE, "number").orderBy(F.desc("score"), "asset_id")
    return figures.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1 OR number IS NULL").drop("rn_")


def reading_order(blocks: DataFrame, width: float, wide: float = 0.6, margin: float = 0.05) -> DataFrame:
    """``blocks`` with ``reading_no`` (from 1) on their page.

    A page has two columns if two blocks or more lie in each half. Then wide
    blocks part it into bands, each read left column first; margin notes come last.
    """
    x0, x1 = F.col("box.x0"), F.col("box.x1")
    role = (
        F.when((x1 <= width * margin) | (x0 >= width * (1 - margin)), "margin").when(x1 - x0 >= width * wide, "wide")
        .when(x1 <= width / 2, "left").when(x0 >= width / 2, "right").otherwise("wide")
    )
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("box.y0", "box.x0", "block_index").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumn("role_", role)
    two = (F.count_if(F.col("role_") == "left").over(page) >= 2) & (F.count_if(F.col("role_") == "right").over(page) >= 2)
    column = F.when(F.col("role_") == "margin", 3).when(~F.col("two_"), 0).when(F.col("role_") == "left", 1).when(F.col("role_") == "right", 2).otherwise(0)
    band = F.when(F.col("role_") == "margin", F.lit(None)).when(F.col("two_"), F.count_if(F.col("role_") == "wide").over(down)).otherwise(0)
    keyed = marked.withColumn("two_", two).withColumn("column_", column).withColumn("band_", band)
    order = page.orderBy(F.asc_nulls_last("band_"), "column_", "box.y0", "box.x0", "block_index")
    return keyed.withColumn("reading_no", F.row_number().over(order)).drop("role_", "two_", "column_", "band_")


def box_clusters(boxes: DataFrame, reach: float = 0.0) -> DataFrame:
    """(doc_id, page_no, block_index, cluster): boxes of a page linked over gaps of at most ``reach``; a cluster is its least block_index."""

    def one(page: list[dict]) -> list[dict]:
        label, seen = [0] * len(page), np.zeros(len(page), bool)
        sides = np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in page])
        for i, first in enumerate(page):
            waiting = [] if seen[i] else [i]
            seen[i] = True
            while waiting:
                at = waiting.pop()
                label[at] = first["block_index"]
                near = ~seen & (sides[:, :2] <= sides[at, 2:] + reach).all(axis=1) & (sides[at, :2] <= sides[:, 2:] + reach).all(axis=1)
                seen |= near
                waiting += np.flatnonzero(near).tolist()
        return [{"block_index": b["block_index"], "cluster": c} for b, c in zip(page, label, strict=True)]

    @F.pandas_udf("array<struct<block_index:int,cluster:int>>")
    def clusters(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    page = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_index", "box.*"))).alias("b"))
    return page.select(*PAGE, F.explode(clusters("b")).alias("c")).select(*PAGE, "c.*")


def merge_fragments(pieces: DataFrame, most_gap: float = 14.0, share: float = 0.9, overlap: float = 2.0, few: int = 2) -> DataFrame:
    """(doc_id, page_no, piece_id, n_pieces, n_cols, box): stacked pieces (piece_id, n_cols, box, and n_rows where known) of a table as one.

    From the top of a page down, a piece joins the table above it if both have as many columns, the gap to
    the box around all of that table's pieces is small, they share most of the narrower width, and either has ``few``
    rows or fewer (where rows are known). The box grows with each piece, so this is one fold over a page.
    """
    rows = F.coalesce(F.col("n_rows"), F.lit(0)) if "n_rows" in pieces.columns else F.lit(0)
    one = F.struct(F.col("box.y0").alias("y"), "piece_id", "n_cols", rows.cast("long").alias("rows"), F.struct(*(F.col(f"box.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias("box"), F.lit(1).alias("n"))
    pages = pieces.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("p"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        down = x["box"]["y0"] - last["box"]["y1"]
        fits = (last["n_cols"] == x["n_cols"]) & (x["n_cols"] > 0) & (down >= -overlap) & (down <= most_gap) & (share_of_narrower(last["box"], x["box"]) >= share) & ((last["rows"] <= few) | (x["rows"] <= few))
        edge = lambda f, c: f(last["box"][c], x["box"][c]).alias(c)
        whole = F.struct(
            last["y"].alias("y"), F.least(last["piece_id"], x["piece_id"]).alias("piece_id"), last["n_cols"].alias("n_cols"), (last["rows"] + x["rows"]).alias("rows"),
            F.struct(edge(F.least, "x0"), edge(F.least, "y0"), edge(F.greatest, "x1"), edge(F.greatest, "y1")).alias("box"), (last["n"] + 1).alias("n"),
        )
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(x)))

    merged = pages.select(*PAGE, F.explode(F.aggregate(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1), step)).alias("t"))
    return merged.select(*PAGE, "t.piece_id", F.col("t.n").cast("long").alias("n_pieces"), "t.n_cols", "t.box")


def assign_captions(regions: DataFrame, captions: DataFrame, most_gap: float = 180.0, least_share: float = 0.12) -> DataFrame:
    """(doc_id, page_no, caption_id, region_id, relaxed): regions (region_id, box, tiles) to captions (caption_id, box), one to one on a page.

    Captions choose in order of caption_id, each the best free region that stands
    above or below it, near enough and over enough of its width; ties to the
    smaller region_id. Captions left over choose again among the regions left,
    with ``relaxed`` limits; the last region left may stand beside them. Pairs
    are scored in the join; only ids and scores of a page reach one task.
    """
    a, b = F.col("box"), F.col("caption_box")
    met = regions.select(*PAGE, "region_id", "box", "tiles").join(captions.select(*PAGE, "caption_id", F.col("box").alias("caption_box")), PAGE)
    wide = lambda x: x["x1"] - x["x0"]
    above, below = a["y1"] - b["y0"], b["y1"] - a["y0"]  # how far they reach into one another
    score = (
        F.least(F.lit(4.5), area(a) / 30000.0) + F.least(F.lit(2.5), F.greatest(F.coalesce("tiles", F.lit(1)), F.lit(0)) * 0.14) + share_of_narrower(a, b) * 1.8
        + _share(a, b, "x0", "x1") / F.greatest(wide(b), F.lit(1e-6)) * 1.8 + overlap(a, b) / F.greatest(area(b), F.lit(1e-6)) * 0.6 - gap(a, b) / 150.0
        + F.when(above <= 10.0, 0.9).when(below <= 10.0, 0.15).otherwise(-0.2)
    )
    measured = met.select(*PAGE, "region_id", "caption_id", F.round(score, 9).alias("score"), gap(a, b).alias("gap"), share_of_narrower(a, b).alias("share"), F.least(above, below).alias("into"))
    near = measured.filter((F.col("gap") <= most_gap * 1.6) & (F.col("into") <= 10.0))
    alive = regions.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_regions"))
    pair = "array<struct<caption_id:int,region_id:int,relaxed:boolean>>"

    def one(pairs: list[dict], n_regions: int) -> list[dict]:
        taken: dict[int, dict] = {}
        for relaxed in (False, True):
            for caption in sorted({p["caption_id"] for p in pairs} - {t["caption_id"] for t in taken.values()}):
                last = n_regions - len(taken) == 1
                strict = lambda p: p["share"] >= least_share and p["gap"] <= most_gap and p["into"] <= 6.0
                fits = [p for p in pairs if p["caption_id"] == caption and p["region_id"] not in taken and ((p["share"] >= 0.2 * least_share or last) if relaxed else strict(p))]
                if fits:
                    best = min(fits, key=lambda p: (-p["score"], p["region_id"]))["region_id"]
                    taken[best] = {"caption_id": caption, "region_id": best, "relaxed": relaxed}
        return list(taken.values())

    @F.pandas_udf(pair)
    def assigned(pages: pd.Series, n_regions: pd.Series) -> pd.Series:
        return pd.Series([one(list(p), n) for p, n in zip(pages, n_regions, strict=True)], dtype=object)

    per_page = near.groupBy(*PAGE).agg(F.collect_list(F.struct("caption_id", "region_id", "score", "gap", "share", "into")).alias("pairs"))
    return per_page.join(alive, PAGE).select(*PAGE, F.inline(assigned("pairs", "n_regions")))
