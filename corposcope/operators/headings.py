"""Headings of documents: lines that look like one, their places among blocks, and the choice between sources of headings."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions import headings as H
from corposcope.functions.text import SECTION_PATTERNS, canonical_heading
from corposcope.sources.index import shared_folder

# The least score of a place by source, what a source adds to it, and the least score of a local anchor.
LEAST = {"pdf_toc": 0.48, "grobid": 0.58, "arxiv_source": 0.56, "heuristic": 0.44}
LEAST_OTHER, ADDED, ANCHOR_LEAST, GIVEN_PLACE = 0.6, {"pdf_toc": 0.04, "arxiv_source": 0.02, "grobid": 0.01}, 1.02, 1.3
# Sources of headings in order of preference, with their bonus and the share of their headings that should be placed.
SOURCES = (("pdf_toc", 1.25, 0.55), ("arxiv_source", 1.1, 0.6), ("grobid", 1.0, 0.55), ("heuristic", 0.7, None))
OTHER_BONUS = 0.6
# What a mention counts at least and for its words, a heading anywhere in a first line, and the text of a block beside its first line.
MENTION_LEAST, MENTION, INSIDE_LINE, OF_BLOCK = 0.22, 0.55, 0.35, 0.82
# What equal, contained and equally named titles add to an anchor, and equal and lower levels.
SAME_TITLE, PART_OF_TITLE, SAME_NAME, SAME_LEVEL, LOWER_LEVEL = 0.45, 0.18, 0.35, 0.06, -0.08
# Sections one of which a paper's source should have.
EARLY = ("abstract", "introduction", "related_work", "methodology", "experiments", "results")


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed here; a generator keeps the optimizer from copying them into each expression that uses them."""
    kept = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("held_"))
    return kept.select("*", *(F.col(f"held_.{n}").alias(n) for n in columns)).drop("held_")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: what follows reads it instead of computing ``df`` again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _styled(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``line_``, their first line, and the measures of their look where they have none."""
    looks = {"line_count": F.lit(1), "char_count": F.length(F.trim("text")), "max_font": F.lit(0.0), "bold_ratio": F.lit(0.0), "body_font": F.lit(0.0)}
    have = {c: F.coalesce(F.col(c), default) if c in blocks.columns else default for c, default in looks.items()}
    lines = F.filter(F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), "\0", ""), "[\n\r]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    cut = _held(blocks.withColumns(have), lines_=lines)
    return _held(cut, line_=F.coalesce(F.get("lines_", F.lit(0)), F.lit("")), second_=F.coalesce(F.get("lines_", F.lit(1)), F.lit(""))).drop("lines_")


def heading_shapes(lines: DataFrame) -> DataFrame:
    """``lines`` (text) with ``numeric_title``, ``roman_title``, ``marker``, ``phrase``, ``prose`` and ``plausible`` of each."""
    t, none = F.col("text"), F.lit("")
    staged = _held(_held(lines, title_=H.clean_title(t)), key_=H.heading_key(F.col("title_")))
    # only lines with an outline number are cut into words for its title
    numeric, roman = F.when(t.rlike(H.NUMBERED), H.numeric_title(t)).otherwise(none), F.when(t.rlike(H.ROMAN), H.roman_title(t)).otherwise(none)
    return staged.withColumns({
        "numeric_title": numeric, "roman_title": roman, "marker": H.is_marker(t), "phrase": H.heading_phrase(t), "prose": H.reads_as_prose(t), "plausible": H.plausible_title(t, F.col("title_"), F.col("key_")),
    }).drop("title_", "key_")


def heading_anchors(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_index, page_no, title, level): blocks whose first line is a heading by its own look.

    blocks (doc_id, block_index, page_no, text) and, where known, line_count, char_count, max_font, bold_ratio
    and body_font. A number alone takes the next line of its block for its
    title, else the first line of the next block. An unnumbered line needs capitals and a
    larger or bolder font.
    """
    b = _styled(blocks)
    after = F.coalesce(F.lead("line_").over(Window.partitionBy("doc_id").orderBy("block_index")), F.lit(""))
    line, second, low, numeric, roman = F.col("line_"), F.col("second_"), F.lower("line_"), F.col("numeric_"), F.col("roman_")
    b = b.withColumn("after_", after).filter("line_ <> ''")
    fit = lambda x: (x != "") & ~H.reads_as_prose(x) & (H.heading_phrase(x) | H.plausible_title(x))
    beside = F.when(H.is_marker(line), F.when(fit(second), H.clean_title(second)).when(fit(F.col("after_")), H.clean_title(F.col("after_"))))
    b = _held(b, numeric_=F.when(line.rlike(H.NUMBERED), H.numeric_title(line)).otherwise(""), roman_=F.when(line.rlike(H.ROMAN), H.roman_title(line)).otherwise(""), beside_=F.coalesce(beside, F.lit("")))
    words = F.split(line, " ")
    large = ((F.col("body_font") > 0) & (F.col("max_font") >= F.col("body_font") + 0.9)) | (F.col("bold_ratio") >= 0.4)
    short = F.size(words).between(1, 12) & (F.col("line_count") <= 2) & (F.col("char_count") <= 140) & ~low.rlike("^(?:figure|table|algorithm|arxiv:|https?://)")
    styled = large & short & (H._capitalised(words) >= F.greatest(F.lit(2), F.size(words) - 1))
    title = (
        F.when(low.startswith("abstract"), "Abstract").when(low.startswith("references"), "References").when(numeric != "", numeric).when(roman != "", roman)
        .when(F.col("beside_") != "", F.col("beside_")).when(styled, line)
    )
    level = F.when((numeric != "") & ~low.rlike("^(?:abstract|references)"), H.title_level(line)).otherwise(1)
    found = _held(b, title=H.clean_title(title), level=level).filter("title <> ''")
    t = F.col("title")
    found = _held(found, key_=H.heading_key(t)).filter(~F.lower(t).rlike("^(?:we|our|this|these|those) ") & ~H.reads_as_prose(t) & H.plausible_title(t, t, F.col("key_")))
    return found.select("doc_id", "block_index", "page_no", "title", "level")


def _look() -> Column:
    """What the look of a block's first line adds to its score as a heading's place."""
    line = F.col("line_")
    points = (
        (0.08, F.col("line_count") <= 2), (0.13, H.heading_phrase(line)), (0.1, (line.rlike(H.NUMBERED) & (H.numeric_title(line) != "")) | (line.rlike(H.ROMAN) & (H.roman_title(line) != ""))),
        (0.1, (F.col("body_font") > 0) & (F.col("max_font") >= F.col("body_font") + 0.6)), (-0.25, F.lower(line).rlike(H.FLOAT_TITLE)), (-0.22, H.is_marker(line)),
    )
    bold = F.when(F.col("bold_ratio") >= 0.25, F.least(F.lit(0.12), F.col("bold_ratio") * 0.2)).otherwise(0.0)
    return reduce(lambda a, p: a + F.when(p[1], p[0]).otherwise(0.0), points, bold)


def heading_windows(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """``heads`` with ``low`` and ``high``, the first and last place (block number in the document) to look at; null: no bound.

    A heading with a page looks from that page to the second after it; one without looks no further
    than the page after that of the next heading with a page. Pages that the document lacks count as none.
    """
    pages = blocks.groupBy("doc_id", "page_no").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    hinted = heads.join(pages.select("doc_id", F.col("page_no").alias("page_hint"), F.col("first").alias("low")), ["doc_id", "page_hint"], "left")
    after = Window.partitionBy("doc_id").orderBy("heading_no").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("low").isNotNull(), F.col("page_hint")), ignorenulls=True).over(after)
    until = F.when(F.col("low").isNotNull(), F.col("page_hint") + 2).when(F.col("page_hint").isNull(), following + 1)
    since = F.when(F.col("low").isNotNull(), F.col("page_hint")).otherwise(following)
    bounded = hinted.withColumns({"since_": since, "until_": until})
    looked = bounded.filter("until_ IS NOT NULL").select("doc_id", "heading_no", F.explode(F.sequence("since_", "until_")).alias("page_no")).join(pages, ["doc_id", "page_no"])
    high = looked.groupBy("doc_id", "heading_no").agg(F.max("last").alias("high"))
    return bounded.join(high, ["doc_id", "heading_no"], "left").drop("since_", "until_")


def text_share(key: str, other: str) -> float:
    """The share of a key's words that stand somewhere in another string."""
    words = key.split()
    return sum(w in other for w in words) / max(1, len(words))


def text_score(key: str, other: str) -> float:
    """How far ``other`` begins like a heading: 1 where the heading begins it; a mention further on counts little."""
    if not key or not other:
        return 0.0
    if key in other:
        return 1.0 if other.startswith(key) else max(MENTION_LEAST, MENTION * text_share(key, other))
    beginning = " ".join(other.split()[:20])
    share = text_share(key, beginning)
    # no two strings are more alike than their lengths allow
    return share if 2 * min(len(key), len(beginning)) <= share * (len(key) + len(beginning)) else max(share, H.ratio(key, beginning))


def page_score(hint: int | None, page: int, near: tuple[float, float], far: float, from_: int) -> float:
    """A bonus for the hinted page or the one beside it, a penalty growing from the third."""
    if hint is None:
        return 0.0
    apart = abs(page - hint)
    return near[apart] if apart < 2 else -min(0.25, far * (apart - from_)) if apart > 2 else 0.0


def place_score(head: dict, block: dict) -> float:
    """The score of a block as the place of a heading."""
    key, line = head["key"], block["line_key"]
    text = max(text_score(key, line), text_share(key, line) if line else 0.0, INSIDE_LINE if key in line else 0.0, float(line == key or line.startswith(key + " ")))
    if text < 0.9:
        text = max(text, OF_BLOCK * text_score(key, " ".join(block["key"].split()[:20])))
    return text + block["look"] + page_score(head["page_hint"], block["page_no"], (0.12, 0.04), 0.04, 1) + ADDED.get(head["source"], 0.0)


def anchor_score(head: dict, anchor: dict) -> float:
    """How well a heading that stands in the text is the one looked for."""
    key, other = head["key"], anchor["key"]
    if not key or not other:
        return 0.0
    same = SAME_TITLE if key == other else PART_OF_TITLE if key in other or other in key else 0.0
    level = SAME_LEVEL if head["level"] == anchor["level"] else LOWER_LEVEL if (head["level"], anchor["level"]) == (1, 2) else 0.0
    return H.ratio(key, other) + same + level + SAME_NAME * (head["canonical"] == anchor["canonical"]) + page_score(head["page_hint"], anchor["page_no"], (0.2, 0.1), 0.05, 2)


def placed(heads: list[dict], blocks: list[dict], anchors: list[dict]) -> list[tuple[int, int, float]]:
    """(heading_no, place, score) of the headings of one document that find a place, each after the one before."""
    found, at = [], 0
    for head in heads:
        if not head["key"]:
            continue
        given = head["block_hint"]
        if given is not None and at <= given < len(blocks):
            best = (GIVEN_PLACE, given)
        else:
            ranked = [(anchor_score(head, a), a["pos"]) for a in anchors if a["pos"] >= at]
            ranked = [max(ranked, key=lambda r: r[0])] if ranked else []
            ranked = [r for r in ranked if r[0] >= ANCHOR_LEAST]
            low = at if head["low"] is None else max(at, head["low"])
            high = len(blocks) - 1 if head["high"] is None else head["high"]
            high = max(low, high) if head["low"] is not None else high  # past its window a heading with a page still looks at one block
            ranked += [(place_score(head, b), b["pos"]) for b in blocks[low : high + 1]]
            best = max(ranked, key=lambda r: r[0], default=(-1.0, -1))
        if best[0] >= LEAST.get(head["source"], LEAST_OTHER) and best[1] >= 0:
            found.append((head["heading_no"], best[1], best[0]))
            at = max(at, best[1] + 1)
    return found


PLACES = "array<struct<heading_no:int,pos:int,score:double>>"


def heading_align(heads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, heading_no, block_index, page_no, score): the block at which each heading stands, in the order of the headings.

    heads (doc_id, heading_no, title, level, source, page_hint, block_hint), blocks as for
    ``heading_anchors``; ``block_hint`` counts blocks from 0. Keys, looks, windows and anchors are
    joins and columns; what depends on the place of the heading before is one small loop over a
    document, which is one row. A heading whose score is below its source's least is left out.
    Documents without headings or blocks give no rows.
    """
    styled = _styled(blocks)
    b = styled.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index")) - 1)
    # written once: windows, anchors and places read it again, and would each derive all lines anew
    features = _written(b.select("doc_id", "pos", "block_index", "page_no", H.heading_key(F.substring("text", 1, 320)).alias("key"), H.heading_key(F.col("line_")).alias("line_key"), F.round(_look(), 9).alias("look")))
    with_heads = features.join(heads.select("doc_id").distinct(), "doc_id", "left_semi")
    key = H.heading_key(F.col("title"))
    asked = heading_windows(heads.select("doc_id", "heading_no", key.alias("key"), canonical_heading(F.col("title")).alias("canonical"), "level", "source", "page_hint", "block_hint"), with_heads)
    anchors = heading_anchors(blocks).join(features.select("doc_id", "block_index", "pos"), ["doc_id", "block_index"])
    listed = lambda df, name, *columns: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    rows = listed(with_heads, "blocks", "pos", "page_no", "key", "line_key", "look").join(listed(asked, "heads", "heading_no", "key", "canonical", "level", "source", "page_hint", "block_hint", "low", "high"), "doc_id")
    rows = rows.join(listed(anchors, "anchors", "pos", H.heading_key(F.col("title")).alias("key"), canonical_heading(F.col("title")).alias("canonical"), "level", "page_no"), "doc_id", "left")

    @F.pandas_udf(PLACES)
    def places(heads: pd.Series, blocks: pd.Series, anchors: pd.Series) -> pd.Series:
        def one(h, b, a):
            whole = [[{k: None if v is None or v != v else v if k == "look" or isinstance(v, str) else int(v) for k, v in r.items()} for r in x] for x in (h, b, a if a is not None else [])]
            return [{"heading_no": n, "pos": p, "score": round(s, 6)} for n, p, s in placed(*whole)]

        return pd.Series([one(*x) for x in zip(heads, blocks, anchors, strict=True)], dtype=object)

    found = rows.select("doc_id", F.inline(places("heads", "blocks", "anchors")))
    return found.join(features.select("doc_id", "pos", "block_index", "page_no"), ["doc_id", "pos"]).select("doc_id", "heading_no", "block_index", "page_no", "score")


def source_scores(heads: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_headings, n_placed, score) of each source of headings of a document.

    heads (doc_id, source, page_hint, title_like), spans (doc_id, source, pos, canonical, confidence, start_page,
    end_page) of the headings placed, documents (doc_id, total_pages). ``title_like`` marks headings that repeat the document's title.
    Coverage, confidence, core sections and variety count for a source; sections too
    long, late or many, and names made from long titles, against it. A source without a placed heading gets -1.
    """
    known = [*(name for name, _ in SECTION_PATTERNS), "front_matter", "other"]
    slug = lambda least: ~F.col("canonical").isin(*known) & (F.size(F.split("canonical", "_")) >= least)
    of_heads = heads.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("title_like", F.lit(False))).alias("title_like"))
    crowded = heads.filter("page_hint > 0").groupBy("doc_id", "source", "page_hint").agg(F.count(F.lit(1)).alias("c")).groupBy("doc_id", "source").agg(F.max("c").alias("on_page"))
    length = F.greatest(F.lit(1), F.col("end_page") - F.col("start_page") + 1)
    first_of = lambda name, value: F.min_by(F.when(F.col("canonical") == name, value), F.when(F.col("canonical") == name, F.col("pos")))
    s = spans.filter("canonical <> 'front_matter'").groupBy("doc_id", "source").agg(
        F.count(F.lit(1)).alias("m"), F.avg("confidence").alias("sure"), F.count_if(F.col("canonical").isin(*H.CORE)).alias("core"), F.count_distinct("canonical").alias("kinds"), F.max(length).alias("longest"),
        first_of("abstract", length).alias("abstract"), first_of("introduction", F.col("start_page")).alias("intro"), F.min("start_page").alias("first"), F.bool_or(F.col("canonical").isin(*EARLY)).alias("early"),
        F.count_if(slug(6)).alias("slugs6"), F.count_if(slug(5)).alias("slugs5"), F.count_if(F.col("canonical") == "references").alias("refs"),
    )
    r = of_heads.join(crowded, ["doc_id", "source"], "left").join(s, ["doc_id", "source"], "left").join(documents.select("doc_id", F.col("total_pages").alias("pages")), "doc_id", "left")
    c = {k: F.col(k) for k in ("n", "m", "pages", "core", "longest", "abstract", "intro", "first", "on_page", "refs", "slugs5", "slugs6", "title_like")}
    is_ = lambda name: F.col("source") == name
    when = lambda cond, value: F.when(cond, value).otherwise(0.0)
    up_to = lambda most, value: F.least(F.lit(most), value)
    bonus = reduce(lambda a, x: a.when(is_(x[0]), x[1]), SOURCES[1:], F.when(is_(SOURCES[0][0]), SOURCES[0][1])).otherwise(OTHER_BONUS)
    expected = reduce(lambda a, x: a.when(is_(x[0]), x[2]), SOURCES[1:3], F.when(is_(SOURCES[0][0]), SOURCES[0][2]))
    lacking = F.greatest(F.lit(1), F.bround(c["n"] * expected, 0)) - c["m"]
    core, long, paged = c["core"] / c["m"], c["longest"] / c["pages"], c["pages"] > 0
    part, late = c["abstract"] / c["pages"], F.greatest(F.lit(3), F.floor(c["pages"] * 0.35))
    packed = c["on_page"] / c["n"]
    terms = (
        bonus, F.least(c["m"], F.lit(8)) * 0.25, c["m"] / c["n"] * 1.5, F.col("sure") * 0.5, F.col("kinds") / c["m"] * 0.4, core * 0.9,
        # too few of the headings placed
        -when(lacking > 0, up_to(3.8, lacking * 0.75)),
        # sections that are too long or begin too late
        -when(paged & (long > 0.6), (long - 0.6) * 2.4), -when(paged & (c["abstract"] > 2), up_to(1.2, (c["abstract"] - 2) * 0.45)), -when((c["pages"] >= 6) & (part > 0.22), up_to(5.0, (part - 0.22) * 11.5)),
        -when((c["pages"] >= 8) & (c["intro"] > late), up_to(3.0, (c["intro"] - late) * 0.55)),
        # outlines that are short or hold the title
        -when(is_("pdf_toc") & (c["n"] <= 3), F.when(c["n"] <= 2, 1.2).otherwise(0.8)), -when(is_("pdf_toc"), up_to(3.2, c["title_like"] * 1.6)), -when(is_("pdf_toc"), up_to(2.8, c["slugs6"] * 1.4)),
        # guesses that are many, crowded or odd
        -when(is_("heuristic") & (core < 0.55), up_to(2.4, (0.55 - core) * 4.0)), -when(is_("heuristic") & (c["n"] > 18), up_to(4.5, (c["n"] - 18) * 0.35 + 1.0)), -when(is_("heuristic") & c["n"].between(13, 18), (c["n"] - 12) * 0.15),
        -when(is_("heuristic") & (c["on_page"] >= 6), up_to(2.4, (c["on_page"] - 5) * 0.35)), -when(is_("heuristic") & (packed >= 0.55) & (c["n"] >= 8), up_to(1.6, (packed - 0.5) * 4.0)),
        -when(is_("heuristic") & (c["refs"] >= 3), up_to(1.8, (c["refs"] - 2) * 0.4)), -when(is_("heuristic"), up_to(3.2, c["slugs5"] * 0.22)),
        # sources that begin late or lack the usual sections
        -when(is_("arxiv_source") & (c["pages"] >= 8) & (c["first"] > 3), up_to(6.0, (c["first"] - 3) * 0.6)), -when(is_("arxiv_source") & (c["pages"] >= 8) & ~F.col("early"), 3.0),
    )
    score = F.when(F.coalesce("m", F.lit(0)) > 0, F.round(reduce(lambda a, x: a + x, terms), 6)).otherwise(-1.0)
    return r.select("doc_id", "source", F.col("n").alias("n_headings"), F.coalesce("m", F.lit(0)).alias("n_placed"), score.alias("score"))


def strategy_pick(heads: DataFrame, spans: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, n_headings, n_placed): the source of headings of the highest score; of equals the earlier in ``SOURCES``."""
    scores = source_scores(heads, spans, documents)
    order = reduce(lambda a, x: a.when(F.col("source") == x[1][0], -x[0]), list(enumerate(SOURCES))[1:], F.when(F.col("source") == SOURCES[0][0], 0)).otherwise(-len(SOURCES))
    best = scores.groupBy("doc_id").agg(F.max(F.struct("score", order.alias("o"), "source", "n_headings", "n_placed")).alias("b"))
    return best.select("doc_id", "b.source", "b.score", "b.n_headings", "b.n_placed")

