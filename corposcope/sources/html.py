"""Blocks and titles of web pages, by the nesting of their tags."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags whose whole content goes, tags that are blocks, and where the main content is looked for, in order.
DROPPED = ("script", "style", "noscript", "header", "footer", "nav", "aside", "form", "svg", "canvas")
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre")
MAIN = ("article", "main", "body")

CLOSED_BY_NEXT = tuple(t for t in BLOCKS if t not in ("li", "blockquote"))


class Page(HTMLParser):
    """Collects blocks (tag, pieces of text, which of MAIN they stand in) and the title of a page.

    A text belongs to the innermost open block. Paragraphs and headings need no closing tag: the
    next block closes them, and the next item of a list closes the one before. Content inside dropped tags goes up to
    the tag that closes the same nesting. Character references are read with or without their semicolon, as browsers do.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str], tuple[bool, ...]]] = []
        self.title: list[str] = []
        self._open: list[tuple[str, list[str] | None]] = []
        self._dropped, self._depth, self._in_title = None, 0, False
        self._regions = {t: 0 for t in MAIN}
        self._over = {t: False for t in MAIN}

    def handle_starttag(self, tag: str, attrs) -> None:
        if self._dropped:
            self._depth += tag == self._dropped
        elif tag in DROPPED:
            self._dropped, self._depth = tag, 1
        elif tag == "title":
            self._in_title = True
        elif tag in MAIN:
            self._regions[tag] += not self._over[tag]
        elif tag in ("ul", "ol"):
            self._open.append((tag, None))
        elif tag in BLOCKS:
            while self._open and (self._open[-1][0] in CLOSED_BY_NEXT or tag == "li" and self._open[-1][0] == "li"):
                self._open.pop()
            pieces: list[str] = []
            self.blocks.append((tag, pieces, tuple(self._regions[t] > 0 for t in MAIN)))
            self._open.append((tag, pieces))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._dropped:
            self._depth -= tag == self._dropped
            self._dropped = self._dropped if self._depth else None
        elif tag == "title":
            self._in_title = False
        elif tag in MAIN:
            if self._regions[tag]:
                self._regions[tag] -= 1
                self._over[tag] = not self._regions[tag]  # the first of its kind counts
            self._open = []
        elif any(tag == t for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._dropped:
            return
        if self._in_title:
            self.title.append(data)
        elif self._open and self._open[-1][1] is not None:
            self._open[-1][1].append(data)

    def main_blocks(self) -> list[tuple[str, str]]:
        """(tag, text) of the blocks of the first article, else of main, else of the body, else of all."""
        shaped = [(tag, " ".join(" ".join(pieces).replace("\0", "").split()), inside) for tag, pieces, inside in self.blocks]
        for i in range(len(MAIN)):
            if any(inside[i] for *_, inside in shaped):
                return [(tag, text) for tag, text, inside in shaped if inside[i] and text]
        return [(tag, text) for tag, text, _ in shaped if text]

    def page_title(self) -> str | None:
        """The title, else the first heading of the first level that has a text."""
        title = " ".join("".join(self.title).split())
        heads = (" ".join(" ".join(pieces).split()) for tag, pieces, _ in self.blocks if tag == "h1")
        return title or next(filter(None, heads), None)


def parsed(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, tag, text): headings, paragraphs and items of the main content of pages (page_id, html), in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, n, tag, text) for i, html in zip(frame["page_id"], frame["html"], strict=True) for n, (tag, text) in enumerate(parsed(html).main_blocks(), 1)]
            yield pd.DataFrame(found, columns=["page_id", "block_no", "tag", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, "page_id long, block_no int, tag string, text string")


def html_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title) of pages (page_id, html): the title, else the first main heading; null without either."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "title": [parsed(html).page_title() for html in frame["html"]]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, "page_id long, title string")
