"""The shape of heading lines, as Columns, and the likeness of short strings."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corposcope.functions.text import _text, canonical_heading

# Outline numbers before a title, lines that are a number alone, numbered titles, and titles of floats.
PREFIX = r"^\s*(?:[ivxlcdm]+\.?|[a-z]\)|\d+(?:\.\d+){0,3}\.?)\s+"
MARKER = r"^\s*(?:\d+(?:\.\d+){0,3}|[ivxlcdm]+)\.?\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+){0,3})\.?\s+(.+)$"
ROMAN = r"^\s*[IVXLCDM]+\.\s+(.+)$"
FLOAT_TITLE = r"^(?:table|fig|figure|algorithm|lemma|theorem)(?:$|[^\p{L}\p{N}_])"
# Words that may stand in lower case inside a title, that mark prose, and with which no title begins.
CONNECTORS = ("and", "&", "to", "for", "of", "in", "on", "with", "without", "via")
PROSE_WORDS = ("the", "and", "that", "with", "from", "this", "these", "our", "their", "which", "while", "using", "without", "into", "through", "because", "however", "although")
NO_BEGINNING = ("our", "this", "these", "those", "see")
ADDRESSES = ("http://", "https://", "www.", "github", "openreview", "arxiv.org", "doi.org")
# Canonical names of the sections that papers are made of.
CORE = (
    "abstract", "introduction", "problem_definition", "notation", "related_work", "methodology", "achievability", "capacity_bound", "experiments", "results", "discussion",
    "numerical_applications", "conclusion", "appendix", "acknowledgements", "references",
)


def _matched(a: str, b: str, masked: str, junk: bool) -> int:
    """The characters in common blocks: the longest one, of equals the first in ``a``, then in ``b``; then left and right of it.

    Blocks are looked for in ``masked``, ``b`` without its very frequent characters, and grow over these afterwards. Searches
    for substrings find a block, so it takes as many of them as ``a`` has characters, not as there are pairs of equal characters.
    """
    n, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        part, size, i = masked[blo:bhi], 0, alo
        for at in range(alo, ahi):
            if at + size >= ahi:
                break
            while at + size < ahi and a[at : at + size + 1] in part:
                size, i = size + 1, at
        j = blo + part.index(a[i : i + size]) if size else blo
        if junk:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        if size:
            n += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return n


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Twice the characters in common blocks over all characters; blocks by the longest common one, then left and right of it.

    Equal to the ratio of ``difflib.SequenceMatcher``, which in strings of 200 characters or more begins no block with a character that is over a hundredth of them.
    """
    if not a and not b:
        return 1.0
    frequent = {c for c in set(b) if b.count(c) > len(b) // 100 + 1} if len(b) >= 200 else set()
    if not frequent:
        return 2.0 * _matched(a, b, b, False) / (len(a) + len(b))
    rare = next(c for c in map(chr, range(len(a) + 1)) if c not in a)  # stands for the frequent ones and matches nothing
    return 2.0 * _matched(a, b, b.translate({ord(c): rare for c in frequent}), True) / (len(a) + len(b))


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(_text(x), r"\s+", " "))


def _words(x: Column) -> Column:
    return F.filter(F.split(_squeezed(x), " "), lambda w: w != "")


def heading_key(x: Column) -> Column:
    """A title in lower case without its outline number, one blank for all that is not an ASCII letter or digit."""
    bare = F.regexp_replace(F.lower(_squeezed(x)), PREFIX, "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def clean_title(x: Column) -> Column:
    """A title as it reads: commands unwrapped, no braces, no outline number, no marks at its ends."""
    unwrapped = F.regexp_replace(_text(x), r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    return F.btrim(F.regexp_replace(_squeezed(F.translate(unwrapped, "{}", "")), "(?i)" + PREFIX, ""), F.lit(" .:-"))


def _upper_word(w: Column) -> Column:
    letters, capitals = F.length(F.regexp_replace(w, "[^A-Za-z]", "")), F.length(F.regexp_replace(w, "[^A-Z]", ""))
    return (letters > 0) & (capitals >= letters * 0.8)


def _until(words: Column, stop) -> Column:
    """The words before the first one for which ``stop(word, place)`` holds."""
    first = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(stop(w, i), i)), lambda i: i.isNotNull()))
    return F.slice(words, 1, F.coalesce(first, F.size(words)))


def numeric_title(x: Column) -> Column:
    """The title after an arabic outline number, to the first word in lower case after two others (connecting words may stay); else empty."""
    rest = F.slice(_words(F.regexp_extract(_text(x), NUMBERED, 2)), 1, 20)
    solid = F.filter(rest, lambda w: w.rlike("[A-Za-z0-9&()/-]"))
    bare = lambda w: F.regexp_replace(w, "[^A-Za-z0-9&()/-]+", "")
    return clean_title(F.array_join(_until(solid, lambda w, i: (i >= 2) & bare(w).rlike("^[a-z]") & ~F.lower(bare(w)).isin(*CONNECTORS)), " "))


def roman_title(x: Column) -> Column:
    """The words in capitals after a roman outline number; else empty."""
    rest = F.slice(_words(F.regexp_extract(_text(x), ROMAN, 1)), 1, 24)
    return clean_title(F.array_join(_until(rest, lambda w, i: ~_upper_word(w)), " "))


def is_marker(x: Column) -> Column:
    """An outline number alone."""
    return _text(x).rlike("(?i)" + MARKER)


def _capitalised(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}") | _upper_word(w)))


def heading_phrase(x: Column) -> Column:
    """Up to twelve words of which all but two (and two at least) are capitalised, no full stop behind, one comma at most, no title of a float."""
    line, words = _squeezed(x), _words(x)
    commas = F.length(line) - F.length(F.translate(line, ",", ""))
    return F.size(words).between(1, 12) & ~line.endswith(".") & (commas <= 1) & ~F.lower(line).rlike(FLOAT_TITLE) & (_capitalised(words) >= F.greatest(F.lit(2), F.size(words) - 2))


def reads_as_prose(x: Column) -> Column:
    """A sentence ends before a blank, or three words stand in it that prose is made of."""
    words = F.split(F.lower(_text(x)), r"[^\p{L}\p{N}_]+")
    return _text(x).rlike(r"[.!?]\s") | (F.size(F.filter(words, lambda w: w.isin(*PROSE_WORDS))) >= 3)


def plausible_title(x: Column, title: Column | None = None, key: Column | None = None) -> Column:
    """A title that is no address, float, fragment of letters or row of numbers; ``title`` and ``key`` are its ``clean_title`` and that one's ``heading_key`` where known."""
    title = clean_title(x) if title is None else title
    key = heading_key(title) if key is None else key
    core = canonical_heading(title).isin(*CORE)
    share = F.length(F.regexp_replace(title, "[^0-9]", "")) / F.nullif(F.length(F.regexp_replace(title, "[^A-Za-z0-9]", "")), F.lit(0))
    n, single = F.size(F.split(key, " ")), F.regexp_count(key, F.lit("(?:^| )[a-z0-9](?= |$)"))
    address = title.rlike("(?i)" + "|".join(a.replace(".", "[.]") for a in ADDRESSES))
    odd = F.split_part(key, F.lit(" "), F.lit(1)).isin(*NO_BEGINNING) | F.coalesce(share >= 0.28, F.lit(False))
    return (key != "") & ~address & ~key.rlike(FLOAT_TITLE) & (F.length(F.translate(key, " ", "")) >= 4) & ~((n > 1) & (single >= F.floor(n / 2))) & (~odd | core)


def title_level(x: Column) -> Column:
    """1 to 3 by the parts of an arabic outline number, else 1."""
    number = F.regexp_extract(_squeezed(x), NUMBERED, 1)
    return F.least(F.lit(3), F.length(number) - F.length(F.translate(number, ".", "")) + 1)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two strings, null as empty."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")
