"""Sentences of running text: cut, mended and held against what is no sentence, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corposcope.functions.text import _once, _text

# Abbreviations after which no sentence ends.
ABBREVIATIONS = ("et al.", "Fig.", "Figs.", "Sec.", "Secs.", "Eq.", "Eqs.", "Tab.", "Tabs.", "No.", "vs.", "e.g.", "i.e.")
# Tails up to this length without an end belong to the sentence before; length and words of a sentence.
TAIL, SHORTEST, LONGEST, LEAST_WORDS = 24, 35, 420, 6
# Words, and patterns of what a sentence may hold.
WORD = r"[A-Za-z][A-Za-z0-9\-']+"
VERBS = r"(?i)\b(?:is|are|was|were|means|shows?|demonstrates?|uses?|builds?|improves?|achieves?|introduces?|proposes?|evaluates?|finds?)\b"
CITATIONS = r"(?i)\[[0-9,\-\s]{1,20}\]|\bet al\.\b|\((?:19|20)\d{2}[a-z]?\)"
BIBLIOGRAPHY = r"(?i)\b(?:proceedings|conference|journal|volume|pages\b|arxiv|doi|cvpr|iccv|eccv|iclr|neurips|aaai|acl|emnlp)\b"
FIGURE_NAMED = r"(?i)\b(?:figure|fig\.?|table|tab\.?)\s+\d+[A-Za-z]?\b"
CAPTION = r"(?i)^\s*(?:figure|fig\.?|table|tab\.?|algorithm)\s+\d+[A-Za-z]?\b"
CODE = r"(?:\btorch\.|\bdef\b|\breturn\b|=\s*[^ ]|\[[A-Za-z_][A-Za-z0-9_ ,]*\]|_[A-Za-z0-9_]+)"
BULLETS = r"[■●▪□▢◆◇•]"
ENTRY = r"^\s*\[\d+\]\s+"
HEADINGS = ("references", "acknowledgment", "acknowledgements", "acknowledgment.", "acknowledgements.")
FRAGMENT = r"^(?:and|but|or|while|which|that|with|without|using|showing|improving|indicating|suggesting|retrieval)\b"
PANEL, LABEL = r"(?i)^\s*\([a-z0-9]\)\s+", r"^(?:[A-Za-z0-9][A-Za-z0-9 /+_-]{0,30}|[A-Za-z]+(?:\s+[A-Za-z]+){0,4})$"
EQUATION = r"[=()∥×+\-/*^_]"
# Words of tables: with digits or marks, metrics, heads of columns, and what they compare.
NUMBERISH, METRICS = r"\d|[%↑↓×†⋆✓–—-]", r"(FID|IS|rFID|gFID|RMSD|Match|Valid|Unique|Params|Aux\.?|Adv\.?|Token|Method)"
COLUMN_HEAD = r"^(?:[A-Z][A-Za-z0-9.+/-]*|[A-Z]{2,}[A-Za-z0-9.+/-]*|\d+(?:x\d+)?|[✓✗⋆†‡%↑↓×-]+)$"
TICKS, COMPARED = r"[✓✗⋆†‡]", r"\b(with|without|single-stage|two-stage|frameworks?|tokenizer|encoder|decoder|baseline)\b"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(_text(x), r"\s+", " "))


def count_words(x: Column) -> Column:
    return F.regexp_count(_text(x), F.lit(WORD))


def reads_on(x: Column) -> Column:
    """Six words or more with a mark that parts sentences, or ten."""
    return _once(count_words(x), lambda n: (n >= 10) | ((n >= 6) & x.rlike("[.!?;:]")))


def is_entry(s: Column) -> Column:
    """An entry or heading of a list of references."""
    return ((F.length(s) <= max(map(len, HEADINGS))) & F.lower(s).isin(*HEADINGS)) | s.rlike(ENTRY)


def is_table_text(s: Column) -> Column:
    """What is left of a table: many short words, numbers, metrics or heads of columns."""
    tokens = F.split(s, " ")
    count = lambda test: F.size(F.filter(tokens, test))
    short, numbers, heads = count(lambda t: F.length(t) <= 4), count(lambda t: t.rlike(NUMBERISH)), count(lambda t: t.rlike(COLUMN_HEAD))
    metrics, prose = F.regexp_count(s, F.lit(METRICS)), reads_on(s)
    some = (numbers >= 1) | (short >= 4)
    signals = (
        is_entry(s), s.rlike(TICKS) & some, (metrics >= 2) & ((numbers >= 2) | (short >= 6)), ~prose & (numbers >= 1) & ~s.rlike(VERBS) & (heads >= 6),  # dear ones last
        ~prose & (numbers >= 3), (F.length(s) <= 160) & ~prose & F.lower(s).rlike(COMPARED) & some,
    )
    never = (s == "") | s.rlike(CAPTION) | s.startswith("Figure ") | ((F.length(s) >= 220) & prose)
    found = signals[0]
    for signal in signals[1:]:
        found = found | signal
    return ~never & found


def is_label(s: Column) -> Column:
    """A label of a figure: up to 80 characters of bare words, or a letter in brackets first."""
    return (s != "") & ~reads_on(s) & (F.length(s) <= 80) & (s.rlike(PANEL) | s.rlike(LABEL))


def is_bibliography(s: Column) -> Column:
    """Two citations, or a venue named among six words, and no verb that makes it a statement."""
    cited = (F.regexp_count(s, F.lit(CITATIONS)) >= 2) | (s.rlike(BIBLIOGRAPHY) & (count_words(s) >= LEAST_WORDS))
    return cited & ~(s.rlike(VERBS) & reads_on(s))


def is_fragment(s: Column) -> Column:
    bare = F.regexp_replace(s, "^[\"'(\\[{]+", "")
    return (bare == "") | bare.rlike(r"^[\p{Ll},;:]") | F.lower(bare).rlike(FRAGMENT) | is_entry(s)


def is_usable(s: Column) -> Column:
    """Whether a squeezed sentence can stand alone."""
    condition = s.rlike("^[Ww]") & F.lower(s).startswith("where ") & s.rlike(EQUATION)
    plain = F.length(s).between(SHORTEST, LONGEST) & (count_words(s) >= LEAST_WORDS) & ~is_fragment(s) & ~s.rlike(BULLETS) & ~s.rlike(CAPTION)
    return plain & ~s.rlike(CODE) & ~condition & ~is_label(s) & ~is_bibliography(s) & ~is_table_text(s)


def cut_sentences(x: Column) -> Column:
    """Pieces that end after ``.!?`` before a blank, or at the end of a line; not after an abbreviation; short tails without an end joined to the piece before."""
    held = _text(x)
    for a in ABBREVIATIONS:
        held = F.replace(held, F.lit(a), F.lit(a.replace(".", "\2")))
    pieces = F.filter(F.transform(F.split(held, r"(?<=[.!?])\s+|\n+"), lambda s: F.translate(squeezed(s), "\2", ".")), lambda s: s != "")

    def mended(p: Column) -> Column:
        begins = F.filter(F.transform(p, lambda s, i: F.when((i == 0) | (F.length(s) > TAIL) | s.rlike("[.!?]$"), i)), lambda i: i.isNotNull())
        whole = lambda b: F.transform(b, lambda i, j: F.array_join(F.slice(p, i + 1, F.coalesce(F.get(b, j + 1), F.size(p)) - i), " "))
        return F.get(F.transform(F.array(begins), whole), F.lit(0))

    # through arrays of one, pieces and beginnings are computed once
    return F.get(F.transform(F.array(pieces), mended), F.lit(0))


def sentences(x: Column) -> Column:
    """The pieces of ``cut_sentences`` that can stand alone."""
    return F.filter(cut_sentences(x), is_usable)
