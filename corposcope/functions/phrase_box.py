"""The box of a query's words on a page, from the boxes of the spans of text they stand in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corposcope.functions import text as X

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, through an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _valid(b: Column) -> Column:
    return F.when((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), b)


def _segments(spans: Column) -> Column:
    """(start, stop, box) of the spans with text, as they stand in their line with a blank between them; those without a box are left out."""
    solid = F.filter(F.coalesce(spans, F.array().cast(f"array<struct<text:string,box:{BOX}>>")), lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")

    def placed(every: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(every, 1, i), F.lit(0), lambda a, s: a + F.length(s["text"]) + 1)
        return F.transform(every, lambda s, i: _with(before(i), lambda at: F.struct(at.alias("start"), (at + F.length(s["text"])).alias("stop"), _valid(s["box"]).alias("box"))))

    return F.filter(_with(solid, placed), lambda s: s["box"].isNotNull())


def _cut(segments: Column, start: Column, stop: Column) -> Column:
    """Boxes of the parts of segments between two places, by the share of their characters."""
    met = F.filter(segments, lambda s: (s["stop"] > start) & (s["start"] < stop))

    def part(s: Column) -> Column:
        n, wide = s["stop"] - s["start"], s["box"]["x1"] - s["box"]["x0"]
        at = lambda place: s["box"]["x0"] + wide * (F.greatest(F.lit(0), F.least(n, place - s["start"])) / n)
        return F.struct(at(start).alias("x0"), s["box"]["y0"].alias("y0"), at(stop).alias("x1"), s["box"]["y1"].alias("y1"))

    return F.transform(met, part)


def _around(boxes: Column) -> Column:
    """One box around all; null for none."""
    edge = lambda f, name: f(F.transform(boxes, lambda b: b[name])).alias(name)
    return F.when(F.size(boxes) > 0, F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")))


def line_box(line: Column, query: Column, tokens: Column) -> Column:
    """The box of the query in a line (text, box, spans of text and box): of the whole phrase where it stands there,
    else around the words found one after another (a word not found further on is looked for from the start), else the line's own."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def found(known: Column) -> Column:
        low, q, at, segments = known["low"], known["q"], known["at"], known["segments"]

        def step(acc: Column, t: Column) -> Column:
            further, first = F.call_function("locate", t, low, acc["next"]), F.call_function("locate", t, low, F.lit(1))
            longer = lambda place: F.when(place > 0, F.struct((place + F.length(t)).alias("next"), F.concat(acc["found"], F.array(F.struct((place - 1).alias("a"), (place - 1 + F.length(t)).alias("b")))).alias("found"))).otherwise(acc)
            return _with(F.when(further > 0, further).otherwise(first), longer)

        places = F.aggregate(tokens, start, step, lambda acc: acc["found"])
        phrase = F.when((F.length(q) > 1) & (at > 0), _with(_cut(segments, at - 1, at - 1 + F.length(q)), _around))
        words = _with(F.flatten(F.transform(places, lambda p: _cut(segments, p["a"], p["b"]))), _around)
        return F.when(low == "", _valid(line["box"])).otherwise(F.coalesce(phrase, words, _valid(line["box"])))

    low, q = F.lower(F.coalesce(line["text"], F.lit(""))), F.lower(F.trim(query))
    return _with(F.struct(low.alias("low"), q.alias("q"), F.call_function("locate", q, low, F.lit(1)).alias("at"), _segments(line["spans"]).alias("segments")), found)


def phrase_box(lines: Column, box: Column, query: Column, tokens: Column) -> Column:
    """The box of the query in a block: that in its line which matches best (score, whole phrase, words found, earlier lines), else the block's own."""
    ranked = F.transform(lines, lambda line, i: F.struct(
        F.round(X.query_match_score(query, tokens, line["text"]), 9).alias("score"), X.exact_phrase(query, line["text"]).alias("exact"), X.lex_hits(tokens, line["text"]).alias("hits"), (-i).alias("place"),
    ))
    found = _with(-F.array_max(ranked)["place"], lambda i: _with(F.get(lines, i), lambda best: F.coalesce(line_box(best, query, tokens), _valid(box))))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, found).otherwise(_valid(box))
