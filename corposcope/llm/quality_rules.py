"""Quality rules for documents and their hosts, in DataFrame functions only.

Each document is measured and held against rules. Failures of each rule, and of
any, are counted for each host (the column ``source``), and a host's rates are
shrunk towards the corpus by a beta prior for each rule, fitted to all hosts by moments.
The host's verdict is a factor for the limit of each softer rule, from how far its
shrunk log-odds of failing that rule and of failing any rule are from the
corpus: below 1 on a host that fails oftener, above 1 on one that fails less
often. It is joined back, and a document is held against its host's limits. The
base rules hold everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.llm.common import BLANK, durable, plain_name

RULES = ("symbols", "lines", "length")
#: What a host's log-odds of failing a rule, and of failing any, count for in the logarithm of its limits.
OWN_WEIGHT, ANY_WEIGHT = 0.5, 0.25
#: Limits are tightened and widened by these factors at most; no prior counts for more than so many documents.
TIGHTEST, WIDEST, MOST_STRENGTH = 0.8, 2.0, 1000.0


def _barrier(df: DataFrame, name: str, fields: dict[str, Column]) -> DataFrame:
    """Adds struct ``name``; a generator keeps the optimizer from moving its fields into a later lambda, where they would be computed for each element."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in fields.items())))).alias(name))


def _repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds ``name``: how many words lie in 3-word windows that the array ``words`` has twice or more.

    Windows are hashed to 64 bits and sorted with their positions, so equal ones
    are neighbours and the work is n log n in the words of a text.
    """
    ordered, places = (plain_name(df, x) for x in ("ordered_", "places_"))
    w = F.col(words)
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    df = _barrier(df, ordered, {"s": F.sort_array(F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))})
    s = F.col(f"{ordered}.s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    df = _barrier(df, places, {"p": F.sort_array(F.transform(twice, lambda x: x["p"]))})
    p = F.col(f"{places}.p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn(name, covered).drop(ordered, places)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with word and symbol counts of the whole text (null text: none)."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    df = docs.select(*(f"`{c}`" for c in docs.columns if c not in own))
    first = plain_name(df, "words_")
    t = F.coalesce("text", F.lit(""))
    solid = F.regexp_replace(t, BLANK, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    df = _barrier(df, first, {
        "w": F.filter(F.split(t, BLANK, -1), lambda x: x != ""),
        "chars": F.length(solid).cast("long"),
        "symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "lines": lines,
    })
    df = df.withColumns({
        "n_words": F.size(f"{first}.w").cast("long"),
        "word_chars": F.col(f"{first}.chars"),
        "n_symbols": F.col(f"{first}.symbols"),
        "n_dup_lines": (F.size(f"{first}.lines") - F.size(F.array_distinct(f"{first}.lines"))).cast("long"),
        "n_lines": F.size(f"{first}.lines").cast("long"),
    })
    return _repeat_words(df, f"{first}.w", "n_repeat_words").drop(first)


def host_verdicts(marked: DataFrame, worst_rate: float = 0.5) -> DataFrame:
    """(source, n_docs, n_failed, host_rate, host_ok, limit_symbols, limit_lines, limit_length) for each host of judged documents.

    ``limit_*`` multiply the limits of the softer rules; where the shrunk rate of any failure
    is above ``worst_rate`` none is above 1. A rule's beta prior has the mean of all documents
    and, where hosts vary more than chance allows, the spread of the hosts' rates. Where they don't it
    counts for ``MOST_STRENGTH`` documents, so hosts far larger than that still answer
    for their own rate.
    """
    failed = {"any": F.col("any_failed"), **{r: F.col(f"fails_{r}") for r in RULES}}
    hosts = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c.cast("long")).alias(f"n_{r}") for r, c in failed.items()))
    n = F.col("n_docs").cast("double")
    prior = hosts.agg(
        F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n * n).alias("nn"),
        *(F.sum(f"n_{r}").alias(f"x_{r}") for r in failed), *(F.sum(F.col(f"n_{r}").cast("double") * F.col(f"n_{r}") / n).alias(f"xx_{r}") for r in failed),
    )

    def fitted(r: str) -> list[Column]:
        mean = F.col(f"x_{r}") / F.col("n")
        # Between-host variance by moments: spread of the rates about their mean, less what chance gives.
        within = F.col(f"xx_{r}") - F.col("n") * mean * mean
        between = F.greatest(F.lit(0.0), (within - (F.col("k") - 1) * mean * (1 - mean)) / F.nullif(F.col("n") - F.col("nn") / F.col("n"), F.lit(0.0)))
        strength = F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(1.0), F.coalesce(mean * (1 - mean) / F.nullif(between, F.lit(0.0)) - 1, F.lit(MOST_STRENGTH))))
        return [mean.alias(f"mean_{r}"), strength.alias(f"strength_{r}")]

    rated = hosts.join(F.broadcast(prior.select(*(c for r in failed for c in fitted(r)))))  # one row
    mean = lambda r: F.col(f"mean_{r}")
    rate = {r: (F.col(f"n_{r}") + mean(r) * F.col(f"strength_{r}")) / (F.col("n_docs") + F.col(f"strength_{r}")) for r in failed}
    odds = lambda p: p / F.nullif(1 - p, F.lit(0.0))
    over = {r: F.coalesce(F.ln(F.nullif(odds(rate[r]), F.lit(0.0)) / F.nullif(odds(mean(r)), F.lit(0.0))), F.lit(0.0)) for r in failed}
    widest = F.when(rate["any"] <= worst_rate, WIDEST).otherwise(1.0)
    limits = (F.greatest(F.lit(TIGHTEST), F.least(widest, F.exp(-(OWN_WEIGHT * over[r] + ANY_WEIGHT * over["any"])))).alias(f"limit_{r}") for r in RULES)
    return rated.select("source", "n_docs", F.col("n_any").alias("n_failed"), rate["any"].alias("host_rate"), (rate["any"] <= worst_rate).alias("host_ok"), *limits)


def judged(docs: DataFrame, worst_rate: float = 0.5, max_symbols: float = 0.1, max_dup_lines: float = 0.3, max_word_chars: float = 20.0) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, the softer rules, their excesses and ``any_failed``.

    Base rules: fewer than 50 words, or more than half of the words in repeated
    3-word windows. Softer rules: symbols beyond ``max_symbols`` of the word
    characters, repeated lines beyond ``max_dup_lines`` of the lines, words
    longer than ``max_word_chars`` on average. ``excess_*`` are these three measures
    as multiples of their limits. Added columns replace columns of
    their names; all others pass. Null and empty texts have no words and fail. A
    null source is a host of its own. Repeated rows count and are judged each. A very long
    text is judged whole: its words are arrays and sorts of one row, n log n in its length.
    An empty table stays empty.
    """
    df = measured(docs)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    over = lambda n, limit, of: F.coalesce(F.col(n) / F.nullif(limit * F.col(of), F.lit(0.0)), F.lit(0.0))
    df = df.withColumns({"excess_symbols": over("n_symbols", max_symbols, "word_chars"), "excess_lines": over("n_dup_lines", max_dup_lines, "n_lines"), "excess_length": over("word_chars", max_word_chars, "n_words")})
    df = df.withColumns({f"fails_{r}": F.col(f"excess_{r}") > 1 for r in RULES})
    return df.withColumn("any_failed", F.col("base_failed") | F.col("fails_symbols") | F.col("fails_lines") | F.col("fails_length"))


def with_verdicts(marked: DataFrame, verdicts: DataFrame, most_hosts: int = 200_000) -> DataFrame:
    """Joins host verdicts to judged documents and adds ``kept``.

    Verdicts of up to ``most_hosts`` hosts are broadcast, so that documents need no
    shuffle and a large host no task of its own; beyond that both sides are shuffled.
    """
    verdicts = durable(verdicts)
    base = marked.select(*(f"`{c}`" for c in marked.columns if c not in ("n_docs", "n_failed", "host_rate", "host_ok", *(f"limit_{r}" for r in RULES), "kept")))
    v = verdicts.withColumnRenamed("source", "host_")
    v = F.broadcast(v) if v.count() <= most_hosts else v
    joined = base.join(v, base["source"].eqNullSafe(v["host_"]), "left").drop("host_")
    return joined.withColumn("kept", reduce(lambda a, r: a & (F.col(f"excess_{r}") <= F.col(f"limit_{r}")), RULES, ~F.col("base_failed")))


def host_rules(docs: DataFrame, worst_rate: float = 0.5) -> DataFrame:
    """``judged`` documents with their host's verdict and ``kept``; texts are not carried through the join.

    The measures are written once, without texts, and read for both the hosts'
    counts and the join. To keep whole documents use ``keep_good``.
    """
    marked = durable(judged(docs, worst_rate).drop("text"))
    return with_verdicts(marked, host_verdicts(marked, worst_rate))


def keep_good(docs: DataFrame, worst_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged; each text is measured once.

    The judged rows are written with their texts, counted by host, and read
    again for the join with the verdicts. Nulls, repeated rows, empty tables and
    clashing columns as in ``judged``.
    """
    marks = ("base_failed", "any_failed", *(f"{kind}_{r}" for r in RULES for kind in ("fails", "excess")))
    row = plain_name(docs, "row_")
    marked = judged(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias(row), "text", "source"), worst_rate)
    marked = durable(marked.select(row, "source", *marks))
    kept = with_verdicts(marked, host_verdicts(marked, worst_rate)).filter("kept")
    return kept.select(f"{row}.*")
