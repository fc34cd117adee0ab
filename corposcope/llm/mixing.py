"""Mixing sources to target weights by subset-sum budget fitting.

Sources get word targets by weight. Whole copies of a source come first; for
the rest of its budget documents are counted by exact length, a share of each
length is taken, and a bounded-knapsack program over the counts fills what
remains to the word. Documents are then picked by a seeded hash, as many of
each length as the counts say.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corposcope.llm.common import WORD, durable, ranked

WEIGHTS = (5, 2, 1)


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that they sum up to the largest reachable value up to ``budget``.

    Reachable sums are the bits of an integer. Counts are taken as parcels of
    1, 2, 4, ... so each parcel is one shift; the first parcel to reach a sum
    is remembered and leads back.
    """
    take = [0] * len(lengths)
    if budget <= 0:
        return take
    full, reach = (1 << (budget + 1)) - 1, 1
    via, parcels = np.full(budget + 1, -1, np.int64), []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, parcel = min(count, budget // length) if length > 0 else 0, 1
        while left > 0 and not reach >> budget & 1:
            n = min(parcel, left)
            new = (reach << n * length) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                via[np.flatnonzero(bits)] = len(parcels)
                reach |= new
            parcels.append((i, n))
            left -= n
            parcel *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, n = parcels[via[at]]
        take[i] += n
        at -= n * lengths[i]
    return take


def fit(lengths: list[int], counts: list[int], budget: int, window: int, seed: int) -> list[int]:
    """How many documents of each length fill ``budget`` words; never more than ``counts``.

    A proportional share of every length is rounded down; single documents, by
    the fraction lost, bring the rest under ``window`` words; the knapsack fills it.
    """
    total = sum(a * n for a, n in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [n * budget // total for n in counts]
    rest = budget - sum(a * n for a, n in zip(lengths, take, strict=True))
    fraction = [n * budget % total for n in counts]
    for i in sorted(range(len(lengths)), key=lambda i: (-fraction[i], lengths[i])):
        if rest <= window:
            break
        if take[i] < counts[i] and lengths[i] <= rest:
            take[i] += 1
            rest -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # still too much only if counts are few
        if rest > window and lengths[i] > 0:
            n = min(counts[i] - take[i], rest // lengths[i])
            take[i] += n
            rest -= n * lengths[i]
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    more = bounded_knapsack([lengths[i] for i in order], [counts[i] - take[i] for i in order], rest)
    for i, n in zip(order, more, strict=True):
        take[i] += n
    return take


def targets(sources: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources by code point, null last. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until
    none is above. Each round is one aggregate over the sources.
    """
    spark = sources.sparkSession
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("weight", T.LongType())])
    in_order = sources.select("source", "source_size").orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    weighed = durable(spark.createDataFrame(in_order.map(lambda x: (x[0][0], x[0][1], weights[x[1] % len(weights)])), schema))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    per_weight = 0.0
    while True:
        capped = F.col("weight") * F.lit(per_weight) > most * F.col("source_size")
        fixed, free = weighed.agg(F.coalesce(F.sum(F.when(capped, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        level = (share * total - fixed) / free if free else per_weight
        if level <= per_weight:
            break
        per_weight = level
    return weighed.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.lit(per_weight)).alias("target"))


def _plan(window: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        copies = int(target // whole) if whole else 0
        budget = round(target) - copies * whole
        lengths, counts = group["size"].tolist(), group["n"].tolist()
        extra = fit(lengths, counts, budget, window, seed) if whole else [0] * len(lengths)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "source_size": whole, "target": target, "copies": copies, "extra": extra})

    return run


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: int = 2, window: int = 32768, seed: int = 17, with_text: bool = True) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, and ``taken``: words taken, repeats counted.

    A document is taken whole, ``taken / size`` times, at most ``most``. Sources
    come to their targets to the word where lengths allow it. The choice hangs
    on (doc_id, text, seed) alone, so reruns agree. A null text, or one without
    words, has size 0 and is never taken. A very long text is one document of its size,
    which a source whose budget is smaller leaves out. Null sources are one source. Repeated
    rows are documents each. An empty table gives no rows. Added columns
    replace columns of these names. Texts are carried, or left out on request.
    The knapsack fits the last ``window`` words of a source's budget or fewer; what
    lies above is filled by shares and whole documents before (see ``fit``).
    """
    own = ("size", "source_size", "target", "taken")
    columns = [c for c in docs.columns if c not in own]
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(*(f"`{c}`" for c in columns), size.alias("size"), order.alias("pick_hash_"))
    if not with_text:
        columns.remove("text")
        sized = durable(sized.drop("text"))
    slim = durable(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, most)
    counted = slim.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "g.source_size", "g.target")
    plan = counted.groupBy("source").applyInPandas(_plan(window, seed), "source string, size long, source_size long, target double, copies long, extra long")
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    picked = ranked(sized, ["source", "size"], F.col("pick_hash_"), total, "pick_rank_", per_group=durable(plan))
    taken = F.col("size") * (F.col("copies") + (F.col("pick_rank_") < F.col("extra")).cast("long"))
    return picked.select(*(f"`{c}`" for c in columns), "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, columns unchanged."""
    found = mix(docs, **how)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return found.select(*(f"`{c}`" for c in docs.columns), F.explode(F.array_repeat(F.lit(1), times)).alias("mixed_copy_")).drop("mixed_copy_")
