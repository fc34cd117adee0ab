"""Retrieval, extraction and transcription metrics."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions import text as X


def retrieval_eval(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: hit@1/3/5 and reciprocal rank; a query without gold is right if nothing is returned."""
    r = ranked.select("query_id", "rank", "row_id").join(gold.select("query_id", F.col("doc_id").alias("row_id"), F.lit(True).alias("good")), ["query_id", "row_id"], "left")
    best = r.groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("n"))
    no_match = gold.select("query_id").distinct().withColumn("has_gold", F.lit(True))
    q = queries.select("query_id").join(best, "query_id", "left").join(no_match, "query_id", "left")
    none = F.col("has_gold").isNull()
    hit = lambda k: F.when(none, F.col("n").isNull()).otherwise(F.coalesce(F.col("first") <= k, F.lit(False)))
    rr = F.when(none, F.when(F.col("n").isNull(), 1.0).otherwise(0.0)).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0)))
    return q.select("query_id", none.alias("is_no_match"), hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), F.round(rr, 6).alias("rr"))


def localized_eval(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, page_hit1, page_hit3, section_hit1, section_hit3, section_hit5) from the hits inside each query's first document.

    hits (query_id, place from 1, page_no, canonical), gold (query_id, pages, sections). Null, not false, where
    the gold names no page or no section; a query without hits misses.
    """
    near = hits.filter("place <= 5").groupBy("query_id").agg(F.collect_list(F.struct("place", "page_no", "canonical")).alias("h"))
    met = gold.select("query_id", "pages", "sections").join(near, "query_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<place:int,page_no:int,canonical:string>>")))

    def hit(name: str, k: int, field: str, wanted: str):
        within = F.transform(F.filter("h", lambda x: x["place"] <= k), lambda x: x[field])
        return F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, F.coalesce(F.arrays_overlap(F.filter(within, lambda x: x.isNotNull()), wanted), F.lit(False))).alias(name)

    return met.select("query_id", hit("page_hit1", 1, "page_no", "pages"), hit("page_hit3", 3, "page_no", "pages"), *(hit(f"section_hit{k}", k, "canonical", "sections") for k in (1, 3, 5)))


def localized_summary(per_query: DataFrame) -> DataFrame:
    """Means of ``localized_eval``, each over the queries whose gold names a page or section."""
    columns = ["page_hit1", "page_hit3", "section_hit1", "section_hit3", "section_hit5"]
    return per_query.agg(F.count("page_hit1").alias("n_with_pages"), F.count("section_hit1").alias("n_with_sections"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in columns))


def latency_summary(runs: DataFrame) -> DataFrame:
    """(mean, p50, p95) of runs (latency_ms), by linear interpolation."""
    p = lambda q: F.round(F.percentile("latency_ms", F.lit(q)), 6)
    return runs.agg(F.round(F.avg("latency_ms"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"))


def retrieval_summary(per_query: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    none = F.round(F.avg(F.when(F.col("is_no_match"), F.col("hit1").cast("double"))), 6).alias("no_match_accuracy")
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), mean("hit1"), mean("hit3"), mean("hit5"), F.round(F.avg("rr"), 6).alias("mrr"), none, F.round(F.percentile("rr", F.lit(0.5)), 6).alias("rr_p50"))


# What a model says besides the transcript: its prompt, and runs of zeros.
ECHOES = r"(?i)you are a speech-to-text[^.\n]*[.\n]?|transcribe this audio[^.\n]*[.\n]?|the prompt says[^.\n]*[.\n]?"
ZEROS = "0{20,}"


def scored_predictions(predictions: DataFrame) -> DataFrame:
    """``predictions`` (dataset, id, reference, prediction, status) with ``wer``, ``clean_wer`` (without prompt echoes and runs of zeros) and ``flags``; both null where status is not ok."""
    ok, cleaned = F.col("status") == "ok", F.regexp_replace(F.regexp_replace(F.coalesce("prediction", F.lit("")), ECHOES, " "), ZEROS, " ")
    rate = lambda x: F.when(ok, X.wer(F.col("reference"), x))
    return predictions.withColumns({"wer": rate(F.col("prediction")), "clean_wer": rate(cleaned), "flags": F.when(ok, X.prediction_flags(F.col("prediction")))})


def asr_summary(scored: DataFrame) -> DataFrame:
    """(dataset, n, n_ok, n_errors, mean_wer, mean_clean_wer, n_flagged): a row for each dataset, and one (dataset null) for all."""
    levels = scored.groupingSets([[F.col("dataset")], []], F.col("dataset"))
    mean = lambda c: F.round(F.avg(c), 6)
    ok = F.col("status") == "ok"
    return levels.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_errors"), mean("wer").alias("mean_wer"), mean("clean_wer").alias("mean_clean_wer"),
        F.count_if(~F.array_contains("flags", "normal")).alias("n_flagged"),
    )


def flag_counts(scored: DataFrame) -> DataFrame:
    """(dataset, flag, n) of the flags of predictions."""
    return scored.select("dataset", F.explode("flags").alias("flag")).groupBy("dataset", "flag").agg(F.count(F.lit(1)).alias("n"))


def worst_predictions(scored: DataFrame, n: int = 10) -> DataFrame:
    """(place, dataset, id, wer) of the ``n`` predictions of the highest rate."""
    worst = scored.filter("wer IS NOT NULL").orderBy(F.desc("wer"), "dataset", "id").limit(n)  # n rows
    return worst.select(F.row_number().over(Window.orderBy(F.desc("wer"), "dataset", "id")).alias("place"), "dataset", "id", F.round("wer", 6).alias("wer"))


def label_summary(rows: DataFrame) -> DataFrame:
    """Two levels at once: by language, and by language and source."""
    levels = rows.groupingSets([[F.col("lang")], [F.col("lang"), F.col("source")]], F.col("lang"), F.col("source"))
    return levels.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


def _matched(pred: list[tuple], gold: list[tuple]) -> list[tuple[int, int]]:
    """A largest matching of predicted and gold headings that share a variant, as (gold, predicted) positions."""
    by: dict[str, list[int]] = {}
    for j, variants in enumerate(pred):
        for v in variants:
            by.setdefault(v, []).append(j)
    owner: dict[int, int] = {}
    owned: dict[int, int] = {}
    spent: set[str] = set()  # variants from which no search can reach a free heading any more
    for i in range(len(gold)):
        # A path of alternate choices, breadth first, that ends at a free heading.
        came, queue, end, seen = {}, deque([i]), None, set()
        while queue and end is None:
            g = queue.popleft()
            fresh = [v for v in dict.fromkeys(gold[g]) if v not in seen and v not in spent]
            seen.update(fresh)
            for j in (j for v in fresh for j in by.get(v, ())):
                if j not in came:
                    came[j] = g
                    if j not in owner:
                        end = j
                        break
                    queue.append(owner[j])
        if end is None:
            spent |= seen
        while end is not None:
            g = came[end]
            owner[end], owned[g], end = g, end, owned.get(g)
    return sorted((g, j) for j, g in owner.items())


def _in_order(places: list[int]) -> int:
    """The length of the longest increasing row."""
    tails: list[int] = []
    for p in places:
        i = bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails)


def heading_match(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, n_pred, n_gold, n_matched, n_in_order) from headings (doc_id, pos, variants).

    Headings match where they share a variant; the matching is a largest one.
    n_in_order is the longest row of matches in the order of both sides. A
    document's headings, dozens to thousands, are one row.
    """
    side = lambda df, n: df.select("doc_id", F.lit(n).alias("side"), "pos", "variants")
    rows = side(pred, 0).unionByName(side(gold, 1)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "variants"))).alias("rows"))

    @F.pandas_udf("n_matched long, n_in_order long")
    def matched(documents: pd.Series) -> pd.DataFrame:
        out = []
        for d in documents:
            pairs = _matched(*([tuple(r["variants"]) for r in d if r["side"] == n] for n in (0, 1)))
            out.append((len(pairs), _in_order([j for _, j in pairs])))
        return pd.DataFrame(out, columns=["n_matched", "n_in_order"])

    of = lambda n: F.size(F.filter("rows", lambda r: r["side"] == n)).cast("long")
    return rows.select("doc_id", of(0).alias("n_pred"), of(1).alias("n_gold"), matched("rows").alias("m")).select("doc_id", "n_pred", "n_gold", "m.*")


def md_eval(matched: DataFrame) -> DataFrame:
    """(doc_id, precision, recall, f1, heading_order) from ``heading_match``; null where a side has no headings."""
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    f1 = F.round(2 * F.col("n_matched") / F.nullif(F.col("n_pred") + F.col("n_gold"), F.lit(0)), 6)
    return matched.select("doc_id", share("n_matched", "n_pred").alias("precision"), share("n_matched", "n_gold").alias("recall"), f1.alias("f1"), share("n_in_order", "n_matched").alias("heading_order"))
