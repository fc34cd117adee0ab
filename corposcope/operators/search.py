"""Batch keyword and vector search, fusion, gates and document scores. Queries are always joined, never looped."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corposcope.functions import text as X
from corposcope.sources.index import Grams, Index, bucket_of, named, settled, unwritten, unwritten_grams

K1, B = 1.2, 0.75


def top_per_query(rows: DataFrame, k: int, *order) -> DataFrame:
    """Adds ``rank`` and keeps the first k of each query; Spark limits each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def as_index(rows: DataFrame | Index) -> Index:
    """An index as it is; rows (row_id, text) as the plan of theirs."""
    return rows if isinstance(rows, Index) else unwritten(rows)


def frequencies(tokens: DataFrame, index: Index | Grams) -> DataFrame:
    """``tokens`` (with token) and ``bucket`` and ``df``, 0 for unknown ones; the tokens asked for meet the vocabulary alone."""
    asked = tokens.join(F.broadcast(index.stats.select("buckets"))).withColumn("bucket", bucket_of(F.col("token"), F.col("buckets"))).drop("buckets")  # one row
    known = index.vocabulary.join(F.broadcast(asked.select("bucket", "token").distinct()), ["bucket", "token"], "left_semi")  # a batch of queries is small beside the vocabulary
    return asked.join(known, ["bucket", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))


def rows_with_all(asked: DataFrame, index: Index) -> DataFrame:
    """(query_id, row_id, token, positions, df and the other columns of ``asked``) for rows that hold all of a query's tokens.

    ``asked`` has a row (query_id, token, n, bucket, df) for each distinct token of a query, ``n`` being their
    number. Rows that hold a query's three rarest tokens are proposed, and only these meet its other
    tokens, so the postings of a word that every row holds are read but never multiplied. The tokens asked
    for, and the rows proposed where they are few, go to the postings, of which only what is met is shuffled.
    """
    asked = settled(asked, index.folder)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "token"))
    rarest = asked.filter("df > 0").select("query_id", "bucket", "token", "df").withColumn("i", order).filter("i <= 3").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).drop("df", "i")
    proposed = index.postings.select("bucket", "token", "row_id").join(F.broadcast(rarest), ["bucket", "token"]).groupBy("query_id", "row_id", "m").agg(F.count(F.lit(1)).alias("held_")).filter("held_ = m").select("query_id", "row_id")
    complete = asked.groupBy("query_id").agg(F.min("df").alias("least")).filter("least > 0").select("query_id")
    proposed = settled(proposed.join(complete, "query_id", "left_semi"), index.folder)
    read = named(index.postings.join(F.broadcast(asked.select("bucket", "token").distinct()), ["bucket", "token"], "left_semi"), proposed, ["row_id"])
    met = proposed.join(asked, "query_id").join(read, ["bucket", "token", "row_id"])
    full = Window.partitionBy("query_id", "row_id")
    return met.withColumn("met_", F.count(F.lit(1)).over(full)).filter("met_ = n").drop("met_")


def phrase_rows(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, row_id, p): every row that holds the query's words as a phrase, with the token, tf, df and begins of each word in ``p``.

    queries (query_id, q), ``q`` being the words in order. Phrases are found by
    intersecting the places at which they would begin, from the positions of their words;
    no text is read, and no row is left out.
    """
    q = queries.select("query_id", "q").filter(F.size("q") > 0)
    distinct = F.array_distinct("q")
    of_query = q.select("query_id", F.size(distinct).alias("n"), F.explode(F.transform(distinct, lambda t: F.struct(t.alias("token"), F.filter(F.transform("q", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("at")))).alias("a"))
    asked = frequencies(of_query.select("query_id", "n", "a.token", "a.at"), index)
    met = rows_with_all(asked, index)
    begins = F.transform("at", lambda o: F.transform("positions", lambda p: p - o))
    parts = F.struct("token", F.size("positions").alias("tf"), "df", F.aggregate(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.get(begins, F.lit(0)), F.array_intersect).alias("begins"))
    per_row = met.groupBy("query_id", "row_id").agg(F.array_sort(F.collect_list(parts)).alias("p"))
    places = F.transform("p", lambda x: x["begins"])
    phrase = F.aggregate(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.get(places, F.lit(0)), F.array_intersect)
    return per_row.filter(F.size(phrase) > 0)


def keyword_search(queries: DataFrame, rows: DataFrame | Index, k: int) -> DataFrame:
    """(query_id, rank, row_id, bm25): rows holding the query's words as a phrase, by BM25, ties to smaller ids.

    queries (query_id, query), rows (row_id, text) or their index. ``phrase_rows`` has all such rows, not the first k alone.
    """
    index = as_index(rows)
    held = phrase_rows(queries.select("query_id", X.index_tokens(F.col("query")).alias("q")), index)
    met = held.join(index.lengths.select("row_id", "n_tokens"), "row_id").join(F.broadcast(index.stats.select(F.col("n").alias("rows_"), "mean_len")))  # one row

    def part(x):
        idf = F.log(1 + (F.col("rows_") - x["df"] + 0.5) / (x["df"] + 0.5))
        return idf * x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_len")))

    score = F.round(F.aggregate(F.transform("p", part), F.lit(0.0), lambda a, x: a + x), 6)
    return top_per_query(met.select("query_id", "row_id", score.alias("bm25")), k, F.desc("bm25"), "row_id").select("query_id", "rank", "row_id", "bm25")


def rows_containing(queries: DataFrame, rows: DataFrame, index: Index) -> DataFrame:
    """(query_id, row_id): all rows (row_id, text) that hold a query's text verbatim, as ``contains`` has it; ``index`` is theirs.

    A query may begin and end inside words, so only its words between two other
    characters must stand in a row as words. Rows that hold these as a phrase are proposed, and their texts
    decide. Queries without such a word meet every text.
    """
    # the marks join a word at the query's edge, or are words themselves; the first and the last word go
    marked = X.index_tokens(F.concat(F.lit("0"), F.col("query"), F.lit("0")))
    q = queries.filter(F.col("query").isNotNull()).select("query_id", "query", F.slice(marked, 2, F.greatest(F.size(marked) - 2, F.lit(0))).alias("q"))
    proposed = phrase_rows(q, index).select("query_id", "row_id")
    asked = proposed.join(q.select("query_id", "query"), "query_id")
    texts = rows.select("row_id", "text")
    found = texts.join(asked, "row_id").filter(F.contains("text", "query")).select("query_id", "row_id")
    bare = q.filter(F.size("q") == 0).select("query_id", "query")
    return found.unionByName(texts.join(F.broadcast(bare), F.contains("text", "query")).select("query_id", "row_id"))


def substring_search(queries: DataFrame, rows: DataFrame, k: int, grams: Grams | None = None) -> DataFrame:
    """(query_id, rank, row_id): rows (row_id, text) that hold the query anywhere, letters' case aside, in order of row_id.

    The query's three rarest trigrams propose rows, of which the texts are looked at. A query of one
    or two characters is looked up in the trigrams that hold it. Blank queries find nothing.
    """
    grams = unwritten_grams(rows) if grams is None else grams
    q = queries.select("query_id", F.lower("query").alias("q")).filter(F.trim("q") != "")
    c = F.split("q", "")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.length("q") - 3, F.lit(0))), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    known = frequencies(q.filter(F.length("q") >= 3).select("query_id", F.explode(runs).alias("token")), grams)
    best = known.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "token", "bucket"))), 1, 3).alias("best")).filter(F.get("best", F.lit(0))["df"] > 0)
    asked = best.select("query_id", F.size("best").alias("n"), F.inline("best")).drop("df")
    proposed = grams.postings.join(asked, ["bucket", "token"]).groupBy("query_id", "row_id", "n").agg(F.count(F.lit(1)).alias("m")).filter("m = n").select("query_id", "row_id")
    inside = grams.vocabulary.select("bucket", "token", F.explode(F.array_distinct(F.array(*(F.substring("token", i, n) for i, n in ((1, 1), (1, 2)))))).alias("q"))
    short = q.filter(F.length("q") < 3).join(inside, "q").select("query_id", "bucket", "token")
    proposed = proposed.unionByName(grams.postings.join(short, ["bucket", "token"]).select("query_id", "row_id").distinct())
    met = rows.select("row_id", F.lower("text").alias("t")).join(proposed, "row_id").join(q, "query_id").filter(F.contains("t", "q"))
    return top_per_query(met.select("query_id", "row_id"), k, "row_id").select("query_id", "rank", "row_id")


def search_with_fallback(queries: DataFrame, rows: DataFrame, k: int, index: Index | None = None, grams: Grams | None = None) -> DataFrame:
    """(query_id, rank, row_id, bm25): the keyword ranking, and for queries without hits the rows that hold them as a substring (no bm25)."""
    ranked = keyword_search(queries, rows if index is None else index, k)
    left = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return ranked.unionByName(substring_search(left, rows, k, grams).withColumn("bm25", F.lit(None).cast("double")))


def rrf_fuse(vector: DataFrame, words: DataFrame, k: int, alpha: float = 0.5, c: int = 60) -> DataFrame:
    """(query_id, rank, row_id, hybrid_score, sources) from two ranked lists (query_id, row_id, rank)."""
    v = vector.select("query_id", "row_id", F.col("rank").alias("v"))
    w = words.select("query_id", "row_id", F.col("rank").alias("w"))
    score = F.coalesce(alpha / (c + F.col("v")), F.lit(0.0)) + F.coalesce((1 - alpha) / (c + F.col("w")), F.lit(0.0))
    sources = F.concat_ws("+", F.when(F.col("v").isNotNull(), F.lit("vector")), F.when(F.col("w").isNotNull(), F.lit("text")))
    both = v.join(w, ["query_id", "row_id"], "full_outer").select("query_id", "row_id", F.round(score, 6).alias("hybrid_score"), sources.alias("sources"))
    return top_per_query(both, k, F.desc("hybrid_score"), "row_id")


def keyword_hits(ranked: DataFrame, queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Page hits with their features and scores, from (query_id, rank, row_id)."""
    ranked = settled(ranked.select("query_id", "rank", "row_id"))
    h = ranked.join(queries, "query_id").join(named(pages, ranked, ["row_id"]), "row_id")
    h = h.withColumn("lex_hits", X.lex_hits(X.query_tokens(F.col("query")), F.col("text"))).withColumn("exact_phrase", X.page_exact(F.col("query"), F.col("text")))
    h = h.withColumn("keyword_score", 1 / (10 + F.col("rank")) + F.when(F.col("exact_phrase"), 0.08).otherwise(0.0) + F.least("lex_hits", F.lit(4)) * 0.015)
    h = h.withColumn("search_bucket", X.section_bucket(F.col("text"), F.col("page_no"), F.lit(None).cast("string")))
    return h.withColumn("match_score", F.col("keyword_score") * X.bucket_multiplier(F.col("search_bucket"))).withColumn("block_match_score", F.col("lex_hits") + F.when(F.col("exact_phrase"), 8.0).otherwise(0.0))


def merge_hits(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Hits of both lists joined on (query_id, row_id); the harsher bucket wins."""
    known = lambda df: df if "semantic_raw_score" in df.columns else df.withColumn("semantic_raw_score", F.lit(0.0))
    k, s = known(keyword).alias("k"), known(semantic).alias("s")
    high = lambda c: F.greatest(F.coalesce(f"k.{c}", F.lit(0.0)), F.coalesce(f"s.{c}", F.lit(0.0)))
    harsh = F.when(F.col("k.search_bucket").isNull() | (X.bucket_multiplier(F.col("s.search_bucket")) < X.bucket_multiplier(F.col("k.search_bucket"))), F.col("s.search_bucket")).otherwise(F.col("k.search_bucket"))
    both = k.join(s, ["query_id", "row_id"], "full_outer").select(
        "query_id", "row_id", F.coalesce("k.doc_id", "s.doc_id").alias("doc_id"), F.coalesce("k.page_no", "s.page_no").alias("page_no"),
        high("keyword_score").alias("keyword_score"), high("semantic_score").alias("semantic_score"), high("semantic_raw_score").alias("semantic_raw_score"),
        F.greatest(F.coalesce("k.lex_hits", F.lit(0)), F.coalesce("s.lex_hits", F.lit(0))).alias("lex_hits"),
        (F.coalesce("k.exact_phrase", F.lit(False)) | F.coalesce("s.exact_phrase", F.lit(False))).alias("exact_phrase"), F.coalesce(harsh, F.lit("body")).alias("search_bucket"),
    )
    bonus = F.when((F.col("keyword_score") > 0) & (F.col("semantic_score") > 0), 0.05).otherwise(0.0) + F.when(F.col("exact_phrase"), 0.05).otherwise(0.0) + F.least("lex_hits", F.lit(4)) * 0.01
    return both.withColumn("match_score", (F.col("keyword_score") + F.col("semantic_score") + bonus) * X.bucket_multiplier(F.col("search_bucket")))


def token_stats(queries: DataFrame, rows: DataFrame | Index) -> DataFrame:
    """(query_id, token, df, weight, rare) of the content tokens of each query over rows (row_id, text) or their index."""
    index = as_index(rows)
    q = queries.select("query_id", F.explode(X.content_tokens(F.col("query"))).alias("token"))
    known = frequencies(q, index).join(F.broadcast(index.stats.select("n")))  # one row
    weight = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return known.select("query_id", "token", "df", F.round(weight, 6).alias("weight"), (F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.06))).alias("rare"))


def annotate_hits(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds content, rare and weighted token support from ``token_stats``."""
    per = stats.groupBy("query_id").agg(F.collect_list(F.struct("token", "weight", "rare")).alias("tokens_"))
    h = hits.join(per, "query_id", "left").withColumn("tokens_", F.coalesce("tokens_", F.array().cast("array<struct<token:string,weight:double,rare:boolean>>")))
    low = F.lower("text")
    inside = F.filter("tokens_", lambda t: F.contains(low, t["token"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, t: s + t["weight"])
    return h.withColumns({
        "content_hits": F.size(inside), "content_count": F.size("tokens_"), "rare_hits": F.size(F.filter(inside, lambda t: t["rare"])),
        "rare_count": F.size(F.filter("tokens_", lambda t: t["rare"])), "weighted_ratio": F.when(F.size("tokens_") > 0, total(inside) / total(F.col("tokens_"))).otherwise(0.0),
    }).drop("tokens_")


# Scores of the gate for page hits: a front page by words; enough words by coverage and score; coverage below which, and score from which, a weak hit counts by itself.
FRONT_KEYWORD, COVERED, COVERED_SCORE, UNCOVERED, WEAK_SCORE = 0.12, 0.78, 0.10, 0.52, 0.085
# What a weak hit has at least one of: match of a block, keyword score, similarity.
WEAK_BLOCK, WEAK_KEYWORD, WEAK_SIMILARITY = 4.5, 0.05, 0.012


def section_gate(hits: DataFrame) -> DataFrame:
    """Keeps the hits that are relevant enough; ``hits`` annotated, with query, scores and bucket, and semantic_raw_score and canonical where known."""
    similarity = F.coalesce("semantic_raw_score", F.lit(0.0)) if "semantic_raw_score" in hits.columns else F.lit(0.0)
    low = X.is_low_salience(F.col("canonical")) if "canonical" in hits.columns else F.lit(False)
    n = F.size(X.query_tokens(F.col("query")))
    lex, content, rare, nrare = F.col("lex_hits"), F.col("content_hits"), F.col("rare_hits"), F.col("rare_count")
    enough = (content >= X.min_hits(F.col("content_count"))) & (lex >= X.min_hits(n))
    some = (lex >= F.greatest(F.lit(1), X.min_hits(n) - 1)) | (F.col("block_match_score") >= WEAK_BLOCK) | (F.col("keyword_score") >= WEAK_KEYWORD) | (similarity >= WEAK_SIMILARITY)
    weak = (F.col("match_score") >= WEAK_SCORE) & (content >= 1) & ((nrare == 0) | (rare >= 1)) & some
    keep = (
        F.when(F.col("search_bucket") == "references", False).when(F.col("exact_phrase"), True)
        .when((F.col("content_count") == 0) & (lex >= X.min_hits(n)), True)
        .when(F.col("search_bucket") == "front_matter", (F.col("keyword_score") >= FRONT_KEYWORD) & (content >= 1))
        .when(F.col("search_bucket") != "body", False)
        .when(enough, (nrare == 0) | (rare >= X.min_hits(nrare)) | ((F.col("weighted_ratio") >= COVERED) & (F.col("match_score") >= COVERED_SCORE)))
        .when((nrare > 0) & (rare == 0), False).when(low, False).when((content >= 1) & (F.col("weighted_ratio") < UNCOVERED), False).otherwise(weak)
    )
    return hits.filter(keep)


def doc_scores(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, n_support): the three best hits of a document, weighted, with page and bucket rules."""
    by = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("match_score"), "row_id")
    top = hits.withColumn("i", F.row_number().over(by)).filter("i <= 3")
    weight = F.when(F.col("i") == 1, 1.0).when(F.col("i") == 2, 0.6).otherwise(0.35)
    bucket = lambda b: F.col("search_bucket") == b
    g = top.groupBy("query_id", "doc_id").agg(
        F.sum(weight * F.col("match_score")).alias("s"), F.count_distinct("page_no").alias("pages"), F.count(F.lit(1)).alias("n_support"),
        F.bool_and(bucket("references")).alias("all_ref"), F.bool_or((F.col("i") == 1) & bucket("references")).alias("first_ref"), F.bool_or(bucket("body")).alias("any_body"),
        F.bool_and(bucket("front_matter")).alias("all_front"), F.bool_or((F.col("i") == 1) & bucket("front_matter")).alias("first_front"),
    )
    factor = F.when(F.col("all_ref"), 0.12).when(F.col("first_ref") & ~F.col("any_body"), 0.22).when(F.col("all_front"), 0.5).when(F.col("first_front") & ~F.col("any_body"), 0.7).otherwise(1.0)
    score = (F.col("s") + F.when(F.col("pages") > 1, F.least(F.col("pages") - 1, F.lit(2)) * 0.02).otherwise(0.0)) * factor
    return g.select("query_id", "doc_id", F.round(score, 6).alias("score"), F.col("n_support"))


def title_bonus(queries: DataFrame, docs: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, doc_id, bonus) over docs (doc_id, title); only titles that share a token with the query are met.

    All documents are candidates. Titles are joined by their tokens to the queries'
    tokens, so a query word inside a longer title word does not count here. What a query and a title share is counted
    where the title is read, and only titles with every token of a query are searched for its whole text. (doc_id) must be a key of ``docs``.
    """
    q = queries.select("query_id", "query", X.query_tokens(F.col("query")).alias("tokens"), X.content_tokens(F.col("query")).alias("content"))
    rare = stats.filter("rare").groupBy("query_id").agg(F.collect_list("token").alias("rare"))
    q = q.join(rare, "query_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    asked = q.select("query_id", F.lower(F.trim("query")).alias("query"), F.size("tokens").alias("n"), F.size("content").alias("nc"), F.size("rare").alias("nr"))
    within = lambda c: F.array_contains(c, F.col("part")).cast("int")
    marked = q.select("query_id", F.explode("tokens").alias("part"), "content", "rare").select("query_id", "part", within("content").alias("c"), within("rare").alias("r"))
    words = docs.select("doc_id", F.lower("title").alias("title"), F.array_distinct(X.index_tokens(F.col("title"))).alias("words"))
    # a batch of queries is small beside the titles
    met = title_words(marked, words).join(F.broadcast(asked), "query_id")
    # an exploded array is searched once; the title came along where it holds every token
    met = met.withColumn("phrase", F.explode(F.array(F.coalesce(F.col("o") == F.col("n"), F.lit(False)) & F.coalesce(F.contains("title", "query"), F.lit(False)))))
    over, content, rares, phrase = F.col("o"), F.col("c"), F.col("r"), F.col("phrase")
    score = F.when(phrase, 0.18).otherwise(0.0) + F.least(over, F.lit(5)) * 0.015 + F.least(content, F.lit(5)) * 0.05 + rares * 0.07
    score = score + F.when(F.col("nc") > 0, content / F.col("nc")).otherwise(0.0) * 0.10 + F.when(F.col("nr") > 0, rares / F.col("nr")).otherwise(0.0) * 0.10
    return met.filter(phrase | (content > 0) | (rares > 0) | (over >= 2)).select("query_id", "doc_id", F.round(score, 6).alias("bonus"))


def title_words(marked: DataFrame, titles: DataFrame, group: int = 10_000, most: int = 200_000) -> DataFrame:
    """(query_id, doc_id, title, o, c, r): how many of a query's tokens, content and rare tokens stand in a title of which a word is one of the query's tokens.

    ``marked`` (query_id, part, c, r) has a row for each token of a query, ``titles`` (doc_id, title, words) distinct words. Queries, at most about
    ``group`` of them at a time, travel with the tasks, so neither titles nor pairs are shuffled. A word is cut into its pieces once
    in a task, which remembers ``most`` words. The title is null where it does not hold every token of the query.
    """
    parts = max(1, -(-marked.select("query_id").distinct().count() // group))

    def one(part: int) -> DataFrame:
        of: dict[str, list[tuple[int, int, int]]] = {}
        number: dict[int, int] = {}
        for r in marked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect():
            of.setdefault(r["part"], []).append((number.setdefault(r["query_id"], len(number)), r["c"], r["r"]))
        ids, token = np.array(list(number), np.int64), {p: i for i, p in enumerate(of)}
        # the queries of each token, one after another, with what the token is to them
        held = [np.array(of[p], np.int64).reshape(-1, 3) for p in token]
        sizes = np.bincount([q for rows in held for q, _, _ in rows], minlength=len(ids)) if held else np.zeros(0, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces: dict[str, list[int]] = {}

            def inside(word: str) -> list[int]:
                found = pieces.get(word)
                if found is None:
                    # tokens are letters and digits alone, so one that stands in a title stands in a word of it
                    cut = {word[i:j] for i in range(len(word) - 2) for j in range(i + 3, min(len(word), i + longest) + 1)}
                    found = [token[x] for x in cut if x in token]
                    if len(pieces) < most:
                        pieces[word] = found
                return found

            longest, step = max(map(len, token), default=0), max(1, 2**18 // max(1, len(ids)))  # pairs at once
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    rows, kept = batch.slice(a, step), []
                    for i, words in enumerate(rows.column(2).to_pylist()):
                        whole = [token[w] for w in words if w in token]
                        if not whole:
                            continue
                        met = np.concatenate([held[t] for t in {t for w in words for t in inside(w)}])
                        o, c, r = (np.bincount(met[:, 0], weights=x, minlength=len(ids)).astype(np.int64) for x in (None, met[:, 1], met[:, 2]))
                        q = np.unique(np.concatenate([held[t][:, 0] for t in whole]))
                        kept.append((np.full(len(q), i), q, o[q], c[q], r[q]))
                    if kept:
                        at, q, o, c, r = (np.concatenate(x) for x in zip(*kept, strict=True))
                        title = rows.column(1).take(pa.array(at, mask=o < sizes[q]))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), rows.column(0).take(pa.array(at)), title, *map(pa.array, (o, c, r))], ["query_id", "doc_id", "title", "o", "c", "r"])

        return titles.mapInArrow(run, f"query_id long, doc_id {dict(titles.dtypes)['doc_id']}, title string, o long, c long, r long")

    return reduce(DataFrame.unionByName, map(one, range(parts)))


def chunk_hits_to_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Page rows for chunk hits (query_id, doc_id, page_no, rank, similarity), with the best score of each page."""
    score = 1 / (15 + F.col("rank")) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))) * 0.15
    best = hits.groupBy("query_id", "doc_id", "page_no").agg(F.round(F.max(score), 6).alias("semantic_score"), F.max("similarity").alias("semantic_raw_score"))
    return best.join(pages, ["doc_id", "page_no"])


def section_search(keyword: DataFrame, semantic: DataFrame, search_type: str) -> DataFrame:
    """The plan of a search type: one list alone, or both merged."""
    if search_type == "hybrid":
        return merge_hits(keyword, semantic)
    if search_type not in ("keyword", "embedding"):
        raise ValueError(f"unknown search type {search_type}")
    columns = ["query_id", "row_id", "doc_id", "page_no", "keyword_score", "semantic_score", "semantic_raw_score", "lex_hits", "exact_phrase", "search_bucket"]
    if search_type == "keyword":
        return keyword.select(*columns, "match_score")
    return semantic.select(*columns, (F.col("semantic_score") * X.bucket_multiplier(F.col("search_bucket"))).alias("match_score"))


# Fixed value: the title bonus that makes up for missing hits.
TITLE_ALONE = 0.30


def title_rescue(scored: DataFrame, bonus: DataFrame, pages: DataFrame, least: float = TITLE_ALONE) -> DataFrame:
    """(query_id, doc_id, score, page_no): documents of a high title bonus without hits, with their first page."""
    missing = bonus.filter(F.col("bonus") >= least).join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    first = pages.groupBy("doc_id").agg(F.min("page_no").alias("page_no"))
    return missing.join(first, "doc_id").select("query_id", "doc_id", F.col("bonus").alias("score"), "page_no")


def only_documents(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Restricts rows of any search to the documents of ``ids``."""
    return rows.join(ids.select("doc_id"), "doc_id", "left_semi")


def doc_max_score(hits: DataFrame, score: str) -> DataFrame:
    return hits.groupBy("query_id", "doc_id").agg(F.max(score).alias(score))


def context_by_doc(hits: DataFrame, prefix: int = 100) -> DataFrame:
    """(query_id, source_no, doc_id, n, context): hits (query_id, doc_id, rank, text) of one beginning once, joined by document in rank order."""
    w = Window.partitionBy("query_id", F.substring("text", 1, prefix)).orderBy("rank")
    once = hits.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1")
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    docs = once.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id"))
    return docs.select("query_id", number.alias("source_no"), "doc_id", "n", "context")


def rag_union(*lists: DataFrame) -> DataFrame:
    """Context lists (query_id, rank, row_id) one after another, numbered anew."""
    every = [df.select("query_id", "rank", "row_id", F.lit(i).alias("list_no")) for i, df in enumerate(lists)]
    whole = every[0]
    for df in every[1:]:
        whole = whole.unionByName(df)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("list_no", "rank", "row_id"))
    return whole.select("query_id", number.alias("rank"), "row_id", "list_no")


def full_text_search(queries: DataFrame, rows: DataFrame | Index, k: int) -> DataFrame:
    """(query_id, rank, row_id, score): rows holding all of a query's words anywhere, by the sum of ln(1 + count); no stemming."""
    index = as_index(rows)
    q = queries.select("query_id", F.array_distinct(X.index_tokens(F.col("query"))).alias("q")).filter(F.size("q") > 0)
    asked = frequencies(q.select("query_id", F.size("q").alias("n"), F.explode("q").alias("token")), index)
    per_row = rows_with_all(asked, index).groupBy("query_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("token", F.size("positions").alias("tf")))).alias("p"))
    score = F.aggregate(F.transform("p", lambda x: F.log1p(x["tf"])), F.lit(0.0), lambda a, x: a + x)
    return top_per_query(per_row.select("query_id", "row_id", F.round(score, 6).alias("score")), k, F.desc("score"), "row_id").select("query_id", "rank", "row_id", "score")


def tfidf_search(queries: DataFrame, rows: DataFrame | Index, k: int) -> DataFrame:
    """(query_id, rank, row_id, cosine): rows by the cosine of tf-idf vectors, idf ln((1 + N) / (1 + df)) + 1, over rows sharing a word.

    Only the postings of the queries' words are read; the rows' norms stand in the index. Postings are dealt by row, and queries, at
    most ``vectors.GROUP`` at a time, go with the tasks, which keep their k best rows for each query. So what is shuffled grows with
    the postings, not with the pairs of queries and rows that share a word.
    """
    from corposcope.operators import vectors  # which needs this module

    index = as_index(rows)
    asked = queries.select("query_id", F.explode(X.index_tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("q_tf"))
    known = frequencies(asked, index).filter("df > 0").join(F.broadcast(index.stats.select("n")))  # one row
    known = settled(known.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).select("query_id", "bucket", "token", "idf", (F.col("q_tf") * F.col("idf")).alias("q_w")), index.folder)
    parts = max(1, -(-known.select("query_id").distinct().count() // vectors.GROUP))

    def one(part: int) -> DataFrame:
        mine = known.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
        code = {t: i for i, t in enumerate(sorted({(r["bucket"], r["token"], r["idf"]) for r in mine}))}
        ids = np.array(sorted({r["query_id"] for r in mine}), np.int64)
        q = np.searchsorted(ids, np.array([r["query_id"] for r in mine], np.int64))
        at, weight = np.array([code[r["bucket"], r["token"], r["idf"]] for r in mine], np.int64), np.array([r["q_w"] for r in mine], np.float64)
        norm = np.sqrt(np.bincount(q, weights=weight * weight, minlength=len(ids)))
        order = np.argsort(at, kind="stable")
        q, weight = q[order], weight[order]
        size = np.bincount(at, minlength=len(code))
        start = np.cumsum(size) - size
        coded = queries.sparkSession.createDataFrame([(*t, i) for t, i in code.items()], "bucket int, token string, idf double, code int")
        words = index.postings.join(F.broadcast(coded), ["bucket", "token"]).select("row_id", "code", (F.size("positions") * F.col("idf")).alias("w"))
        whole = words.unionByName(index.lengths.filter("norm IS NOT NULL").select("row_id", F.lit(-1).alias("code"), F.col("norm").alias("w")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), vectors.LAST)
            at_once = max(1, min(2048, 2**21 // max(1, len(ids))))

            def score(row: np.ndarray, c: np.ndarray, w: np.ndarray) -> None:
                own, place = np.unique(row, return_inverse=True)
                of_row = np.zeros(len(own))
                of_row[place[c < 0]] = w[c < 0]
                place, c, w = place[c >= 0], c[c >= 0], w[c >= 0]
                for a in range(0, len(own), at_once):
                    # postings come sorted by row
                    lo, hi = np.searchsorted(place, (a, a + at_once))
                    n = size[c[lo:hi]]
                    each = np.repeat(np.arange(lo, hi), n)
                    entry = start[c[each]] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    held = own[a : a + at_once]
                    dots = np.bincount(q[entry] * len(held) + place[each] - a, weights=w[each] * weight[entry], minlength=len(ids) * len(held)).reshape(len(ids), len(held))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = np.floor(dots / of_row[a : a + at_once] / norm[:, None] * 1e6 + 0.5) / 1e6
                    vectors.merge(best, 0, np.where((dots > 0) & (of_row[a : a + at_once] > 0), s, -np.inf), held)

            rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for batch in batches:
                rest = [np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(rest)]
                cut = np.searchsorted(rest[0], rest[0][-1]) if len(rest[0]) else 0  # the last row may go on
                score(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
            score(*rest)
            r, c = np.nonzero(np.isfinite(best[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(best[1][r, c]), pa.array(best[0][r, c])], ["query_id", "row_id", "cosine"])

        return whole.repartition("row_id").sortWithinPartitions("row_id").mapInArrow(run, "query_id long, row_id long, cosine double")

    return top_per_query(reduce(DataFrame.unionByName, map(one, range(parts))), k, F.desc("cosine"), "row_id").select("query_id", "rank", "row_id", "cosine")


def rag_context(ranked: DataFrame, rows: DataFrame, chars: int = 1200) -> DataFrame:
    """(query_id, source_no, row_id, context): numbered context rows of a ranking, texts squeezed and cut."""
    return ranked.join(rows.select("row_id", X.preview(F.col("text"), chars).alias("context")), "row_id").select("query_id", F.col("rank").alias("source_no"), "row_id", "context")


def find_rows(queries: DataFrame, ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, rank, row_id): a query of digits finds the row of that id; other queries, and ids not found, get their ranking."""
    by_id = queries.filter(F.trim("query").rlike("^[0-9]{1,18}$")).select("query_id", F.trim("query").cast("long").alias("row_id")).join(rows.select("row_id"), "row_id", "left_semi")
    rest = ranked.join(by_id.select("query_id"), "query_id", "left_anti")
    return by_id.select("query_id", F.lit(1).alias("rank"), "row_id").unionByName(rest.select("query_id", "rank", "row_id"))


def doc_gate(hits: DataFrame, bonus: DataFrame, title_alone: float = TITLE_ALONE) -> DataFrame:
    """(query_id, doc_id, title_bonus): documents whose three best gated hits, or whose title, support them enough.

    ``hits`` annotated as for ``section_gate``, with ``canonical`` and
    ``semantic_raw_score``; ``bonus`` from ``title_bonus``. A document whose best
    body hit lies in a section of low salience needs a title or another body hit.
    """
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("match_score"), "row_id")
    top = section_gate(hits).withColumn("i", F.row_number().over(order)).filter("i <= 3")
    need = X.min_hits(F.col("content_count"))
    known = (F.col("rare_count") == 0) | (F.col("weighted_ratio") >= 0.82)
    near = (F.col("content_hits") >= 1) & (F.col("match_score") >= 0.085)
    facts = F.struct(
        "i", F.col("exact_phrase").alias("exact"), X.is_low_salience(F.col("canonical")).alias("low"), (F.col("content_hits") >= need).alias("content"), near.alias("near"),
        ((F.col("content_hits") >= need) & (F.col("lex_hits") >= X.min_hits(F.size(X.query_tokens(F.col("query"))))) & (known | (F.col("rare_hits") >= X.min_hits(F.col("rare_count"))))).alias("full"),
        (near & (known | (F.col("rare_hits") >= 1))).alias("close"), ((F.col("block_match_score") >= 4.5) | (F.coalesce("semantic_raw_score", F.lit(0.0)) >= 0.012)).alias("strong"),
    )
    body = F.col("search_bucket") == "body"
    best = top.groupBy("query_id", "doc_id").agg(F.min(facts).alias("first"), F.min(F.when(body, facts)).alias("body"), F.count_if(body & ~X.is_low_salience(F.col("canonical"))).alias("salient"))
    # of titles alone only high ones count; the others matter where there are hits, and these are few for each query
    known = bonus.select("query_id", "doc_id", F.col("bonus").alias("title_bonus")).join(F.broadcast(best.select("query_id", "doc_id", F.lit(True).alias("hit_"))), ["query_id", "doc_id"], "left")
    known = known.filter((F.col("title_bonus") >= title_alone) | F.col("hit_")).drop("hit_")
    met = best.join(known, ["query_id", "doc_id"], "full_outer").withColumn("title_bonus", F.coalesce("title_bonus", F.lit(0.0)))
    b, f, title = F.col("body"), F.col("first"), F.col("title_bonus")
    keep = (
        F.when(f.isNull(), title >= title_alone).when(b["low"] & (title < 0.10) & (F.col("salient") == 0), False)
        .when(b["exact"] | b["full"] | (b["close"] & ((title >= 0.06) | b["strong"])), True)
        .otherwise((title >= 0.10) & (f["exact"] | f["content"] | f["near"]))
    )
    return met.filter(keep).select("query_id", "doc_id", "title_bonus")
