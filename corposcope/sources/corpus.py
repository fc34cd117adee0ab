"""Corpus tables: reading, views over documents, maintenance by keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TABLES = ("documents", "pages", "embeddings", "benchmark", "labels", "conversations", "events", "customer", "orders", "lineitem", "part", "supplier", "nation", "region")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks_of(documents: DataFrame, per_page: int = 5, blanks: str = " ") -> DataFrame:
    """(doc_id, block_index, page_no, text): the non-blank lines of each document; a line of ``blanks`` alone is blank."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "" if blanks == " " else x.rlike(f"[^{blanks}]"))
    return documents.select("doc_id", F.posexplode(lines).alias("block_index", "text")).withColumn("page_no", (F.col("block_index") / per_page).cast("int") + 1)


def pages_of(documents: DataFrame, per_page: int = 5) -> DataFrame:
    """(doc_id, page_no, text): blocks joined by a space, cut within each row so nothing is shuffled."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    d = documents.select("doc_id", F.explode(F.array(lines)).alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / per_page).cast("int"))
    return d.filter(F.size("lines") > 0).select("doc_id", "lines", F.explode(starts).alias("p")).select("doc_id", (F.col("p") + 1).alias("page_no"), F.array_join(F.slice("lines", F.col("p") * per_page + 1, F.lit(per_page)), " ").alias("text"))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text, spans, n_pages, sha1): pages in order joined by newlines, with [start, end, page] spans; empty ones dropped."""
    order = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.filter(F.coalesce("text", F.lit("")) != "").withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0).cast("long")))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "start", "text")))
    whole = placed.groupBy("doc_id").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    spans = F.transform("parts", lambda p: F.concat_ws(":", p["start"], p["start"] + F.length(p["text"]), p["page_no"]))
    return whole.select("doc_id", F.array_join(spans, ",").alias("spans"), F.size("parts").alias("n_pages"), text.alias("text"), F.sha1(text).alias("sha1"))


def build_postings(texts: DataFrame, row_id: str, tokens) -> DataFrame:
    """(token, row_id, tf); counts are combined before the shuffle."""
    return texts.select(row_id, F.explode(tokens).alias("token")).groupBy("token", row_id).agg(F.count(F.lit(1)).alias("tf"))


def unique_index(rows: DataFrame, group: list[str], index: str, order: list[str]) -> DataFrame:
    """Repeats of ``index`` in a group get the group's maximum + 1, + 2, ...; the old one stays as ``source_index``."""
    again = Window.partitionBy(*group, index).orderBy(*order)
    in_order = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("source_index", F.col(index)).withColumn("again", (F.row_number().over(again) > 1).cast("int"))
    marked = marked.withColumn("nth", F.sum("again").over(in_order)).withColumn("top", F.max(index).over(Window.partitionBy(*group)))
    return marked.withColumn(index, F.when(F.col("again") == 1, F.col("top") + F.col("nth")).otherwise(F.col(index))).drop("again", "nth", "top")


def newest_rows(rows: DataFrame, keys: list[str], newest: str | None) -> DataFrame:
    """One row for each key: the one of the largest ``newest``, then of the largest other columns."""
    order = F.struct(*([newest] if newest else []), *(c for c in rows.columns if c not in keys and c != newest))
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("rn_ = 1").drop("rn_")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; of rows that repeat a key in ``new`` the newest counts."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(newest_rows(new, keys, newest))


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of a document in ``new`` take the place of its rows in ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_documents(new: DataFrame, folder: str, buckets: int = 64, key: str = "doc_id") -> None:
    """A table at ``folder`` in which all rows of the documents of ``new`` take the place of their former ones.

    Documents lie in folders by a hash of their key. Only folders that a document of ``new`` falls
    into are read and written anew (dynamic partition overwrite); the files of the others stay. Repeated, it changes
    nothing. ``buckets`` must stay the same for a table.
    """
    spark = new.sparkSession
    dealt = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.schema(dealt.schema).parquet(folder).filter(F.col("bucket").isin(touched))
        dealt = old.join(new.select(key).distinct(), key, "left_anti").select(*dealt.columns).unionByName(dealt)
    dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def delete_documents(rows: DataFrame, ids: DataFrame, key: str = "doc_id", detach: bool = False) -> DataFrame:
    """Cascade delete, or with ``detach`` the key set to null."""
    if not detach:
        return rows.join(ids.select(key).distinct(), key, "left_anti")
    marked = rows.join(ids.select(key, F.lit(True).alias("gone_")).distinct(), key, "left")
    return marked.withColumn(key, F.when(F.col("gone_").isNull(), F.col(key))).drop("gone_").select(*rows.columns)


def remap_ids(parents: DataFrame, key: str) -> DataFrame:
    """(old_id, new_id): dense ids from 1 in the order of the old ones."""
    return numbered(parents.select(F.col(key).alias("old_id")).distinct(), "old_id").select("old_id", (F.col("number") + 1).alias("new_id"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def sample_per_category(rows: DataFrame, category: str, key: str, order: str, targets: dict[str, int]) -> DataFrame:
    """First N of each category; a key counts once, for the first category that takes it."""
    taken = None
    for name, n in targets.items():
        left = rows.filter(F.col(category) == name)
        if taken is not None:
            left = left.join(taken.select(key), key, "left_anti")
        part = left.groupBy(key).agg(F.min(order).alias(order)).orderBy(order, key).limit(n).withColumn(category, F.lit(name))
        taken = part if taken is None else taken.unionByName(part)
    return taken


def numbered(rows: DataFrame, key: str, cells: int = 64) -> DataFrame:
    """``rows`` of distinct keys with a gapless ``number`` from 0 in the order of ``key``, without a single-task window.

    Cells of about as many rows lie between keys of a bounded sample. Cells are counted and summed up, and rows
    numbered within theirs.
    """
    sample = sorted(r[0] for r in rows.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(32 * cells).select(key).collect())
    bounds = sample[31::32]
    cell = sum(((F.col(key) >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    keyed = rows.withColumn("cell_", F.when(F.col(key).isNull(), -1).otherwise(cell))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keyed.groupBy("cell_").agg(F.count(F.lit(1)).alias("n_")).withColumn("before_", before).select("cell_", "before_")  # a row for each cell
    within = F.row_number().over(Window.partitionBy("cell_").orderBy(key))
    return keyed.join(F.broadcast(starts), "cell_").withColumn("number", (F.col("before_") + within - 1).cast("long")).drop("cell_", "before_")


def pending_work(paths: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """(group_no, n_paths, hash): unknown paths in order, n to a group, without the groups whose hash is done."""
    groups = numbered(paths.select("path").distinct(), "path").select("path", F.floor(F.col("number") / n).alias("group_no"))
    hashed = groups.groupBy("group_no").agg(F.count(F.lit(1)).alias("n_paths"), F.sha1(F.array_join(F.array_sort(F.collect_list("path")), "")).alias("hash"))
    return hashed.join(done.select("hash").distinct(), "hash", "left_anti").select("group_no", "n_paths", "hash")


def upsert_keeping(old: DataFrame, new: DataFrame, key: str, kept: str, newest: str | None = None) -> DataFrame:
    """Upsert by key in which the column ``kept`` stays as first inserted; of rows that repeat a key in ``new`` the newest counts."""
    first = newest_rows(new, [key], newest).join(old.select(key, F.col(kept).alias("old_")), key, "left")
    merged = first.withColumn(kept, F.coalesce("old_", kept)).drop("old_").select(*old.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(merged)


def index_check(rows: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_indexed, n_missing): rows of the base table against those that the index holds."""
    indexed = postings.select(key).distinct().withColumn("indexed", F.lit(1))
    return rows.select(key).join(indexed, key, "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count("indexed").alias("n_indexed"), F.count_if(F.col("indexed").isNull()).alias("n_missing"))


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each table, to compare a copy with its source."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def clean_transcript(lines: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """(key, text): caption lines as a transcript.

    Headers, notes, cue times, cue numbers and tags go; of rolling captions,
    each a prefix of the next, the fullest line stays. A transcript is one row.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]*>", "")
    for written, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(written), F.lit(sign))
    shaped = lines.select(key, order, F.trim(F.regexp_replace(plain, r"\s+", " ")).alias("line"))
    kept = shaped.filter((F.col("line") != "") & ~F.col("line").rlike(r"^(WEBVTT|KIND:|LANGUAGE:|Kind:|Language:|NOTE\b)|-->|^[0-9]+$"))
    whole = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("lines"))

    @F.pandas_udf(StringType())
    def collapsed(transcripts: pd.Series) -> pd.Series:
        return transcripts.map(lambda rows: "\n".join(fullest([r["line"] for r in rows])))

    return whole.select(key, collapsed("lines").alias("text"))


def fullest(lines: list[str]) -> list[str]:
    """``lines`` of which one that goes on another, or is its beginning, counts once, as the longer one."""
    out: list[str] = []
    for line in lines:
        if out and line.startswith(out[-1]):
            out[-1] = line
        elif not (out and out[-1].startswith(line)):
            out.append(line)
    return out


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table to its folder as parquet, json or csv; a repeated write replaces it."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").format(form).save(f"{folder}/{name}")


def list_newest(rows: DataFrame, created: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(created), F.desc(key))


def page_excerpt(pages: DataFrame, wanted: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, first_page, last_page, text): the texts of a range of pages joined by newlines and cut."""
    met = pages.join(wanted, "doc_id").filter(F.col("page_no").between(F.col("first_page"), F.col("last_page")))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return met.groupBy("doc_id", "first_page", "last_page").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, most).alias("text"))
