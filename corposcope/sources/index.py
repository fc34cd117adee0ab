"""A positional index of texts and an index of their trigrams, as tables that outlive a query.

``build`` writes five tables to a folder: postings (token, row_id, positions), the
vocabulary with document frequencies, the rows' lengths and norms, one row of
statistics, and where asked for trigrams. Postings lie in folders by a hash of the token and are
sorted by token in each file, so a join with the tokens of a batch of queries reads their
folders alone (dynamic partition pruning) and in these the row groups that hold them.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corposcope.functions import text as X

#: Bytes of text a folder of postings is meant for, and the most folders.
FOLDER_BYTES, MOST_FOLDERS = 256 * 2**20, 4096
#: Characters of text whose postings a task sorts, and those that are cut into positions at once.
TASK_CHARS, BATCH_CHARS = 8 * 2**20, 2 * 2**20
#: Rows of a list of hits that may go to the rows instead of these being shuffled.
FEW = 500_000


@dataclass(frozen=True)
class Index:
    """postings (bucket, token, row_id, positions), vocabulary (bucket, token, df), lengths (row_id, n_tokens, norm, which is null where it was not asked for), stats (n, mean_len, buckets), and the folder of a written one."""

    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame
    stats: DataFrame
    folder: str | None = None


@dataclass(frozen=True)
class Grams:
    """postings (bucket, token, row_id) and vocabulary (bucket, token, df) of the trigrams of lowered texts, and stats (buckets)."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame


def bucket_of(token: Column, buckets) -> Column:
    return F.pmod(F.xxhash64(token), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def positions(rows: DataFrame) -> DataFrame:
    """(token, row_id, positions) of rows (row_id, text), grouped within each row, so nothing is shuffled.

    Tokens are cut by Spark; a batch's tokens are numbered, sorted by row, token and place at once, and cut into lists.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Pieces of a batch of about as many tokens as ``BATCH_CHARS`` hold, of whole rows."""
        ends = batch.column(1).offsets.to_numpy()[1:]
        piece = (ends - batch.column(1).offsets.to_numpy()[0]) * 4 // BATCH_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in cut(whole)):
            lists = batch.column(1)
            # a slice's values are its own rows' alone
            starts, words = lists.offsets.to_numpy(), lists.flatten()
            if not len(words):
                continue
            sizes = np.diff(starts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(words)) - np.repeat(starts[:-1] - starts[0], sizes)
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            order = np.argsort(row * len(coded.dictionary) + code, kind="stable")  # places stay in order
            r, c = row[order], code[order]
            first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]))))
            found = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(c[first])), batch.column(0).take(pa.array(r[first])), found], ["token", "row_id", "positions"])

    return rows.select(F.col("row_id").cast("long").alias("row_id"), X.index_tokens(F.col("text")).alias("tokens")).mapInArrow(run, "token string, row_id long, positions array<int>")


def trigrams(rows: DataFrame) -> DataFrame:
    """(token, row_id): distinct runs of three characters of lowered texts; two marks behind a text give its last characters runs of their own."""
    chars = F.split(F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit("\1\1")), "")
    held = rows.select(F.col("row_id").cast("long").alias("row_id"), F.explode(F.array(F.struct(chars.alias("c")))).alias("a")).select("row_id", F.col("a.c").alias("c"))
    c = F.col("c")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    return held.filter(F.size(c) > 2).select(F.explode(F.array_distinct(grams)).alias("token"), "row_id")


def vocabulary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"))


def norms(postings: DataFrame, vocabulary: DataFrame, stats: DataFrame, chars: int = 0) -> DataFrame:
    """(row_id, norm): lengths of the rows' tf-idf vectors, idf ln((1 + N) / (1 + df)) + 1; tasks are as many as ``chars`` of text ask for, where known."""
    idf = vocabulary.join(F.broadcast(stats.select("n"))).select("bucket", "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    postings, weight = postings.select("bucket", "token", "row_id", F.size("positions").alias("tf")), F.col("tf") * F.col("idf")
    if chars:
        postings, idf = (df.repartition(max(8, -(-chars // TASK_CHARS)), "bucket", "token") for df in (postings, idf))
    return postings.join(idf, ["bucket", "token"]).groupBy("row_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def lengths_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.size(X.index_tokens(F.col("text"))).alias("n_tokens"), F.length("text").alias("n_chars"))


def stats_of(lengths: DataFrame, buckets: int) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean_len")).withColumn("buckets", F.lit(buckets))


def unwritten(rows: DataFrame) -> Index:
    """The index of rows (row_id, text) as plans, for tables too small or too short-lived to be written."""
    postings = positions(rows).withColumn("bucket", F.lit(0))
    vocabulary, lengths = vocabulary_of(postings), lengths_of(rows)
    stats = stats_of(lengths, 1)
    return Index(postings, vocabulary, lengths.join(norms(postings, vocabulary, stats), "row_id", "left"), stats)


def _write_postings(rows: DataFrame, path: str, buckets: int, chars: int) -> DataFrame:
    """Postings by folder and in slices of rows, as many as keep what a task sorts small, however many rows hold a token; ``chars`` of text in all."""
    slices = max(1, -(-chars // (buckets * TASK_CHARS)))
    dealt = rows.withColumn("bucket", bucket_of(F.col("token"), buckets)).repartition(2 * buckets * slices, F.col("bucket"), F.pmod(F.hash("row_id"), F.lit(slices)))
    dealt.sortWithinPartitions("bucket", "token", "row_id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("bucket", IntegerType())])).parquet(path)


def build(rows: DataFrame, folder: str, normed: bool = True) -> Index:
    """Writes the positional index of rows (row_id, text) to ``folder``, with the rows' norms if ``normed``; the statistics come last and mark it whole."""
    spark = rows.sparkSession
    lengths_of(rows).write.mode("overwrite").parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    total = sizes.agg(F.sum("n_chars")).first()[0] or 0
    buckets = max(4, min(MOST_FOLDERS, total // FOLDER_BYTES))
    postings = _write_postings(positions(rows), f"{folder}/postings", buckets, total)
    vocabulary_of(postings).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    vocabulary, stats = spark.read.parquet(f"{folder}/vocabulary"), stats_of(sizes, buckets)
    lengths = sizes.select("row_id", "n_tokens")
    (lengths.join(norms(postings, vocabulary, stats, total), "row_id", "left") if normed else lengths).write.mode("overwrite").parquet(f"{folder}/lengths")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")
    return read(spark, folder)


def read(spark: SparkSession, folder: str) -> Index:
    kinds = {"postings": "token string, row_id long, positions array<int>, bucket int", "vocabulary": "bucket int, token string, df long", "lengths": "row_id long, n_tokens int, norm double", "stats": "n long, mean_len double, buckets int"}
    return Index(*(spark.read.schema(kind).parquet(f"{folder}/{t}") for t, kind in kinds.items()), folder)


def build_grams(rows: DataFrame, folder: str) -> Grams:
    """Writes the trigrams of rows (row_id, text) to ``folder``."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4, min(MOST_FOLDERS, total // FOLDER_BYTES))
    postings = _write_postings(trigrams(rows), f"{folder}/grams", buckets, total)
    vocabulary_of(postings).write.mode("overwrite").parquet(f"{folder}/gram_vocabulary")
    rows.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{folder}/gram_stats")
    return read_grams(rows.sparkSession, folder)


def read_grams(spark: SparkSession, folder: str) -> Grams:
    kinds = {"grams": "token string, row_id long, bucket int", "gram_vocabulary": "bucket int, token string, df long", "gram_stats": "buckets int"}
    return Grams(*(spark.read.schema(kind).parquet(f"{folder}/{t}") for t, kind in kinds.items()))


def unwritten_grams(rows: DataFrame) -> Grams:
    postings = trigrams(rows).withColumn("bucket", F.lit(0))
    return Grams(postings, vocabulary_of(postings), rows.sparkSession.createDataFrame([(1,)], "buckets int"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session in one JVM that names none gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corposcope.index.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corposcope-")
        spark.conf.set("corposcope.index.dir", folder)
    return folder


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` computed once, as a table in ``folder`` or the shared one."""
    path = f"{folder or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(rows: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys ``hits`` (settled) name, if these are few: then rows need not be shuffled to meet them. Else all rows."""
    return rows.join(F.broadcast(hits.select(*keys).distinct()), keys, "left_semi") if hits.count() <= FEW else rows


def _state(source: DataFrame, name: str) -> str:
    """A digest of the files behind ``source`` (paths, lengths, times of change) and the kind of index."""
    spark, seen = source.sparkSession, [name]
    for file in sorted(source.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]


def _whole(spark: SparkSession, folder: str, last: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def index_for(rows: DataFrame, source: DataFrame, name: str, normed: bool = True) -> Index:
    """The index of ``rows``, written once for each state of the files behind ``source``; ``name`` tells kinds of rows apart, and only tf-idf searches need them ``normed``."""
    folder = f"{shared_folder(rows.sparkSession)}/index-{_state(source, name)}"
    return read(rows.sparkSession, folder) if _whole(rows.sparkSession, folder, "stats") else build(rows, folder, normed)


def grams_for(rows: DataFrame, source: DataFrame, name: str) -> Grams:
    """As ``index_for``, of trigrams."""
    folder = f"{shared_folder(rows.sparkSession)}/grams-{_state(source, name)}"
    return read_grams(rows.sparkSession, folder) if _whole(rows.sparkSession, folder, "gram_stats") else build_grams(rows, folder)
