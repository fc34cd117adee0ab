"""Registries of assets and of ingestion: primary flags, audits, repair plans, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def demote_primary(assets: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``assets`` with ``is_primary`` left only on the first claimant of each key in ``order``."""
    w = Window.partitionBy(*keys, "is_primary").orderBy(*order)
    return assets.withColumn("is_primary", F.col("is_primary") & (F.row_number().over(w) == 1))


def docs_with_asset(docs: DataFrame, assets: DataFrame) -> DataFrame:
    return docs.join(assets.filter("is_primary").select("doc_id"), "doc_id", "left_semi")


def audit_storage(docs: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """(doc_id, state, issues): where a document's file is, from the keys of ``remote`` and ``local`` (doc_id)."""
    mark = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    met = docs.select("doc_id").join(mark(remote, "far"), "doc_id", "left").join(mark(local, "near"), "doc_id", "left").fillna(False, ["far", "near"])
    state = F.when(F.col("far") & F.col("near"), "backed").when(F.col("far"), "remote_only").when(F.col("near"), "local_only").otherwise("broken")
    issues = F.array_compact(F.array(F.when(~F.col("far"), "no_object"), F.when(~F.col("near"), "no_local_file")))
    return met.select("doc_id", state.alias("state"), F.array_join(issues, ",").alias("issues"))


def repair_plan(audit: DataFrame) -> DataFrame:
    action = F.when(F.col("state") == "local_only", "upload").when(F.col("state") == "remote_only", "restore").when(F.col("state") == "broken", "unrecoverable")
    return audit.withColumn("action", action).filter("action IS NOT NULL").select("doc_id", "action")


def ingest_status(docs: DataFrame, results: DataFrame, most: int = 500) -> DataFrame:
    """(doc_id, status, error) from results (doc_id, started, finished, error); errors are cut."""
    met = docs.select("doc_id").join(results, "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("finished"), "done").when(F.col("started"), "processing").otherwise("queued")
    return met.select("doc_id", status.alias("status"), F.substring("error", 1, most).alias("error"))


def backfill_candidates(docs: DataFrame, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Documents with a path that is not empty, optionally only those of ``ids``."""
    found = docs.filter(F.coalesce(path, F.lit("")) != "")
    return found if ids is None else found.join(ids.select("doc_id"), "doc_id", "left_semi")


def first_per_config(rows: DataFrame, config: str, size: str, most: float, n: int, key: str) -> DataFrame:
    """First ``n`` rows by key of each configuration with 0 < size <= most."""
    w = Window.partitionBy(config).orderBy(key)
    return rows.filter((F.col(size) > 0) & (F.col(size) <= most)).withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_")
