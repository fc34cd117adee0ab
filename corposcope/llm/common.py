"""Helpers that several of the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^ \t\n\x0B\f\r]+"
BLANK = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one JVM (tests) a temporary
    folder is made and remembered in the session; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("corposcope.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corposcope-")
        spark.conf.set("corposcope.shared.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    computing ``df`` again. Unlike ``checkpoint()`` it computes ``df`` once and
    keeps columns prunable.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``durable``, once what follows is written and nothing reads it again."""
    session = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = session._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if re.fullmatch(r"table-[0-9a-f]{32}", folder.getName()):
            folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def plain_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ranked(df: DataFrame, group: list[str], order: Column, total: int, name: str, per_group: DataFrame | None = None) -> DataFrame:
    """Gapless long ``name`` from 0 within ``group``, in an order given by hash ``order``.

    No task gets a whole group: a group is cut into cells by the leading bits
    of ``order`` (a 64-bit hash), about a thousand rows of the table each. Cells
    are counted, summed up, and rows numbered within their cell. The running
    sum over a group has a row for each cell, not for each row. Rows equal in
    ``order`` are numbered in any order, so ``order`` must cover every column
    that matters to the caller. The further columns of ``per_group``, which has
    a row for each group, are added on the same join.
    """
    bits = max(0, min(40, (max(total, 1) // 1000).bit_length()))
    cell, key, n, before = (plain_name(df, x) for x in ("cell_", "key_", "n_", "before_"))
    keyed = df.withColumn(key, order).withColumn(cell, F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("long"))
    counts = keyed.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(n).over(running), F.lit(0).cast("long"))).drop(n)
    added = []
    if per_group is not None:
        added = [c for c in per_group.columns if c not in group]
        p = per_group.alias("p")
        starts = starts.alias("s").join(p, [F.col(f"s.`{c}`").eqNullSafe(F.col(f"p.`{c}`")) for c in group], "left").select("s.*", *(f"p.`{c}`" for c in added))
    left, right = keyed.alias("l"), starts.alias("r")
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in (*group, cell)]
    joined = left.join(right, same, "left").select("l.*", f"r.`{before}`", *(f"r.`{c}`" for c in added))
    within = Window.partitionBy(*group, cell).orderBy(key)
    return joined.withColumn(name, F.col(before) + F.row_number().over(within) - 1).drop(key, cell, before)
