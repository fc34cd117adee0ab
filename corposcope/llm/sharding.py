"""K-d tree sharding: documents into shards of near-equal bytes.

The metadata of a document is a point; a node of the tree is split on its
widest dimension at a weighted quantile, so that each side gets bytes in
proportion to the shards it will hold, until a node is one shard.

Quantiles are exact and found over all rows: a dimension's value, a hash of
the text and a hash of the row make a 60-bit key, and the key of the cut is
found ten bits at a time from sums of bytes. A pass over the slim metadata
brings back at most 1024 sums for each node, whatever the number of rows. All
nodes of a level share their passes. The tree is a handful of thresholds, so
giving rows their shards needs no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposcope.llm.common import durable, plain_name, ranked

OVERHEAD = 16
VALUE_BITS, TEXT_BITS, ROW_BITS, STEP = 20, 16, 24, 10
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")


@dataclass
class Node:
    low: int  # the node's first shard
    shards: int
    bytes: int
    dimension: int = 0
    cut: int = 0  # keys up to it go left
    left: Node | None = None
    right: Node | None = None


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _position(column: Column, kind: str) -> Column:
    """A dimension's value as an integer of VALUE_BITS bits, in the order of the values (null: 0).

    Dates and times count as their seconds since 1970; numbers and times below 0 stand with 0. Numbers keep their order on a logarithmic scale; strings are spread by a hash.
    """
    top = (1 << VALUE_BITS) - 1
    if kind in ("string", "varchar", "char"):
        spread = F.pmod(F.xxhash64(column), F.lit(top)).cast("long") + 1
        return F.coalesce(F.when(column.isNotNull(), spread), F.lit(0).cast("long"))
    x = (F.unix_timestamp(column.cast("timestamp")) if kind.startswith(("date", "timestamp")) else column).cast("double")
    # 2^14 steps for each doubling, up to 2^63.
    scaled = F.floor(F.log2(F.greatest(x, F.lit(0.0)) + 1) * (top / 64.0))
    return F.coalesce(F.when(F.isnan(x), F.lit(0)).otherwise(F.least(scaled, F.lit(top))), F.lit(0)).cast("long")


def _keys(docs: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    kinds = dict(docs.dtypes)
    tie = F.shiftright(crc_of(F.col("text")), 32 - TEXT_BITS) * (1 << ROW_BITS) + F.pmod(F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("text")), F.lit(1 << ROW_BITS))
    return [_position(F.col(f"`{d}`"), kinds[d]) * (1 << (TEXT_BITS + ROW_BITS)) + tie for d in dimensions]


def _side(keys: list[Column], nodes: list[Node], root: Node, value) -> Column:
    """CASE over the tree as far as it is grown; ``value`` gives what a leaf yields."""

    def of(node: Node) -> Column:
        if node.left is None:
            return value(node)
        return F.when(keys[node.dimension] <= node.cut, of(node.left)).otherwise(of(node.right))

    return of(root)


def fit_tree(docs: DataFrame, shards: int, dimensions: tuple[str, ...] = DIMENSIONS) -> Node:
    """The tree over all rows of ``docs`` (doc_id, text and metadata columns).

    A dimension that the table lacks is left out; doc_id is always one.
    """
    dimensions = tuple(d for d in dimensions if d in docs.columns)
    names = [f"k{i}" for i in range(len(dimensions))]
    slim = docs.select(size_of(F.col("text")).alias("size"), *(k.alias(n) for n, k in zip(names, _keys(docs, dimensions), strict=True)))
    slim = durable(slim)  # many passes read it
    keys = [F.col(n) for n in names]
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    root = Node(0, shards, total)
    level, whole = [root], None
    while level := [n for n in level if n.shards > 1]:
        at = {id(n): i for i, n in enumerate(level)}
        placed = slim.withColumn("node", _side(keys, level, root, lambda n: F.lit(at.get(id(n))).cast("int"))).filter("node IS NOT NULL")
        # The widest dimension: the largest spread of positions, as a share of that in the whole table.
        spread = placed.groupBy("node").agg(*(F.stddev_pop(F.shiftright(k, TEXT_BITS + ROW_BITS).cast("double")).alias(n) for n, k in zip(names, keys, strict=True)))
        wide = {r["node"]: [r[n] or 0.0 for n in names] for r in spread.collect()}
        if whole is None:
            whole = wide.get(0, [0.0] * len(names))
        for i, node in enumerate(level):
            widths = [w / g if g else 0.0 for w, g in zip(wide.get(i, whole), whole, strict=True)]
            node.dimension = max(range(len(names)), key=lambda d: (widths[d], -d))
        key = F.lit(None).cast("long")
        for d in range(len(names)):
            mine = [i for i, n in enumerate(level) if n.dimension == d]
            if mine:
                key = F.when(F.col("node").isin(mine), keys[d]).otherwise(key)
        keyed = placed.select("node", "size", key.alias("key"))
        # The cut is sought in the range of keys with this prefix; `before` bytes lie left of the range.
        prefix, before, done = [0] * len(level), [0] * len(level), [False] * len(level)
        bits = VALUE_BITS + TEXT_BITS + ROW_BITS
        wanted = [n.bytes * (n.shards // 2) / n.shards for n in level]
        while bits > 0 and not all(done):
            bits -= STEP
            alive = [i for i in range(len(level)) if not done[i]]
            inside = F.lit(False)
            for i in alive:
                inside = inside | ((F.col("node") == i) & (F.shiftright("key", bits + STEP) == prefix[i]))
            sums = keyed.filter(inside).groupBy("node", F.shiftright("key", bits).alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
            by: dict[int, list] = {i: [] for i in alive}
            for r in sums:
                by[r["node"]].append((r["bucket"], r["size"], r["n"]))
            for i in alive:
                run, last = before[i], prefix[i] << STEP
                for bucket, size, n in sorted(by[i]):
                    if run + size > wanted[i]:
                        break
                    run, last = run + size, bucket
                else:
                    bucket, size, n = last, 0, 0
                # A bucket of one row, or none, is not opened: the nearer of its two ends is the cut.
                if n <= 1 or bits == 0:
                    take = n >= 1 and abs(run + size - wanted[i]) < abs(run - wanted[i])
                    cut = ((bucket + 1) << bits) - 1 if take or n == 0 else (bucket << bits) - 1
                    level[i].cut, before[i], done[i] = cut, run + (size if take else 0), True
                else:
                    prefix[i], before[i] = bucket, run
        for i, node in enumerate(level):
            half = node.shards // 2
            node.left = Node(node.low, half, before[i])
            node.right = Node(node.low + half, node.shards - half, node.bytes - before[i])
        level = [c for n in level for c in (n.left, n.right)]
    return root


def assign(docs: DataFrame, tree: Node, dimensions: tuple[str, ...] = DIMENSIONS, name: str = "shard") -> DataFrame:
    """``docs`` with its shard, an expression over each row alone."""
    dimensions = tuple(d for d in dimensions if d in docs.columns)
    keys = [plain_name(docs, f"kd_key_{i}_") for i in range(len(dimensions))]
    keyed = docs.select("*", *(k.alias(n) for n, k in zip(keys, _keys(docs, dimensions), strict=True)))
    return keyed.withColumn(name, _side([F.col(k) for k in keys], [], tree, lambda n: F.lit(n.low))).drop(*keys)


def shard(docs: DataFrame, shards: int = 40, dimensions: tuple[str, ...] = DIMENSIONS, slots: bool = True) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    Shards hold near-equal bytes (law "bytes"): a cut is off by half a document
    at most. Rows are placed by source, language, length and id, so copies of a text that
    differ in one of these may lie in different shards: the law is about bytes, and a group of copies may be
    larger than a shard. A very long text is one row of its size: a shard that holds it may exceed the others by half of it. A null text has
    no bytes and the checksum of the empty text; null metadata sort first. Rows
    equal in doc_id and text go to one shard. An empty table gives no rows.
    Added columns replace columns of these names.
    """
    base = docs.select(*(f"`{c}`" for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")))
    tree = fit_tree(base, shards, dimensions)
    placed = assign(base, tree, dimensions).withColumns({"size": size_of(F.col("text")), "text_crc32": crc_of(F.col("text"))})
    return with_slots(placed, base.count()) if slots else placed


def with_slots(placed: DataFrame, total: int) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, in a hash order."""
    return ranked(placed, ["shard"], F.xxhash64(F.lit("slot"), F.col("doc_id"), F.col("text_crc32"), F.col("size")), total, "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Whole documents as Parquet, a folder for each shard."""
    shard(docs, shards, slots=False).write.partitionBy("shard").parquet(path)
