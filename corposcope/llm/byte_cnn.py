"""A byte-level convolutional quality classifier in numpy.

Bytes are embedded and convolved with learned filters at every second byte. A
document is covered by overlapping chunks; in a chunk each filter's largest
response counts, and the mean and the maximum of these over all chunks give
one probability by a logistic layer. Fitting uses a bounded sample of labelled
rows; scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIDE, WIDTH, FILTERS, DEPTH = 2, 6, 16, 8
BLOCK, BLOCKS = 64, 8  # a chunk is 8 blocks of 64 bytes; neighbours share a block
CHUNK, STEP = BLOCK * BLOCKS, BLOCK * (BLOCKS - 1)


@dataclass
class Network:
    embed: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH x DEPTH x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    offset: float

    def tables(self) -> np.ndarray:
        """WIDTH x 256 x FILTERS: what a byte at a tap adds to each filter."""
        return np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32)


def chunk_maxima(data: bytes, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """chunks x FILTERS: the largest rectified response of each filter in each chunk of ``data``."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.zeros((0, FILTERS), np.float32)
    blocks = -(-len(x) // BLOCK)
    x = np.concatenate((x, np.full(WIDTH, 32, np.uint8)))
    per = BLOCK // STRIDE
    largest = np.empty((blocks, FILTERS), np.float32)
    for low in range(0, blocks, 4096):  # a window begins in its block and may end in the next
        high = min(blocks, low + 4096)
        first, windows = low * per, -(-(min(high * BLOCK, len(x) - WIDTH) - low * BLOCK) // STRIDE)
        out = np.zeros((windows, FILTERS), np.float32)
        for k in range(WIDTH):
            out += tables[k][x[first * STRIDE + k :: STRIDE][:windows]]
        largest[low:high] = np.maximum.reduceat(out, np.arange(0, windows, per))
    largest = np.maximum(largest + bias, 0)
    starts = np.arange(0, max(1, blocks - 1), BLOCKS - 1)
    return np.stack([largest[s : s + BLOCKS].max(axis=0) for s in starts])


def probability(maxima: np.ndarray, net: Network) -> float:
    features = np.concatenate((maxima.mean(axis=0), maxima.max(axis=0))) if len(maxima) else np.zeros(2 * FILTERS)
    return float(1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30))))


def train(texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 32, most_chunks: int = 512, seed: int = 7) -> Network:
    """Fits by Adam on all chunks of whole texts; a step takes about ``batch`` texts, fewer where they have over ``most_chunks`` chunks together.

    Only the windows with the largest response carry a gradient, so the backward pass is
    sparse. Classes weigh alike. With fewer than two classes the network answers with
    the share of class 1 (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, DEPTH)), rng.normal(0, 0.25, (WIDTH, DEPTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return Network(net.embed, net.filters, net.bias, np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    importance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    params = [net.embed, net.filters, net.bias, net.weights, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    full = [i for i, t in enumerate(texts) if t]
    length = CHUNK + WIDTH
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order, steps = rng.permutation(full), [[]]
        for i in order.tolist():
            if len(steps[-1]) == batch or steps[-1] and sum(-(-len(texts[j]) // STEP) for j in (*steps[-1], i)) > most_chunks:
                steps.append([])
            steps[-1].append(i)
        for rows in map(np.array, filter(None, steps)):
            owner, pieces, sizes = [], [], []
            for r, i in enumerate(rows):
                t = texts[i]
                every = np.arange(0, max(1, -(-len(t) // BLOCK) - 1), BLOCKS - 1) * BLOCK
                for s in every:
                    piece = t[s : s + length]
                    owner.append(r)
                    sizes.append(-(-min(len(t) - s, CHUNK) // STRIDE))
                    pieces.append(np.frombuffer(piece + b" " * (length - len(piece)), np.uint8))
            owner, sizes, x = np.array(owner), np.array(sizes), np.stack(pieces)
            embed, filters, bias, weights, offset = params
            tables = np.einsum("be,kef->kbf", embed, filters)
            windows = CHUNK // STRIDE
            out = np.zeros((len(x), windows, FILTERS))
            for k in range(WIDTH):
                out += tables[k][x[:, k : k + 2 * windows : STRIDE]]
            out[np.arange(windows)[None, :] >= sizes[:, None]] = -np.inf
            top = out.argmax(axis=1)
            z = np.take_along_axis(out, top[:, None, :], axis=1)[:, 0] + bias
            m = np.maximum(z, 0)
            n = np.bincount(owner, minlength=len(rows))[:, None]
            mean = np.zeros((len(rows), FILTERS))
            np.add.at(mean, owner, m)
            mean /= n
            best = np.full((len(rows), FILTERS), -1.0)
            np.maximum.at(best, owner, m)
            features = np.concatenate((mean, best), axis=1)
            p = 1 / (1 + np.exp(-np.clip(features @ weights + offset[0], -30, 30)))
            g = (p - y[rows]) * importance[rows] / len(rows)
            d_features = g[:, None] * weights[None, :]
            d_m = d_features[owner, :FILTERS] / n[owner] + d_features[owner, FILTERS:] * (m >= best[owner])
            d_z = d_m * (z > 0)
            d_embed, d_filters = np.zeros_like(embed), np.zeros_like(filters)
            at = np.arange(len(x))[:, None]
            for k in range(WIDTH):
                byte = x[at, top * STRIDE + k]
                d_filters[k] = np.einsum("cfe,cf->ef", embed[byte], d_z)
                np.add.at(d_embed, byte, d_z[:, :, None] * filters[k].T[None, :, :])
            grads = [d_embed, d_filters, d_z.sum(axis=0), features.T @ g + 1e-4 * weights, np.array([g.sum()])]
            step += 1
            for q, d, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(params[0], params[1], params[2], params[3], float(params[4][0]))


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled rows: of each class the ``per_class`` rows of least hash, not held out, with whole texts.

    Labels that repeat a doc_id count by their highest quality; of documents that
    repeat one the text of least hash is taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(remainder(F.col("doc_id")) != 1).withColumn("h", F.xxhash64(F.lit("fit"), "doc_id"))
    sample = [known.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(per_class) for q in (0, 1)]
    ids = F.broadcast(sample[0].unionByName(sample[1]))  # at most 2 * per_class rows
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(ids, "doc_id").groupBy("h", "doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = sorted(rows.collect(), key=lambda r: (r["h"], r["doc_id"]))
    return [r["text"].encode() for r in found], [int(r["quality"]) for r in found]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, over its whole text.

    Null and empty texts have no chunk and get the logistic layer's offset. Repeated
    rows score alike. A null doc_id is not held out. An empty table gives no rows.
    """
    tables, bias = net.tables(), net.bias.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [probability(chunk_maxima(t or b"", tables, bias), net) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(p >= 0.5) for p in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """Fits on the bounded sample and scores all of ``docs``."""
    return score(docs, train(*training_rows(docs, labels, per_class)))
