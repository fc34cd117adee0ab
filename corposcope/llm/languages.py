"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of one to four characters inside its words, a word's
edges being marked. They are hashed into buckets; each bucket has an embedding,
and a text is the average of its subwords' embeddings, over the whole text. A linear softmax
over the average gives a probability for each learned language. Embeddings and
softmax are trained together by stochastic gradient descent in numpy.

Probabilities are calibrated by a temperature fitted on rows kept from the training;
the same rows give the probability below which an answer is rejected.

Only the fit sees a sample, of at most ``sample_rows`` rows: Spark turns
their whole texts into bucket frequencies, so what reaches the driver is bounded by
``sample_rows`` times the number of buckets, whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKETS, DEPTH, LONGEST_SUBWORD = 2**14, 16, 4
#: Characters of a text hashed at once.
CHUNK = 2**18
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def bucket_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's subwords occur in the whole text; None without a letter.

    Characters other than letters end a word; an edge counts as a character, once for
    both words beside it. A subword holds an edge at its ends only.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    solid = letters()[points]
    if not solid.any():
        return None
    points = np.where(solid, points, 0)
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # of several characters in a row that are none, the first is the edge
    points, solid = np.concatenate(([0], points[keep], [0])), np.concatenate(([False], solid[keep], [False]))
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(points), CHUNK):
        piece, inner = points[start : start + CHUNK + LONGEST_SUBWORD - 1].astype(np.uint64), solid[start : start + CHUNK + LONGEST_SUBWORD - 1]
        h = np.zeros(len(piece), np.uint64)
        whole = np.ones(len(piece), bool)  # no edge between the first character and the last
        for n in range(1, LONGEST_SUBWORD + 1):
            size = min(CHUNK, len(piece) - n + 1)
            if size <= 0:
                break
            h = h[:size] * np.uint64(0x100000001B3) + piece[n - 1 : n - 1 + size] + np.uint64(n)
            if n > 2:
                used = whole = whole[:size] & inner[n - 2 : n - 2 + size]
            else:
                used = inner[:size] | inner[n - 1 : n - 1 + size]
            mixed = h[used] * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    """``weights`` (buckets x languages) are embeddings times softmax weights: averaging is linear, so both are one table when scoring."""

    languages: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    temperature: float
    least: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(counts)
        z = (counts[used] @ self.weights[used] / counts[used].sum() + self.offsets) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def descend(x: np.ndarray, y: np.ndarray, classes: int, epochs: int, batch: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times softmax weights, and offsets, by plain stochastic gradient descent; classes weigh alike."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DEPTH, (x.shape[1], DEPTH)).astype(np.float32)
    weights, offsets = rng.normal(0, 0.1, (DEPTH, classes)).astype(np.float32), np.zeros(classes, np.float32)
    share = np.bincount(y, minlength=classes) / len(y)
    importance = (1 / (classes * np.maximum(share, 1e-9)))[y].astype(np.float32)
    steps = epochs * -(-len(y) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            now = rate * (1 - step / steps)
            a = x[rows] @ embed
            g = softmax(a @ weights + offsets)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= importance[rows][:, None] / len(rows)
            back = g @ weights.T
            weights -= now * (a.T @ g)
            offsets -= now * 0.1 * g.sum(0)
            used = np.flatnonzero(x[rows].any(0))
            embed[used] -= now * 50 * (x[rows][:, used].T @ back)  # frequencies are small: their gradients are scaled up
            step += 1
    return (embed @ weights).astype(np.float64), offsets.astype(np.float64)


def calibrated(z: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the least probability from which answers are right in a share of ``precision``."""
    if not len(y):
        return 1.0, 0.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean())

    temperature = min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss)
    p = softmax(z / temperature)
    best, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(y) + 1))
    if len(good) == len(y) or len(good) and good[-1] == len(y) - 1:
        return float(temperature), 0.0  # all may be answered
    return float(temperature), float(best[order[good[-1]]]) if len(good) else 1.0


def fit(languages: list[str], rows: list[tuple[int, bool, np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 1.0, precision: float = 0.99, seed: int = 11) -> Model:
    """A model from (language, kept for calibration, buckets, frequencies). One language has probability 1."""
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    y, later = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, _, at, share) in enumerate(rows):
        x[i, at] = share
    if later.all() or len(set(y[~later].tolist())) < len(set(y.tolist())):
        later[:] = False  # too few rows to keep some
    weights, offsets = descend(x[~later], y[~later], len(languages), epochs, batch, rate, seed)
    temperature, least = calibrated(x[later].astype(np.float64) @ weights + offsets, y[later], precision)
    return Model(languages, weights, offsets, temperature, least)


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, sample_rows: int, most_languages: int) -> tuple[list[str], list[tuple[int, bool, np.ndarray, np.ndarray]]]:
    """Languages and a bounded sample of their rows as bucket frequencies; a fifth is kept for calibration.

    Rows not held out, with a language and a letter in the text. Of each language the doc_ids of least hash, as
    many as its part of ``sample_rows``; a threshold on the hash, from the language's
    number of ids, finds them (and a few more, which the driver leaves out) without a ranking. Of rows that repeat
    an id the text of least hash counts.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(True)))
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counted:
        return [], []
    languages = sorted(r["lang"] for r in counted)
    each = max(1, sample_rows // len(languages))
    wanted = 1.1 * each + 4 * each**0.5
    session = docs.sparkSession
    shares = session.createDataFrame([(r["lang"], languages.index(r["lang"]), min(1.0, wanted / max(1, r["ids"]))) for r in counted], "lang string, y int, share double")
    rows = known.filter(F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.lit("fit"), "doc_id").alias("h")).join(F.broadcast(shares), "lang")  # a row for each of most_languages
    thinned = rows.filter(F.shiftrightunsigned("h", 34) < F.col("share") * 2**30)
    picked = thinned.groupBy("y", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("y", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = bucket_counts(text)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((y, h, at.astype("<u2").tobytes(), (counts[at] / counts.sum()).astype("<f4").tobytes()))
            if out:
                y, h, at, share = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(h, pa.int64()), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["y", "h", "at", "share"])

    found: dict[int, list] = {}
    for r in sorted(picked.mapInArrow(run, "y int, h long, at binary, share binary").collect(), key=lambda r: (r["y"], r["h"] % 2**64)):
        found.setdefault(r["y"], []).append(r)
    rows = [(k, i % 5 == 4, np.frombuffer(r["at"], "<u2"), np.frombuffer(r["share"], "<f4")) for k, y in enumerate(found) for i, r in enumerate(found[y][:each])]
    return [languages[y] for y in found], rows


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row, from its whole text alone.

    ``score`` is the calibrated probability of ``lang_pred``; ``accepted`` is false where it is below the
    rejection threshold. A text that is null or has no letter, and every text where nothing was learned, is ``und``,
    scored 0 and not accepted. A null doc_id is not held out. Repeated rows score alike. Texts are hashed
    in chunks, so a very long one costs a few bytes a character. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = [], []
            for text in batch.column(2):
                counts = bucket_counts(text.as_py()) if model.languages else None
                p = None if counts is None else model.probabilities(counts)
                said.append(UNDETERMINED if p is None else model.languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            accepted = [w != UNDETERMINED and s >= model.least for w, s in zip(said, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, sample_rows: int = 2000, most_languages: int = 400) -> DataFrame:
    """Fits on the bounded sample of ``docs`` (the ``most_languages`` most frequent languages) and predicts all of its rows."""
    return predict(docs, fit(*training_rows(docs, sample_rows, most_languages)))
