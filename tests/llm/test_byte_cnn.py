import random
import zlib

import numpy as np

from corposcope.llm import byte_cnn

SCHEMA = "doc_id long, text string, score string"


def naive_maxima(data, net):
    x = data + b" " * byte_cnn.WIDTH
    blocks = -(-len(data) // byte_cnn.BLOCK)
    largest = np.zeros((blocks, byte_cnn.FILTERS))
    for t in range(0, len(data), byte_cnn.STRIDE):
        out = sum(net.embed[x[t + k]] @ net.filters[k] for k in range(byte_cnn.WIDTH)) + net.bias
        b = t // byte_cnn.BLOCK
        largest[b] = np.maximum(largest[b], out)
    return [largest[s : s + byte_cnn.BLOCKS].max(axis=0) for s in range(0, max(1, blocks - 1), byte_cnn.BLOCKS - 1)]


def test_every_byte_is_convolved():
    rng = np.random.default_rng(0)
    net = byte_cnn.train([b"good text", b"bad ###"], [1, 0], epochs=1)
    for n in (1, 2, 63, 64, 65, 448, 449, 512, 513, 3000):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        got = byte_cnn.chunk_maxima(data, net.tables(), net.bias.astype(np.float32))
        assert np.allclose(got, np.array(naive_maxima(data, net)), atol=1e-4)


def rows_of(n):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "river", "stone", "über", "walks"]) + ("" if good or rng.random() < 0.4 else rng.choice(["###", "!!", "%%%"])) for _ in range(rng.randint(20, 400))]
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = rows_of(500)
    got = byte_cnn.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_nulls_empty_texts_and_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, None), (2, "", None), (None, "x" * 300000, None), (2, "", None)], SCHEMA)
    assert [r.score for r in byte_cnn.classify(docs, labels).collect()] == [0.5] * 4
    assert byte_cnn.classify(docs.limit(0), labels).count() == 0
