import random
import zlib

from corposcope.llm import sharding

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, shard string, size long"


def rows_of(n):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        text = rng.choice(["same text " * 20, "x" * rng.randint(0, 400), "é" * rng.randint(0, 90)])
        rows.append((i, text, rng.choice(["big"] * 5 + ["a", "b", None]), rng.choice(["en", "de"]), len(text), "clash", 1))
    return rows


def check(rows, found, shards):
    texts = {r[0]: r[1] for r in rows}
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in found:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_bytes_are_near_equal_and_slots_gapless(spark):
    rows = rows_of(3000)
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert len(found) == len(rows)
    sizes = check(rows, found, 7)
    mean = sum(sizes) / 7
    assert max(abs(s - mean) for s in sizes) < 2 * 416 + 0.01 * mean


def test_nulls_repeats_and_few_rows(spark):
    rows = [(None, None, None, None, None, None, None), (5, "a", "s", "en", 1, None, None), (5, "a", "s", "en", 1, None, None)]
    found = sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == [("5", 17), ("5", 17), ("None", 16)]
    assert len({r.shard for r in found if r.doc_id == 5}) == 1
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_written_shards_hold_every_text(spark, tmp_path):
    rows = rows_of(200)
    sharding.write_shards(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), 4)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r[1] for r in rows)
