import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corposcope.llm import packing

SCHEMA = "doc_id long, text string, offset string, lang string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(8)
    alphabet = ["Ab", "é", "ß", "İ", "Σ", "don't", "1234", "!?", "<|endoftext|>", " ", "\x1c", "\x0b", "é", "漢字", "🙂", "'S", "|", ".", ",", "<|", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "\x1f", "i\u0307", "²", "ª", "Ünd", "x."]
    out = ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.choice([1, 5, 40, 900, 4000]))) for _ in range(60)]
    return out + ["", None, " \n", "word " * 2047, "word " * 2048, "word " * 4095, "Σ İ.", "<| İ,", "<|EndOfText|> a.", "ends. and, so"]


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    import pyarrow as pa

    steps = json.loads(Tokenizer.from_file(PATH).to_str())
    steps["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(steps))
    encoder, plain = packing.WordEncoder(str(other), packing.splits_at_blanks(str(other))), Tokenizer.from_file(str(other))
    assert not encoder.by_words
    got = encoder.encode(pa.array(texts()))
    assert [g.tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts()]


def test_forgotten_words_change_nothing():
    import pyarrow as pa

    small, plain = packing.WordEncoder(PATH, packing.splits_at_blanks(PATH), memo_bytes=3000), Tokenizer.from_file(PATH)
    assert small.by_words
    for _ in range(2):
        for t in texts():
            assert small.encode(pa.array([t], pa.string()))[0].tolist() == plain.encode(t or "", add_special_tokens=False).ids
    assert small.words.nbytes < 10**6


def test_pieces_hold_the_tokenizers_ids(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t, "clash", "en") for i, t in enumerate(texts())]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    by = {(r.doc_id, r.piece): r for r in got}
    assert len(by) == len(got)
    for doc_id, text, _, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k in range(-(-len(ids) // 2048)):
            r, own = by.pop((doc_id, k)), ids[2048 * k : 2048 * (k + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * k, len(own), zlib.crc32(own.tobytes()))
    assert not by
    kept = packing.tokenized_pieces(spark.createDataFrame(rows, SCHEMA), PATH, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept)


def valid(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(b and sum(lengths[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("low", [1, 200, 500, 700])
def test_search_never_needs_more_bins(low):
    rng = random.Random(low)
    lengths = [rng.randint(low, 2048) for _ in range(1500)]
    first = packing.best_fit(lengths, 2048)
    valid(first, lengths, 2048)
    better = packing.local_search([list(b) for b in first], lengths, 2048)
    valid(better, lengths, 2048)
    assert len(better) <= len(first)


def test_exchanges_empty_a_bin():
    lengths = [6, 3, 5, 4, 2]  # two bins of ten, from three
    better = packing.local_search([[0, 1], [2, 3], [4]], lengths, 10)
    valid(better, lengths, 10)
    assert len(better) == 2


def test_offsets_are_gapless(spark):
    rows = [(i % 50, i, 0, (i * 37) % 2048 + 1, 1) for i in range(900)] + [(7, 7, 0, 5, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, group_rows=300).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0)).count() == 0
