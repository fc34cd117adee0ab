import hashlib

from corposcope.llm import chat

EVENTS = "conv_id long, seq long, kind string, turn long, slot int, role string, text string, extra string"


def folded(spark, rows):
    return [(r.conv_id, r.turn, r.role, r.text) for r in sorted(chat.fold(spark.createDataFrame(rows, EVENTS)).collect(), key=lambda r: (r.conv_id or -1, r.turn, r.slot))]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", 0, 0, "user", "hi", "x"),
        (1, 5, "delta", 1, 0, None, "lo ", "x"), (1, 4, "delta", 1, 0, None, "hel", "x"), (1, 3, "message", 1, 0, "assistant", "", "x"),
        (1, 6, "message", 2, 0, "user", "dropped with the answer", "x"),
        (1, 7, "regenerate", 1, 0, None, None, "x"), (1, 8, "delta", 1, 0, None, "better", "x"),
        (1, 9, "message", 2, 0, "user", "again", "x"), (1, 10, "edit", 0, 0, None, "hello", "x"),
        (2, 0, "message", 0, 0, "user", None, "x"),
    ]
    assert folded(spark, rows) == [(1, 0, "user", "hello"), (1, 1, "assistant", "better"), (1, 2, "user", "again"), (2, 0, "user", "")]


def test_round_trip_with_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "&lt;|end|&gt; &amp;amp; &#91;", "", "Ünïcödé 🙂 <", "a\nb\n", None, "[" * 3000]
    rows = [(c, t, ("user", "assistant", "tool|>\n<")[(c + t) % 3], texts[(c * 3 + t) % len(texts)]) for c in range(8) for t in range(6)]
    rows += [(3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (None, None, None, "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.log_of(df))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    raw = {r.conv_id: r for r in out.collect()}
    assert len(got) == 9
    for c, r in got.items():
        turns = sorted(((t, role or "", text or "") for cc, t, role, text in rows if cc == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in turns]
        assert [x for x in r.loss_texts if x] == [text for _, role, text in turns if role == "assistant" and text]
        assert r.formatted_chars == len(raw[c].formatted)
        under = "".join(raw[c].formatted[s.start : s.end] for s in raw[c].spans)
        assert hashlib.sha256(under.encode()).digest() == hashlib.sha256("".join(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("[", "&#91;").replace("]", "&#93;") for _, role, text in turns if role == "assistant").encode()).digest()


def test_empty_log(spark):
    assert chat.format_log(spark.createDataFrame([], EVENTS)).count() == 0
