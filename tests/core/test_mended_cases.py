import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corposcope.functions import phrase_box
from corposcope.functions import text as X
from corposcope.operators import layout
from corposcope.sources import corpus
from corposcope.sources import html as web

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_nested_parts_of_a_page_go_whole(spark):
    page = (
        "<html><head><title> A &amp;\n title </title><script>var a = '<p>no</p>';</script></head><body><p>outside</p><article>"
        "<aside><p>x</p><aside><p>y</p></aside><p>still aside</p></aside><h1>Head</h1><nav><nav><p>m</p></nav><p>menu</p></nav>"
        "<ul><li>one<ul><li>inner</li></ul></li><li>two <b>bold</b><li>three</ul><blockquote>quote <p>inside</p> after</blockquote><pre>code &lt;x&gt;</pre><p>a<p>b</article><article><p>second</p></article></body></html>"
    )
    rows = [(1, page), (2, None), (3, ""), (4, "<p>bare<p>text"), (5, "<main><h1></h1><h1>First <i>real</i></h1></main>"), (6, "<body><form><p>f</p></form><p>ok</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {}
    for r in web.html_blocks(df).orderBy("page_id", "block_no").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.text))
    assert got[1] == [("h1", "Head"), ("li", "one"), ("li", "inner"), ("li", "two bold"), ("li", "three"), ("blockquote", "quote after"), ("p", "inside"), ("pre", "code <x>"), ("p", "a"), ("p", "b")]
    assert got[4] == [("p", "bare"), ("p", "text")] and got[5] == [("h1", "First real")] and got[6] == [("p", "ok")] and 2 not in got and 3 not in got
    assert {r.page_id: r.title for r in web.html_titles(df).collect()} == {1: "A & title", 2: None, 3: None, 4: None, 5: "First real", 6: None}


def plain_merge(pieces):
    """Pieces (y0, id, cols, rows, x0, x1, y1) down a page, each against the box around the table above."""
    out = []
    for y0, i, cols, rows, x0, x1, y1 in sorted(pieces):
        if out:
            t = out[-1]
            wide = min(t[4][2] - t[4][0], x1 - x0)
            shared = max(0.0, min(t[4][2], x1) - max(t[4][0], x0)) / wide if wide > 0 else 0.0
            if t[1] == cols > 0 and -2 <= y0 - t[4][3] <= 14 and shared >= 0.9 and (t[2] <= 2 or rows <= 2):
                out[-1] = (min(t[0], i), cols, t[2] + rows, t[3] + 1, (min(t[4][0], x0), min(t[4][1], y0), max(t[4][2], x1), max(t[4][3], y1)))
                continue
        out.append((i, cols, rows, 1, (x0, y0, x1, y1)))
    return sorted((i, n, cols, box) for i, cols, _, n, box in out)


def test_fragments_join_the_box_around_all_pieces(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for page in range(150):
        y, mine = 0.0, []
        for i in range(rng.randrange(1, 8)):
            y += rng.choice((5.0, 12.0, 25.0))
            x0 = rng.choice((0.0, 4.0, 40.0))
            height = rng.choice((6.0, 20.0, 60.0))
            mine.append((y, i, rng.choice((2, 2, 3)), rng.choice((1, 2, 5)), x0, x0 + rng.choice((60.0, 100.0)), y + height))
            y += rng.choice((height, height / 2))
        want[page] = plain_merge(mine)
        rows += [(1, page, i, c, n, (x0, y0, x1, y1)) for y0, i, c, n, x0, x1, y1 in mine]
    got = {}
    for r in layout.merge_fragments(spark.createDataFrame(rows, f"doc_id long, page_no int, piece_id int, n_cols int, n_rows int, box {BOX}")).collect():
        got.setdefault(r.page_no, []).append((r.piece_id, r.n_pieces, r.n_cols, tuple(r.box)))
    assert {p: sorted(v) for p, v in got.items()} == want
    # the last piece is far below the piece above it but close to the table's box
    three = [(1, 1, 1, 2, (0.0, 0.0, 100.0, 60.0)), (1, 1, 2, 2, (0.0, 58.0, 100.0, 59.0)), (1, 1, 3, 2, (0.0, 74.0, 100.0, 90.0))]
    assert [r.n_pieces for r in layout.merge_fragments(spark.createDataFrame(three, f"doc_id long, page_no int, piece_id int, n_cols int, box {BOX}")).collect()] == [3]


def plain_line_box(text, box, spans, query, tokens):
    segments, at = [], 0
    for t, b in spans:
        if (t or "").strip():
            if b and b[2] > b[0] and b[3] > b[1]:
                segments.append((at, at + len(t), b))
            at += len(t) + 1

    def cut(a, e):
        return [(b[0] + (b[2] - b[0]) * max(0, a - s) / (z - s), b[1], b[0] + (b[2] - b[0]) * min(z - s, e - s) / (z - s), b[3]) for s, z, b in segments if z > a and s < e]

    around = lambda bs: (min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs)) if bs else None
    low, q = text.lower(), query.strip().lower()
    if text and len(q) > 1 and q in low and (found := around(cut(low.index(q), low.index(q) + len(q)))):
        return found
    boxes, after = [], 0
    for t in tokens if text else ():
        i = low.find(t, after)
        i = low.find(t) if i < 0 else i
        if i >= 0:
            boxes += cut(i, i + len(t))
            after = i + len(t)
    return around(boxes) or (box if box[2] > box[0] and box[3] > box[1] else None)


def test_line_boxes_match_a_plain_version(spark):
    rng = random.Random(8)
    words, rows = ["deep", "nets", "a", "Model", "of"], []
    for i in range(300):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) if rng.random() < 0.9 else " " for _ in range(rng.randrange(0, 4))]
        spans, x = [], 0.0
        for t in texts:
            wide = 7.0 * len(t) if rng.random() < 0.9 else 0.0
            spans.append((t, (x, 0.0, x + wide, 10.0 + rng.randrange(3))))
            x += wide + 5
        line = " ".join(t for t in texts if t.strip()) if rng.random() < 0.9 else ""
        rows.append((i, (line, (0.0, 0.0, 300.0, rng.choice((12.0, 0.0))), spans), rng.choice(("deep nets", "nets model", "of", "a", "missing", "model deep of")), ["deep", "model", "nets"][: rng.randrange(4)]))
    df = spark.createDataFrame(rows, f"id int, line struct<text:string,box:{BOX},spans:array<struct<text:string,box:{BOX}>>>, query string, tokens array<string>")
    got = {r.id: r.b and tuple(r.b) for r in df.select("id", phrase_box.line_box(F.col("line"), F.col("query"), F.col("tokens")).alias("b")).collect()}
    for i, (text, box, spans), query, tokens in rows:
        want = plain_line_box(text, box, spans, query, tokens)
        assert (got[i] is None) == (want is None) and (want is None or all(abs(a - b) < 1e-9 for a, b in zip(got[i], want, strict=True))), i


def test_the_box_of_a_block_is_that_of_its_best_line(spark):
    line = lambda t, y: (t, (0.0, y, 100.0, y + 10.0), [(t, (0.0, y, float(len(t)), y + 10.0))])
    rows = [(1, [line("nothing here", 0.0), line("on deep nets now", 20.0), line("deep nets again", 40.0)], (0.0, 0.0, 100.0, 60.0)), (2, [], (0.0, 0.0, 5.0, 5.0)), (3, None, (0.0, 0.0, 0.0, 5.0))]
    df = spark.createDataFrame(rows, f"id int, lines array<struct<text:string,box:{BOX},spans:array<struct<text:string,box:{BOX}>>>>, box {BOX}").withColumn("q", F.lit("deep nets"))
    got = {r.id: r.b and tuple(r.b) for r in df.select("id", phrase_box.phrase_box(F.col("lines"), F.col("box"), F.col("q"), X.query_tokens(F.col("q"))).alias("b")).collect()}
    assert got == {1: (3.0, 20.0, 12.0, 30.0), 2: (0.0, 0.0, 5.0, 5.0), 3: None}


def test_documents_are_replaced_in_their_folders_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    files = lambda: {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in Path(folder).glob("bucket=*/*.parquet")}
    rows = lambda: sorted(map(tuple, spark.read.parquet(folder).select("doc_id", "text").collect()))
    spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("old "), "id").alias("text")).unionByName(spark.createDataFrame([(7, "second row")], "doc_id long, text string")).transform(lambda df: corpus.write_documents(df, folder, 16) or df)
    before, all_before = files(), rows()
    assert len(all_before) == 201
    new = spark.createDataFrame([(7, "new"), (500, "added"), (500, "added too")], "doc_id long, text string")
    corpus.write_documents(new, folder, 16)
    after = files()
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and set(before) == set(after)
    want = sorted([r for r in all_before if r[0] != 7] + [(7, "new"), (500, "added"), (500, "added too")])
    assert rows() == want
    corpus.write_documents(new, folder, 16)
    assert rows() == want and {b for b, f in files().items() if f != after[b]} == changed


def test_numbers_follow_the_order_of_keys(spark):
    for keys in (list(range(0, 9000, 3)), ["", "a", "b" * 40, "é", "z"] + [f"k{i}" for i in range(300)], [5], []):
        kind = "string" if keys and isinstance(keys[0], str) else "long"
        df = spark.createDataFrame([(k,) for k in keys], f"k {kind}").repartition(3)
        got = sorted((r.number, r.k) for r in corpus.numbered(df, "k", 8).collect())
        assert got == list(enumerate(sorted(keys, key=lambda k: k.encode() if isinstance(k, str) else k)))


def test_word_errors_match_the_whole_table(spark):
    rng = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    pairs = [(" ".join(rng.choice("abcd") for _ in range(rng.randrange(12))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for _ in range(300)] + [(None, "a"), ("a", None), ("a " * 3000, "a b " * 1500)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", X.word_errors(F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        a, b = ((x or "").split() for x in pairs[r.i])
        assert r.e == (1500 if r.i == len(pairs) - 1 else distance(a, b))


@pytest.mark.parametrize("lines,want", [(["a", "a b", "a b c", "x"], ["a b c", "x"]), (["a b", "a", "a b"], ["a b"]), ([], [])])
def test_rolling_captions_stay_once(lines, want):
    assert corpus.fullest(lines) == want and math.isfinite(len(want))
