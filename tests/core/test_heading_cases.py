import random
import re

from pyspark.sql import functions as F

from corposcope.functions import headings as H
from corposcope.functions import text as X
from corposcope.operators import headings as places

BLOCK = "doc_id long, block_index int, page_no int, text string"
HEAD = "doc_id long, heading_no int, title string, level int, source string, page_hint int, block_hint int"


def common(a, b):
    """Characters in common blocks: the longest one (the earliest in a, then in b), then left and right of it. Of strings of 200
    or more, characters that make up over a hundredth of b begin no block but may continue one."""
    popular = {c for c in set(b) if len(b) >= 200 and b.count(c) > len(b) // 100 + 1}

    def count(alo, ahi, blo, bhi):
        best, rows = (0, alo, blo), {}
        for i in range(alo, ahi):
            now = {}
            for j in range(blo, bhi):
                if a[i] == b[j] and b[j] not in popular:
                    k = now[j] = rows.get(j - 1, 0) + 1
                    if k > best[0]:
                        best = (k, i - k + 1, j - k + 1)
            rows = now
        k, i, j = best
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            k, i, j = k + 1, i - 1, j - 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        if not k:
            return 0
        return k + count(alo, i, blo, j) + count(i + k, ahi, j + k, bhi)

    return count(0, len(a), 0, len(b))


def test_similarity_matches_a_plain_version(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(10_000):
        n = rng.choice((0, 1, 5, 12, 25)) if i % 200 else 260
        a = "".join(rng.choice("abcde ") for _ in range(n))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abcdefgh ") for c in a) if rng.random() < 0.6 else "".join(rng.choice("abcde ") for _ in range(rng.choice((0, 3, 20))))
        pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").repartition(4).select("a", "b", H.similarity("a", "b").alias("s")).collect()
    for r in got:
        want = 2 * common(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 1.0
        assert abs(r.s - want) < 1e-12, (r.a, r.b)


def test_likeness_counts_for_longer_queries_alone(spark):
    rows = [("graph neural networks for molecules", "graph neural network of molecule data", True), ("graph neural networks for molecules", "we use graph neural networks for molecules", False),
            ("short query", "short querx", False), ("graph neural networks for molecules", "nothing alike", False), ("graph neural networks for molecules", None, False)]
    q, t = F.col("q"), F.col("t")
    for r in spark.createDataFrame(rows, "q string, t string, counts boolean").select("*", X.likeness(q, t, H.similarity).alias("s")).collect():
        assert (r.s > 0) == r.counts
        if r.counts:
            assert abs(r.s - 2 * (H.ratio(r.q, r.t) - 0.5)) < 1e-12


def test_shapes_of_lines(spark):
    cases = {
        "3.2 Training for Models we describe": ("Training for Models", "", False, False, False),
        "IV. EXPERIMENTAL RESULTS Here we": ("", "EXPERIMENTAL RESULTS", False, True, True),
        "2.": ("", "", True, False, False), "xii": ("", "", True, False, False),
        "Related Work and Background": ("", "", False, True, False),
        "Figure 3 Shows Our Results": ("", "", False, False, False),
        "The model and the data that we use. Then more": ("", "", False, False, True),
        "Related Work.": ("", "", False, False, False),
    }
    got = places.heading_shapes(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r.text: (r.numeric_title, r.roman_title, r.marker, r.phrase, r.prose) for r in got} == cases


def test_plausible_titles(spark):
    good = ("Related Work", "4 Experiments", "Our Results", "Data", "See Discussion", "Results 2019 2020 2021")
    bad = ("", "of", "See Below", "https://x.org Page", "Table 3 Results", "a b results", "1234 56 78 9", "x y", "Figure")
    df = spark.createDataFrame([(t, t in good) for t in good + bad], "t string, want boolean")
    assert [r.t for r in df.select("t", "want", H.plausible_title(F.col("t")).alias("got")).collect() if r.got != r.want] == []


def test_anchors_take_the_next_line_for_a_number_alone(spark):
    rows = [(1, 0, 1, "Abstract We do things"), (1, 1, 1, "2"), (1, 2, 1, "Deep Learning Methods\nthen text"), (1, 3, 2, "3.\nData Sets Used"), (1, 4, 2, "the plain text of it"), (1, 5, 2, "References [1] A. B"), (1, 6, 3, "4.1 Ablation Study")]
    got = [tuple(r) for r in places.heading_anchors(spark.createDataFrame(rows, BLOCK)).orderBy("block_index").select("block_index", "title", "level").collect()]
    assert got == [(0, "Abstract", 1), (1, "Deep Learning Methods", 1), (3, "Data Sets Used", 1), (5, "References", 1), (6, "Ablation Study", 2)]


def test_anchors_by_font_and_weight(spark):
    df = spark.createDataFrame([(1, 0, 1, "Model Design", 14.0, 0.0, 10.0), (1, 1, 1, "Other Design", 10.0, 0.5, 10.0), (1, 2, 1, "Third Design", 10.0, 0.0, 10.0)], BLOCK + ", max_font double, bold_ratio double, body_font double")
    assert {r.block_index for r in places.heading_anchors(df).collect()} == {0, 1}


def key(x):
    x = re.sub(r"^\s*(?:[ivxlcdm]+\.?|[a-z]\)|\d+(?:\.\d+){0,3}\.?)\s+", "", " ".join((x or "").split()).lower())
    return " ".join(re.sub("[^a-z0-9]+", " ", x).split())


def plain_alignment(heads, blocks, looks, anchors):
    """Places by the rules as they read, over all blocks and pages of a document."""
    out, cursor = [], 0
    pages = [b[2] for b in blocks]

    def match(h, t):
        if not h or not t:
            return 0.0
        ws = h.split()
        if h in t:
            return 1.0 if t.startswith(h) else max(0.22, 0.55 * sum(w in t for w in ws) / len(ws))
        t = " ".join(t.split()[:20])
        return max(H.ratio(h, t), sum(w in t for w in ws) / len(ws))

    for n, (_, no, title, level, source, hint, given) in enumerate(heads):
        h = key(title)
        if not h:
            continue
        best, score = -1, -1.0
        if given is not None and cursor <= given < len(blocks):
            best, score = given, 1.3
        else:
            for i, t, lv, page, canonical, own in anchors[no]:
                if i >= cursor:
                    s = H.ratio(h, t) + (0.35 if canonical == own else 0) + (0.45 if h == t else 0.18 if h in t or t in h else 0) + (0.06 if lv == level else -0.08 if (level, lv) == (1, 2) else 0)
                    if hint is not None:
                        d = abs(hint - page)
                        s += 0.2 if d == 0 else 0.1 if d == 1 else 0 if d == 2 else -min(0.25, 0.05 * (d - 2))
                    if s > score:
                        best, score = i, s
            if score < 1.02:
                best, score = -1, -1.0
            first, last = cursor, len(blocks) - 1
            if hint is not None and hint in pages:
                first = max(first, pages.index(hint))
                last = max(first, max(i for i, p in enumerate(pages) if hint <= p <= hint + 2))
            elif hint is None:
                later = [x[5] for x in heads[n + 1 :] if x[5] is not None and x[5] in pages]
                if later:
                    last = max(i for i, p in enumerate(pages) if p <= later[0] + 1)
            for i in range(first, min(last, len(blocks) - 1) + 1):
                line, whole = key(blocks[i][3].strip().split("\n")[0]), key(blocks[i][3][:320])
                s = match(h, line)
                s = max(s, 1.0) if line == h or line.startswith(h + " ") else max(s, 0.35) if h in line else s
                if s < 0.9:
                    s = max(s, 0.82 * match(h, " ".join(whole.split()[:20])))
                if line:
                    s = max(s, sum(w in line for w in h.split()) / len(h.split()))
                s += looks[i]
                if hint is not None:
                    d = abs(pages[i] - hint)
                    s += 0.12 if d == 0 else 0.04 if d == 1 else 0 if d == 2 else -min(0.25, 0.04 * (d - 1))
                s += {"pdf_toc": 0.04, "arxiv_source": 0.02, "grobid": 0.01}.get(source, 0)
                if s > score:
                    best, score = i, s
        if best >= 0 and score >= {"pdf_toc": 0.48, "grobid": 0.58, "arxiv_source": 0.56, "heuristic": 0.44}.get(source, 0.6):
            out.append((no, best, round(score, 6)))
            cursor = max(cursor, best + 1)
    return out


def test_alignment_matches_a_plain_version_over_random_documents(spark):
    rng = random.Random(6)
    words = "deep model data results method graph analysis of training the study".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))).title()
    blocks, heads = [], []
    for doc in range(25):
        titles, page = [title() for _ in range(8)], 1
        for i in range(rng.randint(1, 30)):
            page += rng.random() < 0.3
            page += rng.random() < 0.1  # a page without blocks
            text = rng.choice(titles) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(25))
            text = rng.choice(("", "", "2 ", "3.1 ", "IV. ")) + text + rng.choice(("", "\n" + title()))
            blocks.append((doc, i, page, rng.choice((text, text, "2.\n" + text)) if rng.random() < 0.9 else " "))
        for no in range(rng.randint(0, 8)):
            hint = rng.choice((None, rng.randint(1, 9), rng.randint(1, page)))
            heads.append((doc, no, rng.choice(titles) if rng.random() < 0.8 else rng.choice(("", "12 x")), rng.randint(1, 2), rng.choice(("pdf_toc", "grobid", "arxiv_source", "heuristic", "own")), hint, rng.choice((None, None, None, rng.randint(0, 40)))))
    b, h = spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(heads, HEAD)
    got = {}
    for r in places.heading_align(h, b).collect():
        got.setdefault(r.doc_id, []).append((r.heading_no, r.block_index, r.score))
    looks = {(r.doc_id, r.block_index): r.look for r in places._styled(b).select("doc_id", "block_index", places._look().alias("look")).collect()}
    anchors = {}
    for r in places.heading_anchors(b).select("*", X.canonical_heading(F.col("title")).alias("c")).orderBy("doc_id", "block_index").collect():
        anchors.setdefault(r.doc_id, []).append((r.block_index, key(r.title), r.level, r.page_no, r.c))
    own = {(r.doc_id, r.heading_no): r.c for r in h.select("doc_id", "heading_no", X.canonical_heading(F.col("title")).alias("c")).collect()}
    n = 0
    for doc in range(25):
        mine = [x for x in heads if x[0] == doc]
        of = {x[1]: [(*a, own[doc, x[1]]) for a in anchors.get(doc, [])] for x in mine}
        rows = [x for x in blocks if x[0] == doc]
        want = plain_alignment(mine, rows, [looks[doc, x[1]] for x in rows], of)
        assert sorted(got.get(doc, [])) == want
        n += len(want)
    assert n > 40


def test_alignment_keeps_the_order_of_headings(spark):
    b = spark.createDataFrame([(1, i, 1 + i // 2, t) for i, t in enumerate(("Results", "text of it", "Method Part", "more text", "Results", "end"))], BLOCK)
    h = spark.createDataFrame([(1, 0, "Method Part", 1, "pdf_toc", None, None), (1, 1, "Results", 1, "pdf_toc", None, None)], HEAD)
    assert [(r.heading_no, r.block_index) for r in places.heading_align(h, b).orderBy("heading_no").collect()] == [(0, 2), (1, 4)]
    assert places.heading_align(h.filter("doc_id = 9"), b).count() == 0


def test_source_scores_by_hand(spark):
    heads = spark.createDataFrame([(1, "pdf_toc", 1, False)] * 2 + [(1, "heuristic", p, False) for p in (1, 2, 3, 4)] + [(1, "grobid", 1, None)], "doc_id long, source string, page_hint int, title_like boolean")
    spans = spark.createDataFrame([(1, "pdf_toc", 0, "abstract", 0.9, 1, 1), (1, "heuristic", 0, "abstract", 0.5, 1, 1), (1, "heuristic", 1, "introduction", 0.5, 2, 2), (1, "grobid", 0, "front_matter", 1.0, 1, 4)], "doc_id long, source string, pos int, canonical string, confidence double, start_page int, end_page int")
    docs = spark.createDataFrame([(1, 4)], "doc_id long, total_pages int")
    got = {r.source: r.score for r in places.source_scores(heads, spans, docs).collect()}
    toc = 1.25 + 0.25 + 0.5 * 1.5 + 0.9 * 0.5 + 0.4 + 0.9 - 1.2
    guess = 0.7 + 0.5 + 0.5 * 1.5 + 0.25 + 0.4 + 0.9
    assert abs(got["pdf_toc"] - toc) < 1e-6 and abs(got["heuristic"] - guess) < 1e-6 and got["grobid"] == -1.0
    assert places.strategy_pick(heads, spans, docs).first().source == "heuristic"


def test_ratio_is_that_of_the_standard_library_without_its_search_for_blocks(monkeypatch):
    """Short and long strings, with frequent characters and without."""
    from difflib import SequenceMatcher

    rng = random.Random(9)
    for k in range(4000):
        letters = rng.choice(("ab", "abc ", "abcdefghij klmnop", "the quick brown"))
        length = lambda: rng.choice((0, 1, 3, 30, 60, 199, 200, 205, 320)) if k < 1000 else rng.randint(0, 60)
        a, b = ("".join(rng.choice(letters) for _ in range(length())) for _ in range(2))
        if k % 3 == 0 and a:
            b = b[: len(b) // 2] + a[rng.randrange(len(a)) :][:20] + b[len(b) // 2 :]
        assert H.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", None)
    assert H.ratio("deep model", "a deep model of it") == 2 * 10 / 28
