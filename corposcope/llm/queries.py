"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposcope.llm import byte_cnn, chat, languages, licenses, mixing, packing, periodic_runs, quality_rules, sharding, simhash, substrings, topk, vector_codes
from corposcope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer's file: the session's setting ``corposcope.tokenizer.path``, else the installed one."""
    import public_tokenizers

    return spark.conf.get("corposcope.tokenizer.path", None) or public_tokenizers.path("word_bpe_49k.json")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=50)
    return found.select("doc_id", "text", "n_sentences", "n_removed", "removed_words")


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.as_integers(table(spark, sf_dir, "embeddings"), scale=64)
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(i AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(i, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_back(chat.format_log(chat.log_of(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), with_text=False)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.host_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(spark), capacity=2048)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, history = vector_codes.compress(table(spark, sf_dir, "embeddings"), scale=256, parts=16, entries=64, rounds=2)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(history[-1])).alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_kd_sharding, op2_substring_dedup, op3_pivot_topk, op4_license_scan, op5_simhash_near_dedup,
        op6_chat_format, op7_mixing, op8_quality_rules, op9_best_fit_packing, op10_quality_classifier, op11_vector_codes,
        op12_periodic_runs, op13_language_id,
    )
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+') AS tokens, regexp_extract(coalesce(text, ''), '[ \t\n\x0B\f\r]*$') AS tail FROM documents),
token AS (SELECT doc_id, i, tokens[i] AS raw, regexp_extract(tokens[i], '[^ \t\n\x0B\f\r]+') AS w FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM cut)),
gap AS (SELECT *, raw[1:length(raw) - length(w)] AS gap, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM token),
opened AS (SELECT *, i = 1 OR contains(gap, chr(10)) OR (before[-1:] IN ('.', '!', '?') AND gap[1:1] IN (' ', chr(9))) AS opens FROM gap),
numbered AS (SELECT doc_id, i, raw, w, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS k FROM opened),
solid AS (SELECT doc_id, k AS i, string_agg(w, ' ' ORDER BY i) AS said, count(*) AS w, min(i) AS a, max(i) AS b FROM numbered GROUP BY doc_id, k),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM solid),
arrays AS (SELECT doc_id, list(said ORDER BY i) AS said, list(a ORDER BY i) AS a, list(b ORDER BY i) AS b, count(*) AS n FROM summed GROUP BY doc_id),
forward AS (
  SELECT s.doc_id, s.i AS i, CASE WHEN s.w >= 40 THEN s.i WHEN e.i IS NOT NULL THEN greatest(e.i, s.i + 1) END AS j
  FROM (SELECT *, total - w + 20 AS goal FROM summed) s ASOF LEFT JOIN summed e ON s.doc_id = e.doc_id AND e.total >= s.goal),
backward AS (
  SELECT e.doc_id, CASE WHEN e.w >= 40 THEN e.i WHEN s.i IS NOT NULL THEN least(s.i, e.i - 1) END AS i, e.i AS j
  FROM (SELECT *, total - 20 AS goal FROM summed) e ASOF LEFT JOIN (SELECT doc_id, i, total - w AS before FROM summed) s ON e.doc_id = s.doc_id AND s.before <= e.goal),
run AS (
  SELECT DISTINCT r.doc_id, i, a.a[i] AS first, a.b[j] AS last, array_to_string(a.said[i:j], chr(31)) AS body
  FROM (SELECT * FROM forward UNION SELECT * FROM backward) r JOIN arrays a ON r.doc_id = a.doc_id
  WHERE i IS NOT NULL AND j IS NOT NULL AND i >= 1 AND j <= a.n),
lists AS (SELECT doc_id, list(w ORDER BY i) AS w FROM token GROUP BY doc_id HAVING count(*) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM lists)),
met AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS origin, min(i) OVER (PARTITION BY body, doc_id) AS own FROM windows),
later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS place FROM run) WHERE place > 1
  UNION ALL SELECT doc_id, i, i + 49 FROM met WHERE doc_id > origin OR i - own >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
done AS (
  SELECT n.doc_id, string_agg(CASE WHEN g.i IS NULL THEN n.raw ELSE '' END, '' ORDER BY n.i) AS text,
    max(n.k)::BIGINT AS n_sentences, count(DISTINCT CASE WHEN g.i IS NOT NULL THEN n.k END) AS n_removed, count(g.i) AS removed_words
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT c.doc_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(done.text, '') || tail END AS text,
  coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed_words, 0) AS removed_words
FROM cut c LEFT JOIN done ON c.doc_id = done.doc_id""",
    "op8_quality_rules": r"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
base AS (
  SELECT words.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated ON words.doc_id = repeated.doc_id LEFT JOIN lines ON words.doc_id = lines.doc_id),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_symbols / nullif(0.1::DOUBLE * word_chars, 0), 0) AS e1,
    coalesce(n_dup_lines / nullif(0.3::DOUBLE * n_lines, 0), 0) AS e2, coalesce(word_chars / nullif(20.0::DOUBLE * n_words, 0), 0) AS e3 FROM base),
failed AS (SELECT doc_id, source, unnest([0, 1, 2, 3]) AS rule, unnest([base_failed OR e1 > 1 OR e2 > 1 OR e3 > 1, e1 > 1, e2 > 1, e3 > 1]) AS x FROM ruled),
host AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(x::INT)::DOUBLE AS x FROM failed GROUP BY source, rule),
total AS (SELECT rule, sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(n * n) AS nn, sum(x * x / n) AS xx FROM host GROUP BY rule),
spread AS (SELECT rule, m, greatest(0, ((xx - n * m * m) - (k - 1) * m * (1 - m)) / nullif(n - nn / n, 0)) AS between_hosts FROM total),
prior AS (SELECT rule, m, least(1000, greatest(1, coalesce(m * (1 - m) / nullif(between_hosts, 0) - 1, 1000))) AS s FROM spread),
rated AS (SELECT source, h.rule, m, (x + m * s) / (n + s) AS rate FROM host h JOIN prior p ON h.rule = p.rule),
odds AS (SELECT source, rule, rate, coalesce(ln(nullif(rate / nullif(1 - rate, 0), 0) / nullif(m / nullif(1 - m, 0), 0)), 0) AS over FROM rated),
verdict AS (
  SELECT source, max(rate) FILTER (WHERE rule = 0) AS rate, max(over) FILTER (WHERE rule = 0) AS o0, max(over) FILTER (WHERE rule = 1) AS o1, max(over) FILTER (WHERE rule = 2) AS o2, max(over) FILTER (WHERE rule = 3) AS o3
  FROM odds GROUP BY source),
limits AS (
  SELECT source, list_transform([o1, o2, o3], lambda o: greatest(0.8, least(CASE WHEN rate <= 0.5 THEN 2.0 ELSE 1.0 END, exp(-(0.5 * o + 0.25 * o0))))) AS f FROM verdict)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND e1 <= f[1] AND e2 <= f[2] AND e3 <= f[3] AS kept
FROM ruled r JOIN limits v ON r.source IS NOT DISTINCT FROM v.source""",
    "op3_pivot_topk": """
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, c.row, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_vector_codes": """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
part AS (SELECT row, p, v[(p - 1) * (len(v) // 16) + 1 : p * (len(v) // 16)] AS x FROM (SELECT row, v, unnest(range(1, 17)) AS p FROM kept)),
c0 AS (SELECT p, row AS e, x AS c FROM part WHERE row <= 64),
a0 AS (SELECT row, p, any_value(x) AS x, min({'d': d, 'e': e}) AS best FROM (SELECT row, c0.p, x, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM part JOIN c0 ON part.p = c0.p) GROUP BY row, p),
m1 AS (SELECT p, best.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS y FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a0) GROUP BY p, best.e, i),
c1 AS (SELECT c0.p, c0.e, coalesce(y, c) AS c FROM c0 LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS y FROM m1 GROUP BY p, e) m ON c0.p = m.p AND c0.e = m.e),
a1 AS (SELECT row, p, any_value(x) AS x, min({'d': d, 'e': e}) AS best FROM (SELECT row, c1.p, x, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM part JOIN c1 ON part.p = c1.p) GROUP BY row, p),
m2 AS (SELECT p, best.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS y FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a1) GROUP BY p, best.e, i),
c2 AS (SELECT c1.p, c1.e, coalesce(y, c) AS c FROM c1 LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS y FROM m2 GROUP BY p, e) m ON c1.p = m.p AND c1.e = m.e),
a2 AS (SELECT row, p, min({'d': d, 'e': e}) AS best FROM (SELECT row, c2.p, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM part JOIN c2 ON part.p = c2.p) GROUP BY row, p),
coded AS (SELECT row, string_agg(printf('%02x', (best.e - 1)::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded ON kept.row = coded.row, books""",
    "op12_periodic_runs": r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
shaped AS (SELECT row, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM words),
texts AS (
  SELECT row, doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM shaped),
token AS (SELECT row, n, i, w[i + 1] AS t, CASE WHEN i + 6 <= n THEN array_to_string(w[i + 1 : i + 6], ' ') END AS six FROM (SELECT row, n, w, unnest(range(n)) AS i FROM texts)),
-- in a run of period q at least six words in a row equal those q later
pair AS (SELECT a.row, b.i - a.i AS q, a.i FROM token a JOIN token b ON a.row = b.row AND a.six = b.six AND b.i > a.i AND b.i - a.i <= a.n // 2),
island AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM pair),
stretch AS (SELECT row, q, min(i) AS s, max(i) + 6 + q AS e FROM island GROUP BY row, q, g),
run AS (SELECT row, s, e - s AS length, min(q) AS q FROM stretch WHERE e - s >= greatest(12, 2 * q) GROUP BY row, s, e),
gone AS (SELECT DISTINCT row, unnest(range(s + q, s + length)) AS i FROM run),
digest AS (
  SELECT row, count(*) AS n_runs, min({'l': -length, 's': s, 'q': q}) AS best, sha256(string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q)) AS runs FROM run GROUP BY row),
kept AS (SELECT t.row, sha256(string_agg(t.t, ' ' ORDER BY t.i)) AS text FROM token t LEFT JOIN gone g ON t.row = g.row AND t.i = g.i WHERE g.i IS NULL GROUP BY t.row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period, 1000 * -best.l // best.q AS exponent_milli,
  coalesce(runs, sha256('')) AS runs_sha256, coalesce(kept.text, sha256('')) AS collapsed_sha256
FROM texts LEFT JOIN digest ON texts.row = digest.row LEFT JOIN kept ON texts.row = kept.row""",
    "op6_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, role)),
sized AS (
  SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(regexp_replace(text, '[<>]', '', 'g'))) + 4 * (length(text) - length(regexp_replace(text, '[\[\]]', '', 'g'))) AS written FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 5 + written + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
}
