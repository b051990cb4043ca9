"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import audio, audit, chat, divergence, html, jaccard, lm, mixing, packing, quality, secrets, substrings, toxicity
from gridloom.llm.common import read_table, written

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read_table(spark, sf_dir, "documents"))


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).result().drop("row", "source", "content")


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(read_table(spark, sf_dir, "documents")).drop("kept")


def op8_sparse_product_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents")).drop("node")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.features(read_table(spark, sf_dir, "documents"), keep_media=False).drop("media", "tensors")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("filter")


#: A conversation whose texts are control strings, added to those of the table.
CONTROLLED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = said.union(spark.createDataFrame(CONTROLLED, "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(written(chat.formatted(chat.logged(said)), "conversations"))


def op13_systolic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_site_templates": op1_site_templates,
    "op2_context_mixing": op2_context_mixing,
    "op3_kneser_ney_toxicity": op3_kneser_ney_toxicity,
    "op4_blob_ledger": op4_blob_ledger,
    "op5_source_mix": op5_source_mix,
    "op6_decision_list": op6_decision_list,
    "op7_fingerprint_index": op7_fingerprint_index,
    "op8_sparse_product_join": op8_sparse_product_join,
    "op9_audio_features": op9_audio_features,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_event_sourced_chat": op12_event_sourced_chat,
    "op13_systolic_divergence": op13_systolic_divergence,
}

#: DuckDB's SQL for those queries that SQL can express.
SQL: dict[str, str] = {
    "op7_fingerprint_index": r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
dup AS (SELECT doc_id, pos FROM win JOIN firsts USING (g) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS p FROM dup),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) t ANTI JOIN gone USING (doc_id, p) GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS C,
  regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t)),
g AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
h AS (SELECT part, x.letter, x.bit, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM (SELECT part, good, toxic, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS m FROM g) CROSS JOIN (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(letter, bit) GROUP BY ALL),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(l)
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, CAST(CASE WHEN step > 1 THEN 1 << (ascii(filter_order[1]) - 65) ELSE 0 END + CASE WHEN step > 2 THEN 1 << (ascii(filter_order[2]) - 65) ELSE 0 END + CASE WHEN step > 3 THEN 1 << (ascii(filter_order[3]) - 65) ELSE 0 END + CASE WHEN step > 4 THEN 1 << (ascii(filter_order[4]) - 65) ELSE 0 END AS INTEGER) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT h.part, filter_order, step, s.letter, sum(n) FILTER (m & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (m & coalesce(before, 0) = 0 AND m & bit > 0) AS removed, sum(n) FILTER (m & coalesce(before, 0) > 0 AND m & bit > 0) AS redundant,
  sum(n) FILTER (m = bit) AS unique_fails, sum(good) FILTER (m & coalesce(before, 0) = 0 AND m & bit > 0) AS good_lost, sum(toxic) FILTER (m & coalesce(before, 0) = 0 AND m & bit > 0) AS toxic_lost FROM s JOIN h ON h.letter = s.letter GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""",
    "op12_event_sourced_chat": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
d AS (SELECT *, sha256(role || chr(0) || text) AS name, length('<|turn|>' || regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g') || chr(10)
  || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>)', '\1\\\2\3', 'g') || '<|end|>' || chr(10)) AS chars FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, name)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, name) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars FROM d GROUP BY conv_id""",
    "op13_systolic_divergence": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10), l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL), s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS count, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.n + 2 * v) AS HUGEINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (l.n + 2 * v) AS HUGEINT) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE count > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10""",
}
