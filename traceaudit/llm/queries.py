"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.llm import bpe, conversations, decontaminate, fim, jaccard, language, lm, mixing, quality, secrets, sharding, topk, toxicity
from traceaudit.llm.common import table

# Vocabulary files of public tokenizers; only the driver opens them.
TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, each distinct text scanned once."""
    return secrets.secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources by weight takes of each document, in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, mixing.word_count(F.col("text"))).drop("source", "_key")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document in 40 shards of nearly equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by rules learned from the labelled ones."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a chain learned from the labelled ones, with the offending spans."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, found by a positional index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination_report(docs, table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on five-word shingles, and how many rows each links with."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language.identify(table(spark, sf_dir, "documents"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged to fill in a middle, and restored."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under a byte-level vocabulary, and the texts that they decode to."""
    codec = bpe.Codec(spark, f"{TOKENIZERS}/byte_bpe_50k.json")
    ids = codec.encode(table(spark, sf_dir, "documents"))
    both = ids.withColumn("decoded", codec.decode(F.col("ids")))
    return both.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, and their cheapest repairs."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(turns, conversations.damage(turns))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_secret_scan, op2_source_mix, op3_kd_shards, op4_quality_rules, op5_toxic_spans, op6_decontamination, op7_inner_products,
    op8_jaccard_join, op9_language, op10_pitman_yor, op11_fill_in_middle, op12_byte_bpe, op13_conversation_repair)}


def _spans_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: pieces between the matches, and the matches, give the positions."""
    held = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""
  SELECT r, unnest(list_transform(list_filter(list_zip(range(1, len(m) + 1), m, held, gap), lambda z: len(z[3]) >= {least}), lambda z: struct_pack(
      s := list_sum(list_transform(gap[1:z[1]], lambda p: len(p))) + coalesce(list_sum(list_transform(m[1:z[1] - 1], lambda p: len(p))), 0),
      n := len(z[2]), place := {place}, kind := '{kind}')), recursive := true)
  FROM (SELECT r, t, regexp_extract_all(t, '{pattern}', 0) AS m, {held} AS held, string_split_regex(t, '{pattern}') AS gap FROM d)"""


def _op1_sql() -> str:
    parts = [_spans_sql(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least)
             for i, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, place) AS spans
      FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g USING (r)
"""


_OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || md5('mix|' || coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, '')))[1:8])::BIGINT >> 1 AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
-- Sources fill up in the order of what they may give for their weight; the rest share what the full ones leave.
o AS (SELECT *, coalesce(sum(most) OVER b, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight,
    sum(source_size) OVER () AS total
  FROM w WINDOW b AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- This level rises up to the last full source and falls after it.
l AS (SELECT max((total - given) / open_weight) AS level FROM o),
t AS (SELECT source, source_size, least(most, level * weight) AS target FROM w, l),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""

_OP6_SQL = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, words)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

_OP7_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
r AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS suf FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END)
    AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {"op11_fill_in_middle": _OP11_SQL, "op7_inner_products": _OP7_SQL, "op6_decontamination": _OP6_SQL, "op1_secret_scan": _op1_sql(), "op2_source_mix": _OP2_SQL}
