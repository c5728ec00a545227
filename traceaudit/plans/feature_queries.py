"""Queries over call features, text signatures and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.jsontext import outputs_text
from traceaudit.functions.text import clean_text, prompt_hash, rounded
from traceaudit.operators import features, graph, signatures
from traceaudit.plans.registry import query
from traceaudit.plans.span_queries import CALLS, NODES
from traceaudit.sources import adapters as A

# Frequent short words of the benchmark's English, used as stop words on both sides.
STOP_WORDS = ["the", "and", "for", "was", "that", "with", "are", "his", "from", "this"]


@query("token_features", f"""WITH {CALLS}
SELECT span_idx, num_input_tokens AS input_tokens, num_output_tokens AS output_tokens,
  round(CASE WHEN num_input_tokens > 0 THEN num_output_tokens / num_input_tokens::DOUBLE ELSE 0 END, 9) AS token_ratio FROM call""")
def token_features(spark, folder):
    """Token counts and their ratio per call."""
    out = features.token_features(A.chat_rows(spark, folder))
    return out.select("span_idx", "input_tokens", "output_tokens", rounded(F.col("token_ratio"), 9).alias("token_ratio"))


VALIDITY = f"""WITH {CALLS},
x AS (SELECT span_idx, event_type AS t, response, span_idx % 4 AS want,
        CASE WHEN response LIKE '{{%' AND json_valid(response) THEN 'json' WHEN response LIKE '%```%' THEN 'markdown' ELSE 'text' END AS fmt FROM call)
SELECT span_idx,
  CASE want WHEN 0 THEN (t <> 'error') WHEN 1 THEN (t <> 'error') WHEN 2 THEN length(trim(response)) > 10 ELSE true END::INT::DOUBLE AS is_well_formed,
  round(log10(length(response) + 1), 9) AS output_length_normalized,
  CASE WHEN regexp_matches(lower(response), '\\b(errors?|fail(s|ed|ing|ures?)?|exceptions?|invalid|incorrect|unable|cannot)\\b') THEN 1 ELSE 0 END::DOUBLE AS has_error_stems,
  CASE WHEN want IN (0) THEN (fmt IN ('json', 'markdown')) WHEN want = 1 THEN (fmt = 'markdown') ELSE true END::INT::DOUBLE AS format_matches_expectation,
  CASE WHEN response LIKE '%...' THEN 1 WHEN regexp_matches(right(response, 20), '[.!?;"'')}}\\]]') OR response LIKE '%```' THEN 0 ELSE 1 END::DOUBLE AS is_truncated
FROM x"""


@query("validity_features", VALIDITY)
def validity_features(spark, folder):
    """The five validity numbers per call."""
    rows = A.chat_rows(spark, folder).select("span_idx", "system_prompt", F.col("response").alias("output_text"))
    out = features.validity_features(rows).drop("system_prompt", "output_text")
    return out.withColumn("output_length_normalized", rounded(F.col("output_length_normalized"), 9))


@query("validity_documents", r"""
SELECT doc_id, CASE WHEN length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) > 10 THEN 1 ELSE 0 END::DOUBLE AS is_well_formed,
  round(log10(CASE WHEN regexp_matches(text, 'def |class |import |from |return |    ') THEN len(string_split(text, chr(10))) ELSE length(text) END + 1), 9) AS output_length_normalized,
  CASE WHEN regexp_matches(lower(text), '\b(errors?|fail(s|ed|ing|ures?)?|exceptions?|invalid|incorrect|unable|cannot)\b') THEN 1 ELSE 0 END::DOUBLE AS has_error_stems,
  1.0::DOUBLE AS format_matches_expectation,
  CASE WHEN regexp_matches(text, '(\.\.\.|…)\s*$') OR length(text) > 10000 THEN 1 WHEN regexp_matches(right(regexp_replace(text, '\s+$', ''), 20), '[.!?;"'')}\]]') THEN 0 ELSE 1 END::DOUBLE AS is_truncated
FROM documents""")
def validity_documents(spark, folder):
    """The five validity numbers with every document as a plain-text output."""
    rows = A.table(spark, folder, "documents", spread=True).select("doc_id", F.lit("Answer briefly.").alias("system_prompt"), F.col("text").alias("output_text"))
    out = features.validity_features(rows).drop("system_prompt", "output_text")
    return out.withColumn("output_length_normalized", rounded(F.col("output_length_normalized"), 9))


@query("structural_features", f"""WITH {CALLS},
j AS (SELECT span_idx, CASE WHEN json_valid(response) THEN response END AS js FROM call),
p AS (SELECT span_idx, js, json_extract_string(js, '$.action') AS act, coalesce(json_array_length(js, '$.subtasks'), 0) AS subs,
        list_filter([coalesce(TRY_CAST(json_extract_string(js, '$.shortlisted_apis[0].relevance_score') AS DOUBLE), TRY_CAST(json_extract_string(js, '$.shortlisted_apis[0].score') AS DOUBLE)),
                     coalesce(TRY_CAST(json_extract_string(js, '$.shortlisted_apis[1].relevance_score') AS DOUBLE), TRY_CAST(json_extract_string(js, '$.shortlisted_apis[1].score') AS DOUBLE))],
                    lambda v: v IS NOT NULL) AS scores,
        coalesce(json_array_length(js, '$.subtasks_progress'), 0) AS steps, coalesce(json_array_length(js, '$.relevant_apis'), 0) AS apis,
        len(list_filter(CAST(json_extract(js, '$.subtasks_progress') AS VARCHAR[]), lambda v: v = 'completed')) AS done,
        coalesce(len(json_keys(js)), 0) AS keys, json_extract_string(js, '$.code') AS code FROM j)
SELECT span_idx, (coalesce(act, '') = 'CoderAgent')::INT::DOUBLE AS action_is_coder, (coalesce(act, '') = 'ConcludeTask')::INT::DOUBLE AS action_is_conclude,
  (coalesce(act, '') = 'ShortlisterAgent')::INT::DOUBLE AS action_is_shortlist,
  (coalesce(act, '') NOT IN ('', 'CoderAgent', 'ConcludeTask', 'ShortlisterAgent'))::INT::DOUBLE AS action_is_other,
  round(ln(1 + subs), 9) AS num_subtasks_log1p, (subs > 0)::INT::DOUBLE AS has_subtasks, (len(scores) > 0)::INT::DOUBLE AS has_relevance_scores,
  round(coalesce(list_avg(scores), 0), 9) AS mean_relevance_score, (coalesce(code, '') <> '')::INT::DOUBLE AS has_code,
  round(CASE WHEN steps > 0 THEN done / steps::DOUBLE ELSE 0 END, 9) AS completion_fraction, round(ln(1 + apis), 9) AS num_relevant_apis_log1p,
  round(ln(1 + keys), 9) AS num_json_keys_log1p FROM p""")
def structural_features(spark, folder):
    """The twelve structure numbers per call."""
    rows = A.chat_rows(spark, folder).select("span_idx", F.col("response").alias("output_any"))
    out = features.structural_features(rows).drop("output_any")
    return out.withColumns({c: rounded(F.col(c), 9) for c in out.columns if c.endswith(("log1p", "score", "fraction"))})


@query("clean_texts", f"""WITH {CALLS}
SELECT span_idx, CASE span_idx % 3 WHEN 0 THEN json_extract_string(user_input, '$.intent') || ' ' || json_extract_string(user_input, '$.goal')
    WHEN 1 THEN trim(regexp_replace(user_input, '\\s+', ' ', 'g')) ELSE json_extract_string(regexp_extract(user_input, '\\{{.*\\}}'), '$.query') END AS task_text,
  CASE event_type WHEN 'click' THEN json_extract_string(response, '$.thoughts')
    WHEN 'signup' THEN regexp_extract(response, '\\{{.*\\}}') ELSE response END AS answer_text FROM call""")
def clean_texts(spark, folder):
    """Task and answer texts prepared for encoding."""
    rows = A.chat_rows(spark, folder).select("span_idx", "user_input", F.col("response").alias("output_any"))
    return features.clean_texts(rows).select("span_idx", "task_text", "answer_text")


@query("clean_documents", r"""SELECT doc_id, md5(CASE WHEN length(t) > 5000 THEN trim(substr(t, 1, 5000) || '...') ELSE trim(t) END) AS text_md5,
  md5(substr(trim(t), 1, 100)) AS head_md5
FROM (SELECT doc_id, regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', ' ', 'g') AS t FROM documents)""")
def clean_documents(spark, folder):
    """Documents with white space collapsed, shortened for encoding and to 100 characters, as md5."""
    d = A.table(spark, folder, "documents", spread=True)
    return d.select("doc_id", F.md5(features.clean_task(F.col("text"))).alias("text_md5"), F.md5(clean_text(F.col("text"), 100)).alias("head_md5"))


@query("agent_outputs", """SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' AS response FROM events""")
def agent_outputs(spark, folder):
    """Responses unwrapped from their output envelopes."""
    e = A.table(spark, folder, "events")
    return e.select("event_id", outputs_text("outputs")(F.concat(F.lit('{"outputs": '), F.col("props"), F.lit("}"))).alias("response"))


@query("prompt_dedup", """SELECT DISTINCT substr(sha256(text), 1, 16) AS prompt_hash, length(text) AS chars FROM documents WHERE text <> ''""")
def prompt_dedup(spark, folder):
    """Distinct documents by content hash."""
    out = signatures.distinct_prompts(A.table(spark, folder, "documents", spread=True), "text")
    return out.select("prompt_hash", F.length("prompt").cast("bigint").alias("chars"))


def _tfidf(features_: int, share: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
doc AS (SELECT substr(sha256(text), 1, 16) AS h, any_value(text) AS text FROM documents WHERE text <> '' GROUP BY 1),
w AS (SELECT h, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda v: regexp_full_match(v, '[a-z]{{3,}}') AND v NOT IN ({stops})) AS ws FROM doc),
tok AS (SELECT h, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
cnt AS (SELECT h, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n FROM doc),
voc AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM cnt GROUP BY term HAVING count(*) <= {share}::DOUBLE * (SELECT n FROM n) ORDER BY 2 DESC, 1 LIMIT {features_}),
raw AS (SELECT h, term, cnt.tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM cnt JOIN (SELECT term, df FROM voc) USING (term), n),
wt AS (SELECT h, term, w / sqrt(sum(w * w) OVER (PARTITION BY h)) AS weight FROM raw)"""


@query("tfidf_terms", f"""WITH {_tfidf(500, '0.9')} SELECT h AS prompt_hash, term, round(weight, 6) AS weight FROM wt""")
def tfidf_terms(spark, folder):
    """Unit-length term weights of the distinct documents over 500 words and word pairs."""
    docs = signatures.distinct_prompts(A.table(spark, folder, "documents", spread=True), "text")
    lists = signatures.word_lists(docs, "prompt_hash", "prompt", STOP_WORDS)
    vocab = signatures.fixed_vocabulary(signatures.vocabulary(lists))
    out = signatures.term_weights(lists, "prompt_hash", vocab)
    return out.withColumn("weight", rounded(F.col("weight")))


@query("tfidf_keywords", f"""WITH {_tfidf(200, '0.8')}
SELECT term, round(sum(weight) / (SELECT n FROM n), 6) AS score FROM wt GROUP BY term ORDER BY round(sum(weight) / (SELECT n FROM n), 12) DESC, term LIMIT 50""")
def tfidf_keywords(spark, folder):
    """The fifty terms with the largest mean weight."""
    docs = signatures.distinct_prompts(A.table(spark, folder, "documents", spread=True), "text")
    out = signatures.keywords(docs, "prompt_hash", "prompt", stop_words=STOP_WORDS)
    return out.withColumn("score", rounded(F.col("score")))


@query("text_signatures_svd")
def text_signatures_svd(spark, folder):
    """Signatures of the distinct documents (32 numbers each)."""
    docs = signatures.distinct_prompts(A.table(spark, folder, "documents", spread=True), "text")
    return signatures.text_signatures(docs, "prompt_hash", "prompt", stop_words=STOP_WORDS)


@query("name_signatures")
def name_signatures(spark, folder):
    """Signatures of the distinct customer names from character runs."""
    names = A.table(spark, folder, "part").select(F.col("p_type").alias("name_suffix"))
    return signatures.node_name_signatures(names)


@query("embed_texts")
def embed_texts(spark, folder):
    """Hashed embeddings of the conversation texts."""
    c = A.table(spark, folder, "conversations", spread=True).select("conv_id", "turn", "text")
    return features.embed_texts(c, "text", "embedding", 384).drop("text")


def conversation_calls(spark, folder):
    """Graph nodes of the conversations with call texts."""
    nodes = graph.build_trace_graph(A.conversation_spans(spark, folder))
    text = F.col("text")
    is_call = F.col("role") == "assistant"
    return nodes.select(
        *nodes.columns, F.concat(F.lit("Answer as "), "role", F.lit(", style "), F.repeat(F.lit("x"), (F.col("trace_id") % 7).cast("int"))).alias("system_prompt"), F.when(is_call, text).alias("user_input"),
        F.when(is_call, text).alias("output_text"), F.when(is_call, text).alias("output_any"),
        F.length("text").cast("bigint").alias("num_input_tokens"), F.col("span_idx").alias("num_output_tokens"))


@query("assemble_features")
def assemble_features(spark, folder):
    """Whole feature vectors (860 numbers) of the conversation nodes."""
    calls = conversation_calls(spark, folder)
    prompts = signatures.distinct_prompts(calls, "system_prompt")
    # Numbers that tell the prompts apart: their lengths, counted up.
    found = prompts.select("prompt_hash", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.length("prompt") + i).cast("double")).alias("signature"))
    return features.assemble_features(calls, found)


@query("feature_layout", f"""WITH {NODES},
f AS (SELECT trace_id, node_idx, coalesce(duration, -1.0) AS duration, node_type, role, span_idx, length(text) AS chars FROM node)
SELECT trace_id, node_idx, CAST(860 AS BIGINT) AS width, round(duration, 3) + 0.0 AS f820, CASE node_type WHEN 'llm_call' THEN 0.0 ELSE 1.0 END::DOUBLE AS f821,
  2.0::DOUBLE AS f822, CAST(span_idx AS DOUBLE) AS f823,
  CASE node_type WHEN 'llm_call' THEN 18 + length(role) + trace_id % 7 ELSE 0 END::DOUBLE AS f0,
  CASE node_type WHEN 'llm_call' THEN 49 + length(role) + trace_id % 7 ELSE 0 END::DOUBLE AS f31,
  CASE node_type WHEN 'llm_call' THEN chars ELSE 0 END::DOUBLE AS f800,
  CASE node_type WHEN 'llm_call' THEN span_idx ELSE 0 END::DOUBLE AS f801 FROM f""")
def feature_layout(spark, folder):
    """Chosen positions of the assembled vectors: width, common numbers and token counts."""
    out = assemble_features(spark, folder)
    at = {c: F.round(F.element_at("features", int(c[1:]) + 1).cast("double"), 3) + F.lit(0.0)
          for c in ("f0", "f31", "f800", "f801", "f820", "f821", "f822", "f823")}
    return out.select("trace_id", "node_idx", F.size("features").cast("bigint").alias("width"), *[c.alias(n) for n, c in at.items()])


@query("feature_metadata", f"""WITH {NODES}
SELECT count(DISTINCT trace_id) AS traces, count(*) AS nodes, 384 AS embedding_dim, 820 AS call_dim, 40 AS common_dim, 860 AS total_dim,
  '{{"llm_call": 0, "non_llm": 1}}' AS node_types FROM node""")
def feature_metadata(spark, folder):
    """Widths and counts of the assembled table."""
    return features.feature_metadata(graph.build_trace_graph(A.conversation_spans(spark, folder)))


@query("batch_ids", """SELECT conv_id AS trace_id, CAST((dense_rank() OVER (ORDER BY conv_id) - 1) // 100 AS BIGINT) AS batch_id
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def batch_ids(spark, folder):
    """Traces in batches of one hundred."""
    return graph.batch_ids(A.table(spark, folder, "conversations").select(F.col("conv_id").alias("trace_id")))


@query("feature_summary", """
WITH v AS (SELECT vec_id // 50 AS trace_id, vec_id % 2 AS odd, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT vec_id // 50 AS trace_id, count(*) AS nodes, count(*) FILTER (vec_id % 2 = 0) AS llm_nodes, count(*) FILTER (vec_id % 2 = 1) AS other_nodes FROM embeddings GROUP BY 1)
SELECT c.*, round(lo, 6) + 0.0 AS feature_min, round(hi, 6) + 0.0 AS feature_max, round(mu, 6) + 0.0 AS feature_mean, round(sd, 6) + 0.0 AS feature_std
FROM c JOIN (SELECT trace_id, min(x) AS lo, max(x) AS hi, avg(x) AS mu, stddev_samp(x) AS sd FROM v GROUP BY 1) USING (trace_id)""")
def feature_summary(spark, folder):
    """Minimum, maximum, mean and deviation of the vectors per graph."""
    nodes = A.graph_nodes(spark, folder).withColumn("node_type", F.when(F.col("node_idx") % 2 == 0, "llm_call").otherwise("non_llm"))
    out = graph.feature_summary(nodes)
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c.startswith("feature_")})


UNNEST = "unnest(range(1, 65))"


def _flat(df, keys):
    return df.select(*keys, F.posexplode("features").alias("dim", "x")).select(
        *keys, F.col("dim").cast("bigint").alias("dim"), rounded(F.col("x").cast("double"), 5).alias("x"))


def _pool(how: str, sql: str, doc: str) -> None:
    @query(f"pool_{how}", f"""WITH v AS (SELECT vec_id // 50 AS trace_id, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))
SELECT trace_id, dim, round({sql}, 5) + 0.0 AS x FROM v GROUP BY ALL""")
    def pool(spark, folder):
        return _flat(graph.pool_graph(A.graph_nodes(spark, folder), 64, how), ["trace_id"])

    pool.__doc__ = doc


_pool("mean", "avg(x)", "Mean vector per graph.")
_pool("max", "max(x)", "Element-wise maximum per graph.")
_pool("add", "sum(x)", "Sum of the vectors per graph.")


@query("pool_attention", """
WITH v AS (SELECT vec_id // 50 AS trace_id, exp(embedding[1]::DOUBLE) AS w, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))
SELECT trace_id, dim, round(sum(w * x) / (sum(w) + 1e-8), 5) + 0.0 AS x FROM v GROUP BY ALL""")
def pool_attention(spark, folder):
    """Attention-weighted vector per graph; the first number of a vector is its score."""
    nodes = A.graph_nodes(spark, folder).withColumn("score", F.element_at("features", 1).cast("double"))
    return _flat(graph.pool_graph(nodes, 64, score="score"), ["trace_id"])


EDGES = """
v AS (SELECT vec_id // 50 AS t, vec_id % 50 AS n, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
e AS (SELECT vec_id // 50 AS t, (vec_id % 50 - 1) // 2 AS s, vec_id % 50 AS d FROM embeddings WHERE vec_id % 50 > 0)"""


@query("propagate_gcn", f"""WITH {EDGES},
deg AS (SELECT vec_id // 50 AS t, vec_id % 50 AS n, CASE WHEN vec_id % 50 > 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS d FROM embeddings),
m AS (SELECT e.t, e.d AS n, v.dim, v.x / sqrt(a.d * b.d) AS x FROM e JOIN v ON v.t = e.t AND v.n = e.s
        JOIN deg a ON a.t = e.t AND a.n = e.s JOIN deg b ON b.t = e.t AND b.n = e.d
      UNION ALL SELECT v.t, v.n, v.dim, v.x / d FROM v JOIN deg USING (t, n))
SELECT t AS trace_id, n AS node_idx, dim, round(sum(x), 5) + 0.0 AS x FROM m GROUP BY ALL""")
def propagate_gcn(spark, folder):
    """Degree-normalised neighbour sums."""
    return _flat(graph.propagate(A.graph_nodes(spark, folder), A.graph_edges(spark, folder), 64), ["trace_id", "node_idx"])


@query("propagate_sage", f"""WITH {EDGES},
m AS (SELECT e.t, e.d AS n, v.dim, avg(v.x) AS x FROM e JOIN v ON v.t = e.t AND v.n = e.s GROUP BY ALL),
a AS (SELECT v.t, v.n, v.dim, coalesce(m.x, 0) AS x FROM v LEFT JOIN m USING (t, n, dim)),
l AS (SELECT t, n, sqrt(sum(x * x)) AS len FROM a GROUP BY ALL)
SELECT t AS trace_id, n AS node_idx, dim, round(CASE WHEN len > 0 THEN x / len ELSE 0 END, 5) + 0.0 AS x FROM a JOIN l USING (t, n)""")
def propagate_sage(spark, folder):
    """Unit-length neighbour means."""
    return _flat(graph.propagate(A.graph_nodes(spark, folder), A.graph_edges(spark, folder), 64, "sage"), ["trace_id", "node_idx"])


def _layer(last: str, name: str) -> str:
    return f"""{name}m AS (SELECT e.t, e.d AS n, v.dim, v.x / sqrt(a.d * b.d) AS x FROM e JOIN {last} v ON v.t = e.t AND v.n = e.s
        JOIN deg a ON a.t = e.t AND a.n = e.s JOIN deg b ON b.t = e.t AND b.n = e.d
      UNION ALL SELECT v.t, v.n, v.dim, v.x / d FROM {last} v JOIN deg USING (t, n)),
{name} AS (SELECT t, n, dim, sum(x) AS x FROM {name}m GROUP BY ALL)"""


@query("propagate_layers", f"""WITH {EDGES},
deg AS (SELECT vec_id // 50 AS t, vec_id % 50 AS n, CASE WHEN vec_id % 50 > 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS d FROM embeddings),
{_layer('v', 'l1')}, {_layer('l1', 'l2')}, {_layer('l2', 'l3')}
SELECT t AS trace_id, n AS node_idx, dim, round(x, 5) + 0.0 AS x FROM l3""")
def propagate_layers(spark, folder):
    """Three layers of degree-normalised neighbour sums."""
    return _flat(graph.propagate_layers(A.graph_nodes(spark, folder), A.graph_edges(spark, folder), 64, "gcn", 3), ["trace_id", "node_idx"])


@query("hash_prompts", """SELECT doc_id, substr(sha256(text), 1, 16) AS prompt_hash FROM documents""")
def hash_prompts(spark, folder):
    """Content hash of every document."""
    return A.table(spark, folder, "documents").select("doc_id", prompt_hash(F.col("text")).alias("prompt_hash"))
