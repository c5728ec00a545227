"""Node features: common, output, cleaned texts, embeddings and the assembled vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions import jsontext as J
from traceaudit.functions import quality as Q
from traceaudit.functions.text import prompt_hash
from traceaudit.operators.lookup import lookup_join

# JSON fields that hold the task, and those that hold the answer.
TASK_FIELDS = ("intent", "task", "goal", "objective", "question", "query")
ANSWER_FIELDS = ("thoughts", "reasoning", "explanation", "analysis", "result", "output", "answer", "response", "content")

SIGNATURE_DIM = 32
COMMON_HEAD = ("duration", "node_type_id", "hierarchy_depth", "sibling_index", "parent_index")
COMMON_FLAGS = ("is_llm_call", "is_tool_call", "is_complex")
TOKEN_NAMES = ("input_tokens", "output_tokens", "token_ratio")


def common_features(nodes: DataFrame, on_bad_prefix: str = "null") -> DataFrame:
    """Duration, type id, place in the name hierarchy and task flags of every node.

    A missing or negative duration is -1.0. Name prefixes such as ``0.3.2:`` give
    depth, sibling and parent numbers. A prefix that is not numeric gives nulls,
    or with ``drop_trace`` removes its whole trace.
    """
    name = F.col("name")
    has_prefix = F.instr(name, ":") > 0
    prefix = F.when(has_prefix, F.substring_index(name, ":", 1)).otherwise("")
    parts = F.split(prefix, r"\.", -1)
    size = F.size(parts)
    last = F.element_at(parts, -1).try_cast("int")
    before = F.when(size >= 2, F.try_element_at(parts, F.lit(-2)).try_cast("int")).otherwise(0)
    blank = prefix == ""

    def tagged(word: str) -> Column:
        return F.when(F.coalesce(F.exists("tags", lambda t: F.lower(t) == word), F.lit(False)), 1.0).otherwise(0.0)

    rows = nodes.select(
        *nodes.columns, F.when(has_prefix, F.substr(name, F.instr(name, ":") + 1)).otherwise(name).alias("name_suffix"),
        F.when(F.col("duration") >= 0, F.col("duration")).otherwise(-1.0).alias("duration_feature"),
        F.when(F.col("node_type") == "llm_call", 0).otherwise(1).alias("node_type_id"),
        F.when(blank, 0).otherwise(size).alias("hierarchy_depth"),
        F.when(blank, 0).otherwise(last).alias("sibling_index"),
        F.when(blank, 0).otherwise(before).alias("parent_index"),
        tagged("llm_call").alias("is_llm_call"), tagged("tool_call").alias("is_tool_call"),
        tagged("complex").alias("is_complex"))
    if on_bad_prefix == "null":
        return rows
    if on_bad_prefix != "drop_trace":
        raise ValueError(f"unknown policy {on_bad_prefix!r}")
    bad = rows.filter(F.col("sibling_index").isNull() | F.col("parent_index").isNull()).select("trace_id").distinct()
    return rows.join(bad, "trace_id", "left_anti")


def call_texts(nodes: DataFrame) -> DataFrame:
    """Add prompt, input, output and token counts from the ``input``, ``output`` and ``attributes`` maps.

    ``output_text`` is the completion itself; ``output_any`` falls back to any completion content.
    """
    def get(column: str, key: str) -> Column:
        return F.nullif(F.try_element_at(F.col(column), F.lit(key)), F.lit(""))

    roles = F.map_keys(F.map_filter("input", lambda k, v: k.contains("prompt") & k.contains("role") & (v == "user")))
    contents = F.filter(F.transform(roles, lambda k: F.try_element_at(F.col("input"), F.replace(k, F.lit(".role"), F.lit(".content")))),
                        lambda v: v.isNotNull())
    completions = F.map_values(F.map_filter("output", lambda k, v: k.contains("completion") & k.contains("content")))
    return nodes.select(
        *nodes.columns, F.coalesce(get("input", "gen_ai.prompt.0.content"), F.lit("")).alias("system_prompt"),
        F.coalesce(get("input", "gen_ai.prompt.1.content"), F.get(contents, F.lit(0))).alias("user_input"),
        get("output", "gen_ai.completion.0.content").alias("output_text"),
        F.coalesce(get("output", "gen_ai.completion.0.content"), F.get(completions, F.lit(0))).alias("output_any"),
        F.try_element_at("attributes", F.lit("num_input_tokens")).try_cast("bigint").alias("num_input_tokens"),
        F.try_element_at("attributes", F.lit("num_output_tokens")).try_cast("bigint").alias("num_output_tokens"))


def token_features(rows: DataFrame) -> DataFrame:
    """Input and output token counts and their ratio (0 without input)."""
    given, made = F.coalesce("num_input_tokens", F.lit(0)), F.coalesce("num_output_tokens", F.lit(0))
    return rows.select(*rows.columns, given.cast("bigint").alias("input_tokens"), made.cast("bigint").alias("output_tokens"),
                       F.when(given > 0, F.try_divide(made.cast("double"), given.cast("double"))).otherwise(0.0).alias("token_ratio"))


def validity_features(rows: DataFrame, text: str = "output_text", prompt: str = "system_prompt") -> DataFrame:
    """Add the five validity numbers."""
    return rows.select(*rows.columns, *[c.alias(n) for n, c in Q.validity(F.col(text), F.col(prompt)).items()])


def structural_features(rows: DataFrame, text: str = "output_any") -> DataFrame:
    """Add the twelve structure numbers of outputs that are JSON objects."""
    staged = rows.withColumn("__j", J.strict_parse(F.col(text)))
    staged = staged.withColumn("__j", F.when(J.is_object(F.col("__j")), F.col("__j")))
    return staged.select(*rows.columns, *[c.alias(n) for n, c in Q.structure(F.col("__j")).items()])


def output_features(rows: DataFrame) -> DataFrame:
    """Token, validity and structure numbers of every call."""
    return structural_features(validity_features(token_features(rows)))


_task_text = J.joined_fields(TASK_FIELDS, False)
_answer_text = J.joined_fields(ANSWER_FIELDS, True)


def _shorten(text: Column, max_length: int) -> Column:
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    cut = F.when(F.length(flat) > max_length, F.concat(F.substring(flat, 1, max_length), F.lit("..."))).otherwise(flat)
    return F.trim(cut)


def clean_task(text: Column, max_length: int = 5000) -> Column:
    """User input for encoding: fence removed, task fields of a JSON object joined, shortened."""
    opened = F.when(text.contains("```") & F.regexp_like(text, F.lit(J.FENCE)), F.regexp_extract(text, J.FENCE, 1)).otherwise(text)
    is_json = J.is_object(J.strict_parse(opened))
    body = F.coalesce(_task_text(F.when(is_json, opened)), opened)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(_shorten(body, max_length))


def clean_answer(text: Column, max_length: int = 5000) -> Column:
    """Model output for encoding: answer fields of a JSON object, the first code block, or the text; shortened."""
    fmt = Q.output_format(text)
    is_json = (fmt == "json") & J.is_object(J.strict_parse(text))
    code = F.when(fmt.isin("code", "markdown"), F.nullif(J.fenced_code(text), F.lit("")))
    body = F.coalesce(_answer_text(F.when(is_json, text)), code, text)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(_shorten(body, max_length))


def clean_texts(rows: DataFrame, max_length: int = 5000) -> DataFrame:
    """Add ``task_text`` and ``answer_text``."""
    return rows.select(*rows.columns, clean_task(F.col("user_input"), max_length).alias("task_text"),
                       clean_answer(F.col("output_any"), max_length).alias("answer_text"))


def hashed_embedding(rows: DataFrame, text: str, out: str, dim: int = 384) -> DataFrame:
    """Default encoder: word counts hashed into ``dim`` buckets, scaled to unit length, all in the JVM."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    hashed = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim).transform(rows.withColumn("__words", words))
    scaled = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(hashed)
    return scaled.withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__unit")


def embed_texts(rows: DataFrame, text: str, out: str, dim: int = 384,
                encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add an embedding of a text column; empty texts give zeros.

    ``encoder`` is a Pandas UDF from text to ``array<float>`` of length ``dim``
    (an iterator UDF can load a model once per task); without one the texts are hashed.
    """
    if encoder is None:
        return hashed_embedding(rows, text, out, dim)
    zeros = F.array_repeat(F.lit(0.0), dim).cast("array<float>")
    usable = F.nullif(F.col(text), F.lit(""))
    return rows.withColumn(out, F.coalesce(encoder(usable), zeros))


def feature_names(dim: int = 384) -> list[str]:
    """Names of the assembled vector's numbers, in order."""
    calls = ([f"role_sig_{i}" for i in range(SIGNATURE_DIM)] + [f"task_emb_{i}" for i in range(dim)]
             + [f"output_emb_{i}" for i in range(dim)] + list(TOKEN_NAMES) + list(Q.VALIDITY_NAMES) + list(Q.STRUCTURAL_NAMES))
    common = [*COMMON_HEAD, *[f"name_emb_{i}" for i in range(32)], *COMMON_FLAGS]
    return calls + common


def assemble_features(nodes: DataFrame, signatures: DataFrame | None = None, names: DataFrame | None = None,
                      dim: int = 384, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nodes with their whole feature vector (``features``, ``array<float>``).

    ``nodes`` carries the graph columns and the call texts. ``signatures`` is
    ``prompt_hash, signature`` and ``names`` is ``name_suffix, name_embedding``;
    misses and absent tables give zeros. Other nodes have zeros in the call part.
    """
    # Lookups come first: where they split off hot keys, the texts are cleaned and encoded once, after the parts meet.
    zeros = F.array_repeat(F.lit(0.0), SIGNATURE_DIM)
    rows = common_features(nodes).withColumn("prompt_hash", prompt_hash(F.col("system_prompt")))
    rows = lookup_join(rows, signatures, ["prompt_hash"]) if signatures is not None else rows.withColumn("signature", zeros)
    rows = lookup_join(rows, names, ["name_suffix"]) if names is not None else rows.withColumn("name_embedding", zeros)
    rows = clean_texts(output_features(rows))
    rows = embed_texts(embed_texts(rows, "task_text", "task_emb", dim, encoder), "answer_text", "output_emb", dim, encoder)

    def numbers(columns) -> Column:
        return F.array(*[F.col(c).cast("double") for c in columns])

    call = F.concat(F.coalesce("signature", zeros), F.col("task_emb").cast("array<double>"),
                    F.col("output_emb").cast("array<double>"), numbers(TOKEN_NAMES), numbers(Q.VALIDITY_NAMES),
                    numbers(Q.STRUCTURAL_NAMES))
    width = SIGNATURE_DIM + 2 * dim + 20
    common = F.concat(numbers(["duration_feature", *COMMON_HEAD[1:]]), F.coalesce("name_embedding", zeros), numbers(COMMON_FLAGS))
    whole = F.concat(F.when(F.col("node_type") == "llm_call", call).otherwise(F.array_repeat(F.lit(0.0), width)), common)
    return rows.select("trace_id", "node_idx", "parent_idx", "node_type", whole.cast("array<float>").alias("features"))


def feature_metadata(nodes: DataFrame, dim: int = 384) -> DataFrame:
    """One row about an assembled table: widths, counts and the node type codes."""
    width = SIGNATURE_DIM + 2 * dim + 20
    return nodes.agg(
        F.count_distinct("trace_id").alias("traces"), F.count(F.lit(1)).alias("nodes"), F.lit(dim).alias("embedding_dim"),
        F.lit(width).alias("call_dim"), F.lit(40).alias("common_dim"), F.lit(width + 40).alias("total_dim"),
        F.lit('{"llm_call": 0, "non_llm": 1}').alias("node_types"))
