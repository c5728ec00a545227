"""Quality expressions over model outputs: format, validity, truncation and JSON structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceaudit.functions import jsontext as J
from traceaudit.functions.stems import has_error_stems

# Phrases that tell the expected output format, and marks of code.
JSON_PHRASES = ("output json", "return json", "json object", "json format", "output.*json", "response.*json",
                "must be json")
CODE_PHRASES = ("write code", "python code", "generate code", "write a function", "implement", "write python",
                "code snippet")
CODE_MARKS = ("def ", "class ", "import ", "from ", "return ", "    ")

VALIDITY_NAMES = ("is_well_formed", "output_length_normalized", "has_error_stems", "format_matches_expectation",
                  "is_truncated")
STRUCTURAL_NAMES = ("action_is_coder", "action_is_conclude", "action_is_shortlist", "action_is_other",
                    "num_subtasks_log1p", "has_subtasks", "has_relevance_scores", "mean_relevance_score", "has_code",
                    "completion_fraction", "num_relevant_apis_log1p", "num_json_keys_log1p")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def expected_format(prompt: Column) -> Column:
    """Output format a system prompt asks for: json, code or text; null for an empty prompt."""
    low = F.lower(prompt)
    wants_json = F.regexp_like(low, F.lit("|".join(JSON_PHRASES)))
    return (F.when(F.coalesce(prompt, F.lit("")) == "", F.lit(None).cast("string"))
             .when(wants_json, "json").when(_any(low, CODE_PHRASES), "code").otherwise("text"))


def output_format(text: Column) -> Column:
    """Format of an output: json, markdown, code or text."""
    t = J.stripped(text)
    looks = t.startswith("{") | t.startswith("[")
    return (F.when(looks & J.strict_parse(t).isNotNull(), "json").when(t.contains("```"), "markdown")
             .when(_any(t, CODE_MARKS), "code").otherwise("text"))


def is_truncated(text: Column, max_length: int = 10_000) -> Column:
    """Does a non-empty text look cut off?"""
    t = J.stripped(text)

    def surplus(opening: str, closing: str) -> Column:
        return F.length(F.replace(t, F.lit(closing), F.lit(""))) > F.length(F.replace(t, F.lit(opening), F.lit("")))

    unclosed = (t.startswith("{") | t.startswith("[")) & (surplus("{", "}") | surplus("[", "]"))
    tail = F.when(F.length(t) > 20, F.right(t, F.lit(20))).otherwise(t)
    finished = F.regexp_like(tail, F.lit(r"""[.!?;"')}\]]""")) | t.endswith("```")
    return (F.when(t.endswith("...") | t.endswith("…"), True).when(F.length(t) > max_length, True)
             .when(unclosed, True).otherwise(~finished))


def output_length(text: Column, fmt: Column) -> Column:
    """JSON: length of its re-serialised form; code: number of lines; otherwise characters."""
    dumped = J.python_json_ascii(F.when(fmt == "json", text))
    return (F.when(fmt == "json", F.length(dumped)).when(fmt == "code", F.size(F.split(text, "\n", -1)))
             .otherwise(F.length(text)))


def normal_length(length: Column) -> Column:
    """log10(length + 1), at most 10, zero for nothing."""
    return F.when(length > 0, F.least(F.log10(length + 1), F.lit(10.0))).otherwise(0.0)


def well_formed(text: Column, expected: Column) -> Column:
    """Can the output be read in the expected format?"""
    block = F.nullif(J.fenced_code(text), F.lit(""))
    code = J.is_python(F.when(expected == "code", F.coalesce(block, text)))
    size = F.length(J.stripped(text))
    return (F.when(expected == "json", J.loose_parse(text).isNotNull()).when(expected == "code", code)
             .when(expected == "text", size > 10).otherwise(size > 0))


def format_matches(fmt: Column, expected: Column) -> Column:
    """Does the actual format fit the expected one?"""
    return F.coalesce(F.when(expected == "json", fmt.isin("json", "markdown"))
                       .when(expected == "code", fmt.isin("code", "markdown")), F.lit(True))


def validity(text: Column, prompt: Column) -> dict[str, Column]:
    """The five validity numbers of an output; all zero for an empty one."""
    expected, fmt = expected_format(prompt), output_format(text)
    full = F.coalesce(text, F.lit("")) != ""

    def flag(value: Column) -> Column:
        return F.when(full & value, 1.0).otherwise(0.0)

    return {
        "is_well_formed": flag(well_formed(text, expected)),
        "output_length_normalized": F.when(full, normal_length(output_length(text, fmt))).otherwise(0.0),
        "has_error_stems": flag(has_error_stems(text)),
        "format_matches_expectation": flag(format_matches(fmt, expected)),
        "is_truncated": flag(is_truncated(text)),
    }


def _truthy(value: Column) -> Column:
    """Is a VARIANT neither empty, zero, false nor null?"""
    shown = F.to_json(value)
    zero = F.coalesce(F.when(~shown.startswith('"'), shown.try_cast("double")) == 0, F.lit(False))
    return F.coalesce(~shown.isin("null", "false", '""', "[]", "{}") & ~zero, F.lit(False))


def structure(parsed: Column) -> dict[str, Column]:
    """The twelve structure numbers of a JSON object given as VARIANT (null gives zeros)."""
    def field(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(parsed, f"$.{n}", "variant") for n in names])

    def listed(value: Column) -> Column:
        return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))

    def count(value: Column) -> Column:
        return F.coalesce(F.size(listed(value)), F.lit(0))

    def flag(value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit(False)), 1.0).otherwise(0.0)

    action = field("action")
    named = F.when(F.schema_of_variant(action) == "STRING", F.try_variant_get(action, "$", "string"))
    known = named.isin("CoderAgent", "ConcludeTask", "ShortlisterAgent")
    subtasks = count(field("subtasks", "subtask_list"))
    entries = F.filter(listed(field("shortlisted_apis", "apis")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    scores = F.filter(F.transform(entries, lambda x: F.try_variant_get(
        F.coalesce(F.try_variant_get(x, "$.relevance_score", "variant"), F.try_variant_get(x, "$.score", "variant")),
        "$", "double")), lambda s: s.isNotNull())
    has_scores = F.coalesce(F.size(scores), F.lit(0)) > 0
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.greatest(F.size(scores), F.lit(1))
    progress = listed(field("subtasks_progress"))
    steps = F.coalesce(F.size(progress), F.lit(0))
    done = F.size(F.filter(progress, lambda s: F.to_json(s) == '"completed"'))
    keys = F.coalesce(F.size(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))), F.lit(0))
    return {
        "action_is_coder": flag(named == "CoderAgent"),
        "action_is_conclude": flag(named == "ConcludeTask"),
        "action_is_shortlist": flag(named == "ShortlisterAgent"),
        "action_is_other": flag(_truthy(action) & ~F.coalesce(known, F.lit(False))),
        "num_subtasks_log1p": F.log1p(subtasks.cast("double")),
        "has_subtasks": flag(subtasks > 0),
        "has_relevance_scores": flag(has_scores),
        "mean_relevance_score": F.when(has_scores, mean).otherwise(0.0),
        "has_code": flag(_truthy(field("code", "python_code"))),
        "completion_fraction": F.when(steps > 0, done / steps).otherwise(0.0),
        "num_relevant_apis_log1p": F.log1p(count(field("relevant_apis")).cast("double")),
        "num_json_keys_log1p": F.log1p(keys.cast("double")),
    }
