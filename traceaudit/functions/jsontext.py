"""JSON text as Columns: strict parsing in the JVM, Python re-serialisation in Arrow batches."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fenced blocks, with an optional json tag and with any tag.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
CODE_FENCE = r"(?s)```(?:\w+)?\s*\n?(.*?)\n?```"


END_MARK = "~|end of text|~"


def strict_parse(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, otherwise null.

    The parser ignores what follows the first value, so the text is parsed as
    the first of two list items: a mark must come right after it.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END_MARK}"]')))
    return F.when(F.try_variant_get(listed, "$[1]", "string") == END_MARK, F.try_variant_get(listed, "$[0]", "variant"))


def is_object(value: Column) -> Column:
    """True when a VARIANT holds a JSON object."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def fenced(text: Column) -> Column:
    """Content of the first fenced block (optionally tagged json), stripped; null without one."""
    return F.when(F.regexp_like(text, F.lit(FENCE)), stripped(F.regexp_extract(text, FENCE, 1)))


def fenced_code(text: Column, language: str | None = None) -> Column:
    """Content of the first fenced block, any language tag or a given one; null without one."""
    pattern = rf"(?s)```{language}\s*\n?(.*?)\n?```" if language else CODE_FENCE
    return F.when(F.regexp_like(text, F.lit(pattern)), stripped(F.regexp_extract(text, pattern, 1)))


def stripped(text: Column) -> Column:
    """Text without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def loose_parse(text: Column) -> Column:
    """VARIANT from the whole text, else its first fenced block, else from the first ``{`` or ``[`` on."""
    from_brace = F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{")))
    from_bracket = F.when(F.instr(text, "[") > 0, F.substr(text, F.instr(text, "[")))
    return F.coalesce(strict_parse(text), strict_parse(fenced(text)),
                      strict_parse(from_brace), strict_parse(from_bracket))


@F.pandas_udf(T.StringType())
def python_json(text: pd.Series) -> pd.Series:
    """Re-serialise JSON text with ``", "`` and ``": "`` separators, keeping non-ASCII characters."""
    return text.map(lambda t: None if t is None else _dump(t, False), na_action="ignore")


@F.pandas_udf(T.StringType())
def python_json_ascii(text: pd.Series) -> pd.Series:
    """Re-serialise JSON text with ``", "`` and ``": "`` separators and ASCII escapes."""
    return text.map(lambda t: None if t is None else _dump(t, True), na_action="ignore")


def python_json_indented(size: int):
    """Arrow UDF over lists of JSON texts: each over several lines, two spaces deep, cut to ``size`` characters."""

    def one(texts):
        return None if texts is None else [json.dumps(json.loads(t), indent=2)[:size] for t in texts]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def indent(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return indent


def outputs_text(*path: str):
    """Arrow UDF: the value under a path of keys as response text, null when it is not there.

    Text that is JSON itself and objects come back re-serialised with keys in
    their order; other text and values come back as they print.
    """

    def one(raw):
        try:
            value = json.loads(raw)
            for key in path:
                value = value.get(key)
        except (ValueError, AttributeError):
            return None
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
        if isinstance(value, str):
            return _dump(value, False) or value
        return None if value is None else str(value)

    @F.pandas_udf(T.StringType())
    def pick(raw: pd.Series) -> pd.Series:
        return raw.map(one, na_action="ignore")

    return pick


def _at(raw: str, path: tuple[str, ...]):
    """Value under a path of keys of a JSON text; None if there is none."""
    try:
        value = json.loads(raw)
        for key in path:
            value = value.get(key)
        return value
    except (ValueError, AttributeError):
        return None


def json_field(*path: str):
    """Arrow UDF: the value under a path of keys as JSON text; null when it is not there or counts as false."""

    @F.pandas_udf(T.StringType())
    def pick(raw: pd.Series) -> pd.Series:
        values = raw.map(lambda t: _at(t, path), na_action="ignore")
        return values.map(lambda v: json.dumps(v, ensure_ascii=False) if v else None, na_action="ignore")

    return pick


def printed_field(name: str):
    """Arrow UDF: a field of a JSON object the way Python prints it; null when there is no such field."""

    def one(raw: str) -> str | None:
        try:
            value = json.loads(raw)
        except ValueError:
            return None
        return str(value[name]) if isinstance(value, dict) and name in value else None

    @F.pandas_udf(T.StringType())
    def pick(raw: pd.Series) -> pd.Series:
        return raw.map(one, na_action="ignore")

    return pick


def _dump(text: str, ascii_only: bool) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=ascii_only)
    except ValueError:
        return None


def joined_fields(keys: tuple[str, ...], only_text_and_lists: bool):
    """Arrow UDF: chosen fields of a JSON object as one text, or the re-serialised JSON.

    Values that are not text appear the way Python prints them.
    """
    kinds = (str, list) if only_text_and_lists else object

    def one(text):
        try:
            parsed = json.loads(text)
        except (ValueError, TypeError):
            return None
        if not isinstance(parsed, dict):
            return None
        found = [str(parsed[k]) for k in keys if k in parsed and isinstance(parsed[k], kinds)]
        return " ".join(found) if found else json.dumps(parsed)

    @F.pandas_udf(T.StringType())
    def fields(text: pd.Series) -> pd.Series:
        return text.map(one, na_action="ignore")

    return fields


@F.pandas_udf(T.BooleanType())
def is_python(code: pd.Series) -> pd.Series:
    """True when the text is syntactically valid Python."""
    return code.map(_compiles, na_action="ignore")


def _compiles(code: str) -> bool:
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
