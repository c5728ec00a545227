"""Text and number expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters at which a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column, max_length: int | None = None) -> Column:
    """Collapse white space, strip, and cut to ``max_length`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.substring(flat, 1, max_length) if max_length else flat


def lines_of(text: Column) -> Column:
    """Lines of a text at every Unicode line boundary; a final break opens no extra line."""
    parts = F.split(text, LINE_BREAK, -1)
    size = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, size - 1)).otherwise(parts)


def literal_pattern(anchor: Column, ignore_case: bool = True) -> Column:
    """Regular expression that matches ``anchor`` literally."""
    quoted = F.replace(anchor, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iu)\\Q" if ignore_case else "\\Q"), quoted, F.lit("\\E"))


def prompt_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def shuffle_key(seed: int, *ids: Column) -> Column:
    """Hex key that orders rows pseudo-randomly, the same on any partitioning."""
    parts = [c.cast("string") for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_bucket(key: Column, digits: int = 4) -> Column:
    """Bucket that is monotone in a hex key; ``16 ** digits`` buckets per group."""
    return F.substring(key, 1, digits)


def hash_number(text: Column) -> Column:
    """Integer in [0, 2^32) from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def basename(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def type_slug(name: Column) -> Column:
    """Lower-cased name with underscores."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def trace_number(name: Column) -> Column:
    """Number after ``trace`` in a file name, null without one."""
    return F.regexp_extract(name, r"trace(\d+)", 1).try_cast("bigint")


def normal_trace_name(name: Column) -> Column:
    """File name with the zero padding of single-digit trace numbers removed."""
    number = trace_number(name)
    return F.when(number < 10, F.concat(F.lit("trace"), number.cast("string"), F.lit(".log"))).otherwise(name)


def natural_key(name: Column) -> Column:
    """Sort key that orders embedded numbers by value.

    Every run of digits is left-padded to 20 places, so text comparison of the
    keys orders numbers by size.
    """
    low = F.lower(name)
    padded = F.regexp_replace(low, r"(\d+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def rounded(number: Column, digits: int = 6) -> Column:
    """Rounded number without negative zero."""
    return F.round(number, digits) + F.lit(0.0)
