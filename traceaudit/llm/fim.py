"""Fill-in-the-middle documents, cut at line boundaries found through a learned rank index.

The index of a text answers "at which character does line number r end?". All
boundary offsets of the text are fitted by straight segments over their rank; a
segment reaches as far as every boundary on it stays within a fixed error of the
line. What the line misses is stored as a two-byte residual per boundary, so a
prediction plus its residual is the exact offset. The index is one struct column,
fitted in Arrow batches; cuts, the new texts and their reversal are column
expressions.

Null texts count as empty, an empty text has no lines and stays plain. Any id,
null or repeated, is allowed: equal ids get equal draws. A row is handled alone,
so ties, repeated rows and empty tables need no rule; other columns of the input
are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.shingles import pieces

# Fixed markers of the task.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# No boundary is further from its segment than this many characters; a residual takes two bytes.
ERROR = 1000
HALF = 1 << 15
FIRST_WINDOW = 64

INDEX = "struct<n:bigint,ranks:array<bigint>,bases:array<bigint>,slopes:array<double>,residuals:binary>"
INDEX_TYPE = pa.struct([("n", pa.int64()), ("ranks", pa.list_(pa.int64())), ("bases", pa.list_(pa.int64())),
                        ("slopes", pa.list_(pa.float64())), ("residuals", pa.binary())])


def boundary_offsets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text 0 and the offset, in code points, at which each of its lines ends; a line keeps its line feed."""
    for _, _, data, ends in pieces(texts):
        begins = np.concatenate(([0], ends[:-1]))
        marks = np.zeros(len(data) + 1, dtype=bool)
        marks[np.flatnonzero(data == 10) + 1] = True
        marks[ends[ends > begins]] = True
        cuts = np.flatnonzero(marks)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        first, after = np.searchsorted(cuts, begins, "right"), np.searchsorted(cuts, ends, "right")
        for a, b, begin in zip(first, after, begins, strict=True):
            yield np.concatenate(([0], chars[cuts[a:b]] - chars[begin]))


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[int], list[float]]:
    """First rank, offset there and slope of each segment; no offset is further than ``error`` from its segment.

    Each segment starts on a boundary and takes in the next ones while a slope
    is left that serves all of them.
    """
    ranks, bases, slopes = [], [], []
    at, total = 0, len(offsets)
    while at < total:
        window = FIRST_WINDOW
        while True:
            rise = offsets[at + 1:at + 1 + window] - offsets[at]
            run = np.arange(1, len(rise) + 1)
            low = np.maximum.accumulate((rise - error) / run)
            high = np.minimum.accumulate((rise + error) / run)
            broken = np.flatnonzero(low > high)
            if len(broken) or at + 1 + window >= total:
                break
            window *= 2
        reach = int(broken[0]) if len(broken) else len(rise)
        ranks.append(at)
        bases.append(int(offsets[at]))
        slopes.append(float(low[reach - 1] + high[reach - 1]) / 2 if reach else 0.0)
        at += reach + 1
    return ranks, bases, slopes


def fit_index(offsets: np.ndarray, error: int = ERROR) -> dict:
    """Segments and residuals of one text's boundary offsets."""
    ranks, bases, slopes = fit_segments(offsets, error)
    every = np.arange(len(offsets))
    segment = np.searchsorted(ranks, every, "right") - 1
    starts = np.asarray(ranks)[segment]
    predicted = np.asarray(bases)[segment] + np.floor(np.asarray(slopes)[segment] * (every - starts)).astype(np.int64)
    residuals = offsets - predicted
    if np.abs(residuals).max() >= HALF:
        raise ValueError("a residual does not fit two bytes; use a smaller error")
    return {"n": len(offsets) - 1, "ranks": ranks, "bases": bases, "slopes": slopes,
            "residuals": (residuals + HALF).astype(">u2").tobytes()}


def boundary_index(text: Column, error: int = ERROR) -> Column:
    """The rank index of each text as a struct column that can be stored; ``error`` is at most 32,000 characters."""
    if not 1 <= error <= 32_000:
        raise ValueError("the error must be from 1 to 32,000 characters")

    @F.arrow_udf(INDEX)
    def fit(texts: pa.Array) -> pa.Array:
        return pa.array([fit_index(offsets, error) for offsets in boundary_offsets(texts)], type=INDEX_TYPE)

    return fit(text)


def offset_of(index: Column, rank: Column) -> Column:
    """Exact end, in code points, of line number ``rank`` (0: the start): the segment's prediction and its residual."""
    segment = F.size(F.filter(index["ranks"], lambda r: r <= rank))
    steps = (rank - F.element_at(index["ranks"], segment)).cast("double")
    predicted = F.element_at(index["bases"], segment) + F.floor(F.element_at(index["slopes"], segment) * steps)
    stored = F.hex(index["residuals"].substr((rank * 2 + 1).cast("int"), F.lit(2)))
    return predicted + F.conv(stored, 16, 10).cast("long") - F.lit(HALF)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the id: the first groups of a SHA-256; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = 100, spm_rate: int = 50, seed: int = 7,
                   error: int = ERROR) -> DataFrame:
    """Rearrange documents so that a model learns to fill in a middle: (id, n, form, prefix_chars, middle_chars, output).

    Two line boundaries are drawn per document; the text between them is the
    middle. ``rate`` percent of the documents are rearranged, ``spm_rate`` percent
    of these suffix first. Empty texts, texts that hold a marker and documents
    not drawn stay ``plain``; their character counts are null.
    """
    body = F.coalesce(docs[text], F.lit(""))
    drawn = docs.select(docs[doc_id].alias("id"), body.alias("body"), F.array(*draws(docs[doc_id], seed)).alias("h"),
                        boundary_index(body, error).alias("index"))
    spots = F.col("index")["n"] + 1
    one, two = F.col("h")[0] % spots, F.col("h")[1] % spots
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("body", F.lit(marker))
    plain = (F.col("body") == "") | marked | (F.col("h")[2] % 100 >= rate)
    placed = drawn.select(
        "id", "body", F.col("index")["n"].alias("n"),
        F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
        offset_of(F.col("index"), F.least(one, two)).alias("begin"),
        offset_of(F.col("index"), F.greatest(one, two)).alias("end"))
    prefix = F.col("body").substr(F.lit(1), F.col("begin").cast("int"))
    middle = F.col("body").substr((F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    suffix = F.col("body").substr((F.col("end") + 1).cast("int"), F.length("body"))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.col("body")))
    cut = F.col("form") != "plain"
    return placed.select(
        F.col("id").alias(doc_id), "n", "form", F.when(cut, F.col("begin")).alias("prefix_chars"),
        F.when(cut, F.col("end") - F.col("begin")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; parts hold no markers, so the three markers cut it exactly."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
            .otherwise(output))
