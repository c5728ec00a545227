"""The elements of one large JSON array, read by many tasks.

A file is one JSON array, or one JSON object with the array under a key. It is cut
into byte ranges. A range alone cannot know whether it begins inside a string or how
deep, so it tells for both cases how it would leave: the parity of its quotes, the
change of depth and the lowest depth, and where the array might open. Joined in file
order these steps give every range its true beginning. Each range then marks its
top-level commas, and reads the elements that begin in it, the last one to its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.session import cut_lineage, unsized
from traceaudit.sources.files import TAIL, Reader, list_files, task_count

SPLIT_BYTES = 64 << 20
PIECE = 2 << 20                                            # bytes of a range looked at at a time
QUOTE, SLASH = 0x22, 0x5C
_TURN = np.zeros(256, dtype=np.int8)
_TURN[[0x5B, 0x7B]] = 1
_TURN[[0x5D, 0x7D]] = -1
STEPS = ("log_path string, first bigint, last bigint, size bigint, outside int, out_turn bigint, out_low bigint, in_turn bigint, in_low bigint, "
         "opens array<struct<at:bigint,inside:int,depth:bigint,low:bigint>>")

PLACED = pa.schema([("log_path", pa.string()), *[(n, pa.int64()) for n in ("first", "last", "size", "inside", "depth", "opened", "target")]])


def _escaped_before(reader: Reader, at: int) -> int:
    """How many backslashes stand right before a place."""
    count = 0
    while at > 0:
        low = max(0, at - TAIL)
        block = reader.read(low, at)
        kept = block.rstrip(b"\\")
        count += len(block) - len(kept)
        if kept:
            break
        at = low
    return count


def real_quotes(data: np.ndarray, slashes_before: int) -> np.ndarray:
    """Places of the quotes that no backslash takes out."""
    at = np.flatnonzero(data == QUOTE)
    other = np.where(data != SLASH, np.arange(len(data)), -1)
    last_other = np.maximum.accumulate(other) if len(data) else other
    before = np.where(at > 0, last_other[np.maximum(at - 1, 0)], -1)
    run = at - 1 - before + np.where(before < 0, slashes_before, 0)
    return at[run % 2 == 0]


def _walk(data: np.ndarray, inside: int, slashes_before: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bracket places outside strings, their steps of depth, parity at the end) of bytes that begin inside a string or not."""
    quotes = np.zeros(len(data), dtype=np.int8)
    quotes[real_quotes(data, slashes_before)] = 1
    parity = (np.cumsum(quotes) + inside) % 2
    places = np.flatnonzero((_TURN[data] != 0) & (parity == 0))
    return places, _TURN[data[places]].astype(np.int64), int(parity[-1]) if len(data) else inside


def _openings(reader: Reader, data: bytes, first: int, key: str) -> list[int]:
    """Places in a range where the array may open: after the key and a colon, or as the first of the file's bytes that is no blank.

    Up to ``TAIL`` blanks may stand there; whether the place lies in a string is not known yet.
    """
    found = []
    before = reader.read(max(0, first - TAIL), first)
    blank = rb"[ \t\r\n]*"
    for one in re.finditer(b'"' + re.escape(key.encode()) + b'"' + blank + b":" + blank + rb"\[", before + data):
        found.append(one.end() - 1 - len(before))
    head = reader.read(0, TAIL)
    start = len(head) - len(head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n"))
    if first <= start < first + len(data) and head[start:start + 1] == b"[":
        found.append(start - first)
    return sorted(at for at in found if at >= 0)


def _slashes_after(raw: bytes, before: int) -> int:
    """How many backslashes stand right before the end of some bytes that follow ``before`` of them."""
    tail = len(raw) - len(raw.rstrip(b"\\"))
    return tail + (before if tail == len(raw) else 0)


def _summary(reader: Reader, uri: str, first: int, last: int, size: int, key: str) -> dict:
    """The step of a range, read block by block: memory is that of a block, whatever the range."""
    slashes = _escaped_before(reader, first)
    parity, turn, lows, opens = [0, 1], [0, 0], [[], []], []
    for at in range(first, max(last, first + 1), PIECE):
        raw = reader.read(at, min(last, at + PIECE))
        data = np.frombuffer(raw, dtype=np.uint8)
        openings = np.array(_openings(reader, raw, at, key), dtype=np.int64)
        for inside in (0, 1):
            places, turns, parity[inside] = _walk(data, parity[inside], slashes)
            depth = turn[inside] + np.cumsum(turns)
            low = np.minimum.accumulate(depth[::-1])[::-1]     # the lowest depth from here on
            for k in np.flatnonzero(np.isin(places, openings)):
                after = int(low[k + 1]) if k + 1 < len(low) else None
                opens.append((at + int(places[k]), inside, int(depth[k]), after, len(lows[inside])))
            lows[inside].append(int(low[0]) if len(low) else None)
            turn[inside] = int(depth[-1]) if len(depth) else turn[inside]
        slashes = _slashes_after(raw, slashes)
    row = {"log_path": uri, "first": first, "last": last, "size": size, "outside": parity[0], "opens": []}  # the other beginning ends the other way round
    later: list[list[int | None]] = []                          # the lowest depth in the blocks after each
    for inside, name in ((0, "out"), (1, "in")):
        least, after = None, []
        for one in reversed(lows[inside]):
            after.append(least)
            least = one if least is None else least if one is None else min(one, least)
        later.append(after[::-1])
        row[f"{name}_turn"], row[f"{name}_low"] = turn[inside], 0 if least is None else least
    for at, inside, depth, after, block in sorted(opens, key=lambda o: (o[1], o[0])):
        below = [x for x in (after, later[inside][block]) if x is not None]
        row["opens"].append({"at": at, "inside": inside, "depth": depth - 1, "low": min(below) if below else depth})
    return row


class _Joined:
    """Takes the steps in order of file and place; gives those ranges that hold a part of the file's array, each with its true beginning."""

    def __init__(self) -> None:
        self.path: str | None = None

    def take(self, r: dict) -> tuple | None:
        if r["log_path"] != self.path:
            self.path, self.inside, self.depth, self.opened, self.target, self.over = r["log_path"], 0, 0, -1, -1, False
        if self.over:
            return None
        low = r["in_low"] if self.inside else r["out_low"]
        inside, depth, begun = self.inside, self.depth, self.opened >= 0
        closed = begun and depth + low < self.target
        if not begun:
            for one in r["opens"]:
                level = depth + one["depth"]
                # The array stands at the top, or under the key of the object at the top.
                if one["inside"] == inside and level in (0, 1):
                    self.opened, self.target, begun = int(one["at"]), level + 1, True
                    closed = depth + one["low"] < self.target
                    break
        self.over = closed
        self.depth += r["in_turn"] if inside else r["out_turn"]
        self.inside = (r["outside"] + inside) % 2
        return (self.path, r["first"], r["last"], r["size"], inside, depth, self.opened, self.target) if begun else None


def _joined(steps: pd.DataFrame) -> pd.DataFrame:
    """The same of a table of steps in any order."""
    rows = [row for row in map(_Joined().take, steps.sort_values(["log_path", "first"]).to_dict("records")) if row]
    return pd.DataFrame(rows, columns=PLACED.names)


def _elements(reader: Reader, first: int, last: int, size: int, inside: int, depth: int, opened: int, target: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the elements that begin in a range: after the opening bracket or a comma that stands in it."""
    begin, parts = None, []                                    # the element that is being read
    at, stop, slashes = first, min(last, first + PIECE), _escaped_before(reader, first)
    while at < size:
        raw = reader.read(at, stop)
        data = np.frombuffer(raw, dtype=np.uint8)
        quotes = np.zeros(len(data), dtype=np.int8)
        quotes[real_quotes(data, slashes)] = 1
        parity = (np.cumsum(quotes) + inside) % 2
        turns = np.where(parity == 0, _TURN[data], 0)
        level = depth + np.cumsum(turns, dtype=np.int64)
        cut = (parity == 0) & (data == 0x2C) & (level == target)
        close = (turns < 0) & (level == target - 1)
        marks = np.flatnonzero(cut | close)
        marks = marks[marks + at > opened]
        if at <= opened < at + len(data):
            begin = opened + 1
        used = max(0, begin - at) if begin is not None else 0
        for k in marks.tolist():
            if begin is not None:
                text = b"".join([*parts, raw[used:k]]).strip(b" \t\r\n")
                if text:
                    yield begin, text
            begin, parts, used = at + k + 1, [], k + 1
            if close[k] or at + k >= last:
                return
        if begin is None and at + len(raw) >= last:
            return
        if begin is not None:
            parts.append(raw[used:])
        inside, depth = int(parity[-1]), int(level[-1])
        slashes, at = _slashes_after(raw, slashes), at + len(raw)
        stop = min(last, at + PIECE) if at < last else min(size, at + TAIL)


def read_json_array(spark: SparkSession, path: str, key: str = "runs", glob: str = "*.json", split_bytes: int = SPLIT_BYTES,
                    marks: Sequence[str] = ()) -> DataFrame:
    """Elements of the array in each file: ``log_path, start, text``; ``start`` orders them.

    The array is the whole file, or the value of ``key`` in the file's object. Files
    with neither have no rows; a broken end ends the elements. With ``marks`` only
    files count that are an object with one of these texts in its first 256 bytes. Per
    file one row a range passes through a task, nothing through the driver.
    """
    heads = [m.encode() for m in marks]

    files = list_files(path, glob)
    parts = [(uri, first, min(size, first + split_bytes), size) for uri, size, _ in files for first in range(0, size, split_bytes)]
    tasks = task_count([last - first for _, first, last, _ in parts], spark.sparkContext.defaultParallelism)
    schema = pa.schema([("log_path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("size", pa.int64())])
    columns = zip(*parts, strict=True) if parts else [[], [], [], []]
    ranges = unsized(spark, pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    ranges = ranges.repartition(tasks, "log_path", "first")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, first, last, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with Reader(uri) as reader:
                    head = reader.read(0, 256).lstrip()
                    if heads and not (head.startswith(b"{") and any(m in head for m in heads)):
                        continue
                    rows.append(_summary(reader, uri, first, last, size, key))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=made)

    opens = pa.list_(pa.struct([("at", pa.int64()), ("inside", pa.int32()), ("depth", pa.int64()), ("low", pa.int64())]))
    numbers = ("first", "last", "size", "out_turn", "out_low", "in_turn", "in_low")
    made = pa.schema([("log_path", pa.string()), *[(n, pa.int64()) for n in numbers[:3]], ("outside", pa.int32()),
                      *[(n, pa.int64()) for n in numbers[3:]], ("opens", opens)])
    steps = ranges.mapInArrow(summed, STEPS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Joined()
        for batch in batches:
            kept = [row for row in map(fold.take, batch.to_pylist()) if row]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), PLACED, strict=True)], schema=PLACED)

    known = cut_lineage(steps.repartition("log_path").sortWithinPartitions("log_path", "first").mapInArrow(
        joined, "log_path string, first bigint, last bigint, size bigint, inside bigint, depth bigint, opened bigint, target bigint"))  # as PLACED

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []
        weight = 0
        for batch in batches:
            for uri, *where in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with Reader(uri) as reader:
                    for at, raw in _elements(reader, *where):
                        held.append((uri, at, raw.decode("utf-8", "replace")))
                        weight += len(raw)
                        if weight > 8 << 20 or len(held) >= 10_000:
                            yield _rows(held)
                            held, weight = [], 0
        if held:
            yield _rows(held)

    return known.repartition(tasks, "log_path", "first").mapInArrow(read, "log_path string, start bigint, text string")


def _rows(held: list[tuple[str, int, str]]) -> pa.RecordBatch:
    uris, starts, texts = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(uris), pa.array(starts, pa.int64()), pa.array(texts)], names=["log_path", "start", "text"])


def numbered(elements: DataFrame, name: str, bytes_per_bucket: int = SPLIT_BYTES) -> DataFrame:
    """Elements with their place in their array, counted from 0; the rows are stored first, so the files are read once."""
    from traceaudit.operators.ranking import ranked
    placed = ranked(cut_lineage(elements), ["log_path"], ["start"], F.floor(F.col("start") / bytes_per_bucket), name)
    return placed.withColumn(name, F.col(name) - 1)
