"""Cheapest repair of conversations, with the audit of its edits.

A conversation may be led by a system turn; then user and assistant take turns, the
assistant last. Turns are kept, given another role, deleted or inserted; the
cheapest list of edits is found by a dynamic program over the turns, whose cells
are the four states of that rule. Each cell holds the last node of its edit list;
lists share their beginnings as linked nodes, which know their ancestors at
distances of powers of two and the rolling hash of the whole list. Of two equally
cheap lists the first in ASCII order wins, found by a search for their longest
common prefix; equal hashes are verified.

Turns are put in order by one range sort of narrow rows and cut into chunks. A chunk is solved
for every state in which it may begin, and the chunks of a conversation are folded in order,
so a conversation of any length is work for many tasks; texts are fetched for what is kept.

Defined results: null ids are one conversation; a null role or text counts as one
blank; null turns come first; turns of equal number are ordered by role, then by
the MD5 of the text; a role beginning with none of s, u, a can only be changed or
deleted. A conversation without turns has no audit rows. Other columns are not
read, whatever their names. Rows that agree in everything are each a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
# Turns that are solved together, as a power of two.
CHUNK_BITS = 11
# Fixed values of the task: costs of the edits and kinds of faults.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, CUT_SHORT = 0, 1, 2, 3
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
PRIME, BASE = (1 << 61) - 1, 0x5DEECE66D


class Audits:
    """Edit lists that share their beginnings: node 0 is the empty list, any other node one more edit."""

    def __init__(self) -> None:
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]                    # ancestors 1, 2, 4, ... edits before

    def add(self, node: int, edit: str) -> int:
        """The list of ``node`` and one more edit."""
        new = len(self.edit)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % PRIME)
        jumps, k = [node], 0
        while k < len(self.up[jumps[k]]):
            jumps.append(self.up[jumps[k]][k])
            k += 1
        self.up.append(jumps)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        """The beginning of ``node`` with so many edits."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth are the same list; equal hashes are followed back to a shared node."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether list ``a`` comes before list ``b`` in ASCII order."""
        level = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, level), self.ancestor(b, level)
        if self.equal(x, y):
            return self.depth[a] < self.depth[b]
        # The shortest beginnings that differ: jump back while what is left differs.
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and not self.equal(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        """The edits as one string."""
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Cells:
    """Cheapest edit list per state, first in ASCII order among equals."""

    def __init__(self, audits: Audits, start: int):
        self.audits = audits
        self.best: dict[int, tuple[int, int]] = {start: (0, 0)}

    def _offer(self, cells: dict[int, tuple[int, int]], state: int, cost: int, node: int, edit: str) -> None:
        known = cells.get(state)
        if known is None or cost < known[0]:
            cells[state] = (cost, self.audits.add(node, edit))
        elif cost == known[0]:
            new = self.audits.add(node, edit)
            if self.audits.less(new, known[1]):
                cells[state] = (cost, new)

    def insert(self) -> None:
        """Let turns be inserted here; a user turn first, then what answers it."""
        for state in (EMPTY, SYSTEM, ASSISTANT, USER):
            if state in self.best:
                cost, node = self.best[state]
                self._offer(self.best, NEXT[state], cost + INSERT, node, "I")

    def turn(self, initial: str, fault: int) -> None:
        """Take in one turn."""
        self.insert()
        cells: dict[int, tuple[int, int]] = {}
        extra = TRUNCATED if fault == CUT_SHORT else 0
        for state, (cost, node) in self.best.items():
            self._offer(cells, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            follows = NEXT[state]
            if initial == "s" and state == EMPTY:
                self._offer(cells, SYSTEM, cost + extra, node, "K")
            elif initial == ("u" if follows == USER else "a"):
                self._offer(cells, follows, cost + extra, node, "K")
            self._offer(cells, follows, cost + RENAME + extra, node, "R")
        self.best = cells


def solve(turns: list[tuple[str, int]], starts: tuple[int, ...] = (EMPTY, SYSTEM, USER, ASSISTANT)) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of the cheapest ways through some turns; nothing is inserted after the last."""
    out = []
    for start in starts:
        audits = Audits()
        cells = Cells(audits, start)
        for initial, fault in turns:
            cells.turn(initial, fault)
        out.extend((start, state, cost, audits.text(node)) for state, (cost, node) in cells.best.items())
    return out


class Fold:
    """Cheapest edit list per state over the chunks of a conversation so far; chunks are linked as edits are."""

    def __init__(self) -> None:
        self.label: list[tuple[int, int, int, str]] = [(0, EMPTY, EMPTY, "")]      # first place, states before and after, edits of the chunk
        self.up: list[list[int]] = [[]]
        self.best: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}

    def _less(self, a: int, edits_a: str, b: int, edits_b: str) -> bool:
        """Whether the list of ``a`` and then ``edits_a`` comes first; both have the same number of chunks.

        Lists part where their chunks part: edits that begin in one state and differ do so within the chunk.
        """
        if a == b:
            return edits_a < edits_b
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.label[a][3] < self.label[b][3]

    def chunk(self, first: int, ways: list[tuple[int, int, int, str]]) -> None:
        """Take in the next chunk, whose first turn stands at place ``first``."""
        chosen: dict[int, tuple[int, int, int, str]] = {}
        for start, state, cost, edits in ways:
            if start not in self.best:
                continue
            total, node = self.best[start]
            total += cost
            known = chosen.get(state)
            if known is None or total < known[0] or (total == known[0] and self._less(node, edits, known[1], known[3])):
                chosen[state] = (total, node, start, edits)
        self.best = {}
        for state, (total, node, start, edits) in chosen.items():
            jumps, k = [node], 0
            while k < len(self.up[jumps[k]]):
                jumps.append(self.up[jumps[k]][k])
                k += 1
            self.best[state] = (total, len(self.label))
            self.label.append((first, start, state, edits))
            self.up.append(jumps)

    def finish(self) -> tuple[int, list[tuple[int, int, int, str]], str]:
        """Cost, chunks and the turns inserted at the end of the cheapest whole list."""
        ends = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        least = min(cost + INSERT * len(ends[state]) for state, (cost, _) in self.best.items())
        ways = []
        for state, (cost, node) in self.best.items():
            if cost + INSERT * len(ends[state]) == least:
                chunks, at = [], node
                while at:
                    chunks.append(self.label[at])
                    at = self.up[at][0]
                ways.append((chunks[::-1], ends[state]))
        chunks, end = min(ways, key=lambda way: "".join(c[3] for c in way[0]) + way[1]) if len(ways) > 1 else ways[0]
        return least, chunks, end


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults: by a hash of id and number, turns are dropped, emptied, left without
    sentence ends, repeated or given the role of the user, each in one of twenty cases. Nulls of role and text become a blank."""
    one = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    case = F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn)).cast("binary")) % 20
    rows = turns.select(turns[conv_id].alias("conv"), turns[turn].cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"),
                        case.alias("case")).filter("case <> 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1))))
    return rows.select(
        "conv", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))


def _signed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("sign", F.md5(F.col("text").cast("binary")))


def placed_turns(turns: DataFrame) -> DataFrame:
    """All turns in order without their texts: (at, chunk, conv, turn, role, sign, initial, fault), stored.

    ``at`` grows along each conversation. Equal rows are counted before anything is
    shuffled by row; whether role and text were seen before is a combinable minimum.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    state = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_SHORT)
    rows = (_signed(turns).withColumn("fault", state)
            .groupBy("conv", "turn", "role", "sign", "fault").agg(F.count(F.lit(1)).alias("copies")))
    seen = (rows.groupBy(F.col("conv").alias("s_conv"), F.col("role").alias("s_role"), F.col("sign").alias("s_sign"))
            .agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("turns"))
            .filter("turns > 1"))
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role")) & (F.col("sign") == F.col("s_sign")), "left")
    later = F.coalesce(F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("first"), F.lit(False))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("fault", F.when((F.col("fault") != BLANK) & (later | (F.col("copy") > 1)), DUPLICATE).otherwise(F.col("fault")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sign", "copy"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(ordered.select("at", F.shiftright("at", CHUNK_BITS).alias("chunk"), "conv", "turn", "role", "sign",
                                 F.substring("role", 1, 1).alias("initial"), F.col("fault").cast("int").alias("fault")))


WAYS = "ways array<struct<start:int,state:int,cost:bigint,edits:string>>"
WAYS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def _fields(placed: DataFrame, rest: str) -> T.StructType:
    return T.StructType([placed.schema["conv"], *T.StructType.fromDDL(rest)])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows that agree in their first columns, across batches."""
    key, group = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if group and row[:keys] != key:
                yield key, group
                group = []
            key = row[:keys]
            group.append(row[keys:])
    if group:
        yield key, group


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def solved_chunks(placed: DataFrame) -> DataFrame:
    """Per conversation and chunk: its first and last place, counts of faults, the roles at its edges and all cheapest ways through it."""
    schema = _fields(placed, f"first bigint, last bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, edges string, {WAYS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                conv_type[:] = [batch.schema.field(1).type]
                yield batch

        def rows() -> Iterator[tuple]:
            before = None
            for (chunk, conv), group in _runs(noted(), 2):
                # Only what opens a chunk may have begun in an earlier one.
                starts = (EMPTY,) if before == chunk else (EMPTY, SYSTEM, USER, ASSISTANT)
                before = chunk
                faults = [fault for _, _, fault in group]
                initials = [initial for _, initial, _ in group]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))
                ways = solve([(initial, fault) for _, initial, fault in group], starts)
                yield (conv, group[0][0], group[-1][0], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_SHORT), illegal,
                       f"{initials[0]:1.1}{initials[-1]:1.1}", [dict(zip(("start", "state", "cost", "edits"), way, strict=True)) for way in ways])

        found = rows()
        head = next(found, None)
        if head is not None:
            made = pa.schema([("conv", conv_type[0]), *[(n, pa.int64()) for n in ("first", "last", "blank", "duplicate", "truncated", "illegal")],
                              ("edges", pa.string()), ("ways", WAYS_TYPE)])

            def every() -> Iterator[tuple]:
                yield head
                yield from found

            yield from _batches(every(), made)

    return (placed.select("chunk", "conv", "at", "initial", "fault").repartition("chunk").sortWithinPartitions("chunk", "at")
            .mapInArrow(run, schema))


CHUNKS = "chunks array<struct<first:bigint,start:int,state:int,edits:string>>"


def audits(placed: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, last, end, chunks): the cheapest edits of each conversation, chunk by chunk.

    Chunks are folded as they come, in order; a task holds the edits of one conversation.
    """
    chunks = solved_chunks(placed)
    schema = _fields(placed, f"blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, last bigint, end string, {CHUNKS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv_type = batch.schema.field(0).type
            break
        else:
            return

        def again() -> Iterator[pa.RecordBatch]:
            yield batch
            yield from batches

        def rows() -> Iterator[tuple]:
            key, fold = None, None
            for row in (row for one in again() for row in zip(*[c.to_pylist() for c in one.columns], strict=True)):
                conv, first, last, *counts, edges, ways = row
                if fold is None or conv != key:
                    if fold is not None:
                        yield closed(key, fold, sums, end)
                    key, fold, sums, edge = conv, Fold(), [0, 0, 0, 0], None
                fold.chunk(first, [(w["start"], w["state"], w["cost"], w["edits"]) for w in ways])
                counts[3] += edge is not None and edge + edges[0] not in LEGAL
                sums, edge, end = [a + b for a, b in zip(sums, counts, strict=True)], edges[1], last
            if fold is not None:
                yield closed(key, fold, sums, end)

        def closed(conv, fold: Fold, sums: list[int], last: int) -> tuple:
            cost, parts, end = fold.finish()
            return conv, *sums, cost, last, end, [dict(zip(("first", "start", "state", "edits"), part, strict=True)) for part in parts]

        made = pa.schema([("conv", conv_type), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "last")],
                          ("end", pa.string()),
                          ("chunks", pa.list_(pa.struct([("first", pa.int64()), ("start", pa.int32()), ("state", pa.int32()),
                                                     ("edits", pa.string())])))])
        yield from _batches(rows(), made, 500)

    return chunks.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "first").mapInArrow(run, schema)


def audit_text(found: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit)."""
    whole = F.concat(F.array_join(F.transform("chunks", lambda c: c["edits"]), ""), "end")
    return found.select("conv", "blank", "duplicate", "truncated", "illegal", "cost", whole.alias("audit"))


def edited_turns(found: DataFrame) -> DataFrame:
    """(conv, at, sub, edit, role): what becomes of each turn; inserted turns stand before the turn at ``at``, or after the last one."""
    schema = _fields(found, "at bigint, sub int, edit string, role string")
    parts = found.select("conv", F.posexplode("chunks").alias("k", "part"), "end", "last", F.size("chunks").alias("n"))
    ends = F.when(F.col("k") + 1 == F.col("n"), F.col("end")).otherwise("")
    parts = parts.select("conv", "part.first", "part.start", "part.state", "part.edits", ends.alias("end"), "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.schema([("conv", batch.schema.field(0).type), ("at", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()),
                              ("role", pa.string())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for conv, first, start, after, edits, end, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    at, sub, state = first, 0, start
                    moves = len(edits) - edits.count("D")
                    # Without a system turn the states would follow each other; where they end elsewhere, one was kept.
                    led = start == EMPTY and moves > 0 and after != (USER if moves % 2 else ASSISTANT)
                    for edit in edits:
                        if edit != "D":
                            state = SYSTEM if led and state == EMPTY else NEXT[state]
                        yield conv, at, sub, edit, None if edit in "KD" else ROLES[state]
                        at, sub = (at, sub + 1) if edit == "I" else (at + 1, 0)
                    for sub, edit in enumerate(end, 3):
                        state = NEXT[state]
                        yield conv, last, sub, edit, ROLES[state]

            yield from _batches(rows(), made)

    return parts.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, placed: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, at, sub, edit, role, text): the turns of the repaired conversations, in the order of ``at`` and ``sub``.

    Only the texts of turns that stay are fetched; a turn that stays is the first with its role and text.
    """
    edits = edited_turns(found).filter("edit <> 'D'")
    keys = placed.select(F.col("at").alias("p_at"), F.col("turn"), F.col("role").alias("p_role"), F.col("sign"))
    stay = edits.join(keys, (F.col("at") == F.col("p_at")) & (F.col("edit") != "I"), "left")
    texts = (_signed(turns).groupBy(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn"), F.col("role").alias("t_role"),
                                    F.col("sign").alias("t_sign")).agg(F.max("text").alias("text")))
    same = (F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn"))
            & (F.col("p_role") == F.col("t_role")) & (F.col("sign") == F.col("t_sign")))
    return stay.join(texts, same, "left").select(
        "conv", "at", "sub", "edit", F.coalesce("role", "p_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, digest): SHA-256 of the lines ``role:text`` of each conversation, joined by line feeds.

    The lines of a conversation pass through one task in order, as the hash demands, and none is held.
    """
    schema = _fields(repaired, "digest string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.Schema] = []

        def rows() -> Iterator[tuple]:
            key, digest = None, None
            for batch in batches:
                made[:] = [pa.schema([("conv", batch.schema.field(0).type), ("digest", pa.string())])]
                for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if digest is not None and conv == key:
                        digest.update(b"\n")
                    else:
                        if digest is not None:
                            yield key, digest.hexdigest()
                        key, digest = conv, hashlib.sha256()
                    digest.update(line.encode())
            if digest is not None:
                yield key, digest.hexdigest()

        found = rows()
        head = next(found, None)
        if head is not None:
            yield from _batches((row for part in ([head], found) for row in part), made[0])

    lines = repaired.select("conv", F.concat_ws(":", "role", "text").alias("line"), "at", "sub")
    return lines.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at", "sub").select("conv", "line").mapInArrow(run, schema)


def repair_report(turns: DataFrame, damaged: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation of ``turns``: what is wrong with its ``damaged`` rows, the cost and audit of its repair, and the digest of the result."""
    placed = placed_turns(damaged)
    found = stored(audits(placed))
    spans = placed.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    repaired = digests(repaired_turns(damaged, placed, found))
    out = turns.select(turns[conv_id].alias("id")).distinct()
    for side in (spans, audit_text(found), repaired):
        side = side.withColumnRenamed("conv", "c")
        out = out.join(side, F.col("id").eqNullSafe(F.col("c")), "left").drop("c")
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return out.select(F.col("id").alias(conv_id), *[count(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
