import hashlib
import random
import zlib

import pytest

from traceaudit.llm import conversations as c
from traceaudit.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, at long"
WS = " \t\n\x0b\x0c\r"


def broken(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        case = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else "".join(x for x in text if x not in ".!?") if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WS)
        out.append(c.BLANK if not bare else c.DUPLICATE if (role, text) in seen else c.FINE if bare[-1] in ".!?" else c.CUT_SHORT)
        seen.add((role, text))
    return out


def exhaustive(turns, limit):
    """All edit lists of at most ``limit`` cost; the cheapest, then the first."""
    best = [(limit + 1, "")]

    def go(i, state, cost, edits, inserts):
        if cost > best[0][0]:
            return
        if i == len(turns) and state in (c.EMPTY, c.ASSISTANT):
            best[0] = min(best[0], (cost, edits))
        if inserts < 2:
            go(i, c.NEXT[state], cost + c.INSERT, edits + "I", inserts + 1)
        if i < len(turns):
            initial, fault = turns[i]
            go(i + 1, state, cost + c.DELETE, edits + "D", 0)
            if fault not in (c.BLANK, c.DUPLICATE):
                extra = c.TRUNCATED if fault == c.CUT_SHORT else 0
                follows = c.NEXT[state]
                if initial == "s" and state == c.EMPTY:
                    go(i + 1, c.SYSTEM, cost + extra, edits + "K", 0)
                if initial == c.ROLES[follows][0]:
                    go(i + 1, follows, cost + extra, edits + "K", 0)
                go(i + 1, follows, cost + c.RENAME + extra, edits + "R", 0)

    go(0, c.EMPTY, 0, "", 0)
    return best[0]


def folded(turns, sizes):
    """The library's answer with the turns cut into chunks of the given sizes."""
    fold, at = c.Fold(), 0
    for size in sizes:
        if turns[at:at + size]:
            fold.chunk(at, c.solve(turns[at:at + size]))
        at += size
    cost, parts, end = fold.finish()
    return cost, "".join(p[3] for p in parts) + end


def some_turns(draw, n):
    return [(draw.choice("suaauat"), draw.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_all_short_lists_against_every_edit_list():
    draw = random.Random(1)
    for _ in range(400):
        turns = some_turns(draw, draw.randint(0, 5))
        want = exhaustive(turns, 3 * len(turns))
        assert folded(turns, [len(turns)]) == want, turns
        assert folded(turns, [1] * len(turns)) == want
        assert folded(turns, [2, 1, 2]) == want


def test_chunks_do_not_matter():
    draw = random.Random(2)
    for _ in range(40):
        turns = some_turns(draw, 120)
        whole = folded(turns, [120])
        for _ in range(3):
            sizes = [draw.randint(1, 40) for _ in range(120)]
            assert folded(turns, sizes) == whole


def test_colliding_hashes_are_seen_through(monkeypatch):
    draw = random.Random(4)
    cases = [some_turns(draw, 25) for _ in range(60)]
    right = [folded(t, [25]) for t in cases]
    monkeypatch.setattr(c, "PRIME", 3)                     # nearly all lists collide
    assert [folded(t, [25]) for t in cases] == right


def test_order_of_linked_lists():
    draw = random.Random(6)
    lists = c.Audits()
    nodes = [0]
    for _ in range(600):
        nodes.append(lists.add(draw.choice(nodes[-40:]), draw.choice("DIK")))
    for _ in range(3000):
        a, b = draw.choice(nodes), draw.choice(nodes)
        assert lists.less(a, b) == (lists.text(a) < lists.text(b)) or lists.text(a) == lists.text(b)


def expected(rows):
    """The contract's columns for one conversation's damaged rows, edits taken from the exhaustive or the folded search."""
    rows = ordered(rows)
    kinds = faults(rows)
    turns = [(r[2][:1], k) for r, k in zip(rows, kinds, strict=True)]
    cost, audit = exhaustive(turns, 3 * len(turns)) if len(turns) < 6 else folded(turns, [len(turns)])
    numbers = [r[1] for r in rows if r[1] is not None]
    lines, state, left = [], c.EMPTY, iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        state = c.SYSTEM if edit == "K" and state == c.EMPTY and row[2][:1] == "s" else c.NEXT[state]
        lines.append(f"{row[2] if edit == 'K' else c.ROLES[state]}:{row[3] if row else ''}")
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[kinds.count(k) for k in (1, 2, 3)],
            sum(a[2][:1] + b[2][:1] not in c.LEGAL for a, b in zip(rows[:-1], rows[1:], strict=True)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def report(spark, rows):
    turns = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    got = c.repair_report(turns, c.damage(turns))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == {r[0] for r in rows}
    return found


@pytest.mark.parametrize("bits", [11, 1])
def test_odd_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(c, "CHUNK_BITS", bits)
    draw = random.Random(9)
    words = ["Yes.", "no", "", None, " \n", "What?", "é!", "same. ", "same. ", "..", "x" * 50_000 + "."]
    rows = [(draw.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), draw.choice([None, 0, 1, 2, 3, 4, 7]), draw.choice(["system", "user", "assistant", "tool", None, ""]),
             draw.choice(words)) for _ in range(70)]
    rows += [(20, 5, "user", "Hi.")] * 7 + [(21, None, "assistant", "All null.")] * 2 + [(22, t, "user", "Again.") for t in range(9)]
    rows += [(23, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(40)]
    gone = next(i for i in range(100, 200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    found = report(spark, rows)
    for conv in found:
        assert found[conv] == expected(broken([r for r in rows if r[0] == conv])), conv
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert c.repair_report(turns, c.damage(turns)).count() == 0


def test_one_conversation_of_many_chunks(spark, monkeypatch):
    """A third of all rows in one conversation is solved in pieces."""
    monkeypatch.setattr(c, "CHUNK_BITS", 4)
    draw = random.Random(11)
    rows = [(1, t, draw.choice(["user", "assistant", "system"]), draw.choice(["One.", "two", f"Turn {t}.", ""])) for t in range(400)]
    rows += [(2 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(800)]
    found = report(spark, rows)
    turns = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    chunks = c.solved_chunks(c.placed_turns(c.damage(turns))).filter("conv = 1")
    assert chunks.count() >= 400 // 2 ** 4 and chunks.selectExpr("max(last - first)").first()[0] < 2 ** 4
    for conv in (1, 2, 3, 50, 101, 201):
        assert found[conv] == expected(broken([r for r in rows if r[0] == conv]))


def test_all_conversations_of_a_folder(spark):
    from traceaudit.llm.queries import op13_conversation_repair
    given = {}
    for r in table(spark, "/root/testdata/sf0.001", "conversations").collect():
        given.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    found = op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == {conv: expected(broken(rows)) for conv, rows in given.items()}
