import zlib
from collections import Counter, defaultdict

from traceaudit.llm import sharding


def rows_of(n):
    rows = [(i, "x" * (i * 37 % 400), ["en", "de", None][i % 3], f"s{i % 4}" if i % 3 else "hot") for i in range(n)]
    return rows + [(n + i, "the same text", "en", "hot") for i in range(n // 2)] + [(None, None, None, None), (3, "", None, "é"), (3, "", None, "é")]


def check(rows, got, shards, tolerance):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= tolerance


def test_shards_are_even_and_slots_gapless(corpus):
    rows = rows_of(900)
    check(rows, sharding.shard_documents(corpus(rows), 40, slot_rows=7).collect(), 40, 1300)
    check(rows, sharding.shard_documents(corpus(rows), 5).collect(), 5, 1300)


def test_target_bytes_set_the_number(corpus):
    rows = rows_of(300)
    total = sum(len((t or "").encode()) + 16 for _, t, _, _ in rows)
    got = sharding.shard_documents(corpus(rows), target_bytes=total // 6).collect()
    assert max(r.shard for r in got) + 1 in (6, 7)


def test_copies_are_cut_apart(corpus):
    rows = [(i, "copy", "en", "a") for i in range(400)]
    sizes = Counter(r.shard for r in sharding.shard_documents(corpus(rows), 8).collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 4


def test_one_long_text_and_few_rows(corpus):
    rows = [(1, "y" * 300_000, "en", "a"), (2, "z", "en", "a")]
    got = sharding.shard_documents(corpus(rows), 40).collect()
    assert len(got) == 2 and all(r.slot == 0 or r.shard == got[0].shard for r in got)
    assert sharding.shard_documents(corpus([]), 40).count() == 0
