import hashlib
import re

from traceaudit.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == b[i:i + n]:
                    hit.update(range(j, j + n))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_against_brute_force(spark, corpus):
    items = [(1, PASSAGE), (2, PASSAGE.upper() + "!"), (10, "the the the"), (3, "Größe 42"), (4, ""), (5, None), (None, "unknown item words"),
             (6, " ".join(["the"] * 14)), (3, "Größe 42")]
    texts = [None, "", "nothing", PASSAGE, "x " * 400 + PASSAGE, "Alpha-beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu",
             "the the the the", "the " * 30, "a größe 42 b GRÖSSE 42 größe  42", "unknown item words here", PASSAGE + " " + PASSAGE,
             "mu nu xi alpha beta gamma", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron " + "y " * 100_000]
    docs = corpus([(i, t) for i, t in enumerate(texts)] + [(3, "other text"), (3, "other text"), (None, PASSAGE)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(docs, bench)
    want = [(i, *brute(t, items)) for i, t in enumerate(texts)] + [(3, *brute("other text", items))] * 2 + [(None, *brute(PASSAGE, items))]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)


def test_blocks_give_the_same(spark, corpus):
    docs = corpus([(1, "q " + PASSAGE), (2, "the cat sat"), (3, "none")])
    bench = spark.createDataFrame([(1, PASSAGE), (2, "cat sat"), (3, "the cat")], "item_id long, text string")
    one = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items")
    many = decontaminate.contamination(docs, bench, block_windows=1).select("doc_id", "n_words", "n_hit", "items")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_proximity(spark, corpus):
    docs = corpus([(1, "red green blue"), (2, "red very green blue"), (3, "red and then far away green")])
    bench = spark.createDataFrame([(1, "red green")], "item_id long, text string")
    ((index, windows),) = decontaminate.indexed(docs, bench)
    assert sorted(r["_id"] for r in decontaminate.phrase_matches(index, windows).collect()) == [1]
    assert {(r["_id"], abs(r["off"])) for r in decontaminate.proximity_matches(index, windows, 1).collect()} == {(1, 0), (2, 1)}


def test_empty_tables(spark, corpus):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination_report(corpus([(1, "a b")]), bench).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.contamination_report(corpus([]), bench).count() == 0
