import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceaudit.llm import fim
from traceaudit.llm.common import table


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def expected(doc_id, text):
    """The contract by plain string work, and the rebuilt text."""
    text = text or ""
    units, digest = lines(text), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(1, 3000))
def test_every_boundary_is_exact_and_no_residual_exceeds_the_error(lengths, error):
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    index = fim.fit_index(offsets, error)
    residuals = np.frombuffer(index["residuals"], dtype=">u2").astype(int) - fim.HALF
    assert np.abs(residuals).max() <= error + 1
    for rank, offset in enumerate(offsets):
        k = int(np.searchsorted(index["ranks"], rank, "right")) - 1
        predicted = index["bases"][k] + int(np.floor(index["slopes"][k] * float(rank - index["ranks"][k])))
        assert predicted + residuals[rank] == offset


def test_even_lines_are_one_segment():
    assert len(fim.fit_index(np.arange(0, 50_000_00, 50))["ranks"]) == 1


def test_boundaries_are_counted_in_code_points():
    texts = ["aé\n\n中文😀\nx", None, "", "\n", "ab\n"]
    assert [o.tolist() for o in fim.boundary_offsets(pa.array(texts))] == [[0, 3, 4, 8, 9], [0], [0], [0, 1], [0, 3]]


def test_offsets_from_a_stored_index_match_in_columns(spark):
    text = "".join("é" * (i * 37 % 211) + "\n" for i in range(3000))
    ends = np.cumsum([len(x) for x in lines(text)]).tolist()
    rows = spark.createDataFrame([(text,)], "text string").select(fim.boundary_index(F.col("text"), 50).alias("index"))
    spots = [0, 1, 2, 777, 1500, 2999, 3000]
    got = rows.select(F.size("index.ranks").alias("s"), *[fim.offset_of(F.col("index"), F.lit(r)).alias(str(r)) for r in spots]).first()
    assert list(got)[1:] == [([0, *ends])[r] for r in spots] and got["s"] > 1


ODD = [(1, "a\nb\nc\n"), (2, None), (3, ""), (None, "null id\nhere"), (4, "no line end"), (4, "no line end"), (5, "\n\n\n"),
       (6, "has <P> in it\n"), (7, "x<S"), (8, "中文\n😀é\n" * 50), (9, "<\n<P\n<S\n<M\n>\nP>\n"), (10, "w\n" * 200_000), (11, "y" * 300_000), (12, "a\r\nb\r\n")]


def test_odd_documents_and_their_way_back(spark, corpus):
    made = fim.fill_in_middle(corpus(ODD).withColumn("body", F.lit(1)).withColumn("form", F.lit("x")).withColumn("output", F.lit(0)))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:6] for r in rows], key=key) == sorted([(i, *expected(i, t)) for i, t in ODD], key=key)
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in ODD)


def test_empty_table_and_rates(spark, corpus):
    assert fim.fill_in_middle(corpus([])).count() == 0
    docs = corpus([(i, f"a{i}\nb\nc\n") for i in range(300)])
    forms = {r["form"]: r["count"] for r in fim.fill_in_middle(docs, rate=40, spm_rate=0).groupBy("form").count().collect()}
    assert forms.keys() == {"plain", "psm"} and 60 < forms["psm"] < 180


def test_an_error_beyond_two_bytes_is_refused():
    with pytest.raises(ValueError):
        fim.boundary_index(None, 40_000)


def test_all_documents_of_a_folder(spark):
    from traceaudit.llm.queries import op11_fill_in_middle
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect():
        n, form, prefix, middle, output = expected(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
