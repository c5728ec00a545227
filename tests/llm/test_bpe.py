import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceaudit.llm import bpe
from traceaudit.llm.common import table

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def ours(definition):
    return bpe.ByteBpe(definition)


@pytest.fixture(scope="module")
def library(definition):
    return Tokenizer.from_str(definition)


def same(ours, library, texts):
    packed = list(ours.encode(pa.array(texts, type=pa.string())))
    assert len(packed) == len(texts)
    for text, ids, known in zip(texts, packed, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == known.ids, text
        assert ours.decode(ids) == library.decode(known.ids, skip_special_tokens=False)


PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'sto", "re", "ll", "12", "!", "...", "\x01", "　", " ", "\xa0", "é", "ß",
         "中", "の", "😀", "<|endoftext|>", "<|endof", "text|>", "\x85", "​", "﻿", "\r\n", "-", "́", "½", "²", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=8))
def test_awkward_neighbours(ours, library, texts):
    same(ours, library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(ours, library, texts):
    same(ours, library, texts)


def test_every_pair_of_ascii_characters_between_words(ours, library):
    same(ours, library, [f"ab{chr(x)}{chr(y)}cd {chr(x)}{chr(x)}{chr(y)}" for x in range(128) for y in range(128)])


def test_windows_and_long_runs(ours, library, monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choice(PARTS) for _ in range(20_000))
    for window in (16, 100, 4096):
        monkeypatch.setattr(bpe, "WINDOW", window)
        same(ours, library, [text, None, "", "x" * 3000, " " * 3000 + "x", "<|endoftext|>" * 40, "ab" * 1500 + "'s"])


def test_a_special_token_across_two_texts_is_none(ours, library):
    same(ours, library, ["a<|endof", "text|>b", "<|endoftext|>", "text|><|endoftext|>"])


def test_both_merges_agree(ours):
    draw = random.Random(5)
    for _ in range(300):
        piece = [ours.number[b] for b in "".join(draw.choice("etaoin ths") for _ in range(draw.randint(0, 23))).encode()]
        assert ours.merge(list(piece)) == ours._merge_long(list(piece))


def test_memory_of_fragments_is_bounded(definition, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    small = bpe.ByteBpe(definition)
    same(small, library, ["many different words are here and each of them is one fragment of this text"])
    assert len(small.known) <= 10


def test_cuts_do_cut(ours):
    """The method works only if most words stand alone."""
    data = np.frombuffer(b"These are plain words, and 42 numbers; all of them apart.", dtype=np.uint8)
    assert len(ours.cuts(data)) >= 12


def test_other_kinds_of_vocabulary_are_refused():
    with open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8") as file, pytest.raises(ValueError):
        bpe.ByteBpe(file.read())


def test_columns_with_odd_rows(spark, corpus, library):
    rows = [(1, "plain text"), (1, "plain text"), (None, "x"), (2, None), (3, ""), (4, "é" * 100_000), (5, "a b " * 100_000)]
    codec = bpe.Codec(spark, PATH)
    made = codec.encode(corpus(rows).withColumn("ids", F.lit("taken")).withColumn("id", F.lit(1)))
    assert made.columns == ["doc_id", "ids"]
    got = sorted((r["doc_id"] or 0, r["back"], r["ids"]) for r in made.withColumn("back", codec.decode(F.col("ids"))).collect())
    assert [r[:2] for r in got] == sorted((i or 0, t or "") for i, t in rows)
    assert all(np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids for _, text, ids in got)
    assert codec.encode(corpus([])).count() == 0


def test_all_documents_of_a_folder(spark, library):
    from traceaudit.llm.queries import op12_byte_bpe
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in op12_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
