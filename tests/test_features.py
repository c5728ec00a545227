"""Quality numbers, cleaned texts, node features and signatures on small cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceaudit.functions import jsontext as J
from traceaudit.functions import quality as Q
from traceaudit.functions.stems import ERROR_STEMS, PREFIXES, has_error_stems, porter_stem
from traceaudit.functions.text import clean_text, lines_of, natural_key, normal_trace_name
from traceaudit.operators import features, signatures


def column(spark, values, make, kind="string"):
    """Values of ``make(t)`` in the order of ``values``."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


# Published examples of the stemming algorithm.
STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
         "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file",
         "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper",
         "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust",
         "adoption": "adopt", "controlling": "control", "rate": "rate", "probate": "probat", "cease": "ceas", "roll": "roll"}


def test_porter():
    assert {w: porter_stem(w) for w in STEMS} == STEMS
    assert all(any(s.startswith(p) for p in PREFIXES) for s in ERROR_STEMS if " " not in s)


def test_error_words(spark):
    texts = ["an Error!", "failing", "it errs", "exceptional", "unability", "cannot", "could not", "", "fine", "invalidé"]
    assert column(spark, texts, has_error_stems) == [True, True, False, True, True, True, False, False, False, False]


JSON_TEXTS = ['{"a": 1}', '{"a":1} xx', "[1, 2]", "3", '"s"', "", "  ", "{", '{"a": 1}{"b": 2}', "1, 2", "null", ' {"a": 1} ', "1], [2"]


def test_strict_parse_matches_python(spark):
    def ok(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False
    assert column(spark, JSON_TEXTS, lambda t: J.strict_parse(t).isNotNull()) == [ok(t) for t in JSON_TEXTS]
    assert column(spark, JSON_TEXTS, lambda t: J.is_object(J.strict_parse(t))) == [
        ok(t) and isinstance(json.loads(t), dict) for t in JSON_TEXTS]


def test_loose_parse(spark):
    texts = ['{"a": 1}', 'see ```json\n{"a": 1}\n``` end', 'then {"a": 1}', "list [1, 2]", "none", '{"a": 1} tail', "```\n[1]\n```"]
    assert column(spark, texts, lambda t: J.loose_parse(t).isNotNull()) == [True, True, True, True, False, False, True]


def test_formats(spark):
    texts = ['{"a": 1}', "{not json", "x ```py\ny``` z", "def f():\n  pass", "from here", "plain", "a    b", "[1]"]
    assert column(spark, texts, Q.output_format) == ["json", "text", "markdown", "code", "code", "text", "code", "json"]
    prompts = ["", None, "Return JSON now", "output as json", "Please write a function", "say hi", "response\njson", "IMPLEMENT it"]
    assert column(spark, prompts, Q.expected_format) == [None, None, "json", "json", "code", "text", "text", "code"]


def test_truncation(spark):
    texts = ["wait...", "more…", "Done.", "no end here at all my friend", '{"a": [1, 2}', '{"a": 1}', "x" * 10_001 + ".", "```\ncode\n```", "short", "ends with ] here"]
    assert column(spark, texts, Q.is_truncated) == [True, True, False, True, True, False, True, False, True, False]


def test_lengths_and_wellformed(spark):
    texts = ['{"a":1,"b":"é"}', "def f():\n    return 1", "plain"]
    want = [len(json.dumps(json.loads(texts[0]))), 2, 5]
    assert column(spark, texts, lambda t: Q.output_length(t, Q.output_format(t)).cast("int")) == want
    code = ["x = 1", "x = = 1", "```python\nx = 1\n```", "```\nx = = 1\n```"]
    assert column(spark, code, lambda t: Q.well_formed(t, F.lit("code"))) == [True, False, True, False]
    plain = ["0123456789", "0123456789a", "   short    "]
    assert column(spark, plain, lambda t: Q.well_formed(t, F.lit("text"))) == [False, True, False]
    assert column(spark, plain, lambda t: Q.well_formed(t, F.lit(None).cast("string"))) == [True, True, True]


def test_empty_output_is_all_zero(spark):
    rows = spark.createDataFrame([("", "return json"), (None, "x")], "output_text string, system_prompt string")
    for r in features.validity_features(rows).collect():
        assert [r[n] for n in Q.VALIDITY_NAMES] == [0.0] * 5


def test_structure(spark):
    objects = [
        {"action": "Other", "subtask_list": [1, 2, 3], "apis": [{"score": 0.5}, {"relevance_score": None, "score": 9}, "x", {"score": "0.7"}], "python_code": "", "subtasks_progress": []},
        {"action": "", "subtasks": None, "subtask_list": [1], "code": 0, "relevant_apis": {}},
        {"action": ["CoderAgent"], "code": {"k": 1}, "subtasks_progress": ["completed", 1, "completed", None]},
        [1, 2], "CoderAgent",
    ]
    rows = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)] + [(9, "not json"), (10, None)], "i int, output_any string")
    got = {r.i: [round(r[n], 6) for n in Q.STRUCTURAL_NAMES] for r in features.structural_features(rows).collect()}
    ln = lambda x: round(math.log1p(x), 6)
    assert got[0] == [0, 0, 0, 1, ln(3), 1, 1, 0.6, 0, 0, 0, ln(5)]
    assert got[1] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, ln(5)]
    assert got[2] == [0, 0, 0, 1, 0, 0, 0, 0, 1, 0.5, 0, ln(3)]
    assert got[3] == got[4] == got[9] == got[10] == [0] * 12


def test_clean_texts(spark):
    tasks = ['{"task": ["a", 1], "goal": null}', '{"zz": "é", "y": 1}', "a \n  b", "[1,  2]", "```\nnot json\n```", "x " * 4000, ""]
    want = ["['a', 1] None", '{"zz": "\\u00e9", "y": 1}', "a b", "[1, 2]", "not json", ("x " * 4000)[:5000] + "...", ""]
    assert column(spark, tasks, features.clean_task) == want
    answers = ['{"thoughts": "t", "result": 5, "answer": ["l"]}', '{"k": true}', "say ```py\nx  = 1\n``` ok", "return 5", "[1,2]"]
    assert column(spark, answers, features.clean_answer) == ["t ['l']", '{"k": true}', "x = 1", "return 5", "[1,2]"]


def test_lines_like_python(spark):
    texts = ["a\nb", "a\n", "\n", "", "a\r\nb\rc", "x\x0by\x0cz\x1cq\x85w" + chr(0x2028) + "e" + chr(0x2029), "a\n\nb\n\n"]
    assert column(spark, texts, lines_of) == [t.splitlines() for t in texts]


def test_small_text_functions(spark):
    assert column(spark, ["a\t\n b ", " x ", None], lambda t: clean_text(t, 3)) == ["a b", "x", ""]
    names = ["trace10.log", "trace2.log", "Trace2b.log", "trace1.log", "trace02.log"]
    assert [n for _, n in sorted(zip(column(spark, names, natural_key), names))][0] == "trace1.log"
    assert sorted(names[:2], key=dict(zip(names, column(spark, names, natural_key))).get) == ["trace2.log", "trace10.log"]
    assert column(spark, ["trace01.log", "trace9.log", "trace010.log"], normal_trace_name) == ["trace1.log", "trace9.log", "trace010.log"]


def test_common_features(spark):
    nodes = spark.createDataFrame([
        (1, 0, "0.3.2:Some:Agent", ["LLM_CALL"], "non_llm", -2.0), (1, 1, "plain", None, "llm_call", None), (1, 2, ":x", ["complex", "Tool_Call"], "non_llm", 1.5),
        (1, 3, "7:y", [], "other", 0.0), (2, 0, "0.x:z", [], "non_llm", 0.0), (3, 0, "a.1:z", [], "non_llm", 0.0)],
        "trace_id int, node_idx int, name string, tags array<string>, node_type string, duration double")
    def pick(df):
        return {(r.trace_id, r.node_idx): (r.name_suffix, r.duration_feature, r.node_type_id, r.hierarchy_depth, r.sibling_index, r.parent_index,
                                           r.is_llm_call, r.is_tool_call, r.is_complex) for r in df.collect()}
    got = pick(features.common_features(nodes))
    assert got[1, 0] == ("Some:Agent", -1.0, 1, 3, 2, 3, 1.0, 0.0, 0.0)
    assert got[1, 1] == ("plain", -1.0, 0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert got[1, 2] == ("x", 1.5, 1, 0, 0, 0, 0.0, 1.0, 1.0)
    assert got[1, 3][3:6] == (1, 7, 0)
    assert got[2, 0][4] is None
    assert {t for t, _ in pick(features.common_features(nodes, "drop_trace"))} == {1}


def test_call_texts_fallbacks(spark):
    nodes = spark.createDataFrame([
        ({"gen_ai.prompt.0.content": "s", "gen_ai.prompt.1.content": "u"}, {"gen_ai.completion.0.content": "o"}, {"num_input_tokens": "4", "num_output_tokens": "6"}),
        ({"gen_ai.prompt.3.role": "user", "gen_ai.prompt.3.content": "late"}, {"gen_ai.completion.1.content": "other"}, {}), ({}, {}, {})],
        "input map<string,string>, output map<string,string>, attributes map<string,string>")
    rows = features.token_features(features.call_texts(nodes)).collect()
    assert [(r.system_prompt, r.user_input, r.output_text, r.output_any, r.input_tokens, r.output_tokens, r.token_ratio) for r in rows] == [
        ("s", "u", "o", "o", 4, 6, 1.5), ("", "late", None, "other", 0, 0, 0.0), ("", None, None, None, 0, 0, 0.0)]


def test_embeddings(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r.e for r in features.embed_texts(rows, "t", "e", 16).collect()]
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-6 and not any(got[1]) and not any(got[2])
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [float(len(t))] * 4)
    assert [r.e for r in features.embed_texts(rows, "t", "e", 4, lengths).collect()] == [[5.0] * 4, [0.0] * 4, [0.0] * 4]


def tfidf(texts, stops, limit, share):
    """Brute-force weights with NumPy."""
    import re
    docs = []
    for t in texts:
        ws = [w for w in re.findall(r"\b[a-zA-Z]{3,}\b", t.lower()) if w not in stops]
        docs.append(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])
    terms = sorted({w for d in docs for w in d})
    tf = np.array([[d.count(w) for w in terms] for d in docs], float)
    df = (tf > 0).sum(axis=0)
    keep = sorted([i for i in range(len(terms)) if df[i] <= share * len(docs)], key=lambda i: (-tf[:, i].sum(), terms[i]))[:limit]
    x = tf[:, keep] * (np.log((1 + len(docs)) / (1 + df[keep])) + 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return [terms[i] for i in keep], x / np.where(norm == 0, 1, norm)


TEXTS = ["plan the steps and check the plan", "write code to check steps", "été code plan steps", "answer questions with care and care", "xx", "check the code, check code again"]


def test_term_weights_and_signatures(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    lists = signatures.word_lists(docs, "id", "t", ["the", "and"])
    vocab = signatures.fixed_vocabulary(signatures.vocabulary(lists, 12, 0.6))
    names, x = tfidf(TEXTS, {"the", "and"}, 12, 0.6)
    assert [v["term"] for v in vocab] == names
    got = {(r.id, r.term): r.weight for r in signatures.term_weights(lists, "id", vocab).collect()}
    want = {(i, names[j]): x[i, j] for i in range(len(TEXTS)) for j in range(len(names)) if x[i, j]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    sig = {r.id: r.signature for r in signatures.text_signatures(docs, "id", "t", dim=8, max_features=12, max_df=0.6, stop_words=["the", "and"]).collect()}
    s = np.array([sig[i] for i in range(len(TEXTS))])
    assert np.allclose(s @ s.T, x @ x.T, atol=1e-6)      # rank is below eight, so all inner products survive
    assert not any(sig[4])
    top = [r.term for r in signatures.keywords(docs, "id", "t", 3, ["the", "and"], 12, 0.6).collect()]
    order = sorted(range(len(names)), key=lambda j: (-round(x[:, j].mean(), 12), names[j]))
    assert top == [names[j] for j in order[:3]]


def test_no_vocabulary_gives_zeros(spark):
    docs = spark.createDataFrame([(1, "same words"), (2, "same words")], "id int, t string")
    lists = signatures.word_lists(docs, "id", "t")
    assert not signatures.fixed_vocabulary(signatures.vocabulary(lists, 10, 0.5))
    assert [r.signature for r in signatures.text_signatures(docs, "id", "t", dim=4, max_df=0.5).collect()] == [[0.0] * 4] * 2
    assert signatures.keywords(docs, "id", "t", max_df=0.5).count() == 0
    assert signatures.term_weights(lists, "id", []).count() == 0


def test_character_signatures(spark):
    names = spark.createDataFrame([("PlanAgent",), ("PlannerAgent",), ("Zq",), ("",)], "name_suffix string")
    got = {r.name_suffix: np.array(r.name_embedding) for r in signatures.node_name_signatures(names).collect()}
    assert set(got) == {"PlanAgent", "PlannerAgent", "Zq"} and all(len(v) == 32 for v in got.values())
    assert got["PlanAgent"] @ got["PlannerAgent"] > 0.3 and abs(got["PlanAgent"] @ got["Zq"]) < 1e-9
    runs = column(spark, ["aB c"], signatures.char_terms)
    assert runs[0] == ["ab", "b ", " c", "ab ", "b c", "ab c"]


def test_assembled_vector_layout(spark):
    rows = spark.createDataFrame([(1, 0, None, "llm_call", "0.1:a", ["llm_call"], 2.0, "sys", "in", "out text here.", "out text here.", 10, 5),
                                  (1, 1, 0, "non_llm", "x", [], None, "", None, None, None, None, None)],
        "trace_id int, node_idx int, parent_idx int, node_type string, name string, tags array<string>, duration double, system_prompt string, "
        "user_input string, output_text string, output_any string, num_input_tokens bigint, num_output_tokens bigint")
    from traceaudit.functions.text import prompt_hash
    signed = rows.filter("node_idx = 0").select(prompt_hash(F.col("system_prompt")).alias("prompt_hash"), F.array_repeat(F.lit(0.25), 32).alias("signature"))
    got = {r.node_idx: r.features for r in features.assemble_features(rows, signed, dim=16).collect()}
    names = features.feature_names(16)
    assert len(names) == len(got[0]) == len(got[1]) == 32 + 32 + 20 + 40
    call = dict(zip(names, got[0]))
    assert call["role_sig_0"] == 0.25 and call["input_tokens"] == 10 and call["token_ratio"] == 0.5 and call["is_well_formed"] == 1
    assert call["duration"] == 2 and call["is_llm_call"] == 1 and call["hierarchy_depth"] == 2
    assert not any(got[1][:84]) and got[1][84] == -1.0 and got[1][85] == 1.0
    meta = features.feature_metadata(rows, 16).first()
    assert meta.total_dim == 124 and meta.traces == 1


@pytest.mark.parametrize("dim,width", [(384, 860), (768, 1628)])
def test_documented_widths(dim, width):
    assert len(features.feature_names(dim)) == width
