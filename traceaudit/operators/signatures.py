"""Text signatures: term weights over distinct texts and their low-dimensional projection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.functions.text import let, prompt_hash
from traceaudit.session import cut_lineage


def distinct_prompts(rows: DataFrame, text: str) -> DataFrame:
    """Distinct non-empty texts with their hash."""
    used = rows.filter(F.coalesce(F.col(text), F.lit("")) != "").select(
        prompt_hash(F.col(text)).alias("prompt_hash"), F.col(text).alias("prompt"))
    # Stored: every pass over the texts (terms, matrix, weights) starts from the distinct ones.
    return cut_lineage(used.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt")))


def english_stop_words() -> list[str]:
    """Spark ML's English stop words."""
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def word_lists(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Terms per document, ``key, terms``: lower-case words of three or more Latin letters, and pairs of
    neighbours after stop-word removal.

    Spark ML's tokenizer, stop-word remover (a hash set) and n-gram maker work
    row by row in the JVM. Without ``stop_words`` its English list is used.
    """
    from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
    words = RegexTokenizer(inputCol="__text", outputCol="__all", pattern=r"(?U)\b[a-z]{3,}\b", gaps=False)
    drop = StopWordsRemover(inputCol="__all", outputCol="__words", caseSensitive=True,
                            stopWords=english_stop_words() if stop_words is None else list(stop_words))
    pairs = NGram(n=2, inputCol="__words", outputCol="__pairs")
    rows = words.transform(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")))
    return pairs.transform(drop.transform(rows)).select(key, F.concat("__words", "__pairs").alias("terms"))


def char_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Terms per document, ``key, terms``: its character runs."""
    return docs.select(key, char_terms(F.col(text)).alias("terms"))


def char_terms(text: Column, shortest: int = 2, longest: int = 4) -> Column:
    """All character runs of 2 to 4 characters of the lower-cased text with white space collapsed."""
    def of_length(t: Column, n: int) -> Column:
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1))
        runs = F.transform(starts, lambda i: F.substr(t, i, F.lit(n)))
        return F.coalesce(runs, F.array().cast("array<string>"))

    def all_runs(t: Column) -> Column:
        return F.concat(*[of_length(t, n) for n in range(shortest, longest + 1)])

    return let(F.regexp_replace(F.lower(text), r"(?U)\s\s+", " "), all_runs)


def vocabulary(lists: DataFrame, max_features: int = 500, max_df: float = 0.9) -> DataFrame:
    """The most frequent terms of ``terms`` lists with corpus count and document count.

    Terms in more than ``max_df`` of the documents are left out. Each document
    contributes its terms once for the corpus count and once, without repeats,
    for the document count; both are counted in one combinable aggregate, so no
    (document, term) shuffle is needed here.
    """
    t = lists.select("terms", F.array_distinct("terms").alias("once"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = F.concat(F.transform("terms", lambda x: F.struct(x.alias("term"), one.alias("tf"), none.alias("df"))),
                    F.transform("once", lambda x: F.struct(x.alias("term"), none.alias("tf"), one.alias("df"))))
    counts = t.select(F.inline(both)).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    n = lists.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = counts.withColumn("docs", n).filter(F.col("df") <= F.lit(max_df) * F.col("docs"))
    return kept.orderBy(F.desc("tf"), "term").limit(max_features)


# Terms that the sketch of one task tracks, and how many times as many candidates as wanted terms are counted again.
TRACKED, SPARE = 100_000, 4


def frequent_vocabulary(lists: DataFrame, max_features: int = 500, max_df: float = 0.9, tracked: int = TRACKED, spare: int = SPARE) -> DataFrame:
    """The same as :func:`vocabulary`, without a shuffle of all terms.

    A mergeable sketch per task finds candidates; they alone are counted again,
    exactly. A term that is no candidate occurs at most as often as the last
    candidate is estimated, or as the sketch can miss. If the last wanted term
    occurs more often than that, the result is proven; else more candidates are
    taken, and in the end all terms are counted.
    """
    room = 1
    while room < tracked / 0.75:
        room *= 2
    docs, wanted = lists.count(), max_features * spare
    every = lists.select(F.explode("terms").alias("term"))
    while wanted <= min(tracked, 10_000):
        seen = every.agg(F.expr(f"approx_top_k(term, {wanted}, {tracked})").alias("top"), F.count(F.lit(1)).alias("terms")).first()
        found = seen["top"] or []
        if not found:
            break
        missed = 3.5 * seen["terms"] / room                # the sketch's bound on what it does not tell
        bound = max(missed if missed >= 1 else 0, found[-1]["count"] if len(found) >= wanted else 0)
        counts = candidate_counts(lists, [r["item"] for r in found]).withColumn("docs", F.lit(docs).cast("bigint"))
        kept = cut_lineage(counts.filter(F.col("df") <= F.lit(max_df) * F.col("docs")).orderBy(F.desc("tf"), "term").limit(max_features))
        last = kept.agg(F.count(F.lit(1)), F.min("tf")).first()
        if bound < 1 or (last[0] == max_features and last[1] > bound):
            return kept.orderBy(F.desc("tf"), "term")
        wanted *= 4
    return vocabulary(lists, max_features, max_df)


def candidate_counts(lists: DataFrame, terms: list[str]) -> DataFrame:
    """term, tf, df (corpus count, document count) of some terms: each document's counts are made where it lies, and only these become rows."""
    from pyspark.ml.feature import CountVectorizerModel
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="__tf").transform(lists)
    # Bound once: named twice, the counts and the terms behind them would be made twice.
    pairs = let(F.unwrap_udt("__tf"), lambda v: F.arrays_zip(v["indices"].alias("idx"), v["values"].alias("n")))
    sparse = counted.select(F.inline(pairs))
    names = lists.sparkSession.createDataFrame(list(enumerate(terms)), "idx int, term string")
    sums = sparse.groupBy("idx").agg(F.sum(F.col("n").cast("bigint")).alias("tf"), F.count(F.lit(1)).alias("df"))
    return sums.join(F.broadcast(names), "idx").select("term", "tf", "df")                                   # one row a candidate


def fixed_vocabulary(vocab: DataFrame) -> list[dict]:
    """The vocabulary computed once, as at most ``max_features`` driver rows in its order."""
    return [r.asDict() for r in vocab.collect()]


def weight_vectors(lists: DataFrame, key: str, vocab: list[dict]) -> DataFrame:
    """Unit-length TF-IDF vector per document: ``key, weights`` (sparse ML vector in vocabulary order).

    idf is ln((1+N)/(1+df)) + 1. Counting, weighting and scaling happen row by
    row in the JVM; nothing is shuffled.
    """
    from math import log

    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    idf = Vectors.dense([log((1.0 + v["docs"]) / (1.0 + v["df"])) + 1.0 for v in vocab])
    counter = CountVectorizerModel.from_vocabulary([v["term"] for v in vocab], inputCol="terms", outputCol="__tf")
    weigh = ElementwiseProduct(scalingVec=idf, inputCol="__tf", outputCol="__raw")
    scale = Normalizer(inputCol="__raw", outputCol="weights", p=2.0)
    return scale.transform(weigh.transform(counter.transform(lists))).select(key, "weights")


def _entries(vectors: DataFrame, key: str) -> DataFrame:
    """Non-zero entries ``key, idx, weight`` of weight vectors."""
    from pyspark.ml.functions import vector_to_array
    numbered = F.transform(vector_to_array("weights"), lambda w, i: F.struct(i.alias("idx"), w.alias("weight")))
    return vectors.select(key, F.inline(F.filter(numbered, lambda p: p["weight"] != 0)))


def _per_term(spark: SparkSession, vocab: list[dict], values: list, kind: str) -> DataFrame:
    """Small table ``idx, term, value`` with one row per vocabulary term."""
    rows = [(i, v["term"], values[i]) for i, v in enumerate(vocab)]
    return spark.createDataFrame(rows, f"idx int, term string, value {kind}")


def term_weights(lists: DataFrame, key: str, vocab: list[dict]) -> DataFrame:
    """Unit-length TF-IDF weights in long form: ``key, term, weight`` (no rows for an empty vocabulary)."""
    if not vocab:
        return lists.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).filter(F.lit(False))
    names = _per_term(lists.sparkSession, vocab, [0] * len(vocab), "int")
    found = _entries(weight_vectors(lists, key, vocab), key)
    return found.join(F.broadcast(names), "idx").select(key, "term", "weight")   # one row per vocabulary term


def keywords(docs: DataFrame, key: str, text: str, top_n: int = 50, stop_words: Sequence[str] | None = None,
             max_features: int = 200, max_df: float = 0.8) -> DataFrame:
    """The terms with the largest mean weight over all documents (a top-n report)."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    lists = word_lists(docs, key, text, stop_words)
    vocab = fixed_vocabulary(frequent_vocabulary(lists, max_features, max_df))
    if not vocab:
        return docs.select(F.lit("").alias("term"), F.lit(0.0).alias("score")).filter(F.lit(False))
    mean = weight_vectors(lists, key, vocab).agg(Summarizer.mean(F.col("weights")).alias("m"))
    scores = mean.select(F.posexplode(vector_to_array("m")).alias("idx", "score"))
    names = _per_term(docs.sparkSession, vocab, [0] * len(vocab), "int")
    return scores.join(F.broadcast(names), "idx").select("term", "score").orderBy(
        F.desc(F.round("score", 12)), "term").limit(top_n)


def project(vectors: DataFrame, key: str, vocab: list[dict], dim: int = 32) -> DataFrame:
    """Truncated singular value decomposition of weight vectors: ``key, signature`` of length ``dim``.

    Spark's row matrix sums the term-by-term matrix in one pass (vocabulary
    squared, so a few megabytes at most); its eigenvectors are the right singular
    vectors, and the projection multiplies batches of rows by them where they
    lie. The entry of largest size in every vector is made positive. Missing
    dimensions are zero.
    """
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select("weights")), numCols=len(vocab))
    values, right = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
    keep = [i for i in np.argsort(values)[::-1][:dim] if values[i] > 1e-12 * values.max()]
    right = right[:, keep]
    right = right * np.where(right[np.abs(right).argmax(axis=0), range(right.shape[1])] < 0, -1.0, 1.0)
    padded = np.zeros((len(vocab), dim))
    padded[:, : right.shape[1]] = right

    def onto_basis(batches):
        for batch in batches:
            rows = np.stack(batch["weights"].to_numpy()) @ padded if len(batch) else np.zeros((0, dim))
            yield pd.DataFrame({key: batch[key], "signature": list(rows)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector_to_array("weights").alias("weights")).mapInPandas(onto_basis, f"`{key}` {kind}, signature array<double>")


def text_signatures(docs: DataFrame, key: str, text: str, analyzer: str = "word", dim: int = 32,
                    max_features: int | None = None, max_df: float | None = None,
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """Signature vectors of distinct texts.

    ``word`` uses words and word pairs (500 terms, at most in 90 % of the texts);
    ``char`` uses character runs (200 terms), for short names. Texts without a
    vocabulary term get zeros.
    """
    if analyzer == "word":
        lists = word_lists(docs, key, text, stop_words)
        limit, share = max_features or 500, 0.9 if max_df is None else max_df
    elif analyzer == "char":
        lists = char_lists(docs, key, text)
        limit, share = max_features or 200, 1.0 if max_df is None else max_df
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    vocab = fixed_vocabulary(vocabulary(lists, limit, share))
    zeros = F.array_repeat(F.lit(0.0), dim)
    if not vocab:
        return docs.select(key, zeros.alias("signature"))
    return project(weight_vectors(lists, key, vocab), key, vocab, dim)


def node_name_signatures(nodes: DataFrame, dim: int = 32) -> DataFrame:
    """Signatures of the distinct node names (without their prefixes): ``name_suffix, name_embedding``."""
    names = cut_lineage(nodes.filter(F.coalesce("name_suffix", F.lit("")) != "").select("name_suffix").distinct())
    return text_signatures(names, "name_suffix", "name_suffix", "char", dim).withColumnRenamed("signature", "name_embedding")
