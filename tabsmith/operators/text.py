"""TF-IDF over whole documents.

Tokens are runs of two or more letters, digits or underscores of the lower-cased text;
n-grams join consecutive tokens with a space. The vocabulary is the ``max_features`` terms
with the largest corpus count (ties by term), ordered alphabetically. Weights are
raw count x smooth idf (ln((1 + N) / (1 + df)) + 1), L2-normalised per document over the
vocabulary terms.

Every document is processed whole. Corpus counts are a pre-aggregated ``groupBy(term)``, the vocabulary
a top-k of them (at most 200 terms); only its occurrences are then counted by a ``groupBy(doc, term)``
and, for the document frequencies, a ``groupBy(term)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import q

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text_col) -> "F.Column":
    return F.regexp_extract_all(F.lower(F.coalesce(text_col.cast("string"), F.lit(""))), F.lit(TOKEN_PATTERN), 0)


#: Frequent words that are told apart in a projection at most.
MOST_WORDS = 2_000


def top_terms(df: DataFrame, text: str, max_features: int = 50, ngram_max: int = 1) -> list[str]:
    """The ``max_features`` n-grams with the largest counts, ties by term: at most 200.

    No n-gram is more frequent than its words. So only n-grams all of whose words are at least as frequent as the
    last of the ``max_features`` most frequent words can be among them, and no others are counted. Where ties make
    these words many, all n-grams are counted."""
    most, n = max(5, min(int(max_features), 200)), max(1, min(int(ngram_max), 3))

    def counted(longest: int, wanted: int, words: list[str] | None = None) -> list:
        found = _with_grams(df, text, longest, words).select(F.explode("__g").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
        return found.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(wanted).collect()

    words = counted(1, most if n == 1 else MOST_WORDS)
    if n > 1:
        least = words[most - 1]["cf"] if len(words) >= most else 0
        kept = [r["term"] for r in words if r["cf"] >= least]
        return [r["term"] for r in counted(n, most, kept if len(kept) < MOST_WORDS else None)]
    return [r["term"] for r in words]


def tfidf_long(df: DataFrame, text: str, key: Sequence[str], max_features: int = 50, ngram_max: int = 1) -> DataFrame:
    """Long TF-IDF: (key..., term, j, weight) for the non-zero vocabulary entries. Only occurrences of the
    vocabulary's terms, by their number, leave a document."""
    key = list(key)
    vocab = sorted(top_terms(df, text, max_features, ngram_max))
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    names = df.sparkSession.createDataFrame([(t, j) for j, t in enumerate(vocab)], "term string, j int")  # at most 200
    grams = _with_grams(df, text, ngram_max, _words(vocab)).select(*[q(k) for k in key], F.explode("__g").alias("term"))
    tf = grams.where(F.col("term").isin(vocab)).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    seen = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf as the join does, so that it is counted once
    w = tf.join(F.broadcast(names.join(seen, "term")), "term").withColumn(
        "raw", F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1))
    # a document has at most max_features vocabulary rows, so the per-document window is bounded
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*key)))
    return w.select(*key, "term", "j", (F.col("raw") / norm).alias("weight"))


def vocabulary(df: DataFrame, text: str, max_features: int = 50, ngram_max: int = 1) -> list[tuple[str, float]]:
    """(term, smooth idf) of the ``max_features`` terms with the largest counts, in order of the term:
    at most 200 rows reach the driver."""
    top = top_terms(df, text, max_features, ngram_max)
    if not top:
        return []
    one_each = _with_grams(df, text, ngram_max, _words(top)).select(F.explode(F.array_distinct("__g")).alias("term")).where(F.col("term").isin(top))
    found = {r["term"]: r["n"] for r in one_each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = df.agg(F.count(F.lit(1))).first()[0]
    return sorted((t, math.log((1 + n) / (1 + found[t])) + 1) for t in top)


def _words(terms: Sequence[str]) -> list[str]:
    return sorted({w for t in terms for w in t.split(" ")})


def _with_grams(df: DataFrame, text: str, ngram_max: int, words: Sequence[str] | None = None) -> DataFrame:
    """The rows with ``__g``, all n-grams (n = 1..ngram_max) of the text as an array; with ``words``, those of these
    words only. Tokens have a projection of their own, so that they are found once."""
    t = tokens(q(text))
    if words is not None:
        t = F.transform(t, lambda x: F.when(x.isin(list(words)), x))
    return df.withColumn("__t", t).withColumn("__g", _grams(F.col("__t"), ngram_max, words is not None)).drop("__t")


def _grams(t, ngram_max: int, gaps: bool):
    """All n-grams of an array of tokens; with ``gaps``, those without a null."""
    out = [t]
    for n in range(2, max(1, min(int(ngram_max), 3)) + 1):
        at = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(F.arrays_zip(at.alias("i"), *[F.slice(t, k + 1, F.greatest(F.size(t) - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)]),
                               lambda x: F.concat(*[y for k in range(n) for y in ([F.lit(" ")] if k else []) + [x[f"w{k}"]]])))
    every = F.concat(*out)
    return F.filter(every, lambda x: x.isNotNull()) if gaps else every


def tfidf_wide(df: DataFrame, text: str, max_features: int = 50, ngram_max: int = 1, fit_df: DataFrame | None = None) -> DataFrame:
    """Wide TF-IDF appended to ``df``: ``tfidf_{text}_{j}`` for j over the vocabulary of ``fit_df``
    (default: ``df``). The counts of a row's terms are taken in one projection: no key, no shuffle,
    and streams work with a static ``fit_df``. Rows without any vocabulary term get zeros."""
    vocab = vocabulary(df if fit_df is None else fit_df, text, max_features, ngram_max)
    if not vocab:
        return df
    terms_ = F.array(*[F.lit(t) for t, _ in vocab])
    # the row's terms that are in the vocabulary, then one count for each of them
    kept = _with_grams(df, text, ngram_max, _words([t for t, _ in vocab])).withColumn("__g", F.filter("__g", lambda x: F.array_contains(terms_, x)))
    equals = lambda t: lambda x: x == F.lit(t)  # noqa: E731 - one argument, as a second one would be the index
    raw = F.array(*[F.size(F.filter("__g", equals(t))) * F.lit(idf) for t, idf in vocab])
    kept = kept.withColumn("__w", raw)
    kept = kept.withColumn("__n", F.sqrt(F.aggregate("__w", F.lit(0.0), lambda a, x: a + x * x)))
    cols = {f"tfidf_{text}_{j}": F.when(F.col("__n") > 0, F.get("__w", F.lit(j)) / F.col("__n")).otherwise(F.lit(0.0)) for j in range(len(vocab))}
    return kept.withColumns(cols).drop("__g", "__w", "__n")
