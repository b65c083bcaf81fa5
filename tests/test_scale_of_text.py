"""The vocabulary is counted without all n-grams, and only its terms leave a document."""

from collections import Counter

import pytest

from tabsmith.operators import text as T

DOCS = [(i, " ".join(w for j, w in enumerate("aa bb cc dd ee ff gg hh aa bb aa cc".split()) if (i * 7 + j * j) % 5 != 1)) for i in range(30)] + [(30, None), (31, ""), (1, "aa bb")]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_top_terms_equal_plain_counts(spark, n, monkeypatch):
    d = spark.createDataFrame(DOCS, "id int, text string")
    counts = Counter(" ".join(x[i:i + k]) for _, t in DOCS for x in [(t or "").split()] for k in range(1, n + 1) for i in range(len(x) - k + 1))
    want = sorted(counts, key=lambda t: (-counts[t], t))[:6]
    assert T.top_terms(d, "text", 6, n) == want
    monkeypatch.setattr(T, "MOST_WORDS", 6)  # as many words as tie: all n-grams are counted
    assert T.top_terms(d, "text", 6, n) == want


def test_rare_ngrams_are_not_counted(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"{t or ''} rare{i} rarer{i}") for i, t in DOCS], "id int, text string")
    asked = []
    plain = T._with_grams
    monkeypatch.setattr(T, "_with_grams", lambda df, text, n, words=None: asked.append((n, words)) or plain(df, text, n, words))
    T.tfidf_long(d, "text", ["id"], 5, 2)
    told = [words for n, words in asked if n > 1]
    assert told and all(words and not any(w.startswith("rare") for w in words) for words in told)


def test_repeated_keys_are_one_document(spark):
    d = spark.createDataFrame(DOCS, "id int, text string")
    got = {(r["id"], r["term"]) for r in T.tfidf_long(d, "text", ["id"], 5, 1).collect()}
    assert len(got) == T.tfidf_long(d, "text", ["id"], 5, 1).count()
