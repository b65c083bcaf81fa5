"""Language model, language identification, embeddings and the pipeline: brute force, held-out
accuracy, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tabsmith.llm import katz, language_crf, vector_graph
from tests.conftest import SF_CHECK, SF_SMALL

DOCS = "doc_id long, text string"


def _katz(rows, rare):
    """(score, base) of each (held_out, text), by dictionaries."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"] for _, t in rows]
    count = Counter(w for (h, _), ws in zip(rows, words) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    common = {w for w in count if count[w] >= max(1, rare * n)}
    name = lambda w: w if w in common or w == "<s>" else "<rare>"
    pairs, history = Counter(), Counter()
    for (h, _), ws in zip(rows, words):
        if not h:
            for a, b in zip(["<s>", *ws], ws):
                history[name(a)] += 1
                if b in common:
                    pairs[name(a), b] += 1
    times = Counter(pairs.values())
    d = katz.good_turing(np.array([0.0, *(times[i] for i in range(1, 7))]))
    disc = lambda c: d[c] if c <= 5 else 1.0
    mass, lower = Counter(), Counter()
    for (a, b), c in pairs.items():
        mass[a] += disc(c) * c
        lower[a] += base(b)
    weight = lambda a: (1 - mass[a] / (history[a] + 0.5)) / (1 - lower[a])

    def p(a, b):
        c = pairs.get((name(a), b), 0) if b in common else 0
        return disc(c) * c / (history[name(a)] + 0.5) if c else weight(name(a)) * base(b)

    for a in ["<s>", *list(common)[:20], "never seen"]:
        assert abs(sum(p(a, b) for b in count) + p(a, "never seen") - 1) < 1e-9
    scores = [(len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10(base(w)) for w in ws), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *ws], ws))) for ws in words]
    return scores


def test_katz_against_dictionaries(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9000, None), (9001, ""), (9002, "The THE the\x0bthe é É"), (9002, "The THE the\x0bthe é É"), (None, "of of"), (9003, "word " * 60_000)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"block": F.lit("clash"), "n_tokens": F.lit(1)})
    held = [d is not None and d % 4 == 0 for d, _ in rows]
    for rare, bucket in ((1e-9, 5000), (2e-3, 10**9)):
        want = _katz([(h, t) for h, (_, t) in zip(held, rows)], rare)
        got = katz.katz_scores(frame, F.col("doc_id") % 4 == 0, rare=rare, bucket_tokens=bucket).collect()
        key = lambda r: (str(r[0]), r[2], r[6])
        ours = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
        theirs = sorted(((d, h, *w) for (d, _), h, w in zip(rows, held, want)), key=key)
        assert [o[:5] for o in ours] == [t[:5] for t in theirs]
        assert np.allclose([o[5:] for o in ours], [t[5:] for t in theirs], rtol=1e-10)
    assert katz.katz_scores(frame.limit(0), F.lit(False)).count() == 0
    unknown = katz.katz_scores(frame, F.lit(True)).collect()
    assert len(unknown) == len(rows) and all(r["n_known"] == 0 and r["score"] == r["base_score"] for r in unknown)


def test_katz_counts_all_bigrams(spark):
    """Words below the broadcast frequency keep their bigrams: as the model in which no word is rare."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9000, None), (9001, ""), (9003, "word " * 60_000), (9004, "new " * 9 + "words new")]
    frame, held = spark.createDataFrame(rows, DOCS), [d % 4 == 0 for d, _ in rows]
    want = sorted((d, *w[:3], *w[3:]) for (d, _), w in zip(rows, _katz([(h, t) for h, (_, t) in zip(held, rows)], 1e-9)))
    for hot, bucket in ((2e-3, 5000), (2e-3, 10**9), (2.0, 5000)):
        got = sorted(tuple(r) for r in katz.katz_scores(frame, F.col("doc_id") % 4 == 0, bucket_tokens=bucket, hot=hot).select(
            "doc_id", "n_tokens", "n_known", "train_tokens", "score", "base_score").collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([[g[5], g[4]] for g in got], [w[4:] for w in want], rtol=1e-10)


def test_blocks_of_a_batch_have_its_tokens():
    import pyarrow as pa

    texts = [f"É{i} the end\x0b x" * (i % 7) for i in range(50)] + [None, "", " \t"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = []
    for block in katz.blocks([batch], "text", 100):
        tokens = katz.block_tokens(block.column(0))
        got += [tokens.hashes[tokens.word[tokens.doc == d]].tolist() for d in range(block.num_rows)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == [[katz.hash_of(w) for w in [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), katz.END]] for t in texts]


def test_katz_beats_its_base_on_held_out_texts(spark):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    r = katz.katz_scores(spark.read.parquet(f"{SF_CHECK}/documents.parquet"), fold == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_chain_marginals_are_those_of_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 63, 64, 65, 200, 1, 128])
    emit, trans = rng.normal(size=(lengths.sum(), 3)) * 4, rng.normal(size=(3, 3)) * 2
    got, at = language_crf.chain_marginals(emit, lengths, trans), 0
    for n in lengths:
        want, _ = language_crf.forward_backward(emit[at:at + n][None], trans)
        assert np.allclose(got[at:at + n], want[0], atol=1e-12)
        at += n
    # the recursion itself, against all paths of a short chain
    e, paths = rng.normal(size=(1, 4, 2)), np.zeros((4, 2))
    t = rng.normal(size=(2, 2))
    for code in range(16):
        y = [(code >> i) & 1 for i in range(4)]
        w = math.exp(sum(e[0, i, y[i]] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            paths[i, y[i]] += w
    assert np.allclose(language_crf.forward_backward(e, t)[0][0], paths / paths.sum(1, keepdims=True))


def test_language_accuracy_on_held_out_documents(spark):
    found = language_crf.op9_language_id(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] and r[2] <= 1
    held = {x["doc_id"] for x in found.where("held_out").collect()}
    assert all((zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) == (x["doc_id"] in held) for x in found.collect())


def test_language_edges_and_code_switching(spark):
    de, en = "der die und ist nicht ein haus mit von auch " * 30, "the of and to is that it with as for " * 30
    model = language_crf.fit([de, en] * 4, ["de", "en"] * 4)
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (4, en), (4, en), (None, de), (5, (de + " ") * 400), (6, "the of and to that is it der die und ist nicht auch mit von haus")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"lang_pred_": F.lit(1), "__text": F.lit("clash")})
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"] == 0) for r in language_crf.identify_languages(docs, model).where("doc_id IS NULL OR doc_id <> 6").collect())
    assert got == sorted([("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "en", False), ("4", "en", False), ("None", "de", False), ("5", "de", False)])
    words, gamma = language_crf.Labeller(model).label([rows[-1][1]])[0]
    assert [model.languages[i] for i in gamma.argmax(1)] == ["en"] * 7 + ["de"] * 9 and len(words) == 16
    empty = language_crf.fit_language_model(spark.createDataFrame([], DOCS + ", lang string"))
    assert {r["lang_pred"] for r in language_crf.identify_languages(docs, empty).collect()} == {"und"}
    assert language_crf.identify_languages(docs.limit(0), model).count() == 0


def _vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    for g in range(12):  # groups of neighbours, near the threshold and close
        own = np.arange(g * 15, g * 15 + 15)
        x[own] = x[own[0]] + rng.normal(size=(15, 16)) * (0.02 + 0.03 * (g % 4)) * np.linalg.norm(x[own[0]]) / 4
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_vector_links_against_brute_force(spark):
    rows = _vectors()
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15),
                                                           (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (None, rows[1][1]), (2007, [x * 1e3 for x in rows[30][1]]), (2008, [2.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "nid": F.lit("clash"), "key": F.lit(2)})
    out = {r["vec_id"]: r for r in vector_graph.near_vectors(vectors, shard=200).collect()}
    assert len(out) == len(rows)
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in fine])
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    n = linked.sum(1)
    got = np.array([out[i]["n_links"] for i, _ in fine])
    assert (got <= n).all() and got.sum() >= 0.95 * n.sum() and n.sum() > 3000
    low = {i: i for i, _ in fine if i is not None}
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert (out[2006]["n_links"], out[2008]["component_id"]) == (1, 2006)
    assert out[1010]["component_id"] == 0 and not out[1010]["kept"] and out[0]["kept"] and len(low)
    found, true = vector_graph.audit_recall(vectors, spark.createDataFrame([(i, int(r["n_links"])) for i, r in out.items()], "vec_id long, n_links long"))
    assert true > 0 and found >= 0.9 * true
    assert vector_graph.near_vectors(vectors.limit(0)).count() == 0


def test_group_of_near_copies_over_many_shards(spark):
    """A group of twenty times a shard's size: links are found in all shards that hold some of it."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    centre /= np.linalg.norm(centre)
    noise = rng.normal(size=(1000, 24))
    x = np.concatenate([centre + 0.14 * noise[:700] / np.linalg.norm(noise[:700], axis=1, keepdims=True), centre + 0.24 * noise[700:] / np.linalg.norm(noise[700:], axis=1, keepdims=True),
                        rng.normal(size=(300, 24))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    out = {r["vec_id"]: r for r in vector_graph.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), shard=50).collect()}
    got = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (got <= linked.sum(1)).all() and got.sum() >= 0.99 * linked.sum() and linked.sum() > 500_000
    assert {out[i]["component_id"] for i in np.flatnonzero(linked.any(1))} == {0}


def test_spanning_components():
    rng = np.random.default_rng(3)
    nid, query = np.arange(100, 160), np.concatenate([np.arange(100, 130), np.arange(200, 210)])
    linked = rng.random((40, 60)) < 0.02
    low = {n: n for n in [*nid.tolist(), *query.tolist()]}
    for _ in range(60):
        for i, j in zip(*np.nonzero(linked)):
            low[query[i]] = low[nid[j]] = min(low[query[i]], low[nid[j]])
    got = {int(n): root for numbers, root in vector_graph.spanning(linked, query, nid) for n in numbers}
    assert got == {n: low[n] for n in got} and {n for n in low if low[n] != n} <= set(got)


def test_robust_prune_keeps_edges_that_point_apart():
    x = np.array([[1.0, 0], [0.999, 0.04], [0.998, 0.06], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    first = vector_graph.robust_prune(x, degree=3)[0]
    assert first[0] == 1 and 2 not in first  # 2 lies behind 1


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; a changed end takes some of both sets
    near = lambda g, n: " ".join([f"{g}{w}" for w in words[:104 - n]] + [f"{g}z{i}" for i in range(n)])
    rows = [(1, near("a", 0)), (2, near("a", 11)), (3, near("b", 0)), (4, near("b", 9)), (5, near("c", 0)), (6, near("c", 12)),  # 89/111, 91/109, 88/112
            (7, "a repeated row"), (7, "a repeated row"), (None, "no id at all"), (None, "no id at all"), (None, "NO id at  all"),
            (8, "other words"), (None, "other words"), (9, ""), (9, " "), (10, None), (None, ""), (None, ""), (11, "two texts"), (11, "of one id")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"root": F.lit("clash"), "first": F.lit(1)})
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], bool((r["text"] or "").strip())) for r in out.collect())
    assert got == {(1, True): 1, (3, True): 1, (5, True): 1, (6, True): 1, (7, True): 1, (None, True): 1, (8, True): 1, (9, False): 1, (10, False): 1,
                   (None, False): 2, (11, True): 2}
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF_SMALL).count() == 0


def test_numerals_are_no_letters(spark):
    assert language_crf.words_in("½ ² ½ x² Ⅷ ٣ a½b É") == ["x", "a", "b", "é"]
    model = language_crf.fit(["the of and", "der die das"], ["en", "de"])
    docs = spark.createDataFrame([(1, "½ ² ½"), (2, "the ½ of"), (3, None)], DOCS)
    assert {r["doc_id"]: r["lang_pred"] for r in language_crf.identify_languages(docs, model).collect()} == {1: "und", 2: "en", 3: "und"}


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "x", 0), (10**6, "", "en", "x", 0), (10**6 + 1, "½ ½", "en", None, 3),
                                 (10**6 + 2, "the and of to is " * 40_000, "en", "x", 1), (10**6 + 2, "the and of to is " * 40_000, "en", "x", 1)], docs.schema)
    names = ("score", "lang_pred", "n_lines", "n_dropped", "kept", "component_id", "n_shingles", "root", "row", "doc", "hit_id", "contaminated", "copies")
    wide = docs.unionByName(odd).withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF_SMALL)
        assert out.columns == wide.columns
        found = out.select("doc_id", *names).where(F.col("doc_id").isNull() | (F.col("doc_id") >= 10**6)).collect()
        assert all(r[c] == c for r in found for c in names)
        ids = Counter(r["doc_id"] for r in found)
        assert ids == {"language_id": {10**6 + 2: 2}, "line_dedup": {None: 1, 10**6: 2, 10**6 + 1: 1, 10**6 + 2: 2},
                       "near_duplicates": {None: 1, 10**6: 1, 10**6 + 1: 1, 10**6 + 2: 1}, "decontamination": {None: 1, 10**6: 2, 10**6 + 1: 1, 10**6 + 2: 2}}[name]
        assert stage(spark, wide.limit(0), SF_SMALL).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, SF_SMALL)
    assert Counter(i for r in packed.collect() for i in set(r["doc_ids"]))[10**6] >= 1


def test_pipeline_stages(spark):
    docs, kept = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    names = docs.columns
    from tabsmith.llm.common import stored

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF_SMALL), "test")
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == names
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    ids = [i for r in docs.collect() for i in r["doc_ids"]]
    assert len(set(ids)) == kept["decontamination"] > 0.5 * kept["language_id"]
    assert kept["language_id"] == kept["line_dedup"] >= kept["near_duplicates"] > kept["decontamination"]
    assert sorted(map(str, E.queries()["pipeline"](spark, SF_SMALL).collect())) == sorted(map(str, docs.collect()))
