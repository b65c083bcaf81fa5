"""Source mixing, source divergence and conversation repair: brute force, DuckDB, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import divergence, mixing, queries, repair
from tests.conftest import SF_CHECK
from tests.oracle import duck

TURNS = "conv_id long, turn long, role string, text string"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def _repaired(rows):
    """The expected row of one conversation's turns, by trying every edit in every state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    gives = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    seen, faults, states = set(), Counter(), {0: (0, "", ())}

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def inserted(table):
        for _ in range(3):
            for s, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if s in gives[role[0]]:
                        better(table, gives[role[0]][s], (cost + 3, audit + "I", (*lines, f"{role}:")))

    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        after = {}
        inserted(states)
        for s, (cost, audit, lines) in states.items():
            better(after, s, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                if s in gives.get(role[:1], {}):
                    better(after, gives[role[:1]][s], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if s in gives[to[0]]:
                        better(after, gives[to[0]][s], (cost + 3 + extra, audit + "R", (*lines, f"{to}:{text}")))
        states = after
    inserted(states)
    cost, audit, lines = min(states[s] for s in (0, 3) if s in states)
    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _expected(rows, damaged):
    by = defaultdict(list)
    for r in damaged:
        by[r[0]].append(r)
    return sorted(((c, *_repaired(by[c])) for c in {r[0] for r in rows}), key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(queries.QUERIES["op13_conversation_repair"](spark, SF_CHECK)) == _expected(rows, _damaged(rows))


def test_repair_edges_and_long_conversations(spark):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "usher"], ["Hi.", "Yes!", "no", " ", None, "", "a ", "b. ", "Why? ", "c.\n", "É.", " "]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randint(0, 9)}.") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, rng.choice([None, *range(700)]), rng.choice(roles[:5]), rng.choice(["x.", "y", f"{i}!", f"{i}"])) for i in range(1500)]  # many segments
    rows += [(101, 5, "user", "same.")] * 900 + [(101, 6, "assistant", "same.")] * 2 + [(None, None, None, None), (None, 1, "user", "q?"), (102, None, "user", "z." * 200_000)]
    docs = spark.createDataFrame(rows, TURNS).withColumns({"sym": F.lit(1), "conv": F.lit("x"), "copies": F.lit(3), "cost": F.lit(2)})
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert _got(repair.repair_conversations(docs, segment=64)) == _expected(rows, filled)
    none = spark.createDataFrame([(1, 1, "user", "a.", 0), (2, 0, "user", "a.", 1)], TURNS + ", copies int")
    empty = (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert _got(repair.repair_conversations(none, copies_col="copies"))[0] == empty
    assert repair.repair_conversations(docs.limit(0)).count() == 0


def test_repaired_turns_are_well_formed(spark):
    rows = spark.createDataFrame([("c", 0, "assistant", "Hello."), ("c", 1, "user", "Yes?"), ("d", 0, "system", "S."), ("d", 1, "user", "u.")], "conv_id string, turn int, role string, text string")
    got = sorted(tuple(r) for r in repair.repaired_turns(rows).collect())
    assert got == [("c", 0, "user", ""), ("c", 1, "assistant", "Hello."), ("c", 2, "user", "Yes?"), ("c", 3, "assistant", ""),
                   ("d", 0, "system", "S."), ("d", 1, "user", "u."), ("d", 2, "assistant", "")]


def test_re_pair_packs_and_spells_back(spark):
    rng = random.Random(2)
    strings = {"".join(rng.choice("EIAI") for _ in range(rng.randint(1, 300))) for _ in range(80)} | {"E" * 257, "A"}
    rules, packed = repair.re_pair(spark.createDataFrame([(s,) for s in strings], "symbols string"))
    spelled = dict(rules)

    def spell(text):
        while any(c in spelled for c in text):
            text = "".join(spelled.get(c, c) for c in text)
        return text

    rows = packed.collect()
    assert {r["symbols"] for r in rows} == strings and all(spell(r["packed"]) == r["symbols"] for r in rows)
    assert sum(len(r["packed"]) for r in rows) < sum(map(len, strings)) / 3


def _levels(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cut = {}
    while True:
        left = share * sum(sizes.values()) - sum(cut.values())
        free = [s for s in names if s not in cut]
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: most * sizes[s] for s in free if want[s] > most * sizes[s]}
        if not above:
            return {s: float(x) for s, x in {**cut, **want}.items()}
        cut |= above


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "text", "source").collect()}
    got = queries.QUERIES["op11_source_mixing"](spark, SF_CHECK).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        source = rows[r["doc_id"]]["source"]
        assert r["size"] == _words(rows[r["doc_id"]]["text"]) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
    want = _levels(sizes)
    for r in got:
        source = rows[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) <= 1e-9 * want[source]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.005 * want[source] + 2
    again = queries.QUERIES["op11_source_mixing"](spark, SF_CHECK).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 7), ["a", "", None, "É", "b"][i % 5]) for i in range(200)] + [(7, "copy of words", "hot")] * 500 + [(None, None, "blank"), (None, "  \n", "blank"), (1, "x " * 200_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "at": F.lit(1), "sid": F.lit(2), "block": F.lit(3)})
    got = mixing.mix_sources(docs, shard_words=5000, block_words=64).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    expected = Counter()
    for _, text, source in rows:
        expected[source] += _words(text)
    assert sizes == expected
    want = _levels(sizes)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.005 * want[source] + 64, source
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    spans = mixing.mix_spans(docs, shard_words=5000, block_words=64)
    held = Counter()
    for r in spans.groupBy("source").agg(F.sum("words").alias("n")).collect():
        held[r["source"]] = r["n"]
    assert held == +taken
    by_shard = [r["n"] for r in spans.select("shard", "slot").distinct().groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(by_shard) > 20 and max(by_shard) - min(by_shard) <= 1  # every shard has its exact number of draws
    cells = spans.select("source", "epoch", (F.col("doc_id")).alias("d"), "copy", "first").groupBy("source", "epoch", "d", "copy", "first").count()
    assert cells.where("count > 1").count() == 0  # no block twice in a round


def test_splitting_tree_and_permutation():
    node = {"node": 1, "lo": 0, "hi": 13, "sid": np.arange(4), "start": np.zeros(4, dtype=np.int64), "count": np.array([5, 0, 1000, 77]), "blocks": np.array([5, 1, 600, 77])}
    leaves = list(mixing.split_nodes(node, 1082, 13, 3, 10))
    assert [x["lo"] for x in leaves] == list(range(13)) and all(sum(x["count"]) == (x["hi"] * 1082 // 13 - x["lo"] * 1082 // 13) for x in leaves)
    owned = defaultdict(list)
    for x in leaves:
        for s, a, n in zip(x["sid"], x["start"], x["count"]):
            owned[int(s)] += range(a, a + n)
    assert {s: sorted(v) for s, v in owned.items()} == {0: list(range(5)), 2: list(range(1000)), 3: list(range(77))}
    halves = np.array([next(mixing.split_nodes(node, 1082, 13, seed, 1))["count"].sum() for seed in range(50)])
    assert (halves == 6 * 1082 // 13).all()
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99))) == list(range(n))
    assert list(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1))) != list(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 2)))


def test_divergence_edges(spark, tmp_path):
    rng = random.Random(6)
    words = ["the", "The", "été", "x1y", "a_b", "日本", "\x00zero", "é é", "ſ", "K"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None, "É"])) for i in range(200)]
    rows += [(900 + i, "rare", "xx", f"s{i % 3}") for i in range(9)] + [(1, None, "en", "none"), (2, "long " * 100_000, "en", "s1"), (3, "alone", "solo", "s1")] + [(5, "Copy me.", "fr", "s2")] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(SF_CHECK)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({divergence.ORACLE})").fetchall())
    for shard, tile in ((200_000, 256), (7, 2)):  # also with many shards and tiles
        before = divergence.SHARD_ROWS, divergence.TILE_SOURCES
        divergence.SHARD_ROWS, divergence.TILE_SOURCES = shard, tile
        try:
            out = divergence.source_divergence(docs.withColumns({"term": F.lit("x"), "n": F.lit(1)}))
        finally:
            divergence.SHARD_ROWS, divergence.TILE_SOURCES = before
        assert sorted(tuple(r[c] for c in names) for r in out.collect()) == want
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_probabilities_are_exact_beyond_64_bits():
    counts, totals = [0, 1, 10**12, 3 * 10**14], [7, 10**13, 9 * 10**14, 3 * 10**14]
    got = divergence.probability(np.array(counts), np.array(totals), 10**6)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (n + 2 * 10**6) for c, n in zip(counts, totals)]
