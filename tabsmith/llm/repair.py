"""Conversation structure repair: the cheapest edits that make the turns of a conversation an optional
system turn followed by pairs of user and assistant.

Each turn is a symbol of its role and fault, each conversation a string. Re-Pair compresses all
distinct strings to one grammar; a rule has a min-plus transfer matrix over the states of the wanted
structure, with a rope of edits in each entry, made from the matrices of its two halves."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import SPACE, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols: class of the role's initial (s, u, a, other) times four faults (none, truncated, blank, duplicate).
BASE = "ABCDEFGHIJKLMNOP"
#: Turns of a segment, the longest string that is compressed and evaluated at a time.
SEGMENT = 4096
#: Rounds of Re-Pair and pairs that a round replaces at most (what is left uncompressed is folded as it is).
ROUNDS, PAIRS = 16, 64
#: Distinct strings and their characters up to which the evaluated table is broadcast.
SMALL_STRINGS, SMALL_CHARS = 20_000, 4_000_000
#: Letters of an edit with the role it gives: I, J insert and R, S rerole to user, assistant. They sort as the audit's do.
AUDIT = str.maketrans("JS", "IR")
#: State: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.
STATES = range(4)
GIVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Cheapest insertions from state to state.
INSERTED = {0: {0: "", 2: "I", 3: "IJ"}, 1: {1: "", 2: "I", 3: "IJ"}, 2: {2: "", 3: "J"}, 3: {3: "", 2: "I"}}
TAILS = {0: "", 1: "IJ", 2: "J", 3: ""}


class Rope(NamedTuple):
    """A string as the concatenation of two, which rules share."""

    left: Rope | str
    right: Rope | str

    def text(self) -> str:
        parts, open_ = [], [self]
        while open_:
            x = open_.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                open_ += [x.right, x.left]
        return "".join(parts)


def text_of(rope: Rope | str) -> str:
    return rope if isinstance(rope, str) else rope.text()


class Value(NamedTuple):
    """What a string of turns does: entry 4 * i + j of the matrix is (cost, edits) from state i to j or
    None; the classes at its ends; counts of illegal neighbours, blank, duplicate and truncated turns."""

    matrix: tuple
    first: str
    last: str
    counts: tuple[int, int, int, int]


def symbol_value(symbol: str) -> Value:
    role, fault = "suao"[BASE.index(symbol) // 4], BASE.index(symbol) % 4
    steps: dict[tuple[int, int], tuple[int, str]] = {}

    def step(i, j, cost, letter):
        if (i, j) not in steps or (cost, letter) < steps[i, j]:
            steps[i, j] = (cost, letter)

    for i in STATES:
        step(i, i, DELETE, "D")
        if fault < 2:
            extra = TRUNCATED * fault
            if i in GIVES.get(role, {}):
                step(i, GIVES[role][i], KEEP + extra, "K")
            for to, letter in (("u", "R"), ("a", "S")):
                if i in GIVES[to]:
                    step(i, GIVES[to][i], REROLE + extra, letter)
    matrix: list = [None] * 16
    for i in STATES:
        for k, inserted in INSERTED[i].items():
            for j in STATES:
                if (k, j) in steps:
                    cost, letter = steps[k, j]
                    entry = (cost + INSERT * len(inserted), inserted + letter)
                    if matrix[4 * i + j] is None or entry < matrix[4 * i + j]:
                        matrix[4 * i + j] = entry
    return Value(tuple(matrix), role, role, (0, int(fault == 2), int(fault == 3), int(fault == 1)))


def product(a: Value, b: Value) -> Value:
    """One string after the other. Of equal costs the smaller string of edits wins; strings over the same
    turns are never prefixes of each other, as each ends with a turn's letter, so the choice stays
    right whatever follows."""
    matrix: list = [None] * 16
    for i, j in itertools.product(STATES, STATES):
        best, via = None, []
        for k in STATES:
            x, y = a.matrix[4 * i + k], b.matrix[4 * k + j]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost < best:
                    best, via = cost, []
                if cost == best:
                    via.append(Rope(x[1], y[1]))
        if via:
            matrix[4 * i + j] = (best, via[0] if len(via) == 1 else min(via, key=Rope.text))
    met = int(a.last + b.first not in ("su", "ua", "au"))
    return Value(tuple(matrix), a.first, b.last, (a.counts[0] + b.counts[0] + met, *(x + y for x, y in zip(a.counts[1:], b.counts[1:], strict=True))))


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): neighbours in a partition's strings, two code points in one number."""
    codes, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        text = np.frombuffer("\0".join(batch.column(0).to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        left, right = text[:-1], text[1:]
        real = (left > 0) & (right > 0)
        codes, at = np.unique(np.concatenate([codes, (left[real] << 32) | right[real]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, np.ones(int(real.sum()), dtype=np.int64)]), len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"pair": pa.array(codes), "n": pa.array(n)})


def chosen(pairs: list[tuple[int, int]], most: int) -> list[str]:
    """Pairs from the most frequent on whose replacements can't overlap: no symbol ends one and starts
    another. A pair of two equal symbols keeps its symbol to itself."""
    lefts, rights, out = set(), set(), []
    for code, _ in pairs:
        x, y = chr(code >> 32), chr(code & 0xFFFFFFFF)
        if len(out) < most and x not in rights and y not in lefts and (x != y or x not in lefts | rights):
            lefts.add(x)
            rights.add(y)
            out.append(x + y)
    return out


def re_pair(strings: DataFrame, rounds: int = ROUNDS, most: int = PAIRS) -> tuple[list[tuple[str, str]], DataFrame]:
    """(rules, packed): rules (symbol, its two halves) in the order they are made, and ``strings`` with a
    column ``packed`` in which they are applied. Each round counts all neighbours and replaces many
    pairs at once, as pairs that share no position can be replaced in any order; it ends when no
    pair occurs twice or after ``rounds``. The rules are at most ``rounds`` * ``most`` and the only
    thing gathered."""
    rules: list[tuple[str, str]] = []
    packed = strings.withColumn("packed", F.col("symbols"))
    for _ in range(rounds):
        found = (packed.where(F.char_length("packed") > 1).select("packed").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                 .where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * most).collect())
        pairs = chosen([(r["pair"], r["n"]) for r in found], most)
        if not pairs:
            break
        now = F.col("packed")
        for pair in pairs:
            rules.append((chr(0x4E00 + len(rules)), pair))
            now = F.replace(now, F.lit(pair), F.lit(rules[-1][0]))
        packed = stored(packed.select("symbols", now.alias("packed")), "packed")
    return rules, packed


def rule_values(rules: list[tuple[str, str]]) -> dict[str, Value]:
    """The value of every symbol, rules bottom-up."""
    values = {s: symbol_value(s) for s in BASE}
    for symbol, pair in rules:
        values[symbol] = product(values[pair[0]], values[pair[1]])
    return values


EVALUATED = "symbols string, first string, last string, counts array<long>, costs array<long>, ranks array<long>, edits array<string>"


def evaluate(packed: DataFrame, values: dict[str, Value]) -> DataFrame:
    """``EVALUATED``: the value of each distinct string; a missing entry has cost -1; ranks order the edits
    from one state."""

    def of(batches):
        for batch in batches:
            out = {c: [] for c in ("symbols", "first", "last", "counts", "costs", "ranks", "edits")}
            for symbols, text in zip(batch.column("symbols").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                parts = [values[c] for c in text]
                while len(parts) > 1:  # pairwise, so that ropes stay shallow
                    parts = [product(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                value = parts[0]
                edits = [text_of(e[1]) if e else None for e in value.matrix]
                ranks = [0] * 16
                for i in STATES:
                    row = sorted((edits[4 * i + j], j) for j in STATES if edits[4 * i + j] is not None)
                    for at, (_, j) in enumerate(row):
                        ranks[4 * i + j] = at
                for c, v in zip(out, (symbols, value.first, value.last, list(value.counts), [e[0] if e else -1 for e in value.matrix], ranks, edits), strict=True):
                    out[c].append(v)
            kinds = {"counts": pa.list_(pa.int64()), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64()), "edits": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})

    return packed.select("symbols", "packed").mapInArrow(of, EVALUATED)


def cheapest(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """The least cost of a conversation given (costs, ranks) of its segments, and the entry taken in each: costs
    to the end backward, then forward the smallest edits that keep to them."""
    after = [0, INSERT * 2, INSERT, 0]
    ahead = [after]
    for costs, _ in reversed(segments):
        after = [min((costs[4 * i + j] + after[j] for j in STATES if costs[4 * i + j] >= 0 and after[j] is not None), default=None) for i in STATES]
        ahead.append(after)
    ahead.reverse()
    state, taken = 0, []
    for k, (costs, ranks) in enumerate(segments):
        best = min((ranks[4 * state + j], j) for j in STATES
                   if costs[4 * state + j] >= 0 and ahead[k + 1][j] is not None and costs[4 * state + j] + ahead[k + 1][j] == ahead[k][state])
        taken.append(4 * state + best[1])
        state = best[1]
    return ahead[0][0], taken


def symbols_of(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, sym and again (the symbol of further copies) of distinct turns."""
    same = rows.withColumn("d", F.md5(F.concat_ws("\0", F.length("role").cast("string"), "role", "text")))
    rows = stored(same, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeats = (rows.groupBy("conv", "d").agg(F.count("*").alias("times"), F.min(order).alias("first")).where("times > 1")
               .select(F.col("conv").alias("conv2"), F.col("d").alias("d2"), F.col("first")))
    rows = rows.join(repeats, rows["conv"].eqNullSafe(repeats["conv2"]) & (rows["d"] == repeats["d2"]), "left")
    body = F.btrim("text", F.lit(SPACE))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(body == "", 2).when(later, 3).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    role = 4 * F.coalesce(*(F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate("sua")), F.lit(3))
    at = F.array(*map(F.lit, BASE))
    return rows.select("conv", "turn", "role", "text", "copies", F.get(at, role + fault).alias("sym"), F.get(at, role + F.when(fault == 2, 2).otherwise(3)).alias("again"))


def segments_of(rows: DataFrame, conv_type: str, size: int) -> DataFrame:
    """conv, part, seg, idx, symbols, role, text: a row with ``symbols`` for each segment (idx -1) and one without
    for each turn that may stay, with its place in its segment. Ranges of (conv, turn, role, text) make
    the parts, so a long conversation lies in many; a part's segments are cut as its rows stream by."""
    start = F.substring("text", 1, 32)
    spread = rows.repartitionByRange(F.col("conv").isNotNull(), "conv", F.col("turn").isNotNull(), "turn", "role", start)
    spread = spread.sortWithinPartitions(F.col("conv").isNotNull(), "conv", F.col("turn").isNotNull(), "turn", "role", "text").withColumn("part", F.spark_partition_id())
    schema = f"conv {conv_type}, part int, seg long, idx long, symbols string, role string, text string"

    def cut(batches):
        current, seg, held, part = None, 0, [], None
        started = False
        for batch in batches:
            done, seg_at, idx_at, stay = [], [], [], []

            def flush():
                nonlocal seg, held
                if held:
                    done.append((current, part, seg, "".join(held)))
                    seg, held = seg + 1, []

            kind = batch.schema.field("conv").type
            for at, (conv, part_of, copies, sym, again) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "copies", "sym", "again")), strict=True)):
                if not started or conv != current:
                    flush()
                    current, seg, started = conv, 0, True
                part = part_of
                if BASE.index(sym) % 4 < 2:
                    stay.append(at)
                    seg_at.append(seg)
                    idx_at.append(len(held))
                held.append(sym)
                more = copies - 1
                if len(held) >= size:
                    flush()
                while more:
                    n = min(more, size - len(held))
                    held.extend(again * n)
                    more -= n
                    if len(held) >= size:
                        flush()
            yield from _segment_rows(done, kind)
            if stay:
                own = batch.take(pa.array(stay))
                yield pa.RecordBatch.from_pydict({"conv": own.column("conv"), "part": own.column("part"), "seg": pa.array(seg_at, pa.int64()), "idx": pa.array(idx_at, pa.int64()),
                                                  "symbols": pa.nulls(len(stay), pa.string()), "role": own.column("role"), "text": own.column("text")})
        if held:
            yield from _segment_rows([(current, part, seg, "".join(held))], kind)

    return spread.select("conv", "part", "copies", "sym", "again", "role", "text").mapInArrow(cut, schema)


def _segment_rows(done: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    if done:
        conv, part, seg, symbols = zip(*done, strict=True)
        n = len(done)
        yield pa.RecordBatch.from_pydict({"conv": pa.array(conv, kind), "part": pa.array(part, pa.int32()), "seg": pa.array(seg, pa.int64()), "idx": pa.array([-1] * n, pa.int64()),
                                          "symbols": pa.array(symbols, pa.string()), "role": pa.nulls(n, pa.string()), "text": pa.nulls(n, pa.string())})


TOTALS = "blank long, duplicate long, truncated long, illegal long, cost long"


def edits_of(segments: DataFrame, evaluated: DataFrame, conv_type: str) -> DataFrame:
    """conv, part, seg, edits (of each segment, with the insertions at the end) and, in a conversation's last
    row, its totals."""
    narrow = evaluated.drop("edits")
    n, chars = evaluated.agg(F.count("*"), F.sum(F.length("symbols"))).first()
    small = n <= SMALL_STRINGS and (chars or 0) <= SMALL_CHARS
    rows = segments.join(F.broadcast(narrow) if small else narrow, "symbols").repartition("conv").sortWithinPartitions(F.col("conv").isNotNull(), "conv", "part", "seg")
    schema = f"conv {conv_type}, part int, seg long, symbols string, entry int, tail string, {TOTALS}"

    def fold(batches):
        own: list[tuple] = []
        out: list[tuple] = []

        def closed():
            if own:
                cost, taken = cheapest([(r[6], r[7]) for r in own])
                counts = [sum(x) for x in zip(*(r[8] for r in own), strict=True)]
                illegal = counts[0] + sum(a[5] + b[4] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
                for r, e in zip(own, taken, strict=True):
                    out.append((*r[:4], e, "", None, None, None, None, None))
                out[-1] = (*own[-1][:4], taken[-1], TAILS[taken[-1] % 4], counts[1], counts[2], counts[3], illegal, cost)
                own.clear()

        def sent(kind):
            names = ["conv", "part", "seg", "symbols", "entry", "tail", "blank", "duplicate", "truncated", "illegal", "cost"]
            kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string()] + [pa.int64()] * 5
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(names, zip(*out[at:at + 10_000], strict=True), kinds, strict=True)})
            out.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "seg", "symbols", "first", "last", "costs", "ranks", "counts")), strict=True):
                if own and own[0][0] != row[0]:
                    closed()
                own.append(row)
            yield from sent(kind)
        closed()
        if out:
            yield from sent(kind)

    taken = rows.select("conv", "part", "seg", "symbols", "first", "last", "costs", "ranks", "counts").mapInArrow(fold, schema)
    texts = evaluated.select(F.col("symbols").alias("symbols2"), F.posexplode("edits").alias("entry2", "own")).where("own IS NOT NULL")
    texts = F.broadcast(texts) if small else texts
    return (taken.join(texts, (F.col("symbols") == F.col("symbols2")) & (F.col("entry") == F.col("entry2")))
            .withColumn("edits", F.concat("own", "tail")).drop("symbols", "symbols2", "entry", "entry2", "own", "tail"))


def applied(edits: DataFrame, turns: DataFrame, conv_type: str, lines: bool) -> DataFrame:
    """The repaired turns (conv, number, role, text) if ``lines``, else a row per conversation: its totals, audit
    and repaired_sha256. Turns and edits of a conversation stream by in order; nothing of a
    conversation is held but its audit."""
    totals = [x.split()[0] for x in TOTALS.split(", ")]
    rows = edits.withColumn("idx", F.lit(-1).cast("long")).unionByName(turns.select("conv", "part", "seg", "idx", "role", "text"), allowMissingColumns=True)
    rows = rows.repartition("conv").sortWithinPartitions(F.col("conv").isNotNull(), "conv", "part", "seg", "idx")
    schema = f"conv {conv_type}, number long, role string, text string" if lines else f"conv {conv_type}, {TOTALS}, audit string, repaired_sha256 string"

    def replay(batches):
        started, current, kind = False, None, None
        audit, known, sha, number = [], [0] * 5, None, 0
        pending, at, idx = "", 0, 0
        out: list[tuple] = []

        def line(role, text):
            nonlocal number
            if lines:
                out.append((current, number, role, text))
            else:
                sha.update(f"{chr(10) if number else ''}{role}:{text}".encode())
            number += 1

        def advance(stop):
            """Replays the segment's edits up to the turn at ``stop`` and returns that turn's letter."""
            nonlocal at, idx
            while at < len(pending):
                letter = pending[at]
                at += 1
                if letter == "I":
                    line("user", "")
                elif letter == "J":
                    line("assistant", "")
                else:
                    idx += 1
                    if idx - 1 == stop:
                        return letter
            return "D"

        def closed():
            if started:
                advance(-1)
                if not lines:
                    out.append((current, *known, "".join(audit), sha.hexdigest()))

        def sent():
            names = schema_names
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, k), v in zip(names(), zip(*out[i:i + 10_000], strict=True), strict=True)})
            out.clear()

        def schema_names():
            if lines:
                return [("conv", kind), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())]
            return [("conv", kind), *((c, pa.int64()) for c in totals), ("audit", pa.string()), ("repaired_sha256", pa.string())]

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, edit, place, role, text, *total in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "idx", "role", "text", *totals)), strict=True):
                if not started or conv != current:
                    closed()
                    started, current, audit, known, sha, number = True, conv, [], [0] * 5, hashlib.sha256(), 0
                    pending, at, idx = "", 0, 0
                if edit is not None:
                    advance(-1)
                    pending, at, idx = edit, 0, 0
                    audit.append(edit.translate(AUDIT))
                    known = total if total[0] is not None else known
                else:
                    letter = advance(place)
                    if letter != "D":
                        line({"R": "user", "S": "assistant"}.get(letter, role), text)
            yield from sent()
        closed()
        if out:
            yield from sent()

    return rows.select("conv", "edits", "idx", "role", "text", *totals).mapInArrow(replay, schema)


def _repair(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None, segment: int, lines: bool) -> tuple[DataFrame, DataFrame]:
    copies = F.col(copies_col).cast("long") if copies_col else F.lit(1).cast("long")
    blank = F.lit(" ")
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"),
                       F.coalesce(F.col(text_col), blank).alias("text"), copies.alias("copies"))
    kind = rows.schema["conv"].dataType.simpleString()
    there = rows.where("copies > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    cut = stored(segments_of(symbols_of(there), kind, segment), "segments")
    segments = cut.where("symbols IS NOT NULL")
    rules, packed = re_pair(stored(segments.select("symbols").distinct(), "strings"))
    evaluated = stored(evaluate(packed, rule_values(rules)), "evaluated")
    edits = edits_of(segments.select("conv", "part", "seg", "symbols"), evaluated, kind)
    return rows, applied(edits, cut.where("symbols IS NULL"), kind, lines)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         copies_col: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of the repaired ``role:text`` joined by line feeds).

    Turns are taken by turn, nulls first, then by role and text. A turn is blank (white space only), else
    duplicate (role and text seen earlier), else truncated (doesn't end with one of ``.!?``). The
    wanted initials of roles are ``(s?(ua)+)?``. Edits: Keep 0; Rerole to user or assistant 3; Delete 4,
    the only one for blank and duplicate turns; Insert an empty user or assistant turn 3; a truncated
    turn that stays adds 3. Of the cheapest edits the least in ASCII is taken, which is unique.

    Null roles and texts are read as one space. Rows without a conversation id are one conversation. Null
    turns count as no number in gaps. Repeated rows are copies: the first may stay, the others are
    duplicates. ``copies_col`` says how often a row occurs; at 0 it only names its conversation, and one
    without any turn has zeros, an empty audit and the hash of the empty string. An empty table gives no
    rows. Other columns are not read.

    Scale: equal rows are counted before anything else. A conversation is cut into segments of ``segment``
    turns over range partitions, so a long one is spread; equal segments are evaluated once. What is
    kept of a conversation in one task is 40 numbers a segment and its audit; its texts stream
    by in order for the hash. Driver: at most ``ROUNDS`` * ``PAIRS`` rules."""
    rows, found = _repair(rows, conv_col, turn_col, role_col, text_col, copies_col, segment, lines=False)
    turns = rows.groupBy("conv", "turn").agg(F.max("copies").alias("copies")).withColumn("known", F.when(F.col("copies") > 0, F.col("turn")))
    gaps = turns.groupBy(F.col("conv").alias("conv_id")).agg(F.coalesce(F.max("known") - F.min("known") + 1 - F.count("known"), F.lit(0)).cast("long").alias("gaps"))
    zero = {c.split()[0]: F.lit(0).cast("long") for c in TOTALS.split(", ")} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return gaps.join(found, gaps["conv_id"].eqNullSafe(found["conv"]), "left").select("conv_id", "gaps", *(F.coalesce(F.col(c), v).alias(c) for c, v in zero.items()))


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   copies_col: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: conv_id, number (from 0), role and text. Cases as in :func:`repair_conversations`."""
    _, found = _repair(rows, conv_col, turn_col, role_col, text_col, copies_col, segment, lines=True)
    return found.withColumnRenamed("conv", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20, nulls read as one space:
    0 drops a row (copies 0), 1 empties its text, 2 removes ``.!?``, 3 repeats it (copies 2), 4 makes it user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(name), F.lit(20)).alias("k"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(rows), copies_col="copies")
