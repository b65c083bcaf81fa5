"""Katz backoff language model over words: counting, the stored model, and scoring.

A bigram that was seen has its Good-Turing discounted share of its history; any other word has the
history's backoff weight times its unigram probability, with weights that make the probabilities
of each history add up to one. Bigrams of all words are counted. The counts and backoff weights of
the at most 1 / ``HOT`` words above a relative frequency are broadcast, those of all others are
joined by the word's hash. With ``rare`` above 0, words below that frequency share one history and
are predicted by backoff instead, so bigrams are of common words.

Tokens travel in packed blocks: sorted, delta-coded and compressed. One shuffle by bigram (and by
the word that isn't hot) brings all occurrences of a bigram together, where it is counted and all
documents' tokens get their share of the score at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import stored

#: Relative frequency of a word whose count is broadcast; characters of a block; tokens that one task gathers.
HOT, BLOCK_CHARS, BUCKET_TOKENS = 1e-6, 4_000_000, 2_000_000
#: Counts up to this are discounted.
GOOD_TURING = 5
#: Added to a history's count, so that every history leaves something for words not seen after it.
LEFT = 0.5
#: The end of a text as a word: no word has a line feed.
END = "\n"
PAIRS, RARES, DOCUMENTS, TABLE, COLD, COLD_TABLE, HISTORY, BACK = 0, 1, 2, 3, 4, 5, 6, 7
#: Flags of a cold token: its key is the history (else the word), the other one isn't hot either.
BY_HISTORY, OTHER_COLD = 1, 2


def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Tokens(NamedTuple):
    """Tokens of a block: per token its word's place in ``hashes`` and its document."""

    hashes: np.ndarray
    word: np.ndarray
    doc: np.ndarray


def block_tokens(texts: pa.Array) -> Tokens:
    """A-Z lower-cased words between ASCII white space, and one end after each text (null: empty)."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # Arrow's string functions misread slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    doc, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(flat, "")
    doc, coded = doc.filter(real).to_numpy(), flat.filter(real).dictionary_encode()
    hashes = np.array([hash_of(w) for w in [*coded.dictionary.to_pylist(), END]], dtype=np.uint64)
    word = coded.indices.to_numpy().astype(np.int64)
    n = len(texts)
    order = np.argsort(np.concatenate([doc, np.arange(n)]), kind="stable")  # the ends come last in their texts
    return Tokens(hashes, np.concatenate([word, np.full(n, len(hashes) - 1)])[order], np.concatenate([doc, np.arange(n)])[order].astype(np.int64))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a block has about ``most`` bytes of text; no text is cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
            yield batch.slice(at, to - at)
            at = to


def _packed(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as compressed byte planes of their differences."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return _squeezed(steps)


def _squeezed(values: np.ndarray) -> bytes:
    size = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _restored(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _ascending(blob: bytes) -> np.ndarray:
    return np.cumsum(_restored(blob, np.uint64), dtype=np.uint64)


class Common(NamedTuple):
    """Common words in the order of their hashes, their counts, and the totals of the training tokens.
    Number ``len(hashes)`` stands for the start of a text, the next for all rare words."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    documents: int

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for rare ones."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def history_counts(self) -> np.ndarray:
        """Tokens after each common word, the start and the rare words; none stands after an end."""
        rare = self.tokens - self.counts.sum()
        if self.numbers(np.array([hash_of(END)], dtype=np.uint64))[0] < 0:
            rare -= self.documents
        return np.append(self.counts, [self.documents, rare]).astype(np.float64)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): occurrences of each word, by its hash, in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            tokens = block_tokens(block.column(0))
            n = np.bincount(tokens.word, minlength=len(tokens.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.hashes.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def common_words(train: DataFrame, rare: float = HOT, text_col: str = "text") -> Common:
    """Count the words of all training texts; the common ones, at most 1 / ``rare``, are gathered."""
    counts = stored(word_counts(train, text_col), "word-counts")
    end = int(np.uint64(hash_of(END)).view(np.int64))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("n"))), F.lit(0)).alias("ends")).first()
    found = counts.where(F.col("n") >= max(1.0, rare * total["n"])).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return Common(h[order], n[order], int(total["n"]), int(total["v"]), int(total["ends"]))


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _encode(block: pa.RecordBatch, number: int, common: Common, buckets: int, merged: bool) -> Iterator[tuple]:
    """(bucket, kind, block, data, extra, ids) of one block: its bigrams of common words, its other
    bigrams (if rare words are merged, its rare words), and what is known of its documents already."""
    tokens, held = block_tokens(block.column("text")), block.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    known = common.numbers(tokens.hashes)[tokens.word]
    start, rare = len(common.hashes), len(common.hashes) + 1
    before = np.concatenate([[start], np.where(known < 0, rare, known)[:-1]])
    first = np.flatnonzero(np.diff(tokens.doc, prepend=-1))
    before[first] = start
    seen = known >= 0
    paired = seen if merged else seen & (before != rare)
    n = block.num_rows
    logs = np.where(seen, np.log10(common.unigram(common.counts[np.maximum(known, 0)] if start else np.zeros(len(known)))), 0.0)
    base = np.bincount(tokens.doc, logs, n)
    n_known, n_tokens = np.bincount(tokens.doc[seen], minlength=n), np.bincount(tokens.doc, minlength=n)
    facts = np.concatenate([held.astype(np.float64), base, n_known, n_tokens])
    alone = ~seen if merged else np.zeros(len(seen), dtype=bool)
    histories = np.stack([tokens.doc[alone], before[alone]], axis=1).astype(np.uint32).reshape(-1)
    yield number % buckets, DOCUMENTS, number, _squeezed(facts), _squeezed(histories), block.column("doc_id").to_pylist()
    keys = (before[paired].astype(np.uint64) * np.uint64(rare + 1) + known[paired].astype(np.uint64)) * np.uint64(1 << 16) + tokens.doc[paired].astype(np.uint64)
    keys, times = np.unique(keys, return_counts=True)
    where = _spread(keys >> np.uint64(16), buckets)
    for b in np.unique(where):
        own = where == b
        yield int(b), PAIRS, number, _packed(keys[own]), _squeezed(times[own].astype(np.uint32)) + held.tobytes(), None
    if not merged:
        yield from _encode_cold(tokens, known, before, ~paired, rare, number, held, buckets)
        return
    words, docs = tokens.hashes[tokens.word[~seen]], tokens.doc[~seen]
    order = np.argsort(words, kind="stable")
    words, docs = words[order], docs[order]
    where = _spread(words, buckets)
    for b in np.unique(where):
        own = where == b
        yield int(b), RARES, number, _packed(words[own]), _squeezed(docs[own].astype(np.uint32)) + held.tobytes(), None


def _encode_cold(tokens: Tokens, known: np.ndarray, before: np.ndarray, cold: np.ndarray, rare: int, number: int, held: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of the bigrams with a word that isn't hot: by the hash of the second word, or of the first
    one if only that isn't hot; the other is its number if hot, else its hash."""
    word = tokens.hashes[tokens.word]
    last = np.concatenate([word[:1], word[:-1]])
    by_history, history_cold = known[cold] >= 0, before[cold] == rare
    key = np.where(by_history, last[cold], word[cold])
    other = np.where(by_history, known[cold].astype(np.uint64), np.where(history_cold, last[cold], before[cold].astype(np.uint64)))
    flags = np.where(by_history, BY_HISTORY, np.where(history_cold, OTHER_COLD, 0))
    tag = tokens.doc[cold].astype(np.uint64) * np.uint64(4) + flags.astype(np.uint64)
    order = np.lexsort((tag, other, key))
    key, other, tag = key[order], other[order], tag[order]
    where = _spread(key, buckets)
    for b in np.unique(where):
        own = where == b
        yield int(b), COLD, number, _packed(key[own]), _squeezed(np.concatenate([other[own], tag[own]])) + held.tobytes(), None


def _with_flags(blob: bytes, size: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a blob that ends with a flag for each document of its block."""
    raw = int.from_bytes(blob[:8], "little")
    values = np.frombuffer(pa.Codec("zstd").decompress(blob[8:len(blob) - size], raw, asbytes=True) if raw else b"", np.uint8)
    return (np.ascontiguousarray(values.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind),
            np.frombuffer(blob[len(blob) - size:], dtype=bool))


def _shares(kind: int, block: int, doc: np.ndarray, columns: list[np.ndarray], unseen: np.ndarray | None = None) -> dict:
    """Sums of ``columns`` by document, as a row."""
    present, place = np.unique(doc, return_inverse=True)
    sums = [np.bincount(place, c, len(present)) for c in columns]
    return {"kind": kind, "block": block, "data": _squeezed(np.concatenate([present.astype(np.float64), *sums])),
            "extra": _squeezed(unseen if unseen is not None else np.zeros(0)), "ids": None, "v": None, "w": None, "c": None}


def _pair_shares(rows: list[dict], common: Common) -> Iterator[dict]:
    """Count one bucket's bigrams in the training texts; give its table and each document's part of
    the score: tokens by discounted count, the sum of log10 count / history, and unseen ones."""
    if not rows:
        return
    width, history = len(common.hashes) + 2, common.history_counts() + LEFT
    keys, times, held, block, starts = [], [], [], [], [0]
    for i, r in enumerate(rows):
        k = _ascending(r["data"])
        t, flags = _with_flags(r["extra"], r["size"], np.uint32)
        keys.append(k)
        times.append(t)
        held.append(flags[(k & np.uint64(0xFFFF)).astype(np.int64)])
        block.append(np.full(len(k), i))
    key, time, held, block = np.concatenate(keys), np.concatenate(times).astype(np.int64), np.concatenate(held), np.concatenate(block)
    doc, pair = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
    distinct, place = np.unique(pair, return_inverse=True)
    count = np.bincount(place, np.where(held, 0, time), len(distinct)).astype(np.int64)
    v, w = (distinct // np.uint64(width)).astype(np.int64), (distinct % np.uint64(width)).astype(np.int64)
    some = count > 0
    yield {"kind": TABLE, "block": None, "data": None, "extra": None, "ids": None, "v": v[some].tolist(), "w": w[some].tolist(), "c": count[some].tolist()}
    value = np.where(some, np.log10(np.maximum(count, 1)) - np.log10(history[v]), 0.0)
    back = np.log10(common.unigram(common.counts[w]))
    c = count[place]
    order = np.argsort(block, kind="stable")
    for i, own in zip(range(len(rows)), np.split(order, np.cumsum(np.bincount(block, minlength=len(rows)))[:-1])):
        cs, ts, at = c[own], time[own], place[own]
        columns = [np.where(cs == n, ts, 0) for n in range(1, GOOD_TURING + 1)] + [value[at] * ts]
        new = own[cs == 0]
        unseen = np.concatenate([doc[new], v[place[new]], time[new], back[place[new]]]).astype(np.float64)
        yield _shares(PAIRS, rows[i]["block"], doc[own], columns, unseen)


def _rare_shares(rows: list[dict], common: Common) -> Iterator[dict]:
    """Count one bucket's rare words; give each document's sum of their unigram logarithms and the
    number of those that the training texts have."""
    if not rows:
        return
    words, docs, held, block = [], [], [], []
    for i, r in enumerate(rows):
        words.append(_ascending(r["data"]))
        d, flags = _with_flags(r["extra"], r["size"], np.uint32)
        docs.append(d.astype(np.int64))
        held.append(flags[docs[-1]])
        block.append(np.full(len(d), i))
    word, doc, held, block = (np.concatenate(x) for x in (words, docs, held, block))
    distinct, place = np.unique(word, return_inverse=True)
    count = np.bincount(place, ~held, len(distinct))
    logs = np.log10(common.unigram(count))[place]
    for i, own in zip(range(len(rows)), np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block, minlength=len(rows)))[:-1])):
        yield _shares(RARES, rows[i]["block"], doc[own], [logs[own], (count[place[own]] > 0).astype(np.float64)])


def _cold_shares(rows: list[dict], common: Common) -> Iterator[dict]:
    """Count one bucket's bigrams with a word that isn't hot, and those words; give the tables by
    history, the tokens whose backoff weight must be looked up by the history's hash, and each
    document's part of the score, as for the other bigrams, of its base and of its known tokens.

    A history that isn't hot is counted in the bucket where it is a word: there each document gets
    its -log10 count once per token, as every word but the end is the history of one token."""
    if not rows:
        return
    keys, others, tags, held, block = [], [], [], [], []
    for i, r in enumerate(rows):
        k = _ascending(r["data"])
        rest, flags = _with_flags(r["extra"], r["size"], np.uint64)
        keys.append(k)
        others.append(rest[:len(k)])
        tags.append(rest[len(k):])
        held.append(flags[(tags[-1] >> np.uint64(2)).astype(np.int64)])
        block.append(np.full(len(k), i))
    key, other, tag, held, block = (np.concatenate(x) for x in (keys, others, tags, held, block))
    doc, flag = (tag >> np.uint64(2)).astype(np.int64), (tag & np.uint64(3)).astype(np.int64)
    is_word, other_cold = flag != BY_HISTORY, flag == OTHER_COLD
    number = np.where(other_cold, 0, other).astype(np.int64)  # of the hot one
    words, word_at = np.unique(key, return_inverse=True)
    n_word = np.bincount(word_at, is_word & ~held, len(words)).astype(np.int64)
    n_second = n_word[word_at]
    if len(common.counts):
        n_second = np.where(is_word, n_second, common.counts[np.where(is_word, 0, number)])
    order = np.lexsort((flag, other, key))
    k, o, f = key[order], other[order], flag[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (f[1:] != f[:-1])])[:len(k)]
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    lead = order[new]
    count = np.bincount(place, ~held, len(lead)).astype(np.int64)
    some = lead[count > 0]
    seen_count = count[count > 0]
    hot = is_word[some] & ~other_cold[some]
    history = np.where(is_word[some], other[some], key[some]).astype(np.uint64)
    for kind, own in ((COLD_TABLE, hot), (HISTORY, ~hot)):
        if own.any():
            yield {"kind": kind, "block": None, "data": None, "extra": None, "ids": None, "v": history[own].view(np.int64).tolist(),
                   "w": n_second[some][own].tolist(), "c": seen_count[own].tolist()}
    c = count[place]
    back = np.log10(common.unigram(n_second))
    hot_history = is_word & ~other_cold
    value = np.where(c > 0, np.log10(np.maximum(c, 1)), back)
    value -= np.where((c > 0) & hot_history, np.log10(common.history_counts() + LEFT)[np.where(hot_history, number, 0)], 0.0)
    as_history = is_word & (key != np.uint64(hash_of(END))) & (n_word[word_at] > 0)
    value -= np.where(as_history, np.log10(n_word[word_at] + LEFT), 0.0)
    name = np.where(is_word, other, key).astype(np.uint64).view(np.int64)
    for i, own in zip(range(len(rows)), np.split(np.argsort(block, kind="stable"), np.cumsum(np.bincount(block, minlength=len(rows)))[:-1])):
        columns = [(c[own] == n).astype(np.float64) for n in range(1, GOOD_TURING + 1)]
        columns += [value[own], np.where(is_word[own], back[own], 0.0), (is_word[own] & (n_word[word_at[own]] > 0)).astype(np.float64)]
        unseen = own[c[own] == 0]
        near = unseen[hot_history[unseen]]
        yield _shares(COLD, rows[i]["block"], doc[own], columns, np.concatenate([doc[near], number[near]]).astype(np.float64))
        far = unseen[~hot_history[unseen]]
        if len(far):
            yield {"kind": BACK, "block": rows[i]["block"], "data": None, "extra": None, "ids": None, "v": name[far].tolist(), "w": doc[far].tolist(), "c": None}


def good_turing(counts: np.ndarray) -> np.ndarray:
    """Discount ratios of the counts 0 (unused) to GOOD_TURING from the numbers of bigrams seen 0
    (unused) to GOOD_TURING + 1 times; 1 where the numbers give no valid discount."""
    k, d = GOOD_TURING, np.ones(GOOD_TURING + 1)
    if counts[1] <= 0:
        return d
    whole = (k + 1) * counts[k + 1] / counts[1]
    for c in range(1, k + 1):
        if counts[c] > 0 and whole < 1:
            ratio = ((c + 1) * counts[c + 1] / counts[c] / c - whole) / (1 - whole)
            if 0 < ratio < 1:
                d[c] = ratio
    return d


def _history_sums(table: DataFrame, common: Common, numbered: bool) -> DataFrame:
    """(v, n1.., more, p): per history the numbers of words seen 1, 2.. times after it, the tokens of
    those seen more often, and the unigram probability of all. In the table, w is the word's number
    if ``numbered``, else its count. Summed in the tasks before the shuffle."""
    top = GOOD_TURING
    names = [*(f"n{n}" for n in range(1, top + 2)), "more", "p"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w, c = (pc.list_flatten(batch.column(x)).to_numpy() for x in ("v", "w", "c"))
            if len(v):
                present, place = np.unique(v, return_inverse=True)
                columns = [np.bincount(place, c == n, len(present)) for n in range(1, top + 2)]
                columns += [np.bincount(place, np.where(c > top, c, 0), len(present)), np.bincount(place, common.unigram(common.counts[w] if numbered else w), len(present))]
                yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), *(pa.array(x, pa.float64()) for x in columns)], ["v", *names])

    return table.select("v", "w", "c").mapInArrow(sums, "v long, " + ", ".join(f"{x} double" for x in names))


def backoff_weights(shares: DataFrame, common: Common) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(log10 weight of each numbered history, discounts, (v, weight) of the other histories) from the
    stored bigram tables. A row for each numbered history is gathered. The weights of the others
    include log10 of the history's count."""
    top = GOOD_TURING
    names = [*(f"n{n}" for n in range(1, top + 2)), "more", "p"]
    total = [F.sum(x).alias(x) for x in names]
    of = lambda kind: shares.where(F.col("kind") == kind)
    near = _history_sums(of(TABLE), common, True).unionByName(_history_sums(of(COLD_TABLE), common, False))
    found = near.groupBy("v").agg(*total).toArrow()
    far = stored(_history_sums(of(HISTORY), common, False).groupBy("v").agg(*total), "histories")
    more = far.agg(*total).first()
    n = np.array([0.0, *((pc.sum(found[f"n{c}"]).as_py() or 0.0) + (more[f"n{c}"] or 0.0) for c in range(1, top + 2))])
    discount, history = good_turing(n), common.history_counts()
    v = found["v"].to_numpy()
    mass, lower = np.zeros(len(history)), np.zeros(len(history))
    mass[v] = found["more"].to_numpy() + sum(discount[c] * c * found[f"n{c}"].to_numpy() for c in range(1, top + 1))
    lower[v] = found["p"].to_numpy()
    left = LEFT + sum(float((1 - discount[c]) * c) * F.col(f"n{c}") for c in range(1, top + 1))
    weights = far.select("v", F.log10(left / F.greatest(1 - F.col("p"), F.lit(1e-300))).alias("weight"))
    return np.log10((1 - mass / (history + LEFT)) / np.maximum(1 - lower, 1e-300)), discount, weights


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rare: float = 0.0,
                bucket_tokens: int = BUCKET_TOKENS, hot: float = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where ``held_out`` is false. ``n_known`` counts the tokens that
    the training texts have, ``train_tokens`` their tokens; ``base_score`` is the add-0.1 unigram
    log10 probability, ``score`` the model's.

    A null or empty text is one token, the end. A null in ``held_out`` counts as false. Rows may
    repeat; null ids are kept. Without training rows every word is unknown. An empty table gives
    no rows. Other columns are ignored. Texts are never cut; a block has up to 10,000 documents.

    Every bigram of the training texts is counted and used. ``hot`` only says which words' counts are
    broadcast and doesn't change the result; ``rare`` above 0 merges the words below that
    relative frequency into one history.

    Scale: three passes of linear cost, over the texts to count words and to code them, and over the
    blocks; then the tokens of unseen bigrams meet the weights of histories that aren't hot. A
    bucket's key is a hot bigram, which counts once a document, or a word that isn't hot."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    merged = rare > 0
    common = common_words(rows.where("NOT held_out"), rare if merged else hot)
    shared = spark.sparkContext.broadcast(tuple(common))
    buckets = max(1, math.ceil(common.tokens / bucket_tokens))
    id_type = rows.schema["doc_id"].dataType
    coded = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()),
                          T.StructField("size", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("extra", T.BinaryType()),
                          T.StructField("ids", T.ArrayType(id_type))])
    ints = T.ArrayType(T.LongType())
    made = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()),
                         T.StructField("extra", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)),
                         T.StructField("v", ints), T.StructField("w", ints), T.StructField("c", ints)])
    kind = pa.list_(_arrow(id_type))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = Common(*shared.value), TaskContext.get().partitionId() << 32
        for i, block in enumerate(blocks(batches, "text")):
            out = [{"bucket": b, "kind": k, "block": n, "size": block.num_rows, "data": d, "extra": e, "ids": x}
                   for b, k, n, d, e, x in _encode(block, first + i, own, buckets, merged)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("size", pa.int32()),
                                                             ("data", pa.binary()), ("extra", pa.binary()), ("ids", kind)]))

    def gather(table: pa.Table) -> pa.Table:
        own = Common(*shared.value)
        parts = {k: table.filter(pc.equal(table["kind"], k)).to_pylist() for k in (PAIRS, RARES, COLD, DOCUMENTS)}
        out = [{"kind": DOCUMENTS, "block": r["block"], "data": r["data"], "extra": r["extra"], "ids": r["ids"], "v": None, "w": None, "c": None} for r in parts[DOCUMENTS]]
        out += [*_pair_shares(parts[PAIRS], own), *_rare_shares(parts[RARES], own), *_cold_shares(parts[COLD], own)]
        longs = pa.list_(pa.int64())
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("extra", pa.binary()), ("ids", kind),
                                                    ("v", longs), ("w", longs), ("c", longs)]))

    shares = stored(rows.mapInArrow(encode, coded).groupBy("bucket").applyInArrow(gather, made), "shares", "kind")
    near, discounts, far = backoff_weights(shares, common)
    weights = spark.sparkContext.broadcast((near, discounts))
    looked_up = (shares.where(F.col("kind") == BACK).select("block", F.explode(F.arrays_zip("v", "w")).alias("x")).select("block", "x.v", F.col("x.w").alias("doc"))
                 .join(far, "v").groupBy("block", "doc").agg(F.sum("weight").alias("weight"))
                 .groupBy("block").agg(F.collect_list(F.struct("doc", "weight")).alias("x"))
                 .select("block", F.lit(BACK).alias("kind"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("extra"),
                         F.lit(None).cast(T.ArrayType(id_type)).alias("ids"), F.col("x.doc").alias("docs"), F.col("x.weight").alias("weights")))
    final = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                          T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
                          T.StructField("score", T.DoubleType())])

    def scored(table: pa.Table) -> pa.Table:
        weight, discount = weights.value
        doc_row = table.filter(pc.equal(table["kind"], DOCUMENTS)).to_pylist()[0]
        ids = doc_row["ids"]
        n = len(ids)
        held, base, n_known, n_tokens = _restored(doc_row["data"], np.float64).reshape(4, n).copy()
        histories = _restored(doc_row["extra"], np.uint32).astype(np.int64).reshape(-1, 2)
        score = np.bincount(histories[:, 0], weight[histories[:, 1]], n).astype(np.float64)
        for r in table.select(["kind", "data", "extra", "docs", "weights"]).to_pylist():
            if r["kind"] == PAIRS:
                part = _restored(r["data"], np.float64).reshape(GOOD_TURING + 2, -1)
                at = part[0].astype(np.int64)
                score[at] += part[1:-1].T @ np.log10(discount[1:]) + part[-1]
                d, v, times, back = _restored(r["extra"], np.float64).reshape(4, -1)
                score += np.bincount(d.astype(np.int64), times * (weight[v.astype(np.int64)] + back), n)
            elif r["kind"] == RARES:
                at, logs, some = _restored(r["data"], np.float64).reshape(3, -1)
                at = at.astype(np.int64)
                score[at] += logs
                base[at] += logs
                n_known[at] += some
            elif r["kind"] == COLD:
                part = _restored(r["data"], np.float64).reshape(GOOD_TURING + 4, -1)
                at = part[0].astype(np.int64)
                score[at] += part[1:GOOD_TURING + 1].T @ np.log10(discount[1:]) + part[GOOD_TURING + 1]
                base[at] += part[GOOD_TURING + 2]
                n_known[at] += part[GOOD_TURING + 3]
                d, v = _restored(r["extra"], np.float64).reshape(2, -1).astype(np.int64)
                score += np.bincount(d, weight[v], n)
            elif r["kind"] == BACK:
                score += np.bincount(np.array(r["docs"], dtype=np.int64), np.array(r["weights"]), n)
        return pa.table([pa.array(ids, _arrow(id_type)), pa.array(held > 0), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)),
                         pa.array(np.full(n, common.tokens), pa.int64()), pa.array(base), pa.array(score)], names=final.fieldNames())

    parts = shares.where(F.col("kind").isin(PAIRS, RARES, COLD, DOCUMENTS)).select(
        "block", "kind", "data", "extra", "ids", F.lit(None).cast("array<long>").alias("docs"), F.lit(None).cast("array<double>").alias("weights"))
    return parts.unionByName(looked_up).groupBy("block").applyInArrow(scored, final)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op8_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return katz_scores(docs, fold == 0)
