"""Language identification with a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; learned transitions say how likely the
language changes from word to word. Forward-backward gives each word's probability of each
language, so code-switched texts get a label a word; a document's language is the one with the
largest share of its words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents a language that the model is fitted on: the bound of the training sample.
SAMPLE = 100
DIMENSIONS = 1 << 16
SEGMENT = 64
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of text handled at a time and words whose scores a worker remembers.
SLICE_CHARS, REMEMBERED = 500_000, 150_000


def words_in(text: str | None) -> list[str]:
    """Runs of letters in lower case; numerals like those of fractions, which ``_WORD`` lets in, part them."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for own in found for w in "".join(c if c.isalpha() else " " for c in own).split()]


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    return (((values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, word) of all features of all words: affixes of up to 4 letters, n-grams of 2
    and 3 with borders, and the word itself, hashed in vectorised form."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(size + 2) - size - 1  # place of each word's first letter between its borders
    marked = np.zeros(size.sum() + 2 * n, dtype=np.uint64)
    inside = np.ones(len(marked), dtype=bool)
    inside[first - 1] = inside[first + size] = False
    marked[inside], marked[first - 1], marked[first + size] = letters, 1, 2
    owner, step = np.repeat(np.arange(n), size + 2), np.uint64(0x100000001B3)
    ids, owners = [], []
    gram = marked
    for k in (1, 2):
        gram = gram[:-1] * step + marked[k:]
        whole = owner[:-k] == owner[k:]
        ids.append(_mixed(gram[whole], k))
        owners.append(owner[:-k][whole])
    for salt, begin, way in ((10, first, 1), (20, first + size - 1, -1)):
        affix = np.zeros(n, dtype=np.uint64)
        for k in range(4):
            own = np.flatnonzero(size > k)
            affix[own] = affix[own] * step + marked[begin[own] + way * k]
            ids.append(_mixed(affix[own], salt + k))
            owners.append(own)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    powers = np.cumprod(np.full(size.max(), step, dtype=np.uint64), dtype=np.uint64)
    ids.append(_mixed(np.add.reduceat(letters * powers[place], np.cumsum(size) - size), 30))
    owners.append(np.arange(n))
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Model:
    """Weights of the features (each row a feature, each column a language), lexicon weights and
    transitions; ``lexicon`` has the frequent words of the sample by language."""

    languages: list
    weights: np.ndarray
    lexicon: dict
    lexicon_weight: float
    transitions: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        ids, owner = feature_rows(words)
        out = np.stack([np.bincount(owner, self.weights[ids, j], len(words)) for j in range(len(self.languages))], axis=1)
        for i, w in enumerate(words):
            if w in self.lexicon:
                out[i, self.lexicon[w]] += self.lexicon_weight
        return out


def forward_backward(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains of equal length, emit (chains, steps, labels), and expected transitions."""
    n, steps, labels = emit.shape
    a = np.exp(trans - trans.max())
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(1, keepdims=True)
    pairs = np.zeros_like(a)
    for t in range(steps - 2, -1, -1):
        ahead = e[:, t + 1] * beta[:, t + 1]
        x = ahead @ a.T
        beta[:, t] = x / x.sum(1, keepdims=True)
        both = alpha[:, t, :, None] * a * ahead[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), pairs


def fit(texts: list[str], labels: list, epochs: int = 25, rate: float = 0.5, penalty: float = 1e-4, chain: int = 192, run: int = 32,
        seed: int = 7) -> Model:
    """Fit by Adagrad on the conditional likelihood. Training chains are put together from runs of
    words of documents in random order, so that the transitions learn changes of language."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    words, labelled = [], []
    for text, label in zip(texts, labels):
        own = words_in(text)
        words += own
        labelled += [number[label]] * len(own)
    if not words:
        return Model(languages, np.zeros((DIMENSIONS, max(1, len(languages)))), {}, 0.0, np.zeros((max(1, len(languages)),) * 2))
    rng = np.random.default_rng(seed)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, gold = np.array([vocabulary[w] for w in words]), np.array(labelled)
    chain, k = min(chain, len(ids)), len(languages)
    runs = [np.arange(i, min(i + run, len(ids))) for i in range(0, len(ids), run)]
    order = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    order = np.resize(order, -(-len(order) // chain) * chain).reshape(-1, chain)
    x, y = ids[order], gold[order]
    counts = Counter(zip(words, labelled))
    totals = Counter(words)
    lexicon = {w: label for (w, label), n in counts.items() if n >= 5 and n >= 0.95 * totals[w]}
    flat, owner = feature_rows(list(vocabulary))
    used, flat = np.unique(flat, return_inverse=True)
    in_lexicon = np.array([lexicon.get(w, -1) for w in vocabulary])
    w, trans, lex = np.zeros((len(used), k)), np.zeros((k, k)), 0.0
    gw, gt, gl = np.full((len(used), 1), 1e-6), np.full((k, k), 1e-6), 1e-6
    tokens = x.size
    onehot = np.eye(k)[y]
    observed = np.zeros((k, k))
    np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for _ in range(epochs):
        emit = np.stack([np.bincount(owner, w[flat, j], len(vocabulary)) for j in range(k)], axis=1)
        emit[in_lexicon >= 0, in_lexicon[in_lexicon >= 0]] += lex
        gamma, pairs = forward_backward(emit[x], trans)
        wrong = (onehot - gamma).reshape(-1, k)
        miss = np.stack([np.bincount(x.ravel(), wrong[:, j], len(vocabulary)) for j in range(k)], axis=1)
        dw = np.stack([np.bincount(flat, miss[owner, j], len(used)) for j in range(k)], axis=1)
        dw = dw / tokens - penalty * w
        dt = (observed - pairs) / tokens - penalty * trans
        dl = miss[in_lexicon >= 0, in_lexicon[in_lexicon >= 0]].sum() / tokens - penalty * lex
        gw += (dw * dw).mean(1, keepdims=True)
        gt += dt * dt
        gl += dl * dl
        w += rate * dw / np.sqrt(gw)
        trans += rate * dt / np.sqrt(gt)
        lex += rate * dl / np.sqrt(gl)
    weights = np.zeros((DIMENSIONS, k), dtype=np.float32)
    weights[used] = w
    return Model(languages, weights, lexicon, float(lex), trans)


def chain_marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals (words, labels) of chains that follow each other in ``emit``, of any lengths.

    Chains are cut into segments of ``SEGMENT`` words that are worked through side by side: first
    each segment's transfer matrix, then the message at each segment's ends along the chains, then
    forward and backward inside the segments. The result is that of the plain recursion."""
    total, k = emit.shape
    a = np.exp(trans - trans.max())
    per = -(-lengths // SEGMENT)
    chain_of = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    rank = np.arange(len(chain_of)) - first[chain_of]
    begin = (np.cumsum(lengths) - lengths)[chain_of] + rank * SEGMENT
    size = np.minimum(SEGMENT, lengths[chain_of] - rank * SEGMENT)
    e = np.exp(emit - emit.max(1, keepdims=True))
    grid = begin[:, None] + np.arange(SEGMENT)
    inside = np.arange(SEGMENT) < size[:, None]
    grid = np.where(inside, grid, 0)
    es = np.where(inside[:, :, None], e[grid], 1.0)
    move = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t in range(SEGMENT):
        live = inside[:, t]
        x = (move[live] @ a) * es[live, t][:, None, :]
        move[live] = x / x.max((1, 2), keepdims=True)
    ahead, behind = np.full((len(begin), k), 1.0 / k), np.ones((len(begin), k))
    deepest = int(per.max()) if len(per) else 0
    for r in range(1, deepest):
        at = np.flatnonzero(rank == r)
        x = np.einsum("ni,nij->nj", ahead[at - 1], move[at - 1])
        ahead[at] = x / x.sum(1, keepdims=True)
    last = per[chain_of] - 1
    for r in range(deepest - 2, -1, -1):
        at = np.flatnonzero((rank == r) & (rank < last))
        x = np.einsum("nij,nj->ni", move[at + 1], behind[at + 1])
        behind[at] = x / x.sum(1, keepdims=True)
    # a chain's first word has no transition before it: start from a message that a uniform vector would give
    start = np.linalg.lstsq(a.T, np.full(k, 1.0 / k), rcond=None)[0]
    ahead[rank == 0] = start
    for r in range(1, deepest):
        at = np.flatnonzero(rank == r)
        x = np.einsum("ni,nij->nj", ahead[at - 1], move[at - 1])
        ahead[at] = x / x.sum(1, keepdims=True)
    alpha = np.empty((len(begin), SEGMENT, k))
    message = ahead
    for t in range(SEGMENT):
        x = (message @ a) * es[:, t]
        message = np.where(inside[:, t][:, None], x / x.sum(1, keepdims=True), message)
        alpha[:, t] = message
    gamma = np.empty((total, k))
    message = behind
    for t in range(SEGMENT - 1, -1, -1):
        live = inside[:, t]
        x = alpha[live, t] * message[live]
        gamma[grid[live, t]] = x / x.sum(1, keepdims=True)
        x = (message * es[:, t]) @ a.T
        message = np.where(live[:, None], x / x.sum(1, keepdims=True), message)
    return gamma


class Labeller:
    """Labels the words of texts; remembers the scores of words that it has met."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((1024, len(model.languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            at = len(known)
            while at + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at:at + len(fresh)] = self.model.scores(fresh)
            known.update(zip(fresh, range(at, at + len(fresh))))
        return self.table[[known[w] for w in words]]

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """(words, marginals of the languages) of each text."""
        words = [words_in(t) for t in texts]
        lengths = np.array([len(w) for w in words])
        flat = [w for own in words for w in own]
        if not flat or not self.model.languages:
            return [(w, np.zeros((len(w), len(self.model.languages)))) for w in words]
        full = lengths > 0
        gamma = chain_marginals(self.emissions(flat), lengths[full], self.model.transitions)
        ends = np.cumsum(lengths)
        return [(w, gamma[e - len(w):e]) for w, e in zip(words, ends)]


def sample_of(docs: DataFrame, label_col: str = "lang", text_col: str = "text", per_label: int = SAMPLE) -> list:
    """Up to ``per_label`` labelled texts a language, those with the smallest digests."""
    marked = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.xxhash64(text_col).alias("h"))
    order = Window.partitionBy("label").orderBy("h")
    chosen = marked.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("label", "h")
    texts = docs.select(F.col(label_col).alias("label"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return sorted((r["label"], r["text"]) for r in texts.join(F.broadcast(chosen), ["label", "h"]).dropDuplicates(["label", "h"]).collect())


def fit_language_model(docs: DataFrame, label_col: str = "lang", text_col: str = "text", per_label: int = SAMPLE) -> Model:
    rows = sample_of(docs, label_col, text_col, per_label)
    return fit([t for _, t in rows], [label for label, _ in rows])


def identify_languages(docs: DataFrame, model: Model, text_col: str = "text", passed: tuple[str, ...] = ("doc_id",),
                       found_cols: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``passed`` columns, then lang_pred and score, named ``found_cols``.

    ``score`` is the share of the words' probability that lang_pred has. A text that is null or has
    no letters gets ``und`` and 0; so does every text if the model has no languages. Ties go to the
    first language in order. Rows are mapped one to one, whole texts in bounded slices."""
    names = [*passed]
    own = text_col in names and docs.schema[text_col].dataType.simpleString() == "string"
    at_text = names.index(text_col) if own else len(names)  # a text that is passed on isn't sent twice

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            texts = batch.column(at_text)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            found = []
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < SLICE_CHARS):
                    chars += sizes[to]
                    to += 1
                for words, gamma in labeller.label(texts.slice(at, to - at).to_pylist()):
                    if len(words) and model.languages:
                        share = gamma.mean(0)
                        best = int(share.argmax())
                        found.append((model.languages[best], min(1.0, float(share[best]))))
                    else:
                        found.append(("und", 0.0))
                at = to
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())], [*names, *found_cols])

    columns = docs.select(*names, *([] if own else [F.col(text_col).cast("string").alias("__text")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:len(names)])
    return columns.mapInArrow(predict, f"{fields}, `{found_cols[0]}` string, `{found_cols[1]}` double")


def fold(c: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % of


def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs.where(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    return (identify_languages(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"))
