"""Toxicity (operator 4): a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is the sum of what it says as a word and as characters: a hashed word vector beside the mean of the hashed
vectors of its character n-grams. A gated recurrent network reads a window of words in both directions, attention
pools its states, and a document's score is that of its most toxic window; windows overlap and cover the whole
text. The network is trained here, on the driver, on a bounded sample of labelled rows; scoring is one pass over the
documents, with the windows of a batch of documents side by side.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_columns, with_id

#: Labelled rows of each label that the network learns from, at most; those of the smallest hashes of doc_id. Of these,
#: texts with more characters than that aren't learned from, so that the driver's share has a bound.
MAX_LABELLED = 1_200
MAX_LABELLED_CHARS = 50_000
#: Rows with this remainder of crc32(doc_id) by FOLDS are never learned from.
FOLDS, HELD_OUT = 5, 0

#: Characters of a word; of the pieces of a longer run, and those that a piece shares with the next.
LONGEST, PIECE, SHARED = 64, 16, 4

#: Words of a window, and of the step to the next.
LENGTH, STEP = 32, 24

WORD_BUCKETS, WORD_SIZE = 8192, 8
GRAM_BUCKETS, GRAM_SIZE = 16384, 16
GRAMS = (3, 4)
HIDDEN = 8

STEPS, DOCS_PER_STEP, RATE, SHARPNESS = 300, 32, 0.01, 3.0

#: Distinct words whose inputs a worker remembers, windows and new words that are computed side by side, words whose inputs
#: are hashed at once, words that wait to be scored together, and characters from which a text is read in parts. None of
#: them changes a score.
REMEMBERED = 150_000
SIDE_BY_SIDE = 512
LEARNED_AT_ONCE = 8_192
WAITING = 50_000
PART = 1_000_000

_EDGES = string.punctuation + "¡«»¿‘’“”…"


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, those of all their n-grams one word after the other, and the number of n-grams of each.

    A token of punctuation alone is kept as it is; a word shorter than an n-gram is one n-gram, zeros after it.
    """
    cores = [w.strip(_EDGES) or w for w in words]
    raw = [c.encode("utf-8", "replace") for c in cores]
    own = np.array([xxhash.xxh32_intdigest(r, 1) % WORD_BUCKETS for r in raw], np.int64)
    size = np.array([len(r) + 2 for r in raw], np.int64)
    text = np.frombuffer(b"<" + b">\0<".join(raw) + b">\0" + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    place = np.arange(size.sum() + len(size)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)  # within its word
    last = np.repeat(size, size + 1)
    buckets, there = [], []
    for n in GRAMS:
        key = np.full(len(place), n, np.uint64)
        for k in range(n):
            key = key << np.uint64(8) | text[k : k + len(place)]
        key *= np.uint64(0x9E3779B97F4A7C15)
        buckets.append((key >> np.uint64(32)) % np.uint64(GRAM_BUCKETS))
        there.append(place <= np.maximum(0, last - n))
    grams = np.stack(buckets, axis=1)[np.stack(there, axis=1)].astype(np.int64)
    return own, grams, sum(np.maximum(1, size - n + 1) for n in GRAMS)


def _pieces(runs: Iterator[str]) -> Iterator[str]:
    for w in runs:
        if len(w) <= LONGEST:
            yield w
        else:
            yield from (w[i : i + PIECE] for i in range(0, len(w) - SHARED, PIECE - SHARED))


def words_of(text: str) -> list[str]:
    """Lower-case words of a text; a run longer than LONGEST, as in scripts without spaces, in overlapping pieces."""
    words = text.lower().split()
    return words if max(map(len, words), default=0) <= LONGEST else list(_pieces(iter(words)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(1, n - (LENGTH - STEP)), STEP) if n else np.empty(0, np.int64)


def laid_out(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, LENGTH) of word indices, -1 beyond a text's end, and each text's number of windows."""
    counts, rows = [], [np.empty((0, LENGTH), np.int64)]
    for x in ids:
        starts = windows_of(len(x))
        counts.append(len(starts))
        if len(starts):
            padded = np.full(starts[-1] + LENGTH, -1, np.int64)
            padded[: len(x)] = x[: len(padded)]
            rows.append(padded[starts[:, None] + np.arange(LENGTH)])
    return np.concatenate(rows), np.array(counts, np.int64)


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """np.matmul(x, w), but always added up in the same order: no row of it depends on the rows beside it."""
    x, w = np.ascontiguousarray(np.swapaxes(x, -1, -2))[..., None, :], w[..., None]
    out = x[..., 0, :, :] * w[..., 0, :, :]
    for i in range(1, w.shape[-3]):
        out += x[..., i, :, :] * w[..., i, :, :]
    return np.swapaxes(out, -1, -2)


class Network:
    """Weights, and what is computed from them. Arrays with a leading 2 are of the two directions."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        size = WORD_SIZE + GRAM_SIZE
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "words": draw(WORD_BUCKETS, WORD_SIZE, scale=0.1), "grams": draw(GRAM_BUCKETS, GRAM_SIZE, scale=0.3),
            "input": draw(2, size, 3 * HIDDEN, scale=size**-0.5), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32), "state": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "base": np.full(1, -1, np.float32),
        }

    def inputs(self, word: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Vectors of words; gram holds the buckets of all n-grams one word after the other, n their number in each."""
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        return np.concatenate([self.w["words"][word], np.add.reduceat(self.w["grams"][gram], starts) / n[:, None]], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(2, words, 3 * HIDDEN): what a word adds to the gates."""
        parts = [_product(x[None, k : k + SIDE_BY_SIDE], self.w["input"]) + self.w["bias"] for k in range(0, len(x), SIDE_BY_SIDE)]
        return np.concatenate([np.empty((2, 0, 3 * HIDDEN), np.float32), *parts], axis=1)

    def states(self, gates: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(LENGTH, windows, 2 * HIDDEN) for windows `at` of indices into gates; keep gets what the way back needs."""
        b = len(at)
        there = (at >= 0).astype(np.float32)
        h = np.zeros((2, b, HIDDEN), np.float32)
        out = np.empty((LENGTH, b, 2 * HIDDEN), np.float32)
        for t in range(LENGTH):
            pair = (t, LENGTH - 1 - t)
            gx = np.stack([gates[d][at[:, p]] for d, p in enumerate(pair)])  # beyond a text's end it is any column's, and isn't used
            gh = _product(h, self.w["state"])
            rz = _sigmoid(gx[..., : 2 * HIDDEN] + gh[..., : 2 * HIDDEN])
            reset, update = rz[..., :HIDDEN], rz[..., HIDDEN:]
            new = np.tanh(gx[..., 2 * HIDDEN :] + reset * gh[..., 2 * HIDDEN :])
            m = np.stack([there[:, p] for p in pair])[..., None]
            if keep is not None:
                keep.append((h, gh[..., 2 * HIDDEN :], reset, update, new, m))
            h = np.where(m > 0, h + (1 - update) * (new - h), h)
            out[pair[0], :, :HIDDEN], out[pair[1], :, HIDDEN:] = h[0], h[1]
        return out

    def pooled(self, states: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights, pooled states and logits of the windows."""
        a = np.where(at.T >= 0, (states * self.w["attend"]).sum(axis=2), -1e9)
        a = np.exp(a - a.max(axis=0))
        a /= np.ascontiguousarray(a.T).sum(axis=1)  # in one order, even where there is one window
        c = (a[..., None] * states).sum(axis=0)
        return a, c, (c * self.w["out"]).sum(axis=1) + self.w["base"][0]

    def logits(self, gates: np.ndarray, at: np.ndarray) -> np.ndarray:
        parts = [at[k : k + SIDE_BY_SIDE] for k in range(0, len(at), SIDE_BY_SIDE)]
        return np.concatenate([np.empty(0, np.float32), *(self.pooled(self.states(gates, p), p)[2] for p in parts)])

    def gradients(self, word, gram, n, at, counts, labels, weights) -> dict[str, np.ndarray]:
        """Of the weighted log loss of documents, each the soft maximum of its windows; every document has a window."""
        w, keep = self.w, []
        x = self.inputs(word, gram, n)
        states = self.states(self.gates(x), at, keep)
        a, c, z = self.pooled(states, at)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        of = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(SHARPNESS * (z - np.maximum.reduceat(z, first)[of]))
        total = np.add.reduceat(e, first)
        doc = np.maximum.reduceat(z, first) + np.log(total) / SHARPNESS
        dz = ((_sigmoid(doc) - labels) * weights / len(counts))[of] * e / total[of]

        g = {"out": c.T @ dz, "base": np.array([dz.sum()])}
        dc = dz[:, None] * w["out"]
        da = np.einsum("tbh,bh->tb", states, dc)
        da = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", da, states)
        ds = a[..., None] * dc[None] + da[..., None] * w["attend"]

        g["state"] = np.zeros_like(w["state"])
        dgates = np.zeros((2, len(word), 3 * HIDDEN))
        flows = np.empty((2, LENGTH, len(at), 3 * HIDDEN), np.float32)
        dh = np.zeros((2, len(at), HIDDEN), np.float32)
        back = w["state"].transpose(0, 2, 1)
        for t in reversed(range(LENGTH)):
            h, ghn, reset, update, new, m = keep[t]
            dh = dh + np.stack([ds[t, :, :HIDDEN], ds[LENGTH - 1 - t, :, HIDDEN:]])
            dn = m * dh * (1 - update) * (1 - new**2)
            du = m * dh * (h - new) * update * (1 - update)
            dr = dn * ghn * reset * (1 - reset)
            flows[0, t] = np.concatenate([dr[0], du[0], dn[0]], axis=1)
            flows[1, LENGTH - 1 - t] = np.concatenate([dr[1], du[1], dn[1]], axis=1)
            dgh = np.concatenate([dr, du, dn * reset], axis=2)
            g["state"] += np.matmul(h.transpose(0, 2, 1), dgh)
            dh = dh * (1 - m * (1 - update)) + np.matmul(dgh, back)
        flat = at.T.ravel()
        real = np.flatnonzero(flat >= 0)
        order = real[np.argsort(flat[real], kind="stable")]
        starts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        for d in range(2):
            dgates[d][flat[order][starts]] = np.add.reduceat(flows[d].reshape(-1, 3 * HIDDEN)[order], starts)
        g["input"] = np.matmul(x.T[None], dgates)
        g["bias"] = dgates.sum(axis=1, keepdims=True)
        dx = np.matmul(dgates, w["input"].transpose(0, 2, 1)).sum(axis=0)
        g["words"] = np.stack([np.bincount(word, dx[:, k], WORD_BUCKETS) for k in range(WORD_SIZE)], axis=1)
        spread = np.repeat(dx[:, WORD_SIZE:] / n[:, None], n, axis=0)
        g["grams"] = np.stack([np.bincount(gram, spread[:, k], GRAM_BUCKETS) for k in range(GRAM_SIZE)], axis=1)
        return g


def _indexed(texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(t, len(known)) for t in x], np.int64) for x in texts]
    return ids, *word_inputs(list(known))


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> Network | None:
    """A network for labels 0 and 1; without both, none: then nothing is toxic."""
    words = [words_of(t) for t in texts]
    y = np.array([k for k, w in zip(labels, words, strict=True) if w], np.float32)
    words = [w for w in words if w]
    if len(set(y.tolist())) < 2:
        return None
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)  # both labels count alike
    net, r = Network(), np.random.default_rng(2)
    mean = {k: np.zeros_like(v, np.float32) for k, v in net.w.items()}
    square = {k: np.zeros_like(v, np.float32) for k, v in net.w.items()}
    order = np.concatenate([r.permutation(len(words)) for _ in range(1 + steps * DOCS_PER_STEP // len(words))])
    for step in range(1, steps + 1):
        own = order[(step - 1) * DOCS_PER_STEP : step * DOCS_PER_STEP]
        ids, word, gram, n = _indexed([words[i] for i in own])
        at, counts = laid_out(ids)
        g = net.gradients(word, gram, n, at, counts, y[own], weight[own])
        rate = RATE * (1 - (step - 1) / steps)
        for name, d in g.items():
            mean[name] += 0.1 * (d - mean[name])
            square[name] += 0.01 * (d * d - square[name])
            net.w[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
    return net


class Scorer:
    """A network with the inputs of the words that were met lately."""

    def __init__(self, net: Network | None):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((2, 4096, 3 * HIDDEN), np.float32)

    def learn(self, words: Iterable[str]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        start = len(self.known)
        if start + len(new) > self.table.shape[1]:
            larger = np.zeros((2, 2 * (start + len(new)), 3 * HIDDEN), np.float32)
            larger[:, :start] = self.table[:, :start]
            self.table = larger
        for k in range(0, len(new), LEARNED_AT_ONCE):
            some = new[k : k + LEARNED_AT_ONCE]
            self.table[:, start + k : start + k + len(some)] = self.net.gates(self.net.inputs(*word_inputs(some)))
        self.known.update(zip(new, range(start, start + len(new)), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Of each whole text: that of its highest window; without words 0."""
        if self.net is None:
            return [0.0] * len(texts)
        best = np.full(len(texts), -np.inf)
        todo: list[list[str]] = []
        of: list[int] = []

        def flush() -> None:
            if len(self.known) > REMEMBERED:
                self.forget()
            self.learn(chain.from_iterable(todo))
            at, counts = laid_out([np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in todo])
            if len(at):
                np.maximum.at(best, np.repeat(np.array(of, np.int64), counts), self.net.logits(self.table, at))
            todo.clear()
            of.clear()

        waiting = 0
        for i, text in enumerate(texts):
            for words in parts_of(text or ""):
                todo.append(words)
                of.append(i)
                waiting += len(words)
                if waiting > WAITING:
                    flush()
                    waiting = 0
        flush()
        return (1 / (1 + np.exp(-np.clip(best, -700, 700))) * np.isfinite(best)).tolist()


_RUN = re.compile(r"\S+")


def parts_of(text: str) -> Iterator[list[str]]:
    """The words of a text; of a very long one in parts whose windows are together those of the whole text."""
    if len(text) < PART:
        if words := words_of(text):
            yield words
        return
    more = _pieces(m[0].lower() for m in _RUN.finditer(text))
    words: list[str] = []
    whole = True
    while new := list(islice(more, max(LENGTH, PART // 8))):
        words += new
        if full := max(0, (len(words) - (LENGTH - STEP)) // STEP):
            yield words[: full * STEP + LENGTH - STEP]
            words, whole = words[full * STEP :], False
    if whole and words or len(words) > LENGTH - STEP:
        yield words


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network from at most MAX_LABELLED labelled documents of each label, of MAX_LABELLED_CHARS each at most; they are
    all that reaches the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    first = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for k in (0, 1)]
    sample = with_id(documents, id_col, text_col).where(F.length("text") <= MAX_LABELLED_CHARS)
    sample = sample.join(F.broadcast(first[0].union(first[1])), "doc_id")  # 2 * MAX_LABELLED ids at most
    rows = sample.groupBy("doc_id", "label").agg(F.max("text").alias("text")).collect()
    rows = sorted((r for r in rows if r.text), key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.label for r in rows])


def toxicity_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents.

    held_out marks the rows that are never learned from. Null texts and texts without words score 0. Rows that repeat are
    scored each; a null id is scored too and is not held out; other columns are ignored. Without labels of both kinds
    every score is 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, id_col, text_col, label_col))
    scorers: list[Scorer] = []

    def run(ids: list, texts: list) -> dict:
        if not scorers:
            scorers.append(Scorer(shared.value))
        return {"doc_id": ids, "score": scorers[0].scores(texts)}

    scored = map_columns(with_id(documents, id_col, text_col), run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
