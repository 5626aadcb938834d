"""Quality rules (operator 10): boosted trees over document statistics.

Statistics of whole texts feed gradient-boosted trees that are trained here, in numpy, on a bounded sample of
labelled rows, and flattened into node arrays: a batch of documents walks all trees at once, one level a step.
Chosen features are monotone: more symbols, repeated lines, repeated words, capitals or exclamation marks never
raise a document's quality, whatever the sample says. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_columns, window_hashes, with_id, word_hashes

#: Labelled rows that the trees learn from, at most; those of the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: Rows with this remainder of crc32(doc_id) by FOLDS are left out of the sample, to measure the trees on.
FOLDS, HELD_OUT = 5, 0

TREES, DEPTH, BINS, RATE, PENALTY = 40, 3, 32, 0.3, 1.0

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features in the order of statistics(), each with the sign of its constraint (0: none).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "digits": 0, "stops": 0, "shouts": -1, "distinct_words": 0, "line_length": 0, "beyond_ascii": 0}

_SPACES = [9, 10, 11, 12, 13, 32]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the features of FEATURES, of a whole text; of no text, zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0] * len(COUNTS), [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(by[0x80:0xC0].sum())
    word_chars = chars - int(by[_SPACES].sum())
    symbols = int(by[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    hashes = word_hashes(words)
    n = len(words)
    repeats = 0
    windows = window_hashes(hashes)
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            again = np.zeros(len(windows), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[: len(windows)] += again
            edge[n + 1 - len(windows) :] -= again
            repeats = int((np.cumsum(edge) > 0).sum())
    letters = int(by[65:91].sum() + by[97:123].sum())
    features = [
        np.log1p(n), word_chars / n, symbols / word_chars, dup_lines / len(lines), repeats / n, int(by[65:91].sum()) / max(1, letters),
        int(by[48:58].sum()) / word_chars, int(by[[44, 46, 58, 59, 63]].sum()) / n, int(by[33]) / n, len(set(words)) / n, np.log1p(n / len(lines)), int(by[0x80:].sum()) / len(raw),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], [float(x) for x in features]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Trees for labels y (0 or 1); without both labels, no tree and a constant verdict."""
    nodes: list[list] = []
    roots: list[int] = []
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1 - 1e-3
    bias = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        logit = np.full(len(y), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            roots.append(_grown(nodes, binned, edges, y - p, p * (1 - p), signs, np.arange(len(y)), logit, DEPTH, -np.inf, np.inf))
    table = nodes or [[0, 0.0, 0, 0, 0.0]]
    feature, limit, left, right, value = (np.array(c) for c in zip(*table, strict=True))
    return Trees(feature.astype(np.int64), limit.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float), np.array(roots, np.int64), bias)


def _grown(nodes: list[list], binned, edges, g, h, signs, rows, logit, depth: int, low: float, high: float) -> int:
    """Adds the node of rows and what is below it; low and high bound its values so that constraints hold."""
    at = len(nodes)
    value = min(max(g[rows].sum() / (h[rows].sum() + PENALTY), low), high)
    nodes.append([0, 0.0, at, at, RATE * value])
    best = (1e-6, None)
    if depth:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, sign in enumerate(signs):
            if not len(edges[f]):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            a = np.clip(left_g / (left_h + PENALTY), low, high)
            b = np.clip(right_g / (right_h + PENALTY), low, high)
            gain = 2 * (a * left_g + b * right_g - value * total_g) - (a**2 * (left_h + PENALTY) + b**2 * (right_h + PENALTY) - value**2 * (total_h + PENALTY))
            gain[(left_h < 1) | (right_h < 1) | (sign * (b - a) < 0)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, a[k], b[k]))
    if best[1] is None:
        logit[rows] += RATE * value
        return at
    f, k, a, b = best[1]
    goes = binned[rows, f] <= k
    middle = (a + b) / 2
    bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
    nodes[at][:2] = [f, edges[f][k]]
    nodes[at][2] = _grown(nodes, binned, edges, g, h, signs, rows[goes], logit, depth - 1, *bounds[0])
    nodes[at][3] = _grown(nodes, binned, edges, g, h, signs, rows[~goes], logit, depth - 1, *bounds[1])
    return at


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from at most MAX_LABELLED labelled rows; only those rows' statistics reach the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = with_id(documents, id_col, text_col).join(F.broadcast(known), "doc_id")  # MAX_LABELLED rows at most

    def run(ids: list, texts: list, of: list) -> dict:
        return {"doc_id": ids, "label": of, "features": [statistics(t)[1] for t in texts]}

    rows = map_columns(sample.select("doc_id", "text", "label"), run, "doc_id long, label int, features array<double>").orderBy("doc_id").limit(MAX_LABELLED).collect()
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r.label for r in rows], float), list(FEATURES.values()))


def quality_verdicts(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, counts of COUNTS, base_failed, kept, score) for each row of documents.

    kept is false where the base rules fail (fewer than 10 words, or over a fifth of the words in repeated windows),
    else whether the trees' score is at least 0.5. Null and empty texts have no words, so they fail. Repeated rows
    each get their verdict; rows without an id too; other columns are ignored. Without labels of both kinds, the
    base rules decide alone.
    """
    trees = fit(documents, labels, id_col, text_col, label_col)

    def run(ids: list, texts: list) -> dict:
        return {"doc_id": ids} | judged(trees, texts)

    columns = ", ".join(f"{c} long" for c in COUNTS)
    return map_columns(with_id(documents, id_col, text_col), run, f"doc_id long, {columns}, base_failed boolean, kept boolean, score double")


def judged(trees: Trees, texts: list[str | None]) -> dict:
    counts, features = zip(*map(statistics, texts), strict=True)
    scores = trees.scores(np.array(features, float))
    failed = [base_failed(c[0], c[4]) for c in counts]
    kept = [not f and bool(s >= 0.5) for f, s in zip(failed, scores, strict=True)]
    return dict(zip(COUNTS, zip(*counts, strict=True), strict=True)) | {"base_failed": failed, "kept": kept, "score": scores}
