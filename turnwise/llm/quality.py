"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text falls into a bin; a score is the sum of one table entry per feature and per chosen pair of
features. The tables are learnt by cyclic boosting: feature after feature, a shallow tree over the bins is fitted to what
the others leave unexplained and a small part of it is added to the feature's table; then the pairs likewise.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FEATURES = ("words", "word_length", "distinct_words", "symbols", "repeated_lines", "doubled_words", "commonest_word", "punctuation", "digits", "capitals", "line_words")
#: Labelled rows the model is fitted on at most; those with the least hash of their id are taken.
MOST_TRAINING_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.15, 4
#: Added to a leaf's weight, so that leaves of few rows say little.
SHRINK = 4.0
SYMBOLS, MARKS = b"#*$%&|<>", b".,;:!?"


def features(text: str) -> list[float]:
    """The feature vector of a whole text; an empty text has zeros."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = len(raw)
    return [math.log1p(n), (size - n) / n, len(counts) / n, math.sqrt((size - len(raw.translate(None, SYMBOLS))) / n), 1 - len(set(lines)) / len(lines),
            sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n, (size - len(raw.translate(None, MARKS))) / n,
            (size - len(raw.translate(None, b"0123456789"))) / size, (size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n, math.log1p(n / len(lines))]


@dataclass
class Model:
    """Bin edges per feature, a table per feature, coarser edges and a table per pair."""
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of feature vectors, by table look-ups and additions."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _gain(g, h):
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with up to `leaves` leaves over ordered bins with gradients g and weights h."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            won = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            i = int(won.argmax())
            if won[i] > best[0]:
                best = (float(won[i]), k, a + i + 1)
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of the best tree that cuts one axis once and each side on the other axis once."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[side].sum(axis=0), hh[side].sum(axis=0)
                values = _tree(sg, sh, 2)
                out[side] = values
                gain += float((values * sg).sum())
            if gain > best[0]:
                best = (gain, out.T if flip else out)
    return best[1], best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from feature rows x and labels y (0 or 1). Without rows every score is 0.5."""
    n = len(y)
    rate = (y.sum() + 1) / (n + 2) if n else 0.5
    model = Model(math.log(rate / (1 - rate)), [_edges(x[:, f], BINS) for f in range(len(FEATURES))], [], [_edges(x[:, f], PAIR_BINS) for f in range(len(FEATURES))], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not n or rate in (0, 1):
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(n, model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = gradients()
            step = RATE * _tree(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), LEAVES)
            table += step
            total += step[bins[f]]
    wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]

    def cells(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[f] * width[g] + wide[g], v, width[f] * width[g]).reshape(width[f], width[g])

    g, h = gradients()
    every = [(a, b) for a in range(len(FEATURES)) for b in range(a + 1, len(FEATURES)) if width[a] > 1 and width[b] > 1]
    model.pairs = sorted(every, key=lambda p: (-_tree2(cells(*p, g), cells(*p, h))[1], p))[:PAIRS]
    model.pair_tables = [np.zeros((width[a], width[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            step = RATE * _tree2(cells(a, b, g), cells(a, b, h))[0]
            table += step
            total += step[wide[a], wide[b]]
    return model


def _vectors(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def is_held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_TRAINING_ROWS) -> Model:
    """A model from the labelled rows that are not held out, at most `most_rows` of them."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "quality").limit(most_rows))
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *[pa.array(x[:, i]) for i in range(len(FEATURES))]],
                                             ["doc_id", "quality", *[f"f{i}" for i in range(len(FEATURES))]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = joined.mapInArrow(run, f"doc_id {kind}, quality int, {names}").toPandas().sort_values(["doc_id", "quality"] + [f"f{i}" for i in range(len(FEATURES))])
    return fit(rows[[f"f{i}" for i in range(len(FEATURES))]].to_numpy(float), (rows["quality"].to_numpy() == 1).astype(float))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null text scores as an empty one. Repeated rows score alike; no rows give no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_vectors(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
