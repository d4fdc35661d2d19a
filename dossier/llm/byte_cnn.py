"""Quality classifier: a byte-level convolutional network, fitted and scored by numpy.

Bytes become learned vectors; learned filters read windows of WINDOW bytes at every second place. A document is
covered whole by chunks of CHUNK bytes, each overlapping the next by half. Each filter is max-pooled over a chunk;
the chunks' pools are combined over the document by mean, maximum and minimum, and a small layer gives one probability.
A filter cannot see that a word comes again, but few different windows give low pools, which the layer can use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import SAMPLE_DOCS, sample

WINDOW, STRIDE, CHUNK = 8, 2, 512
HALF = CHUNK // 2
WIDTH, FILTERS, HIDDEN = 8, 48, 24
EPOCHS, STEPS, BATCH, RATE = 24, 40, 32, 3e-3
#: Bytes of a run that training uses at most, and of one in eight runs.
LONG, LONGEST = 2048, 8192
#: Bytes that the scorer holds as vectors at a time; longer documents are pooled piece by piece.
PIECE = 1 << 19


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each filled with a window of zero bytes at least to whole half chunks, and the half chunks of each."""
    halves = np.array([-(-(len(t) + WINDOW) // HALF) for t in texts], np.int64)
    buffer = np.zeros(int(halves.sum()) * HALF + WINDOW, np.uint8)
    at = 0
    for t, h in zip(texts, halves, strict=True):
        buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(h) * HALF
    return buffer, halves


class ByteCNN:
    """The parameters and what is done with them."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "bytes": normal(256, WIDTH, scale=1.0),
            "filters": normal(WINDOW * WIDTH, FILTERS, scale=(WINDOW * WIDTH) ** -0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "w1": normal(3 * FILTERS + 1, HIDDEN, scale=(3 * FILTERS) ** -0.5),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, scale=HIDDEN**-0.5),
            "b2": np.zeros(1, np.float32),
        }
        self.p["bytes"][0] = 0
        self.rng = rng

    def half_pools(self, buffer: np.ndarray, halves: np.ndarray, place: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter over the windows that begin in each half chunk, and where (if asked).

        Windows that would reach into the next text are left out; the filling before them is all they have of their own.
        """
        n = int(halves.sum())
        last = np.zeros(n, bool)
        last[np.cumsum(halves) - 1] = True
        pools, where = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int64)
        for at in range(0, n, PIECE // HALF):
            k = min(PIECE // HALF, n - at)
            x = self.p["bytes"][buffer[at * HALF : (at + k) * HALF + WINDOW]]
            for phase in range(0, WINDOW, STRIDE):
                rows = x[phase : phase + k * HALF].reshape(k * HALF // WINDOW, WINDOW * WIDTH)
                out = (rows @ self.p["filters"]).reshape(k, HALF // WINDOW, FILTERS)
                if phase:
                    out[last[at : at + k], -1] = -np.inf
                if place:
                    arg = out.argmax(axis=1)
                    top = np.take_along_axis(out, arg[:, None, :], axis=1)[:, 0]
                    better = top > pools[at : at + k]
                    start = (np.arange(at, at + k) * HALF)[:, None] + arg * WINDOW + phase
                    where[at : at + k] = np.where(better, start, where[at : at + k])
                else:
                    top = out.max(axis=1)
                np.maximum(pools[at : at + k], top, out=pools[at : at + k])
        return pools, where if place else None

    def document_features(self, pools: np.ndarray, halves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict]:
        """Mean, maximum and minimum over the chunks of each document, and its length's logarithm."""
        last = np.cumsum(halves) - 1
        left = np.arange(len(pools))
        left[last[halves > 1]] -= 1  # the last half chunk has no next one; it is the second half of its chunk
        right = left + (np.repeat(halves, halves) > 1)
        second = pools[right] > pools[left]
        active = np.maximum(np.maximum(pools[left], pools[right]) + self.p["shift"], 0)
        first = np.cumsum(halves) - halves
        mean = np.add.reduceat(active, first, axis=0) / halves[:, None]
        top = np.maximum.reduceat(active, first, axis=0)
        low = np.minimum.reduceat(active, first, axis=0)
        z = np.concatenate((mean, top, low, np.log1p(lengths)[:, None].astype(np.float32) / 8), axis=1)
        return z, {"active": active, "top": top, "low": low, "half": np.where(second, right[:, None], left[:, None])}

    def head(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(z @ self.p["w1"] + self.p["b1"], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["b2"], -30, 30))), h

    def score(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text; the whole text counts."""
        if not texts:
            return np.zeros(0)
        buffer, halves = padded(texts)
        pools, _ = self.half_pools(buffer, halves)
        z, _ = self.document_features(pools, halves, np.array([len(t) for t in texts]))
        return self.head(z)[0].astype(np.float64)

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        buffer, halves = padded(texts)
        pools, where = self.half_pools(buffer, halves, place=True)
        z, kept = self.document_features(pools, halves, np.array([len(t) for t in texts]))
        prob, h = self.head(z)
        g: dict[str, np.ndarray] = {}
        d = ((prob - y) / len(y)).astype(np.float32)
        g["w2"], g["b2"] = h.T @ d, d.sum(keepdims=True)
        dh = d[:, None] * self.p["w2"] * (h > 0)
        g["w1"], g["b1"] = z.T @ dh, dh.sum(axis=0)
        dz = dh @ self.p["w1"].T
        doc = np.repeat(np.arange(len(halves)), halves)
        active = kept["active"]
        dc = dz[doc, :FILTERS] / halves[doc, None]
        for k, name in enumerate(("top", "low"), 1):
            hit = (active == kept[name][doc]).astype(np.float32)
            ties = np.add.reduceat(hit, np.cumsum(halves) - halves, axis=0)
            dc += dz[doc, k * FILTERS : (k + 1) * FILTERS] * hit / ties[doc]
        dc *= active > 0
        g["shift"] = dc.sum(axis=0)
        half = kept["half"]
        i, f = np.nonzero(dc)
        start, v = where[half[i, f], f], dc[i, f].astype(np.float32)
        window = buffer[start[:, None] + np.arange(WINDOW)]
        g["filters"], g["bytes"] = np.zeros_like(self.p["filters"]), np.zeros_like(self.p["bytes"])
        filters = self.p["filters"].reshape(WINDOW, WIDTH, FILTERS)
        for k in range(WINDOW):
            b = window[:, k]
            by_filter = np.zeros((256, FILTERS), np.float32)
            np.add.at(by_filter, (b, f), v)
            g["filters"].reshape(WINDOW, WIDTH, FILTERS)[k] = self.p["bytes"].T @ by_filter
            g["bytes"] += by_filter @ filters[k].T
        g["bytes"][0] = 0
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, odds: float = 1.0, epochs: int = EPOCHS) -> "ByteCNN":
        """Adam on random runs of the texts, as many of either label; odds: of label 1 in the rows to be scored.

        Runs of label 1 may be short, as any part of a good text is good; runs of label 0 keep to longer parts.
        """
        each = [np.flatnonzero(y == c) for c in (0, 1)]
        if not len(each[0]) or not len(each[1]):
            self.p["w2"][:] = 0
            self.p["b2"][:] = np.float32(-4 if len(each[0]) else 4)
            return self
        m, v, step = dict.fromkeys(self.p, 0), dict.fromkeys(self.p, 0), 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for _ in range(STEPS):
                pick = np.concatenate([self.rng.choice(e, BATCH // 2) for e in each])
                g = self.gradients([self._run(texts[i], bool(y[i])) for i in pick], y[pick])
                step += 1
                for k, own in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * own
                    v[k] = 0.999 * v[k] + 0.001 * own * own
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                    if k in ("w1", "w2", "filters"):
                        self.p[k] *= 1 - rate * 0.01
        self.p["b2"] += np.float32(np.log(np.clip(odds, 0.05, 20)))
        return self

    def _run(self, text: bytes, good: bool) -> bytes:
        whole = min(len(text), LONGEST if self.rng.random() < 0.125 else LONG)
        if not good:
            size = max(whole // 2, int(self.rng.integers(whole // 2, whole + 1)))
        elif self.rng.random() < 0.5:
            size = whole
        else:
            size = int(np.exp(self.rng.uniform(np.log(min(4, whole + 1)), np.log(whole + 1))))
        at = int(self.rng.integers(0, len(text) - min(size, len(text)) + 1))
        return text[at : at + size]


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size: int = SAMPLE_DOCS) -> ByteCNN:
    """Fits on a bounded sample of the labelled rows for which train (of the id) holds.

    Rows with a null id, text or label, or a label that is neither 0 nor 1, are left out; an id that is repeated counts once, with its
    largest label and its least text; very long texts give a run of bounded length. Without rows of both labels, the model gives every text the
    chance of the label that there is. Other columns may have any name.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(train).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    found, counts = sample(texts, known.where(F.col("label").isin(0, 1)), size)
    odds = counts.get(1, 0) / max(1, counts.get(0, 0))
    return ByteCNN().fit([t.encode() for t in found["text"]], found["label"].to_numpy(np.float32), odds)


def quality(model: ByteCNN, text: Column) -> Column:
    """The probability of label 1 of a text; null counts as empty, and an empty text has one too. Rows are scored one by one: repeated ones
    score the same, very long texts are read whole, piece by piece, and an empty table gives none."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out, at, held = [(t or "").encode() for t in batch], np.zeros(len(batch)), 0, 0
            for i, t in enumerate(texts):  # a few megabytes of text at a time
                held += len(t)
                if held >= PIECE or i + 1 == len(texts):
                    out[at : i + 1] = model.score(texts[at : i + 1])
                    at, held = i + 1, 0
            yield pd.Series(out, index=batch.index)

    return score(text)
