"""Language ID by a string kernel.

A text's blended spectrum is the set of its byte n-grams of several lengths (ASCII letters lower-cased, other ASCII
than letters a space), hashed into a fixed number of places. The kernel of two texts is the number of places both
have, over the root of the product of their numbers. Nyström landmarks (a bounded sample of training texts) turn it
into features, and one ridge regression for each language (that language or not) weighs them. Scoring multiplies a
batch's presence matrix with the landmarks' and the weights. A long text is scored in windows that together cover all of it, and
its margins are the windows' means by length: the set of a whole long text would fill most places, whatever its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import SAMPLE_DOCS, sample

#: Places of the n-grams of each length.
PLACES = {1: 256, 2: 4096, 3: 8192, 4: 8192}
WIDTH = sum(PLACES.values())
LANDMARKS = 192
RIDGE = 1e-3
SHARPNESS = 6.0
#: Texts of a presence matrix, and bytes of a window.
BATCH = 256
WINDOW = 4096
UNDETERMINED = "und"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def windows(text: bytes) -> list[bytes]:
    """The text in runs of equal length up to WINDOW; each goes on a little, so that no n-gram is cut."""
    count = max(1, -(-len(text) // WINDOW))
    size = -(-len(text) // count)
    return [text[i * size : (i + 1) * size + max(PLACES) - 1] for i in range(count)]


def presence(texts: list[bytes]) -> np.ndarray:
    """A row for each text, 1 in the places its n-grams have; the whole text counts."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
        code, base = np.zeros(len(b), np.uint32), 0
        for n, places in PLACES.items():
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] << np.uint32(8) | b[n - 1 :]
            place = code if n == 1 else code * np.uint32(2654435761) >> np.uint32(32 - places.bit_length() + 1)
            row[base + place.astype(np.int64)] = 1
            base += places
    return out


class StringKernel:
    """Landmarks and weights of the languages."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.landmarks, self.weights, self.bias = languages, landmarks, weights, bias

    @staticmethod
    def _kernel(x: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        return x @ scaled.T / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    @classmethod
    def fit(cls, texts: list[bytes], languages: list[str], seed: int = 0) -> "StringKernel":
        """Learns from the texts and from short runs of them."""
        rng = np.random.default_rng(seed)
        names = sorted(set(languages))
        if not names:
            return cls([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
        runs, y = [], []
        for text, lang in zip(texts, languages, strict=True):
            own = windows(text)
            runs.append(own[int(rng.integers(0, len(own)))])
            size = int(np.exp(rng.uniform(np.log(12), np.log(400))))
            at = int(rng.integers(0, max(1, len(text) - size)))
            runs.append(text[at : at + size])
            y += [lang, lang]
        where = {lang: np.flatnonzero([v == lang for v in y]) for lang in names}
        each = max(1, LANDMARKS // len(names))
        marks = np.concatenate([rng.choice(i, min(each, len(i)), replace=False) for i in where.values()])
        landmarks = presence([runs[i] for i in marks])
        landmarks /= np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[:, None]
        kernel = np.concatenate([cls._kernel(presence(runs[i : i + BATCH]), landmarks) for i in range(0, len(runs), BATCH)])
        value, vector = np.linalg.eigh((landmarks > 0).astype(np.float64) @ landmarks.T.astype(np.float64) / np.sqrt((landmarks > 0).sum(axis=1))[:, None])
        keep = value > 1e-6 * value.max()
        whiten = vector[:, keep] / np.sqrt(value[keep])
        phi = kernel @ whiten
        target = np.array([[1.0 if v == lang else -1.0 for lang in names] for v in y])
        weight = 1 / np.array([len(where[v]) for v in y])  # languages count alike
        weight /= weight.mean()
        mid, aim = np.average(phi, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
        centred = (phi - mid) * np.sqrt(weight)[:, None]
        ridge = RIDGE * len(y) * np.eye(phi.shape[1])
        w = np.linalg.solve(centred.T @ centred + ridge, centred.T @ ((target - aim) * np.sqrt(weight)[:, None]))
        return cls(names, landmarks, (whiten @ w).astype(np.float32), (aim - mid @ w).astype(np.float32))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the softmax over all."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        parts = [windows(t) for t in texts]
        flat = [w for own in parts for w in own]
        margin = np.concatenate(
            [np.zeros((0, len(self.languages)), np.float32)]
            + [self._kernel(presence(flat[i : i + BATCH]), self.landmarks) @ self.weights + self.bias for i in range(0, len(flat), BATCH)]
        ).astype(np.float64)
        if len(texts):  # windows of a text are of one length, so their mean is by length
            count = np.array([len(own) for own in parts])
            margin = np.add.reduceat(margin, np.cumsum(count) - count, axis=0) / count[:, None]
        share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        return [self.languages[b] for b in best], share[np.arange(len(texts)), best]


def fit_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE_DOCS) -> StringKernel:
    """Fits on a bounded sample of the rows for which train holds and whose language is not null.

    An id that is repeated counts once, with its largest language and its least text; null ids and texts are left out, very long texts give a run of
    bounded length. Without any row the model finds no language. Other columns may have any name.
    """
    rows = docs.where(train).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    found, _ = sample(rows.select("doc_id", "text"), rows.select("doc_id", "label"), size)
    return StringKernel.fit([t.encode() for t in found["text"]], found["label"].tolist())


def language(model: StringKernel, text: Column) -> Column:
    """A struct of lang_pred and score of a text; ``und`` with score 0 for null and for texts without a letter.

    Of equally likely languages the first by name counts; repeated rows get the same; very long texts are scored whole, in windows; an
    empty table gives nothing.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0}, index=batch.index)
            known = batch.notna().to_numpy()
            lang, score = model.predict([t.encode() for t in batch[known]])
            out.loc[known, "lang_pred"], out.loc[known, "score"] = lang, score
            yield out

    return predict(F.when(text.rlike(r"\p{L}"), text))
