"""Averaged hashed embeddings with a softmax on top, trained by stochastic gradient descent in numpy.

A text is the average of the embeddings of its features (hashed words and byte n-grams), and its class scores are linear
in that average. Training sees a bounded sample of labelled rows as hashed counts, counted on the executors. A trained
model is folded into one table, bucket x class, so that scoring a text is a count of its buckets and one product."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column
from .hashing import BYTE, SEGMENT, word_hashes

#: Buckets of each feature kind.
BUCKETS = 4096
#: Width of words_and_ngrams().
WORDS_AND_NGRAMS = 2 * BUCKETS + 2
#: ASCII letters in lower case, other ASCII as a space, bytes of other characters as they are.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:128] = 32
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)


def _ngrams(text: np.ndarray, sizes: tuple[int, ...], counts: np.ndarray) -> None:
    """Adds the byte n-grams of each size to counts, piece by piece."""
    for at in range(0, len(text), SEGMENT):
        value = BYTE[text[at : at + SEGMENT + max(sizes) - 1]]
        total, n = value, 1
        for size in sizes:
            while n < size and len(value) > n:
                total = total[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[n:]
                n += 1
            if len(value) >= size:
                own = total[: min(len(total), SEGMENT)]
                counts += np.bincount(((own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)


def letter_ngrams(text: np.ndarray) -> np.ndarray:
    """Counts of 2-, 3- and 4-byte grams over letters and the spaces between words."""
    counts = np.zeros(BUCKETS, np.int64)
    _ngrams(LETTERS[text], (2, 3, 4), counts)
    return counts


def words_and_ngrams(text: np.ndarray) -> np.ndarray:
    """Counts of words, of 1-, 2- and 3-byte grams, and of two pseudo-words: one beside each word that equals the word before
    it, one beside each that equals a word 2 to 8 before it."""
    counts = np.zeros(WORDS_AND_NGRAMS, np.int64)
    words = word_hashes(text, False)
    counts[:BUCKETS] = np.bincount((words >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    _ngrams(text, (1, 2, 3), counts[BUCKETS : 2 * BUCKETS])
    again = np.zeros(len(words), bool)
    for back in range(1, min(9, len(words))):
        again[back:] |= words[back:] == words[:-back]
        if back == 1:
            counts[-2] = again.sum()
    counts[-1] = again.sum() - counts[-2]
    return counts


def _shares(counts: np.ndarray) -> np.ndarray:
    """Each text's counts as shares of its features."""
    return (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Model:
    """classes: the label values; table: bucket x class; bias, and the temperature fitted on rows kept from training."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = field(default=0.0)

    def probabilities(self, shares: np.ndarray) -> np.ndarray:
        return softmax((shares @ self.table + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, labels: list, width: int = 16, epochs: int = 40, batch: int = 64, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent with per-weight step sizes over shuffled batches. A fifth of the rows stays out of it and
    gives the temperature (least log loss) and the floor: the score under which a prediction is rejected, set so that 99 %
    of right predictions pass. No rows give a model without classes."""
    classes = sorted(set(labels))
    if not classes:
        return Model([], np.zeros((counts.shape[1], 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    x, y = _shares(counts), np.array([classes.index(v) for v in labels])
    scale = 1 / np.maximum(x.std(axis=0), 1e-4)
    order = rng.permutation(len(y))
    out, use = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    embed = rng.normal(0, 0.1, (x.shape[1], width)).astype(np.float32)
    head, bias = np.zeros((width, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    past = [np.full(p.shape, 1e-6, np.float32) for p in (embed, head, bias)]
    for epoch in range(epochs):
        step = rate * 0.1 * (1 - epoch / epochs)
        for at in range(0, len(use), batch):
            rows = rng.choice(use, min(batch, len(use)), replace=False) if epoch else use[at : at + batch]
            part = x[rows] * scale
            hidden = part @ embed
            error = softmax(hidden @ head + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            slopes = (part.T @ (error @ head.T) + 1e-6 * embed, hidden.T @ error + 1e-5 * head, error.sum(axis=0))
            if not epoch and not at:
                head = rng.normal(0, 0.1, head.shape).astype(np.float32)
            for weight, slope, square in zip((embed, head, bias), slopes, past, strict=True):
                square += slope * slope
                weight -= (step * slope / np.sqrt(square)).astype(np.float32)
    model = Model(classes, (scale[:, None] * (embed @ head)).astype(np.float32), bias)
    logits = x[out] @ model.table + model.bias
    loss = [(-np.log(softmax(logits / t)[np.arange(len(out)), y[out]] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 41)]
    model.temperature = float(min(loss)[1])
    chance = softmax(logits / model.temperature)
    right = chance.argmax(axis=1) == y[out]
    model.floor = float(np.quantile(chance.max(axis=1)[right], 0.01)) if right.any() else 0.0
    return model


def _count(features: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            at, value = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                counts = features(data[a:b])
                used = np.flatnonzero(counts)
                at.append(used.astype(np.int32))
                value.append(counts[used].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.int32()))], ["label", "at", "value"])

    return run


def gather(rows: DataFrame, features: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, list]:
    """The counts and labels of rows (text, label), whose number the caller has bounded, in an order of their own."""
    kind = dict(rows.dtypes)["label"]
    found = rows.select("text", "label").mapInArrow(_count(features), f"label {kind}, at array<int>, value array<int>").toArrow()
    got = [(label, np.array(at, np.int64), np.array(value, np.float32)) for label, at, value in zip(*(found.column(c).to_pylist() for c in ("label", "at", "value")), strict=True)]
    got.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))
    counts = np.zeros((len(got), width), np.float32)
    for row, (_, at, value) in zip(counts, got, strict=True):
        row[at] = value
    return counts, [label for label, _, _ in got]


def sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` of the rows, or all if there are fewer, chosen by a hash of their id: the same rows however dealt."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))


def scorer(model: Model, features: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """The class probabilities of one text."""

    def run(text: np.ndarray) -> np.ndarray:
        counts = features(text)
        used = np.flatnonzero(counts)
        share = counts[used] / max(int(counts.sum()), 1)
        return softmax(((share @ model.table[used] + model.bias) / model.temperature)[None, :])[0]

    return run
