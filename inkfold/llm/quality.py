"""Text quality by supervised subword embeddings.

A document is the bag of its words (runs without white space) and their character n-grams, word borders
included; a word equal to the one before it adds one shared word. Each of them is hashed to a row of one
embedding table. The rows of a document (and a few silent ones) are averaged and a softmax layer turns the average into two
probabilities. Table and layer are trained together by stochastic gradient descent in numpy on a bounded, balanced sample of
labelled documents; the bias is then moved to the classes' real shares. As the layer is linear, scoring
needs one number a row (its embedding along the difference of the two outputs).

Defined cases: a null or empty text has no features and gets the score of the bias alone; documents of equal text
get equal scores; rows of a null doc_id are scored, never learned from; without labels of both classes every
document gets the share of good ones (0.5 without labels). Only doc_id and text are read; ``keep`` passes all columns through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import lexicon, scan, store

#: Hashed rows, dimension, n-gram lengths in bytes; labelled documents per class in the sample.
BITS, DIM, NGRAMS, PER_CLASS = 17, 16, (3, 4, 5), 2000
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Silent features that every document has besides: a text of a few words stays near the bias.
SILENT = 40
REJECT_BELOW = 0.3
_AGAIN = scan.mix(np.array([0x5EED], np.uint64))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features of all texts, and where each text's begin."""
    shift = np.uint64(64 - BITS)
    starts, ends = scan.runs(scan.NOT_SPACE[data], offs)
    words = scan.run_hashes(data, starts, ends)
    first = scan.row_starts(starts, offs)
    again = np.r_[False, words[1:] == words[:-1]] if len(words) else np.zeros(0, bool)
    inner = first[(first > 0) & (first < len(words))]
    again[inner] = False
    # texts with a space on either side of each word border: n-grams hold one space at most, at an end
    n, rows = len(data), len(offs) - 1
    padded = np.full(n + rows + 1, 32, np.uint8)
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    padded[np.arange(n) + row_of + 1] = data
    padded[~scan.NOT_SPACE[padded]] = 32
    space = padded == 32
    begin = offs + np.arange(rows + 1)  # of the space before each text
    code = scan.BYTE_VALUE[padded]
    parts = [(words, first)]
    for size in NGRAMS:
        m = len(padded) - size + 1
        if m <= 0:
            continue
        h, blank = np.zeros(m, np.uint64), np.zeros(m, bool)
        for j in range(size):
            h = h * np.uint64(scan.BASE) + code[j : j + m]
            if 0 < j < size - 1:
                blank |= space[j : j + m]
        at = np.flatnonzero(~blank & ~(space[:m] & space[size - 1 :]))
        parts.append((scan.mix(h[at] + np.uint64(size)), np.searchsorted(at, begin)))
    twice = np.flatnonzero(again)
    parts.append((np.repeat(_AGAIN, len(twice)), np.searchsorted(twice, first)))
    # one text after the other, kind by kind within a text
    lens = np.stack([np.diff(f) for _, f in parts])
    to = np.r_[0, np.cumsum(lens.sum(axis=0))]
    out, done = np.empty(int(to[-1]), np.uint64), np.zeros(rows, np.int64)
    for (h, f), k in zip(parts, lens, strict=True):
        out[scan.ragged(to[:-1] + done, k)] = h[f[0] : f[-1]]
        done += k
    return (out >> shift).astype(np.int64), to


@dataclass
class Model:
    """``weight`` of each table row along the difference of the outputs, and ``bias``."""

    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows, at = features(data, offs)
        total = np.r_[0.0, np.cumsum(self.weight[rows])]
        n = np.diff(at)
        mean = (total[at[1:]] - total[at[:-1]]) / (n + SILENT)
        return np.round(1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30))), 9)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float) -> Model:
    """Stochastic gradient descent over documents given as (table rows, how often each)."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            rows, part = bags[i]
            if not len(rows):
                continue
            hidden = part @ table[rows]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            # a row's gradient is its part of the document; the factor makes up for the mean's small parts
            table[rows] -= (rate * np.minimum(part * 50, 1))[:, None] * back
    balanced = float(np.mean(labels))
    prior = np.log(share / (1 - share)) - np.log(balanced / (1 - balanced))
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]) + prior)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    spread = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (lexicon.fold() != 0))
    share = spread.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    chosen = lexicon.sample(labels.select("doc_id", "quality"), "quality", per_class)

    def per_slice(data, offs, _):
        rows, at = features(data, offs)
        made = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            kinds, count = np.unique(rows[a:b], return_counts=True)
            made.append(kinds.astype("<i4").tobytes() + (count / (b - a + SILENT)).astype("<f4").tobytes())
        return {"bag": pa.array(made, pa.binary())}

    found = scan.map_text(lexicon.with_text(docs, chosen), per_slice, "doc_id long, label int, bag binary", keep=["doc_id", "label"]).collect()
    found.sort(key=lambda r: (r.doc_id, zlib.crc32(r.bag)))
    y = np.array([r.label for r in found], np.int64)
    if not len(y) or y.min() == y.max():
        share = min(max(0.5 if share is None else share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    bags = []
    for r in found:
        n = len(r.bag) // 8
        bags.append((np.frombuffer(r.bag, "<i4", n), np.frombuffer(r.bag, "<f4", n, 4 * n)))  # views, not copies
    return fit(bags, y, min(max(share, 1e-3), 1 - 1e-3))


def score(docs: DataFrame, model: Model, threshold: float = REJECT_BELOW) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def per_slice(data, offs, _):
        s = sent.value.score(data, offs)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    made = scan.map_text(store.spread(docs.select("doc_id", "text")), per_slice, "doc_id long, score double, predicted int", keep=["doc_id"])
    return made.select("doc_id", lexicon.held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, threshold: float = REJECT_BELOW) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scan.filter_text(store.spread(docs), lambda data, offs: sent.value.score(data, offs) >= threshold)
