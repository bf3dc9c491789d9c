"""Toxicity by gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words and word stems that mark toxic documents of the training folds, by their log-likelihood
ratio, at most ``TERMS`` of them; a few insults are known from the start. Features are densities of lexicon terms (plain, and after undoing digits and signs that
stand for letters), hits near a word of the second person, and rates of capitals, punctuation, digits and
mixed words. Trees learn from folds 2 to 4, calibration from fold 1; fold 0 is held out. The samples are
bounded per class; weights restore the real shares of the classes in the calibration.

Defined cases: a null or empty text has all features zero and gets what the trees make of that; equal texts
get equal scores; rows of a null doc_id are scored, never learned from; without labels of both classes
every document gets the share of toxic ones (zero without labels). Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import boosting, lexicon, scan, store

#: Lexicon terms, labelled documents per class in the sample, words between a hit and a second person, probability from which a text is toxic.
TERMS, PER_CLASS, NEAR, TOXIC_FROM = 256, 3000, 5, 0.5

# fixed values: words of the second person, insults known from the start and their weight until one is learned, letters behind digits and signs
SECOND_PERSON = "you your yours yourself u ur thou thee du dich dir dein deine euch ihr euer tu te toi ton tes vous votre vos tú ti tus tuyo usted ustedes vosotros os".split()
INSULTS = "idiot idiots moron loser stupid dumb fool pathetic worthless disgusting trash garbage scum clown dummkopf abschaum versager imbécile crétin ordure idiota estúpido basura imbécil".split()
INSULT_WEIGHT = 3.0
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_UNDONE = scan.LOWER.copy()
for _k, _v in LOOKALIKES.items():
    _UNDONE[ord(_k)] = ord(_v)
UNDONE_VALUE = scan.BYTE_VALUE[_UNDONE]
DIGIT, CAPITAL = scan.byte_set((0x30, 0x39)), scan.byte_set((0x41, 0x5A))
LETTER = CAPITAL | scan.byte_set((0x61, 0x7A), (0x80, 0xFF))
SIGN = scan.byte_set((0x23, 0x26), (0x2A, 0x2A), (0x40, 0x40), (0x5E, 0x5F), (0x7E, 0x7E))
MARK = scan.byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
FEATURES = 22
#: Bytes of a word that stand for its inflected forms; only longer words have such a stem.
STEM = 5
_STEM_KEY = np.uint64(0x517CC1B727220A95)


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the stems, and the words they are from."""
    long = np.flatnonzero(ends - starts > STEM)
    return scan.mix(scan.run_hashes(data, starts[long], starts[long] + STEM, scan.LOWER_VALUE) ^ _STEM_KEY), long


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(scan.run_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


def _per_row(flag: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flag)]
    return (total[edge[1:]] - total[edge[:-1]]).astype(np.float64)


class Lexicon:
    def __init__(self, terms: dict[int, float]):
        terms = dict.fromkeys((int(k) for k in _hash_words(INSULTS)), INSULT_WEIGHT) | terms
        keys = np.array(sorted(terms), np.uint64)
        self.table = scan.HashTable(12)
        self.table.add(keys)
        self.weight = np.append(np.array([terms[int(k)] for k in keys], np.float64), 0.0)  # the last is for "not found"
        self.you = scan.HashTable(8)
        self.you.add(_hash_words(SECOND_PERSON))

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows = len(offs) - 1
        starts, ends = scan.runs(scan.ALNUM[data], offs)
        words = scan.run_hashes(data, starts, ends, scan.LOWER_VALUE)
        edge = scan.row_starts(starts, offs)
        at = self.table.find(words)
        hit = at >= 0
        weight = self.weight[at]
        you = self.you.find(words) >= 0
        # hits with a second person at most NEAR words away, in the same text
        reach = np.r_[0, np.cumsum(you)]
        row = np.repeat(np.arange(rows), np.diff(edge))
        hits = np.flatnonzero(hit)
        lo, hi = np.maximum(hits - NEAR, edge[row[hits]]), np.minimum(hits + NEAR + 1, edge[row[hits] + 1])
        near = np.zeros(len(words), bool)
        near[hits] = reach[hi] > reach[lo]
        t_starts, t_ends = scan.runs(scan.ALNUM[data] | (data == 0x40) | (data == 0x24), offs)
        t_edge = scan.row_starts(t_starts, offs)
        undone = self.table.find(scan.run_hashes(data, t_starts, t_ends, UNDONE_VALUE)) >= 0
        plain = self.table.find(scan.run_hashes(data, t_starts, t_ends, scan.LOWER_VALUE)) >= 0
        letter, digit, capital = LETTER[data], DIGIT[data], CAPITAL[data]
        sign = SIGN[data]
        has = lambda flag, a, b: np.r_[0, np.cumsum(flag)][b] > np.r_[0, np.cumsum(flag)][a]
        mixed = has(letter, t_starts, t_ends) & has(digit | sign, t_starts, t_ends)
        loud = ~has(letter & ~capital, starts, ends) & (ends - starts > 1) & has(capital, starts, ends)
        n = np.maximum(np.diff(edge), 1).astype(np.float64)
        size = np.maximum(np.diff(offs), 1).astype(np.float64)
        letters = np.maximum(_per_row(letter, offs), 1)
        # distinct terms and the heaviest of each text
        both = np.unique(np.stack([row[hits], at[hits]]), axis=1) if len(hits) else np.zeros((2, 0), np.int64)
        distinct = np.bincount(both[0], minlength=rows).astype(np.float64)
        heaviest = np.zeros(rows)
        np.maximum.at(heaviest, row[hits], weight[hits])
        stem, of = _stems(data, starts, ends)
        stem_at = self.table.find(stem)
        stem_hit, stem_row = stem_at >= 0, row[of]
        stem_edge = np.searchsorted(of, edge)
        stems, stem_sum = _per_row(stem_hit, stem_edge), np.bincount(stem_row, self.weight[stem_at], rows)
        stem_most = np.zeros(rows)
        np.maximum.at(stem_most, stem_row[stem_hit], self.weight[stem_at][stem_hit])
        count, summed, close = _per_row(hit, edge), np.bincount(row, weight, rows), _per_row(near, edge)
        hidden = _per_row(undone & ~plain, t_edge)
        out = [
            count, 1000 * count / n, distinct, summed, 1000 * summed / n, heaviest, close, 1000 * close / n, hidden, _per_row(you, edge) / n,
            _per_row(capital, offs) / letters, _per_row(loud, edge) / n, _per_row(MARK[data], offs) / size, _per_row(data == 0x21, offs) / size,
            _per_row(sign, offs) / size, _per_row(digit, offs) / size, _per_row(mixed, t_edge) / n, np.log1p(np.diff(offs)),
            stems, 1000 * stems / n, 1000 * stem_sum / n, stem_most,
        ]
        return np.round(np.stack(out, axis=1), 9)


@dataclass
class Model:
    lexicon: Lexicon
    trees: boosting.Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offs) - 1, self.knots[1][0])
        margin = self.trees.margin(self.lexicon.features(data, offs))
        return np.clip(np.round(np.interp(margin, *self.knots), 9), 0, 1)


def _terms(texts: DataFrame, counts: dict[int, int], most: int) -> dict[int, float]:
    """Terms of toxic documents by their log-likelihood ratio; documents are counted, not occurrences."""

    def run(batches):
        for batch in batches:
            labels = np.array(batch.column(0))
            for lo, hi, data, offs in scan.slices(batch.column(1)):
                starts, ends = scan.runs(scan.ALNUM[data], offs)
                words = scan.run_hashes(data, starts, ends, scan.LOWER_VALUE)
                edge = scan.row_starts(starts, offs)
                stem, of = _stems(data, starts, ends)
                stem_edge = np.searchsorted(of, edge)
                once = [np.unique(np.concatenate([words[a:b], stem[c:d]])) for a, b, c, d in zip(edge[:-1], edge[1:], stem_edge[:-1], stem_edge[1:], strict=True)]
                toxic = np.repeat(labels[lo:hi], [len(x) for x in once])
                terms, at = np.unique(np.concatenate(once), return_inverse=True)
                both = np.bincount(at, minlength=len(terms))
                bad = np.bincount(at, toxic, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(both - bad)], ["term", "toxic", "clean"])

    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = counts[1] / (counts[0] + counts[1])
    expected = (t + c) * F.lit(share)
    ratio = t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0.0)
    weight = F.log((t + 0.5) / F.lit(counts[1] + 1.0)) - F.log((c + 0.5) / F.lit(counts[0] + 1.0))
    summed = texts.select("label", "text").mapInArrow(run, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = summed.where((t >= 3) & (weight > 1)).select("term", weight.alias("weight"), F.round(ratio, 6).alias("ratio")).orderBy(F.desc("ratio"), "term").limit(most)
    return {r.term & ((1 << 64) - 1): r.weight for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, terms: int = TERMS) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    chosen = store.written(lexicon.sample(labels.select("doc_id", "toxic"), "toxic", per_class))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (lexicon.fold() != 0))
    real = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = store.written(lexicon.with_text(docs, chosen))  # bounded by the sample
    taken = {(r.label, r.learn): r.n for r in texts.groupBy("label", (F.col("fold") > 1).alias("learn")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {label: taken.get((label, True), 0) for label in (0, 1)}
    if not counts[0] or not counts[1]:
        share = real.get(1, 0) / max(sum(real.values()), 1)
        return Model(Lexicon({}), None, (np.zeros(1), np.array([share])))
    words = Lexicon(_terms(texts.where("fold > 1"), counts, terms))
    sent = spark.sparkContext.broadcast(words)  # at most ``terms`` entries

    def per_slice(data, offs, _):
        x = sent.value.features(data, offs)
        return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))}

    found = scan.map_text(texts, per_slice, "doc_id long, label int, fold int, x array<double>", keep=["doc_id", "label", "fold"]).collect()
    found.sort(key=lambda r: (r.doc_id, r.x))
    x, y, fold = np.array([r.x for r in found]), np.array([r.label for r in found], np.float64), np.array([r.fold for r in found])
    learn, even = fold > 1, fold == 1
    trees = boosting.fit(x[learn], y[learn], np.ones(int(learn.sum())))
    if len(set(y[even])) < 2:
        even = np.ones(len(y), bool)
    # each class weighs as much as it has labels
    part = {label: real[label] / max(float((y[even] == label).sum()), 1) for label in (0, 1)}
    weight = np.where(y[even] > 0, part[1], part[0])
    knots = boosting.isotonic(trees.margin(x[even]), y[even], weight)
    return Model(words, trees, knots)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def per_slice(data, offs, _):
        s = sent.value.score(data, offs)
        return {"score": s, "predicted": (s >= TOXIC_FROM).astype(np.int32)}

    made = scan.map_text(store.spread(docs.select("doc_id", "text")), per_slice, "doc_id long, score double, predicted int", keep=["doc_id"])
    return made.select("doc_id", lexicon.held_out().alias("held_out"), "score", "predicted")
