"""I-Match fingerprints: hashes of a document's distinct mid-frequency terms over randomised lexicon subsets.

The lexicon holds the terms (runs of letters and digits, ASCII case ignored) whose document frequency lies within
a band: at least ``RARE`` and at most ``COMMON`` of all documents. The lower edge is a share of the corpus, so
the lexicon has at most (distinct terms of an average document) / RARE terms however large the corpus is, and can be sent to
every task. ``LEVELS`` x ``SETS`` subsets keep each term with a chance of 1 / level. A document's distinct terms in a
subset, sorted, are hashed to 32 bits; no term gives zero. The fingerprint is all of these hashes in hex.

Likeness of two fingerprints: of the subsets of a level in which either document has a term, the share with equal
hashes; the highest of the levels with ``ENOUGH`` such subsets, else over all subsets; 1 if both fingerprints are zero.

Defined cases: a null text is an empty one; equal texts have equal fingerprints; rows of equal doc_id follow their texts' hashes
(descending) in the order of documents; null doc_ids come last in that order; a single row is its own next one; an empty
table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import scan, store

RARE, COMMON = 1 / 2000, 1 / 20
LEVELS, SETS, ENOUGH = (4, 16, 64, 256, 1024), 16, 6
#: Distinct terms that a task sums up before it sends them on; ranges of doc_id per shuffle partition.
HELD, SPLIT = 1 << 20, 8
_SALT = scan.mix(np.arange(1, len(LEVELS) * SETS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ORDER = 0xE7037ED1A0B428DB


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = scan.runs(scan.ALNUM[data], offs)
    return scan.run_hashes(data, starts, ends, scan.LOWER_VALUE), scan.row_starts(starts, offs)


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> np.ndarray:
    """Sorted term hashes of the band."""

    def run(batches):
        terms, times, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged():
            keys, at = np.unique(np.concatenate([terms, *parts]), return_inverse=True)
            weight = np.concatenate([times, np.ones(len(at) - len(times), np.int64)])
            return keys, np.bincount(at, weight, len(keys)).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(times)], ["term", "n"])

        for batch in batches:
            for _, _, data, offs in scan.slices(batch.column(0)):
                words, edge = _terms(data, offs)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(edge)).astype(np.uint64)
                order = np.lexsort((words, row))
                w, r = words[order], row[order]
                new = np.r_[True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])] if len(w) else np.zeros(0, bool)
                parts.append(w[new])
                if sum(map(len, parts)) >= HELD:
                    terms, times = merged()
                    parts = []
                    if len(terms) >= HELD:
                        yield rows()
                        terms, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        terms, times = merged() if parts else (terms, times)
        yield rows()

    total = docs.count()
    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") >= total * rare) & (F.col("n") <= max(total * common, 1))).select("term")
    return np.sort(np.array([r.term for r in band.collect()], np.int64).view(np.uint64))


class Fingerprinter:
    def __init__(self, terms: np.ndarray):
        self.table = scan.HashTable(max(12, int(2 * len(terms)).bit_length()))
        self.table.add(terms)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """One row of 32-bit hashes per text."""
        rows = len(offs) - 1
        words, edge = _terms(data, offs)
        row = np.repeat(np.arange(rows), np.diff(edge))
        known = self.table.find(words) >= 0
        words, row = words[known], row[known]
        order = np.lexsort((words, row))
        words, row = words[order], row[order]
        new = np.r_[True, (words[1:] != words[:-1]) | (row[1:] != row[:-1])] if len(words) else np.zeros(0, bool)
        words, row = words[new], row[new]
        out = np.zeros((rows, len(_SALT)), np.uint32)
        for k, salt in enumerate(_SALT):
            place = scan.mix(words ^ salt)
            taken = np.flatnonzero(place % np.uint64(LEVELS[k // SETS]) == 0)
            if not len(taken):
                continue
            r = row[taken]
            first = np.r_[True, r[1:] != r[:-1]]
            start = np.flatnonzero(first)
            rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
            value = place[taken] * scan.power_table(_ORDER, int(rank.max()) + 1)[rank]
            h = scan.mix(np.add.reduceat(value, start)) >> np.uint64(32)
            out[r[start], k] = np.maximum(h, 1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1."""
    some = ((a != 0) | (b != 0)).reshape(len(a), len(LEVELS), SETS)
    same = ((a == b) & (a != 0)).reshape(len(a), len(LEVELS), SETS)
    n, hit = some.sum(axis=2), same.sum(axis=2)
    share = np.where(n >= ENOUGH, hit / np.maximum(n, 1), -1.0).max(axis=1)
    all_n = n.sum(axis=1)
    whole = np.where(all_n > 0, hit.sum(axis=1) / np.maximum(all_n, 1), 1.0)
    return np.round(np.where(share >= 0, share, whole), 6)


def _scanned(texts: list[str], prints: Fingerprinter) -> np.ndarray:
    parts = [prints(data, offs) for _, _, data, offs in scan.slices(pa.array(texts, pa.large_string()))]
    return np.concatenate(parts) if parts else np.zeros((0, len(_SALT)), np.uint32)


def _neighbours(sent):
    """Rows in order (bucket, then descending doc_id), each bucket closed by a row that is only a neighbour, to results."""

    def results(ids, texts):
        # the last row only serves as the next one of the row before
        prints = sent.value
        k = [len(t) // 3 for t in texts[:-1]]
        edited = [t[: len(t) - n] + after[:n] for t, n, after in zip(texts[:-1], k, texts[1:], strict=True)]
        own, changed = _scanned(texts, prints), _scanned(edited, prints)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array([x.astype(">u4").tobytes().hex() for x in own[:-1]], pa.string()), pa.array([x.astype(">u4").tobytes().hex() for x in changed], pa.string()),
             pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:]))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, room, closed, head = [], [], 0, False, None
        for batch in batches:
            for doc, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and closed:  # rows of equal doc_id at a bucket's edge: the first is the neighbour
                    continue
                if closed:
                    ids, texts, room, closed, head = [], [], 0, False, None
                head = head or (doc, text or "")
                ids.append(doc)
                texts.append(text or "")
                room += len(texts[-1])
                if guest or room >= scan.SLICE:
                    if len(ids) > 1:
                        yield results(ids, texts)
                    ids, texts, room, closed = ids[-1:], texts[-1:], len(texts[-1]), bool(guest)
        if ids and not closed:  # no doc_id at all: one range without a neighbour, whose last row is followed by its first
            yield results([*ids, head[0]], [*texts, head[1]])

    return run


def _edges(docs: DataFrame, n: int) -> list[int]:
    """Ascending doc_ids that cut the documents into about n ranges; the last is the largest doc_id."""
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("p"), F.max("doc_id").alias("m")).first()
    return sorted({*(found.p or []), found.m} - {None})


def fingerprints(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt out by ranges of doc_id. The first document of a range is sent to the range before it in
    the order too, as a neighbour; so each text is shuffled once and a range needs nothing of the others.
    """
    spark = docs.sparkSession
    docs = store.spread(docs.select("doc_id", "text"))
    sent = spark.sparkContext.broadcast(Fingerprinter(lexicon(docs, rare, common)))
    parts = store.ranges_of(spark)
    edges = np.array(_edges(docs, max(2, SPLIT * parts)), np.int64)
    last = len(edges)

    # range r holds doc_ids in (edges[r - 1], edges[r]]; the order runs from the highest range to range 0, null doc_ids at its end
    @F.pandas_udf("array<struct<range:int,guest:boolean>>")
    def places(doc: pd.Series) -> pd.Series:
        known = doc.notna().to_numpy()
        at = np.zeros(len(doc), np.int64)
        at[known] = np.searchsorted(edges, doc[known].to_numpy().astype(np.int64))
        edge = np.zeros(len(doc), bool)
        edge[known] = edges[at[known]] == doc[known].to_numpy().astype(np.int64) if last else False
        # the largest document of a range opens it, and is the guest of the range above; that of the top range is the guest of the bottom
        return pd.Series([[{"range": int(r), "guest": False}, *([{"range": int(r + 1) % last, "guest": True}] if e else [])] for r, e in zip(at, edge, strict=True)])

    dealt = docs.withColumn("to", F.explode(places("doc_id"))).select("to.range", "to.guest", "doc_id", "text")
    order = ["range", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    ready = dealt.repartition(parts, "range").sortWithinPartitions(*order).select("doc_id", "text", "guest")
    return ready.mapInArrow(_neighbours(sent), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
