"""Packing of tokenized documents into sequences of bounded length by exact complements.

All decisions are taken on the histogram of piece lengths, which has at most ``size`` entries however large
the corpus is. A sequence starts with the longest length left. The gap is looked up in indexes of single
lengths, of pair sums and of triple sums; a combination that fills it exactly under the counts still available
is consumed as often as the counts allow. Without one, the longest length that fits goes in (best fit)
and the lookup is repeated for what is left. The pieces then get their places by their rank within
their length: ranks are counted in two levels (within a task, over tasks), so a length shared by
most pieces is no hot group.

Defined cases: a null text is an empty one (one piece with the end id alone); rows of equal doc_id are
packed each for itself; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm import scan, store, units

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Token pieces of at most ``size`` ids per document, with their rank among the task's pieces of that length."""

    def run(batches):
        units.trim()  # what other stages left in this worker
        enc, task = units.encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, data, offs in scan.slices(batch.column(1), scan.PART):
                ids, at = enc.encode(data, offs)
                wide = ids.astype("<u4")
                row, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    n = b - a + 1
                    for k in range(0, n, size):
                        stop = min(k + size, n)
                        c = zlib.crc32(wide[a + k : a + min(stop, n - 1)])
                        row.append(i)
                        piece.append(k // size)
                        start.append(k)
                        length.append(stop - k)
                        crc.append(zlib.crc32(end, c) if stop == n else c)
                lens = np.array(length, np.int64)
                order = np.argsort(lens, kind="stable")
                rank = np.empty(len(lens), np.int64)
                ordered = lens[order]
                first = np.searchsorted(ordered, ordered)
                rank[order] = np.arange(len(lens)) - first + seen[ordered]
                seen += np.bincount(lens, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lens),
                     pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return store.spread(docs.select("doc_id", "text")).mapInArrow(run, PIECES)


class Lengths:
    """Counts by length, with indexes of pair and triple sums of the lengths that still have some."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.size = len(counts) - 1
        one = (counts > 0).astype(np.float64)
        one[0] = 0
        # sums of lengths with counts at the start; a sum that has lost its lengths is struck off when it is met
        self.pairs = np.rint(np.convolve(one, one)[: self.size + 1]) > 0
        self.triples = np.rint(np.convolve(self.pairs.astype(np.float64), one)[: self.size + 1]) > 0

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int, strike: bool = True) -> list[int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        half = (gap + 1) // 2
        both = np.minimum(self.left[half:gap], self.left[gap - half : 0 : -1])  # longer and shorter part
        if 2 * half == gap and self.left[half] < 2:
            both[0] = 0
        hit = np.flatnonzero(both)
        if not len(hit):
            self.pairs[gap] &= not strike
            return None
        return [half + int(hit[-1]), gap - half - int(hit[-1])]

    def triple(self, gap: int) -> list[int] | None:
        if gap < 3 or not self.triples[gap]:
            return None
        a = np.arange(gap - 2, (gap - 1) // 3, -1)  # the largest of three is a third at least
        for x in a[(self.left[a] > 0) & self.pairs[gap - a]].tolist():
            if not self.pair(gap - x):
                continue
            self.left[x] -= 1
            rest = self.pair(gap - x, strike=False)
            self.left[x] += 1
            if rest:
                return [x, *rest]
        self.triples[gap] = False  # counts never grow: what has no combination now never gets one
        return None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, how many such sequences) for ``counts[length]`` pieces of each length."""
    size, out = len(counts) - 1, []
    h = Lengths(counts)
    top = size
    while top > 0:
        if h.left[top] <= 0:
            top -= 1
            continue
        inside, gap = [top], size - top
        h.left[top] -= 1
        while gap > 0:
            more = h.single(gap) or h.pair(gap) or h.triple(gap)
            if not more:
                fit = np.flatnonzero(h.left[1 : min(gap, top) + 1] > 0)
                if not len(fit):
                    break
                more = [int(fit[-1]) + 1]
            for x in more:
                h.left[x] -= 1
            inside += more
            gap -= sum(more)
        # the same sequence again, as often as all its lengths last
        kinds, need = np.unique(inside, return_counts=True)
        again = int((h.left[kinds] // need).min())
        h.left[kinds] -= again * need
        out.append((inside, 1 + again))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = store.written(pieces(docs, tokenizer, end_id, size))
    spark = docs.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``size`` rows
        counts[r.length] = r.n
    # places: ranks [first, first + each * times) of a length go to one pattern, ``each`` in every sequence
    key, first, each, sequence, at, place = [], [], [], [], [], []
    used, base = np.zeros(size + 1, np.int64), 0
    for inside, times in plan(counts):
        offset, slots = 0, {}
        for x in inside:
            slots.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in slots.items():
            key.append(x)
            first.append(int(used[x]))
            each.append(len(offsets))
            sequence.append(base)
            at.append(len(place))
            place += offsets
            used[x] += len(offsets) * times
        base += times
    order = np.lexsort((first, key))
    table = {k: np.array(v, np.int64)[order] for k, v in {"key": key, "first": first, "each": each, "sequence": sequence, "at": at}.items()}
    sent = spark.sparkContext.broadcast((table, np.array(place, np.int64)))  # bounded by ``size``, not by the corpus

    def places(batches):
        t, offsets = sent.value
        edges = np.searchsorted(t["key"], np.arange(size + 2))
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = cols["length"].to_numpy(), cols["rank"].to_numpy() + cols["before"].to_numpy()
            hit = np.empty(len(length), np.int64)
            for x in np.unique(length):
                i = np.flatnonzero(length == x)
                hit[i] = edges[x] + np.searchsorted(t["first"][edges[x] : edges[x + 1]], rank[i], side="right") - 1
            local = rank - t["first"][hit]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(cols[n] for n in names), pa.array(t["sequence"][hit] + local // t["each"][hit]), pa.array(offsets[t["at"][hit] + local % t["each"][hit]])],
                [*names, "sequence_id", "offset"])

    by_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(sums, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return ranked.mapInArrow(places, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
