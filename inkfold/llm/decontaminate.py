"""Benchmark passages in documents by Wu-Manber search over words.

A pattern is a window of ``size`` consecutive item words (or a whole shorter item). Patterns of one length
are searched together. The shift table maps a block of two words to the distance by which the search may
advance; a block of no pattern skips all positions it covers. Where the shift is zero, the block is a
pattern's suffix: its hash selects a bucket of patterns, the first word narrows it, and the words are compared
directly. The search runs over many texts in lockstep: every stretch of text as long as the largest
shift has its own cursor.

The benchmark is read in blocks of bounded size, each of which is broadcast and searched by one pass; the passes
follow each other over the same rows without a shuffle. So the benchmark's size costs passes, never memory.

Defined cases: a null text has no words; an item without words occurs nowhere; rows of one item_id are one
item; an item of null id marks words, but no id is reported; repeated documents are judged each for itself; an empty
benchmark leaves all clean. Columns of the documents are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import scan, store

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of benchmark text in one pass.
PASS_BYTES = 8 << 20
PAIR = np.uint64(0x9FB21C651E98DF25)
_FOLD = bytes(scan.LOWER.tolist())


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(_FOLD))


class WuManber:
    """Search for patterns of ``m`` words each; ``patterns`` maps the words to the items they belong to."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.m, self.block = m, min(2, m)
        self.texts = list(patterns)
        self.items = [sorted(patterns[p]) for p in self.texts]
        vocabulary = sorted({w for p in self.texts for w in p})
        lens = np.array([len(w) for w in vocabulary])
        ends = np.cumsum(lens)
        hashes = scan.run_hashes(np.frombuffer(b"".join(vocabulary), np.uint8), ends - lens, ends, scan.LOWER_VALUE)
        number = {w: i for i, w in enumerate(vocabulary)}
        self.words = hashes[np.array([[number[w] for w in p] for p in self.texts])]
        self.bits = max(12, int(len(self.texts) * m * 4).bit_length())
        self.largest = m - self.block + 1
        self.shift = np.full(1 << self.bits, self.largest, np.int64)
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, self._slot(self._blocks(self.words[:, j - 1], self.words[:, j])), m - 1 - j)
        suffix = self._blocks(self.words[:, m - 2], self.words[:, m - 1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _blocks(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return scan.mix(before * PAIR + last) if self.block == 2 else last

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, rows: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
        """Last words of the occurrences and their patterns; ``same(first word, pattern)`` compares the bytes."""
        n = np.diff(rows) - self.m + 1
        stretches = np.maximum(-(-n // self.largest), 0)
        first = np.repeat(rows[:-1] + self.m - 1, stretches)
        at = first + (np.arange(len(first)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * self.largest
        stop = np.minimum(at + self.largest, np.repeat(rows[1:], stretches))
        found = []
        while len(at):
            blocks = self._blocks(words[at - self.block + 1], words[at])
            shift = self.shift[self._slot(blocks)]
            zero = shift == 0
            if zero.any():
                found.append((at[zero], blocks[zero]))
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, blocks = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.searchsorted(self.suffix, blocks, side="left"), np.searchsorted(self.suffix, blocks, side="right")
        place, pattern = np.repeat(at, b - a), self.order[scan.ragged(a, b - a)]
        for j in range(self.m):  # the first word narrows the bucket; the others follow while something is left
            hit = words[place - self.m + 1 + j] == self.words[pattern, j]
            place, pattern = place[hit], pattern[hit]
        hit = np.array([same(p - self.m + 1, self.texts[q]) for p, q in zip(place.tolist(), pattern.tolist(), strict=True)], bool)
        return place[hit], pattern[hit]


class Patterns:
    """All windows of some items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.names = [name for name, _ in items]
        by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for i, (_, text) in enumerate(items):
            w = words_of(text)
            m = min(size, len(w))
            for k in range(len(w) - m + 1 if w else 0):
                by_length.setdefault(m, {}).setdefault(tuple(w[k : k + m]), set()).add(i)
        self.searches = [WuManber(m, p) for m, p in sorted(by_length.items())]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Rows' first words, the hit flag of each word, and the names of the items found by row."""
        starts, ends = scan.runs(scan.ALNUM[data], offs)
        words = scan.run_hashes(data, starts, ends, scan.LOWER_VALUE)
        rows = scan.row_starts(starts, offs)
        change, names = np.zeros(len(words) + 1, np.int64), {}

        def same(first: int, pattern: tuple[bytes, ...]) -> bool:
            return all(data[starts[first + j] : ends[first + j]].tobytes().translate(_FOLD) == w for j, w in enumerate(pattern))

        for s in self.searches:
            last, pattern = s.search(words, rows, same)
            np.add.at(change, last - s.m + 1, 1)
            np.add.at(change, last + 1, -1)
            for row, p in set(zip((np.searchsorted(rows, last, side="right") - 1).tolist(), pattern.tolist(), strict=True)):
                names.setdefault(row, set()).update(self.names[i] for i in s.items[p])
        return rows, np.cumsum(change)[:-1] > 0, names


def _passes(benchmark: DataFrame, size: int) -> list:
    """The benchmark as broadcasts of patterns, each made from at most about PASS_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PASS_BYTES) or 1
    made = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        made.append(benchmark.sparkSession.sparkContext.broadcast(Patterns([(r.name, r.text) for r in part.collect()], size)))
    return made


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
STATE = [pa.field("_hit", pa.binary()), pa.field("_items", pa.list_(pa.string()))]


def _pass(sent, text: int, first: bool, finish):
    """One pass over rows: the state of earlier passes (hit words, items) stands in the last two columns."""

    def run(batches):
        for batch in batches:
            kept = batch.columns if first else batch.columns[:-2]
            for lo, hi, data, offs in scan.slices(batch.column(text)):
                rows, hit, names = sent.value.scan(data, offs)
                names = [names.get(i, set()) for i in range(hi - lo)]
                if not first:
                    for i, (h, more) in enumerate(zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns[-2:]), strict=True)):
                        names[i] |= set(more)
                        a, b = rows[i], rows[i + 1]
                        hit[a:b] |= np.unpackbits(np.frombuffer(h, np.uint8), count=b - a).astype(bool)
                out = finish([c.slice(lo, hi - lo) for c in kept], list(batch.schema)[: len(kept)], rows, hit, names)
                if out is not None:
                    yield out

    return run


def _keep_state(columns, fields, rows, hit, names):
    bits = pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())
    items = pa.array([sorted(n, key=str) for n in names], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*columns, bits, items], schema=pa.schema([*fields, *STATE]))


def _digest(columns, fields, rows, hit, names):
    before = np.r_[0, np.cumsum(hit)]
    hits = before[rows[1:]] - before[rows[:-1]]
    names = [sorted(x for x in n if x is not None) for n in names]
    made = {
        "n_words": pa.array(np.diff(rows), pa.int64()), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(n) for n in names], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]), "contaminated": pa.array(hits > 0),
    }
    return pa.RecordBatch.from_arrays([columns[0], *made.values()], ["doc_id", *made])


def _clean_rows(columns, fields, rows, hit, names):
    before = np.r_[0, np.cumsum(hit)]
    clean = pa.array(before[rows[1:]] == before[rows[:-1]])
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)).filter(clean)


def _run(docs: DataFrame, benchmark: DataFrame, size: int, text: int, finish, schema) -> DataFrame:
    from pyspark.sql import types as T

    passes = _passes(benchmark, size)
    state = T.StructType([*docs.schema.fields, T.StructField("_hit", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
    rows = store.spread(docs)
    for k, sent in enumerate(passes):
        last = k == len(passes) - 1
        rows = rows.mapInArrow(_pass(sent, text, k == 0, finish if last else _keep_state), schema if last else state)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _run(docs.select("doc_id", "text"), benchmark, size, 1, _digest, f"doc_id long, {DIGEST}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any passage of the benchmark, with all their columns."""
    return _run(docs, benchmark, size, docs.columns.index("text"), _clean_rows, docs.schema)
