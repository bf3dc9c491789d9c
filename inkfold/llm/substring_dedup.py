"""Removal of repeated word passages with a count-min prefilter.

A window is ``size`` consecutive words. Pass one hashes every window into the cells of a sketch whose width
follows the size of the corpus. Each block of documents keeps its own sketch (cells it touches, and
which of them twice), range by range; the ranges of all blocks are merged and counted. A cell counted twice
overestimates its windows: only windows of such cells can be repeated, and none is lost. Pass two sends the
128-bit keys of just those windows to exact groups. Both passes give their answers back as one bit
per cell or key to the block that asked, so no sketch is broadcast and no table of windows exists.

The blocks (compressed texts) lie in a bucketed table, so the answers travel to the texts, not the texts to
the answers. A window that most documents share is one cell and one key in each block.

Words are compared through 128-bit keys of their bytes; texts of equal words have equal keys, and two different
windows share a key with a probability of 2**-128 a pair.

Defined cases: a null text has no words; a text of fewer words than a window keeps them all; rows of equal
doc_id are texts of their own; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import scan, store
from inkfold.llm.blocks import pack, unpack
from inkfold.llm.token_files import EliasFano

#: Bytes of text in a block, cells of the sketch per window at least, and ranges per shuffle partition.
BLOCK, CELLS, SPLIT = 8 << 20, 8, 4
SECOND = 0xA0761D6478BD642F


class Windows:
    """Windows of the rows of a slice: ``keys`` of those inside one row, ``at`` their first words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, size: int):
        self.starts, self.ends = scan.runs(scan.NOT_SPACE[data], offs)
        words = scan.run_hashes(data, self.starts, self.ends)
        self.rows = scan.row_starts(self.starts, offs)
        self.at = scan.ragged(self.rows[:-1], np.maximum(np.diff(self.rows) - size + 1, 0))
        self.words = words
        self.size = size

    def key(self) -> np.ndarray:
        h = scan.window_hashes(self.words, self.size)
        return h[self.at] if len(h) else h

    def second(self) -> np.ndarray:
        h = scan.window_hashes(scan.mix(self.words + np.uint64(SECOND)), self.size, SECOND)
        return h[self.at] if len(h) else h


def _block_windows(batch: pa.RecordBatch, size: int):
    for lo, hi, data, offs in scan.slices(batch.column(1)):
        yield lo, hi, data, offs, Windows(data, offs, size)


def _split(sorted_keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges by the top bits of sorted 64-bit keys, and where each begins and ends."""
    if not bits:
        return np.array([0]), np.array([0, len(sorted_keys)])
    tops = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    return tops[first], np.r_[first, len(tops)]


def _once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether each occurs more than once."""
    distinct, count = np.unique(keys, return_counts=True)
    return distinct, count > 1


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """Cells as keys: everything below the top ``width`` bits is cleared."""
    return keys & ~np.uint64((1 << (64 - width)) - 1)


def _layout(size: int, width: int, bits: int):
    """Documents to rows of kind 0 (a block's texts) and 1 (a range of the block's sketch)."""

    def run(batches):
        task, made, held_ids, held, room = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            nonlocal made
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(held_ids), pa.concat_arrays(held)], ["doc_id", "text"])
            name = task << 32 | made
            made += 1
            keys = [w.key() for *_, w in _block_windows(batch, size)]
            cells, twice = _once(_cells(np.concatenate(keys), width))
            ranges, edge = _split(cells, bits) if len(cells) else ([], [])
            rows = [(0, 0, pack(batch))]
            for r, a, b in zip(ranges, edge[:-1], edge[1:], strict=True):
                low = ((cells[a:b] << np.uint64(bits)) >> np.uint64(64 - width + bits)).astype(np.int64)
                rows.append((1, int(r), EliasFano.encode(low) + np.packbits(twice[a:b]).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[0] for x in rows], pa.int32())],
                ["block", "range", "payload", "kind"])

        for batch in batches:
            texts = batch.column(1)
            texts = texts.fill_null("") if texts.null_count else texts
            for lo, hi, data, _ in scan.slices(texts):
                held_ids.append(batch.column(0).slice(lo, hi - lo))
                held.append(texts.slice(lo, hi - lo))
                room += len(data)
                if room >= BLOCK:
                    yield block()
                    held_ids, held, room = [], [], 0
        if held:
            yield block()

    return run


def _grouped(batches):
    """(range, blocks, payloads) of rows that are sorted by range."""
    now, names, raws = None, [], []
    for batch in batches:
        for r, name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != now and names:
                yield now, names, raws
                names, raws = [], []
            now = r
            names.append(name)
            raws.append(raw)
    if names:
        yield now, names, raws


def _answers(names: list, r: int, masks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array([r] * len(names), pa.int32()), pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())], ["block", "range", "mask"])


def _merge_sketches(width: int, bits: int):
    """Counters of a range over all blocks; to each block, one bit a cell: counted more than once."""

    def run(batches):
        for r, names, raws in _grouped(batches):
            count = np.zeros(1 << (width - bits), np.uint8)
            parts = []
            for raw in raws:
                sketch = EliasFano(raw)
                cells = sketch.all()
                twice = np.unpackbits(np.frombuffer(raw, np.uint8, offset=sketch.size), count=sketch.n)
                count[cells] = np.minimum(count[cells] + 1 + twice, 2)
                parts.append(cells)
            yield _answers(names, r, [count[c] > 1 for c in parts])

    return run


def _masks(ranges: list, masks: list) -> dict[int, bytes]:
    return dict(zip(ranges or [], masks or [], strict=True))


def _apply(keys: np.ndarray, answers: dict[int, bytes], bits: int) -> np.ndarray:
    """The answers for distinct sorted keys, range by range."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        ranges, edge = _split(keys, bits)
        for r, a, b in zip(ranges.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[a:b] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=b - a)
    return out


def _candidates(batch: pa.RecordBatch, size: int, width: int, bits: int, answers: dict[int, bytes]):
    """Windows of a block whose cell is counted more than once: the slices, and the flag of every window."""
    parts = list(_block_windows(batch, size))
    keys = [w.key() for *_, w in parts]
    cells = _cells(np.concatenate(keys), width)
    distinct, at = np.unique(cells, return_inverse=True)
    flag = _apply(distinct, answers, bits)[at]
    return parts, keys, np.split(flag, np.cumsum([len(k) for k in keys])[:-1])


def _pairs(parts, keys, flags) -> np.ndarray:
    """128-bit keys of the candidates, as rows of two 64-bit numbers."""
    first = np.concatenate([k[f] for k, f in zip(keys, flags, strict=True)])
    second = np.concatenate([p[-1].second()[f] for p, f in zip(parts, flags, strict=True)])
    out = np.empty(len(first), [("a", np.uint64), ("b", np.uint64)])
    out["a"], out["b"] = first, second
    return out


def _distinct_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, how often each occurs, and each pair's place among them."""
    order = np.lexsort((pairs["b"], pairs["a"]))
    s = pairs[order]
    new = np.r_[True, (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])] if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    at = np.empty(len(s), np.int64)
    at[order] = group
    return s[new], np.bincount(group, minlength=int(new.sum())), at


def _ask(size: int, width: int, bits: int):
    """Blocks to the keys of their candidates, range by range."""

    def run(batches):
        for batch in batches:
            for name, raw, ranges, masks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, keys, flags = _candidates(unpack(raw), size, width, bits, _masks(ranges, masks))
                distinct, count, _ = _distinct_pairs(_pairs(parts, keys, flags))
                if not len(distinct):
                    continue
                ranges, edge = _split(distinct["a"], bits)
                made = [np.packbits(count[a:b] > 1).tobytes() + distinct[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([name] * len(made), pa.int64()), pa.array(made, pa.binary())], ["range", "block", "payload"])

    return run


def _group_exactly(batches):
    """To each block, one bit a key: the key stands more than once in all blocks together."""
    for r, names, raws in _grouped(batches):
        keys, weight, edge = [], [], [0]
        for raw in raws:
            n = len(raw) * 8 // 129  # n pairs of 16 bytes behind n flags
            flags = (n + 7) // 8
            keys.append(np.frombuffer(raw, [("a", np.uint64), ("b", np.uint64)], n, flags))
            weight.append(1 + np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=n).astype(np.int64))
            edge.append(edge[-1] + n)
        distinct, _, at = _distinct_pairs(np.concatenate(keys))
        many = np.bincount(at, np.concatenate(weight), minlength=len(distinct))[at] > 1
        yield _answers(names, r, [many[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _remove(size: int, width: int, bits: int):
    """Blocks and both answers to the documents without their repeated windows."""

    def run(batches):
        for batch in batches:
            for raw, ranges1, masks1, ranges2, masks2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = unpack(raw)
                parts, keys, flags = _candidates(docs, size, width, bits, _masks(ranges1, masks1))
                distinct, _, at = _distinct_pairs(_pairs(parts, keys, flags))
                repeated = _apply_pairs(distinct, _masks(ranges2, masks2), bits)[at]
                done = 0
                for (lo, hi, data, _, w), flag in zip(parts, flags, strict=True):
                    n = int(flag.sum())
                    gone = w.at[flag][repeated[done : done + n]]
                    done += n
                    change = np.zeros(len(w.starts) + 1, np.int64)
                    np.add.at(change, gone, 1)
                    np.add.at(change, gone + size, -1)
                    keep = np.cumsum(change)[:-1] == 0
                    yield _kept(docs.column(0).slice(lo, hi - lo), data, w, keep)

    return run


def _apply_pairs(distinct: np.ndarray, answers: dict[int, bytes], bits: int) -> np.ndarray:
    out = np.zeros(len(distinct), bool)
    if len(distinct):
        ranges, edge = _split(distinct["a"], bits)
        for r, a, b in zip(ranges.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[a:b] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=b - a)
    return out


def _kept(doc_ids: pa.Array, data: np.ndarray, w: Windows, keep: np.ndarray) -> pa.RecordBatch:
    starts, lens = w.starts[keep], (w.ends - w.starts)[keep]
    # each kept word and a space behind it
    ends = np.cumsum(lens + 1)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    joined[scan.ragged(ends - lens - 1, lens)] = data[scan.ragged(starts, lens)]
    kept_before = np.r_[0, np.cumsum(keep)][w.rows]
    at = np.r_[0, ends][kept_before].tolist()
    buffer = memoryview(joined)
    texts = [bytes(buffer[a : max(a, b - 1)]) for a, b in zip(at[:-1], at[1:], strict=True)]
    n = np.diff(w.rows)
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n, pa.int64()), pa.array(n - np.diff(kept_before), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept, the words left joined by one space."""
    spark = docs.sparkSession
    source = store.spread(docs.select("doc_id", "text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = store.ranges_of(spark)
    bits = (SPLIT * parts - 1).bit_length()
    width = max(bits + 3, (CELLS * (total // 6 + 1)).bit_length())
    name, path = f"llm_blocks_{uuid.uuid4().hex}", store.shared_folder(spark)
    laid = source.mapInArrow(_layout(size, width, bits), "block long, range int, payload binary, kind int")
    laid.write.partitionBy("kind").bucketBy(parts, "block").format("parquet").option("path", path).saveAsTable(name)
    rows = spark.table(name)
    blocks = rows.where("kind = 0").select("block", "payload")

    def by_block(answers: DataFrame, tag: str) -> DataFrame:
        both = F.collect_list(F.struct("range", "mask"))
        return answers.groupBy("block").agg(both.alias("x")).select("block", F.col("x.range").alias(f"ranges{tag}"), F.col("x.mask").alias(f"masks{tag}"))

    sketches = rows.where("kind = 1").select("range", "block", "payload").repartition("range").sortWithinPartitions("range")
    counted = store.written(sketches.mapInArrow(_merge_sketches(width, bits), "block long, range int, mask binary"))
    first = blocks.join(by_block(counted, "1"), "block", "left")
    asked = first.select("block", "payload", "ranges1", "masks1").mapInArrow(_ask(size, width, bits), "range int, block long, payload binary")
    exact = asked.repartition("range").sortWithinPartitions("range").mapInArrow(_group_exactly, "block long, range int, mask binary")
    grouped = store.written(exact)
    both = first.join(by_block(grouped, "2"), "block", "left").select("payload", "ranges1", "masks1", "ranges2", "masks2")
    return both.mapInArrow(_remove(size, width, bits), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
