"""Token-id files: ids of all documents one after the other, document boundaries as Elias-Fano sequences.

A file is a table of blocks. A block holds the ids of consecutive documents as one array, and two
Elias-Fano sequences: the boundaries of the documents in that array and the documents' ids. Sampled
select positions give any boundary without a table of 64-bit offsets. A block knows how many ids come
before it in its part, so the start of a document needs only the part's sum besides.

Defined cases: a null text is an empty one and gives the end id alone; documents with a null doc_id come
first; rows of equal doc_id follow the order of their texts' bytes; an empty table gives an empty file.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import scan, store, units

BLOCK_IDS = 1 << 18
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(largest / count) bits each.

    ``select(i)`` is element i: the i-th set bit of the upper half is found from a sampled position,
    the lower bits are read in place. ``all()`` is the whole sequence.
    """

    def __init__(self, raw: bytes):
        self.n, self.base, self.low, n_low, n_high = struct.unpack_from("<QqQQQ", raw)
        at = 40
        self.lows = np.frombuffer(raw, np.uint8, n_low, at)
        self.highs = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(raw, "<u4", (self.n + SAMPLE - 1) // SAMPLE, at + n_low + n_high)
        self.size = at + n_low + n_high + 4 * len(self.samples)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        if not n:
            return struct.pack("<QqQQQ", 0, 0, 0, 0, 0)
        base = int(values[0])
        v = (np.asarray(values, np.int64) - base).astype(np.uint64)
        low = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1, np.uint8)
        upper[ones] = 1
        highs = np.packbits(upper, bitorder="little")
        return struct.pack("<QqQQQ", n, base, low, len(lows), len(highs)) + lows.tobytes() + highs.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.highs[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        a = i * self.low
        piece = int.from_bytes(self.lows[a // 8 : (a + self.low + 7) // 8].tobytes(), "little") >> (a % 8)
        return self.base + (high << self.low | piece & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.int64)
            out |= bits @ (np.int64(1) << np.arange(self.low))
        return out + self.base


def pack_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents in ascending order, nulls first, as the bytes of one block."""
    nulls = sum(x is None for x in doc_ids)
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
    names = EliasFano.encode(np.array(doc_ids[nulls:], np.int64))
    return struct.pack("<4sIQ", b"EFI1", ids.dtype.itemsize, nulls) + bounds + names + ids.tobytes()


def open_block(raw: bytes) -> tuple[EliasFano, list, np.ndarray]:
    """Boundaries, document ids and token ids of a block."""
    magic, width, nulls = struct.unpack_from("<4sIQ", raw)
    if magic != b"EFI1":
        raise ValueError("not a token block")
    bounds = EliasFano(raw[16:])
    names = EliasFano(raw[16 + bounds.size :])
    ids = np.frombuffer(raw, f"<u{width}", offset=16 + bounds.size + names.size)
    return bounds, [None] * nulls + names.all().tolist(), ids


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Write the token file of ``docs`` (doc_id, text); returns its table of blocks.

    Rows are dealt out by ranges of doc_id and sorted; each task writes its part block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = units.encoder(tokenizer), TaskContext.get().partitionId()
        kind = enc.kind if end_id < 1 << 8 * enc.kind.itemsize else np.dtype("<u4")
        end = np.array([end_id], kind)
        names, lens, held, n, before = [], [], [], 0, 0

        def block():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "before": [before], "n_ids": [n], "block": [pack_block(names, np.array(lens), np.concatenate(held))]},
                schema=pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offs in scan.slices(batch.column(1)):
                ids, at = enc.encode(data, offs)
                for i in range(hi - lo):
                    names.append(keys[lo + i])
                    lens.append(int(at[i + 1] - at[i]) + 1)
                    held += [ids[at[i] : at[i + 1]].astype(kind, copy=False), end]
                    n += lens[-1]
                    if n >= BLOCK_IDS:
                        yield block()
                        before, names, lens, held, n = before + n, [], [], [], 0
        if n:
            yield block()

    keyed = store.spread(docs.select("doc_id", "text"))
    sorted_docs = keyed.repartitionByRange(parts or store.ranges_of(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return store.written(sorted_docs.mapInArrow(run, "part int, before long, n_ids long, block binary"))


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens and the CRC-32 of its ids as 32-bit little-endian integers."""
    # one number a part: what lies before it
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part], total = total, total + n

    def run(batches):
        for batch in batches:
            for part, before, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bounds, names, ids = open_block(raw)
                at = bounds.all()
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(at[:-1] + base[part] + before), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "before", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
