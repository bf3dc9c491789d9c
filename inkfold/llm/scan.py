"""Vectorised scanning of UTF-8 text: slices of Arrow columns, runs of bytes, 64-bit hashes of runs and of windows.

Text is scanned as bytes in slices of about a megabyte, so that the work per character is a few numpy
passes and the memory doesn't follow the size of a batch. A text is never split over two slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20
#: Bytes of text that ``map_text`` and ``filter_text`` hand over at once: what a function makes of them is many times as large.
PART = 1 << 18
#: Multiplier of the polynomial hash over bytes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C55
UNBASE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_POW: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i < n, kept between calls."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _POW[base] = powers(base, max(n, 1 << 16))
    return have


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUE = BYTE_VALUE[LOWER]


def byte_set(*parts: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in parts:
        table[lo : hi + 1] = True
    return table


#: Everything but space and \t \n \v \f \r.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes); a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags; no run goes beyond its row."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = flag.copy(), flag.copy()
    first[1:] &= ~flag[:-1]
    last[:-1] &= ~flag[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = flag[inner]
    last[inner - 1] = flag[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; ``values`` maps bytes first (LOWER_VALUE: ASCII case is ignored)."""
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        # as many runs as lie in 2 MB; usually all
        top = starts[k] + 2 * SLICE
        j = max(k + 1, int(np.searchsorted(ends, top, side="right")))
        a, b = int(starts[k]), int(ends[j - 1])
        if b - a <= 2 * SLICE:
            s = np.zeros(b - a + 1, U)
            np.cumsum(values[data[a:b]] * power_table(BASE, b - a)[: b - a], out=s[1:])
            out[k:j] = (s[ends[k:j] - a] - s[starts[k:j] - a]) * power_table(UNBASE, b - a)[starts[k:j] - a]
        else:  # one run longer than that, piece by piece
            total = 0
            for at in range(a, b, SLICE):
                part = data[at : min(b, at + SLICE)]
                v = int(np.sum(values[part] * power_table(BASE, len(part))[: len(part)], dtype=U))
                total = (total + v * pow(BASE, at - a, 1 << 64)) % (1 << 64)
            out[k] = total
        k = j
    return mix(out + U(1))


def window_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes (windows over row borders included: the caller leaves them out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    inverse, step = pow(base, -1, 1 << 64), 1 << 20
    for a in range(0, n, step):
        b = min(n, a + step)
        part = words[a : b + size - 1]
        s = np.zeros(len(part) + 1, U)
        np.cumsum(part * power_table(base, len(part))[: len(part)], out=s[1:])
        out[a:b] = (s[size : size + b - a] - s[: b - a]) * power_table(inverse, b - a)[: b - a]
    return mix(out)


def row_starts(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the first run of each row, and the number of runs at the end."""
    return np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of each piece, piece after piece."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class HashTable:
    """64-bit keys to positions 0, 1, 2, ... in order of insertion; open addressing, whole arrays at a time."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, U)
        self.at = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        at = self.at[slot]
        todo = np.flatnonzero((at >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            at[todo] = self.at[slot[todo]]
            todo = todo[(at[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return at

    def add(self, keys: np.ndarray) -> None:
        """Insert distinct keys that are not in the table yet."""
        if (self.n + len(keys)) * 2 > 1 << self.bits:
            old = self.at >= 0
            ks, at = self.keys[old], self.at[old]
            self._make(max(self.bits + 1, int(2 * (self.n + len(keys))).bit_length()))
            self._place(ks, at)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys: np.ndarray, at: np.ndarray) -> None:
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.at[s] < 0
            self.at[s[free]] = at[todo[free]]  # of several for one slot, one stays
            won = self.at[s] == at[todo]
            self.keys[s[won]] = keys[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask


def map_text(df, per_slice, schema, *, keep: list[str], text: str = "text"):
    """``df`` through ``per_slice(bytes, offsets, text column of these rows)``, which gives a dict of new columns.

    The columns in ``keep`` go with the rows; any other column isn't read.
    """
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(batch.num_columns - 1), PART):
                rows = batch.slice(lo, hi - lo)
                made = per_slice(data, offs, rows.column(batch.num_columns - 1))
                arrays = [rows.column(i) for i in range(len(keep))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *made])

    return df.select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(run, schema)


def filter_text(df, keep, text: str = "text"):
    """The rows of ``df`` for which ``keep(bytes, offsets)`` is true, with all columns."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(at), PART):
                yield batch.slice(lo, hi - lo).filter(pa.array(keep(data, offs)))

    return df.mapInArrow(run, df.schema)
