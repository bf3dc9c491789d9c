"""Token ids of whole texts by the tokenizers library, with each distinct unit of text encoded once per process.

A text is cut only where no token can span the cut and where the pre-tokenizer's pattern gives the same
matches on either side: before a space or newline that follows a visible character, after such a newline
when a visible character follows, and between a letter or digit and ASCII punctuation (no apostrophe).
Everything else stays inside a unit, and the library encodes the unit. Ids are those of the whole text.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os

import numpy as np

from inkfold.llm import scan

#: Forget the units of a process beyond this number.
UNITS = 1_200_000

GRAPH = scan.byte_set((0x21, 0x7E))
ASCII_ALNUM = scan.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
PUNCT = GRAPH & ~ASCII_ALNUM & ~scan.byte_set((0x27, 0x27))
HIGH = scan.byte_set((0x80, 0xFF))
#: Bytes after which nothing is known of the row's characters beyond ASCII: controls, and lead bytes but those of U+00C0 to U+027F.
ODD = scan.byte_set((0x00, 0x09), (0x0B, 0x1F), (0x7F, 0x7F), (0xC0, 0xC2), (0xCA, 0xFF))


def _odd_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    odd = ODD[data]
    lead = data == 0xC3  # two signs among the letters, and one letter that lower case makes two characters of
    odd[:-1] |= lead[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    at = np.flatnonzero(odd)
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, at, side="right") - 1] = True
    return out


def cut(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the units."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    solid, letter = GRAPH[data], ASCII_ALNUM[data]
    high = HIGH[data]
    if high.any():
        bad = _odd_rows(data, offs)
        if bad.any():
            high &= ~np.repeat(bad, np.diff(offs))
        solid |= high
        letter |= high
    newline = data == 10
    start = np.zeros(n, bool)
    start[1:] = ((data[1:] == 32) | newline[1:]) & solid[:-1]
    start[1:] |= PUNCT[data[1:]] & letter[:-1]
    after = newline[1:-1] & solid[:-2] & solid[2:]
    # the newline, and what stands before it, belong to the row of what follows
    row_first = offs[:-1][np.diff(offs) > 0]
    near = row_first[(row_first < n)]
    ban = np.zeros(n, bool)
    ban[near] = True
    ban[near[near + 1 < n] + 1] = True
    start[2:] |= after & ~ban[2:]
    start[near] = True
    return np.flatnonzero(start)


class Encoder:
    """``encode(bytes, offsets)`` gives the ids of all rows, one after the other, and where each row's begin.

    A tokenizer whose pre-tokenizer is neither of the two known kinds gets whole texts as units.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a control token's name in a text is ordinary text
        with open(path, encoding="utf-8") as f:
            kind = json.load(f).get("pre_tokenizer") or {}
        inner = [x.get("type") for x in kind.get("pretokenizers", [])]
        self.units = kind.get("type") == "ByteLevel" or inner == ["Split", "ByteLevel"]
        self.fold = inner == ["Split", "ByteLevel"]
        #: Stands between units that are encoded in one call: a token of its own with either kind.
        self.between = " | " if self.fold else "\n"
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        got = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = got[0] if len(got) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.table = scan.HashTable(16)
        self.pool = np.zeros(1 << 16, self.kind)
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)

    def _encode(self, texts: list[str]) -> list:
        """Ids of each of these texts."""
        out: list = [None] * len(texts)
        stop = self.between.strip() or "\n"
        easy = [i for i, t in enumerate(texts) if self.mark is not None and stop not in t and (u := t.removeprefix(" ")) and " " not in u and u.isprintable() and len(u) < 200]
        for k in range(0, len(easy), 1000):
            part = easy[k : k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([texts[i] for i in part])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                continue
            for i, a, b in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 256):
            part = rest[k : k + 256]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.kind)
        return out

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        got = self._encode(texts)
        lens = np.array([len(x) for x in got], np.int64)
        ids = np.concatenate(got) if got else np.zeros(0, self.kind)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.table.n + len(keys) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.pool[self.used : self.used + len(ids)] = ids
        n = self.table.n
        self.first[n : n + len(keys)] = self.used + np.cumsum(lens) - lens
        self.count[n : n + len(keys)] = lens
        self.used += len(ids)
        self.table.add(keys)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = offs[:-1][np.diff(offs) > 0]
        starts = cut(data, offs) if self.units else rows
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        # a unit's length goes into its key, so equal keys need equal hashes and equal lengths
        keys = scan.run_hashes(data, starts, ends, scan.LOWER_VALUE if self.fold else scan.BYTE_VALUE) + (ends - starts).astype(np.uint64)
        keys = scan.mix(keys)
        at = self.table.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.table.n > UNITS:
                self._forget()
                new = np.arange(len(keys))
            fresh, pick = np.unique(keys[new], return_index=True)
            pick = new[pick]
            self._learn(fresh, [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
            at = self.table.find(keys)
        lens = self.count[at]
        ids = self.pool[scan.ragged(self.first[at], lens)]
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids, total[np.searchsorted(starts, offs)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def trim() -> None:
    """Give back to the system what this process has freed; some milliseconds."""
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone
    if back:
        back(0)


def release() -> None:
    """Drop this process's encoders, and give back what they took (about 120 MB)."""
    _ENCODERS.clear()
    gc.collect()
    trim()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
