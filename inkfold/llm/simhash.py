"""SimHash near duplicates by bit-sliced comparison.

Equal fingerprints are one fingerprint from the start, so a group of copies of any size is one row.
A pair within ``RADIUS`` differing bits agrees on whole pieces: of PIECES pieces of the 64 bits, at most
RADIUS differ, so it agrees on some choice of PIECES - RADIUS of them. Every distinct fingerprint goes into
one bucket per choice; pairs are only compared in a bucket. There the fingerprints lie as 64 bit planes: word w of
plane b holds bit b of 64 fingerprints. Against one fingerprint a plane (or its complement) is the
difference in that bit of 64 pairs at once; carry-save counters of three bits add the planes up, and
blocks in which all counters have passed the radius are abandoned.

A bucket is met in tiles of bounded size, tile against tile, so no bucket is in memory as a whole. Of the links of
two tiles only a spanning forest is kept; components then come from contraction.

Defined cases: a null or empty text has fingerprint zero; rows of equal doc_id are one document with the
smallest of the components they reach; rows of null doc_id get a fingerprint, and as component the smallest doc_id of those linked
to it, or null; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm import scan, shingles, store
from inkfold.llm.components import components

SHINGLE, SEED, RADIUS, PIECES, TILE = 3, 42, 3, 5, 4096
#: (Fingerprint, block of 64) pairs that are compared in one call; small buckets share a call.
PAIRS = 1 << 15
_TO_SPACE = bytes(32 if not scan.NOT_SPACE[b] else int(scan.LOWER[b]) for b in range(256))


def fingerprint(text: bytes) -> int:
    """A bit is one if it is set in more than half of the hashes of the 3-word shingles."""
    words = text.translate(_TO_SPACE).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]][: len(words) - SHINGLE + 1].tolist()
        shingles = [line[a:b] for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # whole texts, in pieces that keep the bits of a long one small
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit integers."""

    def per_slice(data, offs, _):
        raw = data.tobytes()
        return {"fp": np.array([fingerprint(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64).view(np.int64)}

    return scan.map_text(store.spread(docs.select("doc_id", "text")), per_slice, "doc_id long, fp long", keep=["doc_id"])


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values a word; the last word is padded with zeros."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def close_pairs(groups: list[tuple[np.ndarray, np.ndarray]], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of at most ``radius`` (below 4) differing bits, a from the first and b from the second part of one group."""
    words = [-(-len(b) // 64) for _, b in groups]
    edge = np.r_[0, np.cumsum(words)]
    values = np.zeros(64 * edge[-1], np.uint64)
    real = np.zeros(64 * edge[-1], bool)
    for (_, b), at in zip(groups, edge[:-1].tolist(), strict=True):
        values[64 * at : 64 * at + len(b)] = b
        real[64 * at : 64 * at + len(b)] = True
    queries = np.concatenate([a for a, _ in groups])
    vertical = planes(values)
    each = np.repeat(words, [len(a) for a, _ in groups])
    q = np.repeat(np.arange(len(queries)), each)
    block = scan.ragged(np.repeat(edge[:-1], [len(a) for a, _ in groups]), each)
    found = []
    for k in range(0, len(q), 1 << 16):
        at, col = q[k : k + (1 << 16)], block[k : k + (1 << 16)]
        # counters: bits of value 1 and 2, and what has passed 3
        one, two, over = (np.zeros(len(at), np.uint64) for _ in range(3))
        value = queries[at]
        for b in range(64):
            flip = np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1))
            differs = vertical[b, col] ^ flip
            carry = one & differs
            one = one ^ differs
            over = over | (two & carry)
            two = two ^ carry
            if b % 8 == 7:
                on = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not on.all():
                    at, col, value, one, two, over = (x[on] for x in (at, col, value, one, two, over))
                    if not len(at):
                        break
        if len(at):
            count = np.unpackbits(one.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
            count += 2 * np.unpackbits(two.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
            passed = np.unpackbits(over.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero((passed == 0) & (count <= radius))
            v = col[i] * 64 + j
            i, v = i[real[v]], v[real[v]]
            found.append((queries[at[i]], values[v]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node linked to it) for the components of these links."""
    parent: dict[int, int] = {}

    def top(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(parent) if top(x) != x]


def _choices() -> list[int]:
    """Masks of the bits on which a close pair agrees for some choice of pieces."""
    edges = [64 * i // PIECES for i in range(PIECES + 1)]
    piece = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(PIECES)]
    return [sum(c) for c in combinations(piece, PIECES - RADIUS)]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span the same components as all close pairs."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _choices()]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    # (choice, key) as one column: the hash is only where the row goes, the bucket is told by both
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp")
    counted = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"))
    crowded = store.written(counted.where(F.col("n") > 1))
    few, many = crowded.where(F.col("n") <= TILE), crowded.where(F.col("n") > TILE)
    # tiles of a crowded bucket: every fingerprint goes to the tile pairs of which its tile is one
    tiles = F.ceil(F.col("n") / F.lit(TILE // 2)).cast("int")
    inside = rows.join(few.select("choice", "key"), ["choice", "key"]).select("choice", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    dealt = rows.join(many, ["choice", "key"]).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = dealt.select("choice", "key", "fp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    across = pairs.select("choice", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "fp")

    def run(batches):
        now, first, second, groups, room = None, [], [], [], 0

        def compare():
            a, b = (x.view(np.int64) for x in close_pairs(groups))
            made = forest(a[a != b], b[a != b])
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())], ["a", "b"])

        def close():
            nonlocal room
            a = np.array(first, np.int64).view(np.uint64)
            b = np.array(second, np.int64).view(np.uint64) if now[2] != now[3] else a
            if len(a) and len(b):
                groups.append((a, b))
                room += len(a) * -(-len(b) // 64)

        for batch in batches:
            for *key, side, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now:
                        close()
                    if room >= PAIRS:
                        yield compare()
                        groups, room = [], 0
                    now, first, second = key, [], []
                (second if side else first).append(fp)
        if now:
            close()
        if groups:
            yield compare()

    order = ["choice", "key", "i", "j"]
    together = inside.unionAll(across).repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return together.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    made = store.written(fingerprints(docs))
    distinct = store.written(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = store.written(rooted.join(least, "root").select("fp", "component_id"))
    out = made.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, likeness: float = 0.8) -> DataFrame:
    """One row of each group of rows whose sets of ``shingle`` words are alike (see ``shingles``); rows of null doc_id stay.

    The fingerprints of ``near_duplicates`` find but a part of such pairs in three bits; these are longer, and what they find is compared exactly.
    """
    return shingles.keep_one(docs, shingle, likeness)
