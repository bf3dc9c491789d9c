"""Near copies by the Jaccard likeness of their sets of word shingles.

Texts of equal sets are one node from the start, so a group of copies of any size is one row. Which nodes are compared is narrowed in
three steps, each inside small groups only:

1. A node has BANDS keys of ROWS minima of its set each (MinHash); nodes that share a key are in one bucket. Two sets of
   likeness 0.8 share no key with a probability of 0.7 in 10,000, more alike ones with less.
2. In a bucket the nodes' SimHash fingerprints, of LANES * 64 bits over the set, are compared bit-sliced: word w of plane b holds bit b of 64
   fingerprints, carry-save counters add up the differing bits of 64 pairs at once, and pairs that have passed the radius are
   abandoned. Sets of likeness 0.8 differ in 155 bits of 1,024, give or take 11; sets of 0.47 in 286, give or take 14; the radius lies between. Small sets,
   whose majorities are often ties, get a wider one. What is found is joined at once, so a group of near copies costs about one comparison a member.
3. What is linked is compared exactly, set with set, so no pair below the likeness is linked.

A bucket or a group of linked nodes is met tile against tile, so none is in memory as a whole. Texts lie in bucketed blocks: those of linked nodes alone
move, once a tile; what stays comes back to the blocks as row numbers.

A text of fewer words than a shingle has one shingle of all its words; null, empty and blank texts have the same empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm import blocks, scan, store, units
from inkfold.llm.components import components

BANDS, ROWS = 24, 5
#: Words of 64 bits in a fingerprint; bits in which alike sets may differ, and the part of it that falls with the root of their size.
LANES, RADIUS, TIES = 16, 203, 90
#: Texts and shingles of a tile; nodes that are compared with all others in one call; (node, word of 64) pairs held at once;
#: words of a plane that small groups share a call by.
TILE, ROOM, QUERIES, PAIRS, WORDS = 2048, 1 << 22, 64, 1 << 15, 512
_FACTORS = scan.mix(np.arange(1, BANDS * ROWS + 1, dtype=scan.U) * scan.U(scan.BASE)) | scan.U(1)
_ADDED = scan.mix(_FACTORS)
_SKETCH = "node long, n int, print binary, bands array<long>"
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each row; ASCII case is ignored."""
    starts, ends = scan.runs(scan.NOT_SPACE[data], offs)
    words = scan.run_hashes(data, starts, ends, scan.LOWER_VALUE)
    windows = scan.window_hashes(words, size)
    edge = scan.row_starts(starts, offs).tolist()
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        out.append(np.unique(windows[a : b - size + 1]) if b - a >= size else scan.window_hashes(words[a:b], max(1, b - a)))
    return out


def print_of(made: np.ndarray) -> bytes:
    """The SimHash of a set: a bit is one if it is set in more than half of the shingles' hashes."""
    ones = np.zeros(64 * LANES, np.int64)
    for a in range(0, len(made), 255 * 64):  # sums of 255 rows fit a byte
        part = made[a : a + 255 * 64]
        wide = np.stack([scan.mix(part * _FACTORS[k]) for k in range(LANES)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        if rest := -len(bits) % 255:
            bits = np.concatenate([bits, np.zeros((rest, bits.shape[1]), np.uint8)])
        ones += bits.reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(made), bitorder="little").tobytes()


def sketch(found: list[np.ndarray]) -> dict:
    """Per set its 64-bit hash, its size, its fingerprint and its band keys."""
    sizes = np.array([len(s) for s in found], np.int64)
    keys = np.zeros((len(found), BANDS), scan.U)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(found)
        at = np.r_[0, np.cumsum(sizes[full])[:-1]]
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((flat + _ADDED[k]) * _FACTORS[k], at)
            keys[full, k // ROWS] = scan.mix(keys[full, k // ROWS] ^ least)
    node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in found], scan.U)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(found) + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
    return {"node": node.view(np.int64), "n": sizes.astype(np.int32), "print": pa.array([print_of(s) for s in found], pa.binary()), "bands": bands}


# --- bit-sliced comparison --------------------------------------------------------------
def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (nodes, LANES): row b holds bit b of all nodes, 64 nodes a word; padded with zeros."""
    padded = np.zeros((-(-len(prints) // 64) * 64, LANES), np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def _passed(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The bits whose counter is above ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | (equal & counters[k]), equal & ~counters[k]
    return above


def _added(counters: list[np.ndarray], carry: np.ndarray, k: int) -> None:
    while k < len(counters):
        counters[k], carry = counters[k] ^ carry, counters[k] & carry
        k += 1


def compared(queries: np.ndarray, vertical: np.ndarray, at: np.ndarray, col: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, differing bits) of at most ``radius`` differing bits among queries ``at`` and all 64 places of words ``col``."""
    found = []
    for first in range(0, len(at), PAIRS):
        q, word = at[first : first + PAIRS], col[first : first + PAIRS]
        counters = [np.zeros(len(q), np.uint64) for _ in range((64 * LANES).bit_length())]
        for lane in range(LANES):
            value = queries[q, lane]
            for b in range(0, 64, 2):
                # two planes at a time: a half adder gives their sum and their carry
                one, two = (vertical[64 * lane + b + j, word] ^ (np.uint64(0) - ((value >> np.uint64(b + j)) & np.uint64(1))) for j in (0, 1))
                low = one ^ two
                carry = counters[0] & low
                counters[0] = counters[0] ^ low
                _added(counters, carry | (one & two), 1)  # never both
            on = _passed(counters, radius) != _ALL
            if not on.all():
                q, word, counters = q[on], word[on], [c[on] for c in counters]
                if not len(q):
                    break
        if len(q):
            close = np.unpackbits((~_passed(counters, radius)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(close)
            count = sum(((c[i] >> j.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k, c in enumerate(counters))
            found.append((q[i], word[i] * 64 + j, count))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def within(queries: np.ndarray, vertical: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, differing bits) of all pairs of at most ``radius`` differing bits; ``vertical`` are the planes of ``n`` nodes."""
    words = vertical.shape[1]
    place = np.arange(len(queries) * words)
    i, j, bits = compared(queries, vertical, place // words, place % words, radius)
    return i[j < n], j[j < n], bits[j < n]


def spanning(n: int, met) -> list[tuple[int, int]]:
    """Links that span the components of a graph of ``n`` nodes. ``met(some, others)`` gives the linked pairs as places in both.

    Nodes come in calls of ``QUERIES``, those linked to earlier ones first, component by component. A node is never compared with
    one that is in its component already, so dense groups cost about one comparison a node.
    """
    left, reached, part, out = np.arange(n), np.zeros(0, np.int64), np.arange(n), []

    def join(x: int, y: int) -> None:
        if part[x] != part[y]:
            part[part == part[y]] = part[x]
            out.append((x, y))

    while len(left) or len(reached):
        if len(reached):
            own = part[reached] == part[reached[0]]
            some, others = reached[own][:QUERIES], np.concatenate([left, reached[~own]])
            reached = np.setdiff1d(reached, some)
        else:
            some, others, left = left[:QUERIES], left, left[QUERIES:]
        if not len(others):
            continue
        i, j = met(some, others)
        for x, y in zip(some[i].tolist(), others[j].tolist(), strict=True):
            join(x, y)
        new = np.setdiff1d(others[np.unique(j)], some)
        left, reached = np.setdiff1d(left, new), np.union1d(reached, new)
    return out


def _radius(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of sets of these sizes."""
    return RADIUS + TIES / np.sqrt(np.maximum(np.minimum(a, b), 4))


_WIDEST = RADIUS + TIES // 2


def close(groups: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, int]]]:
    """For each group (fingerprints, sizes) links that span the components of its nodes whose fingerprints are close.

    Groups of 64 nodes at most, which are nearly all, have a word of each plane to themselves and are compared in one call.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in groups]
    small = [g for g, (prints, _) in enumerate(groups) if len(prints) <= 64]
    for g, (prints, sizes) in enumerate(groups):
        if len(prints) > 64:

            def met(some, others, prints=prints, sizes=sizes):
                i, j, bits = within(prints[some], planes(prints[others]), len(others), _WIDEST)
                ok = bits <= _radius(sizes[some[i]], sizes[others[j]])
                return i[ok], j[ok]

            out[g] = spanning(len(prints), met)
    for first in range(0, len(small), WORDS):
        part = small[first : first + WORDS]
        n = np.array([len(groups[g][0]) for g in part])
        places = scan.ragged(64 * np.arange(len(part)), n)
        prints, sizes = np.zeros((64 * len(part), LANES), np.uint64), np.zeros(64 * len(part), np.int64)
        prints[places], sizes[places] = np.concatenate([groups[g][0] for g in part]), np.concatenate([groups[g][1] for g in part])
        i, j, bits = compared(prints[places], planes(prints), np.arange(len(places)), places // 64, _WIDEST)
        i = places[i]
        ok = (i < j) & (j % 64 < n[j // 64]) & (bits <= _radius(sizes[i], sizes[j]))
        for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            out[part[x // 64]].append((x % 64, y % 64))
    return out


def alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    """Whether two sets have that Jaccard likeness at least."""
    if min(len(a), len(b)) < likeness * max(len(a), len(b)) * 0.999999:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= likeness


def exact(prints: np.ndarray, made: list[np.ndarray], likeness: float) -> list[tuple[int, int]]:
    """Links that span the components of alike sets, of those whose fingerprints are close.

    Sets are compared one by one, so each set that is linked is compared no more: here a fingerprint is met with what is left only.
    """
    sizes = np.array([len(s) for s in made], np.int64)
    left, queue, out = np.arange(len(made)), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        x = queue.pop()
        bits = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1, dtype=np.int64)
        least = np.minimum(sizes[left], sizes[x])
        ok = (bits <= _radius(sizes[left], sizes[x])) & (least >= likeness * np.maximum(sizes[left], sizes[x]) * 0.999999)
        hit = [y for y in left[ok].tolist() if alike(made[x], made[y], likeness)]
        out += [(x, y) for y in hit]
        queue += hit
        left = left[~np.isin(left, hit)]
    return out


# --- on Spark ---------------------------------------------------------------------------
def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` once for each pair of tiles (i, j) of their group, which has so many ``tiles``."""
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return pairs.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("tile", "other", "tiles")


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` once, each in its own tile of its group."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    return rows.withColumn("i", own).withColumn("j", own).drop("tiles")


def _grouped(rows: DataFrame, key: list[str], columns: list[str], link, together: int) -> DataFrame:
    """(a, b): what ``link(groups)`` finds in each group of equal (key, i, j), of about ``together`` rows at once; rows are lists of ``columns``, ``node`` first."""
    order = [*key, "i", "j"]

    def run(batches):
        now, held, groups, room = None, [], [], 0

        def found():
            pairs = [(rows[x][0], rows[y][0]) for rows, linked in zip(groups, link(groups), strict=True) for x, y in linked]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: len(order)] != now:
                    if len(held) > 1:
                        groups.append(held)
                        room += len(held)
                    if room >= together:
                        yield found()
                        groups, room = [], 0
                    now, held = row[: len(order)], []
                held.append(row[len(order) :])
        if len(held) > 1:
            groups.append(held)
        if groups:
            yield found()

    dealt = rows.repartition(*order).sortWithinPartitions(*order, "node")
    return dealt.select(*order, *columns).mapInArrow(run, "a long, b long")


def _prints(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u8").reshape(-1, LANES)


def candidates(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that share a key and have close fingerprints; they span the components of all such pairs.

    Near copies share most of their keys, so many buckets have the same nodes. Such buckets are one, told by their number of nodes and
    the nodes' hashes, and are compared once; what a collision of hashes brings together is only compared in vain.
    """
    keys = distinct.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    same = Window.partitionBy("bucket")
    # the keys move once, without fingerprints; only nodes of crowded buckets get these
    crowded = keys.select("node", F.count(F.lit(1)).over(same).alias("m"), F.bit_xor(F.xxhash64("node")).over(same).alias("members")).where("m > 1")
    dealt = crowded.repartition("node").dropDuplicates(["node", "m", "members"]).join(distinct.select("node", "n", "print"), "node")
    met = _tiles(dealt.withColumn("tiles", F.ceil(F.col("m") / F.lit(TILE)).cast("int")))
    return _grouped(met, ["members", "m"], ["node", "n", "print"], lambda groups: close([(_prints([r[2] for r in rows]), np.array([r[1] for r in rows])) for rows in groups]), PAIRS)


def _sized(rows: DataFrame) -> DataFrame:
    """(root, tiles) of groups of nodes with sizes ``n``."""
    most = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TILE // 2)), F.ceil(F.sum("n") / F.lit(ROOM // 2)), F.lit(1))
    return rows.groupBy("root").agg(most.cast("int").alias("tiles"))


def links(laid: DataFrame, text: int, distinct: DataFrame, size: int, likeness: float) -> DataFrame:
    """Links (a, b) between alike nodes that span the components of all of them; ``distinct`` names a row of each node.

    Nodes that were linked are compared in their tile first, so their texts move once. Of a group of several tiles one text of
    each component so far is compared next, which joins what is dense. Only groups that are not one component then
    are met tile against tile.
    """
    roots = components(candidates(distinct))
    members = store.written(roots.join(distinct.select("node", "n", "print", "least"), "node"))

    def texts(batches):
        for batch in batches:
            for raw, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = blocks.unpack(raw).column(text)
                chosen = rows.take(pa.array([x["row"] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x["root"] for x in found]), pa.array([x["node"] for x in found]), pa.array([x["tiles"] for x in found], pa.int32()), pa.array([x["print"] for x in found], pa.binary()), chosen.cast(pa.string())], ["root", "node", "tiles", "print", "text"])

    def link(rows):
        data = [(r[2] or "").encode() for r in rows]
        made = sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64), size)
        return exact(_prints([r[1] for r in rows]), made, likeness)

    def compare(some: DataFrame, dealt) -> DataFrame:
        # the number of tiles goes with the nodes, so that their texts move once
        wanted = some.join(_sized(some), "root").groupBy("least.block").agg(F.collect_list(F.struct("least.row", "root", "node", "tiles", "print")).alias("found"))
        moved = laid.join(wanted, "block").select("payload", "found").mapInArrow(texts, "root long, node long, tiles int, print binary, text string")
        return store.written(_grouped(dealt(moved), ["root"], ["node", "print", "text"], lambda groups: [link(rows) for rows in groups], 1))

    def parts(made: DataFrame, some: DataFrame) -> DataFrame:
        """``some`` with ``part``, the component of each node by the links so far."""
        return some.join(components(made).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))

    made = compare(members, _once)
    large = store.written(members.join(_sized(members).where("tiles > 1").select("root"), "root", "left_semi"))
    if large.isEmpty():
        return made
    made = made.union(compare(parts(made, large).where("part = node"), _once))
    split = parts(made, large).groupBy("root").agg(F.count_distinct("part").alias("m")).where("m > 1").select("root")
    rest = store.written(large.join(split, "root", "left_semi"))
    return made if rest.isEmpty() else made.union(compare(rest, _tiles))


def keep_one(docs: DataFrame, size: int, likeness: float) -> DataFrame:
    """Of each component of alike rows the one with the smallest (doc_id, hash of the text); rows of null doc_id are not compared and stay.

    Of equal rows one stays. All columns go with the rows, whatever their names.
    """
    text, doc = docs.columns.index("text"), docs.columns.index("doc_id")
    laid = blocks.lay_out(docs, text)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def sketched(batches):
        units.release()
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = blocks.unpack(raw)
                some = np.flatnonzero(rows.column(doc).is_valid().to_numpy(zero_copy_only=False))
                column = rows.column(text).take(pa.array(some))
                for lo, hi, data, offs in scan.slices(column):
                    part = some[lo:hi]
                    hashes = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) - (1 << 63) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                    made = sketch(sets(data, offs, size))
                    head = [pa.array(np.full(len(part), block)), pa.array(part.astype(np.int32)), rows.column(doc).take(pa.array(part)).cast(pa.int64()), pa.array(hashes, pa.int64())]
                    yield pa.RecordBatch.from_arrays([h.cast(k) for h, k in zip(head, kinds, strict=True)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()], ["block", "row", "doc_id", "hash", *made])

    found = laid.select("block", "payload").mapInArrow(sketched, f"block long, row int, doc_id long, hash long, {_SKETCH}")
    least = F.min(F.struct("doc_id", "hash", "block", "row")).alias("least")
    distinct = store.written(found.groupBy("node").agg(least, F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    roots = components(links(laid, text, distinct, size, likeness))
    rooted = distinct.select("node", "least").join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.block", "least.row")
    flags = store.written(kept.groupBy("block").agg(F.collect_list("row").alias("rows")))  # at most the rows of a block

    def chosen(batches):
        for batch in batches:
            for raw, stay in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = blocks.unpack(raw)
                on = rows.column(doc).is_null().to_numpy(zero_copy_only=False).copy()
                on[np.array(stay or [], np.int64)] = True
                yield rows.filter(pa.array(on))

    return laid.join(flags, "block", "left").select("payload", "rows").mapInArrow(chosen, docs.schema)
