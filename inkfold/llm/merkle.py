"""A Merkle manifest of a dataset with a membership proof (witness) of every row.

A row's leaf digests its five fields. Per source the leaves, by doc_id, are the bottom of a tree of ``ARITY``; the sources' roots,
by source, are the bottom of one more tree, whose root stands for the dataset.

Witnesses grow while digests are appended: a stream of nodes keeps one open run per level. When a run is complete, every
node in it becomes known to the leaves below the others: their partial witnesses get one more step, and the run's own digest is appended a level
higher. Leaves are numbered in two levels (``numbering``), cut into blocks at multiples of ``ARITY ** LEVELS``, and
each block is such a stream by itself. The roots of blocks are further appends, to streams of the same kind one storey up, until one node
is left of each tree; a leaf's witness is its witness in the block, then that of the block, then that of its source.
A block has a bounded number of leaves whatever its source, and texts never move: only digests do.

Defined cases: null fields are ``-`` in the leaf; a null doc_id comes before all others and is never tampered with; a null source is a source
of its own, the first; rows of equal doc_id and source stand by their leaves, and equal rows are leaves each (they verify,
with different proofs); an empty table has no root and gives no rows. Only the five columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm import blocks, store
from inkfold.operators import numbering

ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_KEY = "_tree"


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(text: Column) -> Column:
    """The hex digest of the fields, with ``text`` for the text."""
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Witnesses:
    """A stream of digests that is appended to; ``paths[i]`` are the steps of the i-th so far: (hex to its left, hex to its right)."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, int, int]]] = []
        self.paths: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        i = len(self.paths)
        self.paths.append([])
        self._add(0, (node, i, i + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        while len(self.open) <= level:
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        hexes = [d for d, _, _ in run]
        for k, (_, a, b) in enumerate(run):
            step = ("".join(hexes[:k]), "".join(hexes[k + 1 :]))
            for i in range(a, b):
                self.paths[i].append(step)
        self._add(level + 1, (digest(hexes), run[0][1], run[-1][2]))

    def finish(self, height: int) -> str:
        """Complete the open runs below ``height``; the digest that is left."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    h = 0
    while total > 1:
        total, h = -(-total // ARITY), h + 1
    return h


def grown(nodes: list[str], total: int, levels: int) -> Witnesses:
    """The stream of a block's nodes, finished; ``total`` nodes are in the whole tree. Its digest is ``root``."""
    made = Witnesses()
    for node in nodes:
        made.append(node)
    made.root = made.finish(min(levels, height(total)))
    return made


def _blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """(_tree, block, total, payload, root): each block of nodes as one row, the nodes in their order with the columns ``keep``."""
    levels, width = LEVELS, ARITY**LEVELS
    kinds = pa.schema([(c, pa.int64() if c in ("doc_id", "place") else pa.binary()) for c in keep])

    def run(batches):
        now, held = None, []

        def close():
            rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(kinds)], schema=kinds)
            root = grown([x.hex() for x in rows.column(0).to_pylist()], now[2], levels).root
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int64()), pa.array([blocks.pack(rows)], pa.binary()), pa.array([bytes.fromhex(root)], pa.binary())],
                [_KEY, "block", numbering.TOTAL, "payload", "digest"])

        for batch in batches:
            for tree, block, total, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, block, total) != now:
                    if held:
                        yield close()
                    now, held = (tree, block, total), []
                held.append(row)
        if held:
            yield close()

    cut = nodes.select(_KEY, F.floor(F.col(numbering.PLACE) / F.lit(width)).cast("long").alias("block"), numbering.TOTAL, *keep, F.col(numbering.PLACE).alias("_place"))
    dealt = cut.repartition(_KEY, "block").sortWithinPartitions(_KEY, "block", "_place").select(_KEY, "block", numbering.TOTAL, *keep)
    return store.written(dealt.mapInArrow(run, f"{_KEY} string, block long, {numbering.TOTAL} long, payload binary, digest binary"))


def _opened(payload: bytes, total: int, levels: int) -> tuple[pa.RecordBatch, Witnesses]:
    rows = blocks.unpack(payload)
    return rows, grown([x.hex() for x in rows.column(0).to_pylist()], total, levels)


_STEPS = "array<struct<left:string,right:string>>"


def _structs(steps) -> list[dict]:
    return [{"left": a, "right": b} for a, b in steps]


def _given(steps) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in steps]


def upper(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From blocks: (_tree, block, path) of every block up to its tree's root, and (_tree, digest) of the roots."""
    levels, width = LEVELS, ARITY**LEVELS
    if cut.where(F.col(numbering.TOTAL) > width).isEmpty():
        return cut.select(_KEY, "block", F.array().cast(_STEPS).alias("path")), cut.select(_KEY, "digest")
    nodes = cut.select(_KEY, F.col("block").alias(numbering.PLACE), F.ceil(F.col(numbering.TOTAL) / F.lit(width)).cast("long").alias(numbering.TOTAL), "digest")
    above = _blocks(nodes, ["digest", numbering.PLACE])
    paths, roots = upper(above)

    def run(batches):
        for batch in batches:
            for tree, total, payload, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, made = _opened(payload, total, levels)
                out = [_structs(p) + path for p in made.paths]
                yield pa.RecordBatch.from_pydict({_KEY: [tree] * len(out), "block": rows.column(1), "path": out}, schema=kinds)

    kinds = pa.schema([(_KEY, pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])
    joined = above.join(paths, [_KEY, "block"]).select(_KEY, numbering.TOTAL, "payload", "path")
    return store.written(joined.mapInArrow(run, f"{_KEY} string, block long, path {_STEPS}")), roots


def leaves(docs: DataFrame) -> DataFrame:
    """(leaf, tampered, doc_id, _tree): digests as bytes; ``tampered`` is null where nothing was tampered with."""
    text = F.col("text")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    stripped = F.replace(text, F.lit("\n"), F.lit(""))
    rows = store.spread(docs.select(*FIELDS)).select(
        F.unhex(leaf(text)).alias("leaf"), F.when(chosen, F.unhex(leaf(stripped))).alias("tampered"), F.col("doc_id").cast("long").alias("doc_id"),
        # null first, then bytewise
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias(_KEY))
    return store.written(rows)


def fold(node: str, path) -> str:
    for left, right in path:
        node = digest([left, node, right])
    return node


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf), verified."""
    cut = _blocks(numbering.numbered(leaves(docs), ["doc_id", "leaf"], [_KEY]), ["leaf", "tampered", "doc_id"])
    paths, subroots = upper(cut)
    # the sources are the leaves of one tree
    sources = numbering.numbered(store.written(subroots.withColumnRenamed(_KEY, "_source")), ["_source"]).withColumn(_KEY, F.lit(""))
    top = store.written(sources.select(_KEY, numbering.PLACE, numbering.TOTAL, "digest", "_source"))
    top_paths, root = upper_of(top)
    first = root.first()
    whole = first.digest.hex() if first else ""
    of_source = top.join(top_paths, numbering.PLACE).select(F.col("_source").alias(_KEY), F.col("digest").alias("subroot"), F.col("path").alias("last"))
    ways = paths.join(of_source, _KEY).select(_KEY, "block", "subroot", F.concat("path", "last").alias("path"))

    levels = LEVELS

    def run(batches):
        for batch in batches:
            for total, payload, subroot, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, made = _opened(payload, total, levels)
                rest, out = _given(path), []
                after = "".join(a + b for a, b in rest)
                sub = subroot.hex()
                for own, bad, doc_id, steps in zip(*(c.to_pylist() for c in rows.columns), made.paths, strict=True):
                    proof = digest([a + b for a, b in steps] + [after])
                    folded = fold((own if bad is None else bad).hex(), [*steps, *rest])
                    out.append((doc_id, own.hex(), sub, whole, proof, folded, folded == whole))
                yield pa.RecordBatch.from_arrays([pa.array(x) if k else pa.array(x, pa.int64()) for k, x in enumerate(zip(*out, strict=True))], NAMES)

    return cut.join(ways, [_KEY, "block"]).select(numbering.TOTAL, "payload", "subroot", "path").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def upper_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(place, path) of every node of one tree, and its root, one row."""
    cut = _blocks(nodes, ["digest", numbering.PLACE])
    paths, roots = upper(cut)
    levels = LEVELS

    def run(batches):
        for batch in batches:
            for total, payload, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, made = _opened(payload, total, levels)
                yield pa.RecordBatch.from_pydict({numbering.PLACE: rows.column(1), "path": [_structs(p) + path for p in made.paths]}, schema=kinds)

    kinds = pa.schema([(numbering.PLACE, pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])
    joined = cut.join(paths, [_KEY, "block"]).select(numbering.TOTAL, "payload", "path")
    return store.written(joined.mapInArrow(run, f"{numbering.PLACE} long, path {_STEPS}")), roots
