"""Hard negatives by cover trees: for an anchor and each of its positives, the best rows of another label in a window of scores.

Rows are dealt into blocks by a hash of their id; a block has a cover tree of its own (``cover_tree``), built once and written. Anchors go
in packs to slices of the blocks: a cell is (group of anchors, slice), read block by block, and what an anchor has found in one block
bounds its search in the next. A cell gives at most ``k`` rows for each window, of which Spark keeps the best over all cells. The number
of slices follows the root of the number of blocks, so both what is sent to cells and what comes back stay far below anchors times blocks.

Two searches follow one another: positives (same label, no window), then negatives (other labels, one window a positive).

Defined cases: rows with a null vec_id, label or vector, with a null or non-finite component, or of a squared length of 2 ** 52 and more
(in integers, beyond which doubles can't hold scores) take no part; of rows of one vec_id the one with the smallest (label, vector) does,
so equal rows count once; vectors of different dimensions never meet; an anchor without positives, a positive without negatives
and an empty table give no rows. Labels may be any integers. Columns other than vec_id, label and embedding aren't read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm import cover_tree, store

#: Rows of a block; anchors of a group, of a pack, and of one descent.
BLOCK, GROUP, PACK, TOGETHER = 2048, 1 << 15, 2048, 512
SCALE, POSITIVES, NEGATIVES = 256, 5, 10


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, one of each vec_id; labels as mined."""
    label = F.col("label").cast("long")
    value = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    known = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > F.lit(1e15))))
    rows = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), value.alias("embedding"))
    short = rows.where(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x) < F.lit(float(1 << 52)))
    one = short.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return store.written(one.select("vec_id", "r.label", "r.embedding"))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _packed(rows: DataFrame, keys: list[str], most: int, indexed: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, payload): the rows of a key and a dimension, ``most`` at a time; with ``indexed`` as trees."""

    def run(batches):
        now, held = None, []

        def close():
            by_dim: dict[int, list] = {}
            for r in held:
                by_dim.setdefault(len(r[2]), []).append(r)
            for part in by_dim.values():
                for a in range(0, len(part), most):
                    some = part[a : a + most]
                    ids, labels, vectors = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int64), np.stack([r[2] for r in some])
                    small = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors
                    made = cover_tree.build(small, ids, labels) if indexed else (ids, labels, small, *[[r[3 + k] for r in some] for k in range(len(more))])
                    yield pa.RecordBatch.from_arrays([*[pa.array([k]) for k in now], pa.array([pickle.dumps(made, 5)], pa.binary())], [*keys, "payload"])

        for batch in batches:
            n = len(keys)
            columns = [c.to_pylist() for c in batch.columns[: n + 2]] + [_matrix(batch.column(n + 2))] + [c.to_pylist() for c in batch.columns[n + 3 :]]
            for row in zip(*columns, strict=True):
                if list(row[:n]) != now:
                    if held:
                        yield from close()
                    now, held = list(row[:n]), []
                held.append(row[n:])
                if not indexed and len(held) >= most:
                    yield from close()
                    held = []
        if held:
            yield from close()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "vec_id").select(*keys, "vec_id", "label", "embedding", *more)
    return store.written(dealt.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", payload binary"))


def _anchors(rows: DataFrame, groups: int, more: tuple[str, ...] = ()) -> DataFrame:
    placed = rows.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)))
    return _packed(placed, ["grp"], PACK, False, more)


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _cells(anchors: DataFrame, blocks: DataFrame, groups: int, slices: int, run, schema: str) -> DataFrame:
    """``run`` over the rows (grp, slice, kind, payload) of each cell: its anchors (kind 0), then its blocks."""
    there = anchors.select("grp", F.explode(_numbers(slices)).alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "payload")
    here = blocks.select(F.explode(_numbers(groups)).alias("grp"), F.pmod("block", F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "block", "payload")
    order = ["grp", "slice", "kind", "block"]
    return there.unionAll(here).repartition("grp", "slice").sortWithinPartitions(*order).select("grp", "slice", "kind", "payload").mapInArrow(run, schema)


class _Search:
    """The anchors of a cell by dimension, in descents of ``TOGETHER``, and what they have found so far."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, payload: bytes) -> None:
        ids, labels, vectors, *given = pickle.loads(payload)
        for a in range(0, len(ids), TOGETHER):
            at = slice(a, a + TOGETHER)
            q = vectors[at].astype(np.float64)
            positives = [x[at] for x in given]
            if positives:  # windows: 30 * positive <= 100 * score <= 90 * positive
                width = max(len(p) for p in positives[0])
                low, high = np.full((len(q), width), np.inf), np.full((len(q), width), -np.inf)
                for i, found in enumerate(positives[0]):
                    for w, p in enumerate(found):
                        low[i, w], high[i, w] = -(-30 * p["score"] // 100), 90 * p["score"] // 100
            else:
                low, high = np.full((len(q), 1), -np.inf), np.full((len(q), 1), np.inf)
            self.parts.append((ids[at], labels[at], q, (q * q).sum(axis=1), positives[0] if positives else None, cover_tree.Top(low, high, self.k)))

    def meet(self, tree: cover_tree.Tree) -> None:
        for ids, labels, q, norms, positives, top in self.parts:
            if q.shape[1] != tree.vectors.shape[1]:
                continue
            if positives is None:
                cover_tree.search(tree, q, norms, top, lambda rows, other, kind: (labels[rows] == kind) & (ids[rows] != other))
            else:
                cover_tree.search(tree, q, norms, top, lambda rows, _, kind: labels[rows] != kind)

    def found(self):
        for ids, _, _, _, positives, top in self.parts:
            q, w, k = np.nonzero(top.id != cover_tree.NONE)
            column = [ids[q]] if positives is None else [ids[q], np.array([positives[i][j]["id"] for i, j in zip(q, w, strict=True)], np.int64), np.array([positives[i][j]["score"] for i, j in zip(q, w, strict=True)], np.int64)]
            yield [*column, top.id[q, w, k], top.score[q, w, k].astype(np.int64)]


def _searched(k: int, names: list[str]):
    def run(batches):
        now, cell = None, None

        def close():
            for columns in cell.found():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for grp, part, kind, payload in zip(*(c for c in batch.columns), strict=True):
                if (grp.as_py(), part.as_py()) != now:
                    if cell:
                        yield from close()
                    now, cell = (grp.as_py(), part.as_py()), _Search(k)
                if kind.as_py() == 0:
                    cell.add(payload.as_py())
                elif cell.parts:
                    cell.meet(pickle.loads(payload.as_py()))
        if cell:
            yield from close()

    return run


def _best(rows: DataFrame, key: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc(score), ident)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = usable(embeddings)
    is_anchor = F.col("vec_id") % 100 == 0
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    blocks_n, groups = max(1, -(-n["rows"] // BLOCK)), max(1, -(-n["anchors"] // GROUP))
    slices = min(blocks_n, int(np.ceil(2 * np.sqrt(blocks_n))))
    blocks = _packed(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks_n))), ["block"], 2 * BLOCK, True)
    anchors = rows.where(is_anchor)
    near = ["anchor_id", "positive_id", "positive_score"]
    met = _cells(_anchors(anchors, groups), blocks, groups, slices, _searched(positives, near), ", ".join(f"{c} long" for c in near))
    chosen = store.written(_best(met, ["anchor_id"], "positive_score", "positive_id", positives))
    lists = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    given = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _cells(_anchors(given, groups, ("positives",)), blocks, groups, slices, _searched(negatives, names), ", ".join(f"{c} long" for c in names))
    best = _best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
