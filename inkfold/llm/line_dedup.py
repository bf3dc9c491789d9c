"""Removal of repeated line chunks with content-defined boundaries.

A line's hash is the first 60 bits of its MD5. A rolling hash over ``SPAN`` line hashes ends a chunk where it is
divisible by ``DIVISOR``, and every ``LONGEST`` lines behind such a place a chunk ends anyway; so boundaries depend
on nearby lines only and come back after an insertion. Chunks of two lines and more that stand more than
once in the corpus are kept at their first place (smallest doc_id, then smallest line) and removed elsewhere.

Chunks are first counted by a 128-bit hash, without their texts. Those counted twice or more are compared
byte by byte: where the smallest and the largest text of a hash are equal, all are; else its texts are grouped as they are.
Both are minima that combine before the shuffle, so a chunk of every document is no hot group. What is asked for and what is removed comes
back to the documents as line numbers; the texts lie in bucketed blocks and are not shuffled.

Defined cases: a null text stays null and has no lines, an empty one has one line; lines end at \\n alone; rows of
equal doc_id are told apart by their texts, and equal rows are one place: both keep or both lose; a null doc_id
sorts before all others; an empty table gives no rows. Other columns are kept as they are, whatever their names;
n_chars, where there is one, follows the text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.llm import blocks, store
from inkfold.llm.blocks import unpack

SPAN, DIVISOR, LONGEST, LEAST = 3, 4, 64, 2
#: Multipliers of the rolling hash for the line itself and those before it, and its modulus.
FACTORS, MODULUS = (1, 31, 961), 1_000_003


def line_hashes(lines: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.md5(x).digest()[:8], "big") >> 4 for x in lines]


def chunk_edges(hashes: list[int]) -> list[int]:
    """Where chunks begin, and the number of lines."""
    small = [h % MODULUS for h in hashes]
    edges, since = [0], 0  # since: behind the last boundary that the rolling hash chose
    for i in range(len(small)):
        rolling = sum(f * small[i - j] for j, f in enumerate(FACTORS) if i - j >= 0)
        chosen = (rolling % MODULUS) % DIVISOR == 0
        if chosen or (i + 1 - since) % LONGEST == 0 or i + 1 == len(small):
            edges.append(i + 1)
        if chosen:
            since = i + 1
    return edges


def chunks(text: str) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes with inner line ends) of the chunks of a text."""
    lines = text.encode().split(b"\n")
    edges = chunk_edges(line_hashes(lines))
    return [(a, b - a, b"\n".join(lines[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]


PLACE = "doc_id long, sub long, first int"


def _places(blocks: DataFrame, doc: int, text: int, wanted: bool) -> DataFrame:
    """(block, row, place, chunk) of multi-line chunks; with ``wanted`` only those asked for, and their bytes."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.binary()] * wanted]
    names = ["block", "row", "doc_id", "sub", "first", "chunk", *["body"] * wanted]

    def run(batches):
        for batch in batches:
            for block, raw, *asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = unpack(raw)
                only = {(x["row"], x["first"]) for x in asked[0]} if wanted else None
                out = []
                for i, (key, body) in enumerate(zip(rows.column(doc).to_pylist(), rows.column(text).to_pylist(), strict=True)):
                    if body is None:
                        continue
                    sub = int.from_bytes(hashlib.md5(body.encode()).digest()[:8], "big", signed=True)
                    for first, n, chunk in chunks(body):
                        if n >= LEAST and (only is None or (i, first) in only):
                            out.append((block, i, key, sub, first, hashlib.md5(chunk).digest(), *[chunk] * wanted))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    return blocks.mapInArrow(run, f"block long, row int, {PLACE}, chunk binary" + ", body binary" * wanted)


def _rewritten(at: int, length: int | None, counts: list[str]):
    """Blocks with (row, first line) of what goes to their rows with the new texts, and the counts of lines."""

    def run(batches):
        for batch in batches:
            for raw, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, out = unpack(raw), {}
                for x in found or []:
                    out.setdefault(x["row"], set()).add(x["first"])
                texts, total, gone = rows.column(at).to_pylist(), [], []
                for i, text in enumerate(texts):
                    parts = chunks(text) if i in out else []
                    total.append(0 if text is None else text.count("\n") + 1)
                    gone.append(sum(n for first, n, _ in parts if first in out[i]))
                    if parts:
                        texts[i] = b"\n".join(body for first, _, body in parts if first not in out[i]).decode()
                columns = [*rows.columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
                columns[at] = pa.array(texts, rows.schema.field(at).type)
                if length is not None:
                    columns[length] = pa.array([None if t is None else len(t) for t in texts], rows.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, *counts])

    return run


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(F.struct("row", "first")).alias("found"))


def _removals(blocks: DataFrame, doc: int, text: int) -> DataFrame:
    """(block, found): row and first line of the chunks that a block's rows lose."""
    order, at = F.struct("doc_id", "sub", "first"), ["block", "row", "doc_id", "sub", "first"]
    listed = store.written(_places(blocks, doc, text, False))
    counted = listed.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    suspects = _listed(listed.join(counted, "chunk", "left_semi"))
    bodies = store.written(_places(blocks.join(suspects, "block").select("block", "payload", "found"), doc, text, True))
    compared = store.written(bodies.groupBy("chunk").agg(F.min(order).alias("least"), (F.min("body") == F.max("body")).alias("equal")))
    alike = bodies.select(*at, "chunk").join(compared.where("equal"), "chunk")
    found = alike.select(*at, "least")
    collided = compared.where("NOT equal").select("chunk")
    if not collided.isEmpty():  # texts that only share a hash: grouped as they are
        apart = bodies.join(collided, "chunk", "left_semi")
        exact = apart.join(apart.groupBy("chunk", "body").agg(F.min(order).alias("least")), ["chunk", "body"])
        found = found.unionByName(exact.select(*at, "least"))
    return _listed(found.where(~order.eqNullSafe(F.col("least"))))


N_LINES, N_REMOVED = "_n_lines", "_n_removed"


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it where a column of the documents has it."""
    while name in taken:
        name = f"_{name}"
    return name


def repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns and two more: lines before, lines removed (``N_LINES`` and ``N_REMOVED`` where these are free)."""
    text, doc = docs.columns.index("text"), docs.columns.index("doc_id")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows = blocks.lay_out(docs, text)
    removals = store.written(_removals(rows, doc, text))
    counts = [_free(c, docs.columns) for c in (N_LINES, N_REMOVED)]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return rows.join(removals, "block", "left").select("payload", "found").mapInArrow(_rewritten(text, length, counts), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; texts without the chunks that stand elsewhere before."""
    return repeats(docs).select(*docs.columns)
