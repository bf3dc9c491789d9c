"""Rows as compressed blocks in a bucketed table: side data meets its texts without a shuffle of the texts."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from inkfold.llm import scan, store

#: Bytes of text in a block.
BLOCK = 8 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes | pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def lay_out(rows: DataFrame, text: int) -> DataFrame:
    """(block, payload) of all rows and columns; ``text`` is the place of the column that sizes a block.

    The table is bucketed by block, so a join with something that is dealt out by block moves that alone.
    """

    def run(batches):
        task, made, held, room = TaskContext.get().partitionId(), 0, [], 0

        def block():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"block": [task << 32 | made], "payload": [pack(whole)]}, schema=pa.schema([("block", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for lo, hi, data, _ in scan.slices(batch.column(text)):
                held.append(batch.slice(lo, hi - lo))
                room += len(data)
                if room >= BLOCK:
                    yield block()
                    made, held, room = made + 1, [], 0
        if held:
            yield block()

    spark, name = rows.sparkSession, f"llm_blocks_{uuid.uuid4().hex}"
    laid = store.spread(rows).mapInArrow(run, "block long, payload binary")
    laid.write.bucketBy(store.ranges_of(spark), "block").format("parquet").option("path", store.shared_folder(spark)).saveAsTable(name)
    return spark.table(name)
