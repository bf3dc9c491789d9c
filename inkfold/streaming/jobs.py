"""Structured Streaming jobs: event routing, registration state, incremental analysis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import constants as K
from ..plans import analyze as A
from ..session import written
from ..sources import logs
from . import registration as R

STATE = "enabled boolean, normalized string, approval_count int, registered_at timestamp, last_seen_at timestamp"
APPROVAL_OUT = f"file string, term string, {STATE}, is_promotion_candidate boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_actions_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(logs.ACTION_SCHEMA).json(path)


def route_stream(stream: DataFrame, out: str, checkpoint: str, dedupe: bool = False, within: str = "1 day") -> StreamingQuery:
    """Append events to the three logs, one folder per sink and batch.

    A batch that is replayed after a failure overwrites its own folder, so nothing is doubled.
    A client that retries may send an event twice; ``dedupe`` drops an event whose payload was seen before, in this batch or in an earlier one,
    as long as it comes ``within`` that time of the first. Times are those of arrival, by batch, so no event is ever late, whatever its own time stamp.
    """
    if dedupe:
        payload = F.sha2(F.to_json(F.struct(*stream.columns)), 256)
        seen = stream.withColumn("_payload", payload).withColumn("_at", F.current_timestamp()).withWatermark("_at", within)
        stream = seen.dropDuplicatesWithinWatermark(["_payload"]).drop("_payload", "_at")

    def write(batch: DataFrame, batch_id: int) -> None:
        logs.routed(logs.keep_for_log(batch)).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("sink", "batch").json(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ApprovalState(StatefulProcessor):
    """Registration state of one (file, term), by buckets of time (see ``registration``); events may come in any order and any batch.

    The events of a batch are taken chunk by chunk; what is in memory is a chunk, a bucket's events, and one change a bucket.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._events = handle.getMapState("events", "bucket bigint", "events string")
        self._changes = handle.getMapState("changes", "bucket bigint", "change string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        touched = set()
        for chunk in rows:
            by_bucket: dict[int, list[R.Event]] = {}
            for e in chunk.itertuples(index=False):
                ts = int(pd.Timestamp(e.ts).value // 1000)
                norm = None if e.normalized is None or pd.isna(e.normalized) else str(e.normalized)
                on = None if e.enabled is None or pd.isna(e.enabled) else bool(e.enabled)
                by_bucket.setdefault(R.bucket_of(ts), []).append(R.Event(ts, int(e.seq), e.op, norm, on))
            for bucket, new in by_bucket.items():
                old = R.load_events(self._events.getValue((bucket,))[0]) if self._events.containsKey((bucket,)) else []
                self._events.updateValue((bucket,), (R.dump(old + new),))
            touched |= set(by_bucket)
        for bucket in touched:
            events = sorted(R.load_events(self._events.getValue((bucket,))[0]), key=lambda e: (e.ts, e.seq))
            self._changes.updateValue((bucket,), (R.dump(R.folded(map(R.change_of, events))),))
        made = sorted((k[0], v[0]) for k, v in self._changes.iterator())
        state = R.folded(R.load_change(text) for _, text in made).born
        if state is None:
            return
        yield pd.DataFrame([{
            "file": key[0], "term": key[1], "enabled": state.enabled, "normalized": state.normalized, "approval_count": state.approval_count,
            "registered_at": pd.Timestamp(state.registered_at, unit="us"), "last_seen_at": pd.Timestamp(state.last_seen_at, unit="us"),
            "is_promotion_candidate": state.enabled and state.approval_count >= K.PROMOTION_MIN_APPROVALS,
        }])

    def close(self) -> None:
        pass


def approval_stream(stream: DataFrame, checkpoint: str, name: str | None = None, path: str | None = None) -> StreamingQuery:
    """Running state of each (file, term); every batch emits the terms it touched.

    To a memory table ``name`` (tests) or as parquet under ``path``.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    states = stream.groupBy("file", "term").transformWithStateInPandas(
        statefulProcessor=ApprovalState(), outputStructType=APPROVAL_OUT, outputMode="Update", timeMode="None"
    )
    w = states.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update")
    if name is not None:
        return w.format("memory").queryName(name).start()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return w.foreachBatch(write).start()


def analyze_stream(stream: DataFrame, config: A.AnalyzeConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Analyze new, changed and deleted notes as they arrive; a note whose md is null is deleted (a tombstone).

    Every batch writes one folder of versions: for each note of the batch its content hash and, where that has changed, its spans. Notes that
    come again unchanged are not analyzed again. Of several rows of a note in one batch the last counts, by ``ord`` where the stream has it.
    :func:`current_spans` gives the result; a replayed batch overwrites its own folder.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.col("ord") if "ord" in batch.columns else F.lit(0)
        cols = [c for c in batch.columns if c not in ("note_id", "ord")]
        last = batch.groupBy("note_id").agg(F.max_by(F.struct(*cols), F.struct(order, F.xxhash64(*cols))).alias("n")).select("note_id", "n.*")
        now = written(last.withColumn("_hash", F.when(F.col("md").isNotNull(), F.sha2(F.to_json(F.struct(*cols)), 256))))
        known = _versions(spark, out, batch_id)
        changed = now if known is None else now.join(known.select("note_id", F.col("hash").alias("_old"), F.lit(True).alias("_known")), "note_id", "left").where(
            ~F.col("_hash").eqNullSafe(F.col("_old")) | F.col("_known").isNull()
        ).drop("_old", "_known")
        changed = written(changed)
        changed.select("note_id", F.col("_hash").alias("hash"), F.lit(batch_id).cast("long").alias("version")).write.mode("overwrite").parquet(f"{out}/notes/batch={batch_id}")
        found = A.analyze(changed.where("md IS NOT NULL").drop("_hash"), config)
        found.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/spans/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """(note_id, hash, version): the newest version of each note of the batches ``before`` one."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{out}/notes")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    paths = [f"{out}/notes/{n}" for n in done if n.startswith("batch=") and (before is None or int(n[6:]) < before)]
    if not paths:
        return None
    rows = spark.read.parquet(*paths).select("note_id", "hash", "version")
    return rows.groupBy("note_id").agg(F.max(F.struct("version", "hash")).alias("v")).select("note_id", "v.hash", "v.version")


def current_spans(spark: SparkSession, out: str) -> DataFrame:
    """The spans of every note's newest version; those of deleted and replaced versions are out."""
    newest = _versions(spark, out)
    if newest is None:
        raise ValueError(f"nothing was analyzed under {out}")
    spans = spark.read.parquet(f"{out}/spans/batch=*")
    return spans.join(newest.where("hash IS NOT NULL").select("note_id", "version"), ["note_id", "version"], "left_semi").drop("version")
