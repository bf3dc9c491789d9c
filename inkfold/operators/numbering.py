"""Places of rows in an order, counted in two levels: inside a piece of the table, and before that piece.

Only counts of pieces are ever brought into one order, so a group of any size is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.session import written

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_ROW_BITS = 33
PLACE, TOTAL = "place", "total"


def _before(pieces: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``pieces`` with the sums of all earlier pieces of the group (``before_*``) and of the whole group (``all_*``)."""
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    for c in sums:
        pieces = pieces.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(earlier), F.lit(0))).withColumn(f"all_{c}", F.sum(c).over(whole))
    return pieces


def numbered(rows: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order``, nulls first) inside their group and ``total``, the group's size.

    Rows are dealt out by ranges of (group, order) and written; a partition holds at most one piece of a group, whose rows
    stand in order. Rows that are equal in all of ``order`` follow one another in any order, and may lie in several pieces.
    ``group`` holds columns without nulls; without it all rows are one group. ``rows`` should be a written table: they are read twice.
    """
    group = group or []
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    laid = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    piece = laid.withColumn("_piece", F.shiftright("_at", _ROW_BITS))
    counts = piece.groupBy(*group, "_piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    if not group:  # one row a partition of the table
        counts = counts.withColumn("_all", F.lit(0))
    starts = _before(counts, group or ["_all"], ["_piece"], ["n"])
    starts = starts.select(*group, "_piece", "_first", F.col("before_n").alias("_before"), F.col("all_n").alias(TOTAL))
    return piece.join(starts, [*group, "_piece"]).withColumn(PLACE, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_piece", "_first", "_before")


#: Numbers of a file's lines in one number that follows (file, line): the file's place stands above these bits.
LINE_BITS = 40


def scanned(df: DataFrame) -> DataFrame:
    """(file, stretch, at, value) of a text scan: a stretch is a split of a file, along which ``at`` rises by one."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("stretch"), F.monotonically_increasing_id().alias("at"), "value")


def file_places(stretches: DataFrame) -> DataFrame:
    """(file, place): files by name."""
    return numbered(written(stretches.select("file").distinct()), ["file"]).select("file", F.col(PLACE).alias("file_place"))


def ordered(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """``lines`` (file, stretch, at, ...) with ``line``, from 1 in its file, and ``name``, which rises by file name and line.

    A stretch's lines follow one another in one task. So the count of each stretch, and their prefix sums over a file, tell
    where a stretch begins: lines are neither sorted nor numbered by one task, only joined with one row a stretch.
    A scan runs twice: over the same files, with the same splits.
    """
    counts = lines.groupBy("file", "stretch").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("n"))
    starts = _before(written(counts), ["file"], ["stretch"], ["n"])
    starts = starts.join(file_places(starts), "file").select("file", "stretch", "_first", F.col("before_n").alias("_before"), "file_place")
    line = F.col("_before") + F.col("at") - F.col("_first") + 1
    numbered_lines = lines.join(starts, ["file", "stretch"]).withColumn("line", line)
    return numbered_lines.withColumn(name, F.shiftleft("file_place", LINE_BITS) + F.col("line")).drop("_first", "_before", "file_place")
