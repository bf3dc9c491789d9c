"""Records that go over line ends, cut in parallel: quoted CSV and the elements of JSON arrays.

Text comes in pieces (file, stretch, at, value): (stretch, at) orders the pieces of a file. They are first laid out anew, in ranges of that order: a stretch is
then what one task holds of a file, so there are few, however the text came. What a piece means depends on the state before it (inside quotes or not), which all earlier pieces of the
file decide. Each piece gives the state after it for either state before it. Such functions compose: the state is that of the
last piece whose answer is the same for both, changed by the swaps since. They are composed along each stretch first, then over one
row a stretch of the file, so no file is read by one task. What is found along the stretches is written, for either state at their start, so no step works out an earlier one again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import numbering

_STRETCH, _FILE = ["file", "stretch"], ["file"]


def _composed(rows: DataFrame, part: list[str], order: str, keep: str = "") -> DataFrame:
    """``rows`` (if_out, if_in: the state after a row for either state before) with the state before it, ``out_`` and ``in_``, for either start of the part."""
    earlier = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = F.col("if_out") & ~F.col("if_in")
    rows = rows.withColumn("_swaps", F.sum(swaps.cast("int")).over(upto))
    sure = F.when(F.col("if_out") == F.col("if_in"), F.struct(F.col("if_out").alias("state"), F.col("_swaps").alias("at")))
    rows = rows.withColumn("_sure", F.last(sure, ignorenulls=True).over(earlier)).withColumn("_met", F.coalesce(F.sum(swaps.cast("int")).over(earlier), F.lit(0)))
    odd = lambda n: n % 2 == 1
    since = odd(F.col("_met") - F.coalesce(F.col("_sure.at"), F.lit(0)))
    state = lambda start: F.coalesce(F.col("_sure.state"), F.lit(start)) != since
    return rows.withColumn("out_", state(False)).withColumn("in_", state(True)).drop("_swaps", "_sure", "_met")


def _laid(pieces: DataFrame) -> DataFrame:
    """``pieces`` in ranges of their order, written: a stretch is a range, along which ``at`` rises by one."""
    keys = ["file", "stretch", "at"]
    rows = pieces.select(*keys, "value").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return numbering.written(rows.select("file", F.spark_partition_id().cast("long").alias("stretch"), F.monotonically_increasing_id().alias("at"), "value"))


def _earlier(value: Column) -> Column:
    """The sum of ``value`` over the earlier pieces of the stretch."""
    return F.coalesce(F.sum(value.cast("long")).over(Window.partitionBy(*_STRETCH).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _before():
    """The earlier stretches of the file."""
    return Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)


# --- CSV ----------------------------------------------------------------------------------
def quoted_after(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes (or at a field) ends inside quotes. A quote opens at the start of a field only."""
    i = 0
    while True:
        if not inside:
            if line[i : i + 1] != '"':
                i = line.find(",", i) + 1
                if not i:
                    return False
                continue
            i += 1
        i = line.find('"', i)
        if i < 0:
            return True
        if line[i + 1 : i + 2] == '"':
            inside, i = True, i + 2
            continue
        inside, i = False, line.find(",", i + 1) + 1
        if not i:
            return False


def _quote_states(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_pylist()
            plain = ['"' not in v for v in values]  # such a line changes nothing
            out = [False if p else quoted_after(v, False) for p, v in zip(plain, values, strict=True)]
            ins = [True if p else quoted_after(v, True) for p, v in zip(plain, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_()), pa.array(ins, pa.bool_())], [*batch.schema.names, "if_out", "if_in"])

    rows = lines.select("file", "stretch", "at", "value")
    return rows.mapInArrow(run, "file string, stretch long, at long, value string, if_out boolean, if_in boolean")


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, stretch, line, text): CSV records, with the stretch and the number in its file of their first line.

    Lines of a record are joined by their line ends again; blank lines between records are left out. A record of one line, as
    nearly all are, is never grouped.
    """
    upto = Window.partitionBy(*_STRETCH).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = lambda inside: F.max(F.when(~F.col(inside), F.col("at"))).over(upto)
    local = _composed(_quote_states(_laid(lines)), _STRETCH, "at").withColumn("_row", F.row_number().over(Window.partitionBy(*_STRETCH).orderBy("at")))
    local = numbering.written(local.withColumn("_begun_out", begun("out_")).withColumn("_begun_in", begun("in_")))
    after = lambda before: F.when(F.col(before), F.col("if_in")).otherwise(F.col("if_out"))
    ends = local.groupBy(*_STRETCH).agg(
        F.max_by(after("out_"), "at").alias("if_out"), F.max_by(after("in_"), "at").alias("if_in"), F.count(F.lit(1)).alias("n"),
        F.max("_begun_out").alias("_last_out"), F.max("_begun_in").alias("_last_in"))
    # what a stretch finds before it: the state, lines, and the place of the last line that begins a record
    starts = _composed(ends, _FILE, "stretch").withColumn("_start", F.col("out_"))
    own = lambda name: F.when(F.col("_start"), F.col(f"{name}in")).otherwise(F.col(f"{name}out"))
    opened = F.when(own("_last_").isNotNull(), F.struct("stretch", own("_last_").alias("at")))
    starts = starts.select(*_STRETCH, "_start", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("_lines"), F.last(opened, ignorenulls=True).over(_before()).alias("_open"))
    placed = local.join(numbering.written(starts), _STRETCH).withColumn("inside", F.when(F.col("_start"), F.col("in_")).otherwise(F.col("out_")))
    placed = placed.withColumn("line", F.col("_lines") + F.col("_row"))
    placed = placed.withColumn("record", F.coalesce(F.when(own("_begun_").isNotNull(), F.struct("stretch", own("_begun_").alias("at"))), "_open"))
    whole = ~F.col("inside") & ~F.col("if_out")
    single = placed.where(whole & (F.rtrim("value") != "")).select("file", "stretch", "line", "value")
    parts = placed.where(~whole).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("p"))
    several = parts.select("file", F.col("record.stretch").alias("stretch"), F.col("p")[0]["line"].alias("line"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return single.unionAll(several).select("file", "stretch", "line", F.regexp_replace("value", "\r\\z", "").alias("text"))


_CSV = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000", "maxCharsPerColumn": "-1"}


def _fields(text: Column, width: int) -> Column:
    parsed = F.from_csv(text, ", ".join(f"c{k} string" for k in range(width)), _CSV)
    return F.array(*[parsed[f"c{k}"] for k in range(width)])


def csv_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of CSV files: rows (file, line, names, fields), and the names (file, names) of each file's first record.

    Files may have their columns in any order. A row is met with the names of its file by way of its stretch, so a long file is no hot key.
    """
    records = numbering.written(csv_records(lines))
    # commas bound the fields of a header
    width = records.groupBy("file").agg(F.min_by(F.length(F.regexp_replace("text", "[^,]", "")), "line").alias("n")).agg(F.max("n")).first()[0]
    width = (width or 0) + 1
    first = records.groupBy("file").agg(F.min_by("text", "line").alias("text"), F.min("line").alias("head"))
    names = F.transform(F.filter(_fields(F.col("text"), width), lambda x: x.isNotNull()), lambda x: F.trim(F.ltrim(x, F.lit("\ufeff"))))
    headers = numbering.written(first.select("file", "head", names.alias("names")))
    of_stretch = records.select(*_STRETCH).distinct().join(headers, "file")
    rows = records.join(of_stretch, _STRETCH).where(F.col("line") > F.col("head"))
    return rows.select("file", "line", "names", _fields(F.col("text"), width).alias("fields")), headers.select("file", "names")


def field(name: str) -> Column:
    """A row's field under that name, empty where the row is too short, null where its file has no such column."""
    at = F.array_position("names", F.lit(name))
    return F.when(at > 0, F.coalesce(F.get(F.col("fields"), (at - 1).cast("int")), F.lit("")))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbering.scanned(spark.read.option("lineSep", "\n").text(path))


def file_name(file: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(file, "/"), -1), F.lit("+"), F.lit("%2B")))


# --- JSON ---------------------------------------------------------------------------------
def scan_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file in pieces that end before each closing brace: about one object each, however long its lines are."""
    return numbering.scanned(spark.read.option("lineSep", "}").text(path))


def json_elements(pieces: DataFrame) -> DataFrame:
    """(file, element, text, whole): the objects of the JSON array of each file, from 1; ``whole`` is false for what no object ends.

    A closing brace, which ends every piece, is part of an object or stands in a string; the quotes of earlier pieces tell which, and the
    braces and brackets of earlier pieces how deep it is. An object of the array ends where the depth comes back to the array's.
    """
    rows = _laid(pieces).withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    # outside of strings: without strings, and from the first quote on if it begins in one
    strings = '"[^"]*"?'
    rest = F.when(F.contains("_bare", F.lit('"')), F.regexp_replace("_bare", '\\A[^"]*+"', "")).otherwise("")
    rows = rows.withColumn("_out", F.regexp_replace("_bare", strings, "")).withColumn("_in", F.regexp_replace(rest, strings, ""))
    count = lambda name, c: F.length(F.regexp_replace(name, f"[^{c}]", ""))
    net = lambda name: count(name, "{\\[") - count(name, "}\\]")
    odd = F.length(F.regexp_replace("_bare", '[^"]', "")) % 2 == 1
    rows = rows.select(*_STRETCH, "at", "value", odd.alias("_odd"), net("_out").alias("_net_out"), net("_in").alias("_net_in"))
    # along a stretch, for either state at its start
    rows = rows.withColumn("_swapped", _earlier(F.col("_odd")) % 2 == 1)
    closes = lambda inside: F.when(inside, F.col("_odd")).otherwise(~F.col("_odd"))
    delta = lambda inside: F.when(inside, F.col("_net_in")).otherwise(F.col("_net_out")) - closes(inside).cast("int")
    rows = rows.withColumn("_delta_out", delta(F.col("_swapped"))).withColumn("_delta_in", delta(~F.col("_swapped")))
    rows = rows.withColumn("_depth_out", _earlier(F.col("_delta_out"))).withColumn("_depth_in", _earlier(F.col("_delta_in")))
    local = numbering.written(rows.drop("_net_out", "_net_in"))
    totals = local.groupBy(*_STRETCH).agg(F.sum(F.col("_odd").cast("int")).alias("odd"), F.sum("_delta_out").alias("delta_out"), F.sum("_delta_in").alias("delta_in"))
    own = lambda name: F.when(F.col("_start"), F.col(f"{name}in")).otherwise(F.col(f"{name}out"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("odd").over(_before()), F.lit(0)) % 2 == 1)
    starts = starts.select(*_STRETCH, "_start", F.coalesce(F.sum(own("delta_")).over(_before()), F.lit(0)).alias("_above"))
    rows = local.join(numbering.written(starts), _STRETCH)
    rows = rows.withColumn("_depth", F.col("_above") + own("_depth_")).withColumn("_ends", closes(F.col("_swapped") != F.col("_start")) & (F.col("_depth") + own("_delta_") == 1))
    rows = numbering.written(rows.select(*_STRETCH, "at", "value", "_depth", "_ends", _earlier(F.col("_ends")).alias("_before")))
    ended = rows.groupBy(*_STRETCH).agg(F.sum(F.col("_ends").cast("long")).alias("n"))
    ended = numbering.written(ended.select(*_STRETCH, F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("_earlier")))
    rows = rows.join(ended, _STRETCH).withColumn("element", F.col("_earlier") + F.col("_before") + 1)
    alone = F.col("_ends") & (F.col("_depth") <= 1)
    single = rows.where(alone).select("file", "element", F.concat("value", F.lit("}")).alias("text"), F.lit(True).alias("whole"))
    parts = rows.where(~alone).groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "at", "value"))), lambda x: x["value"]), "}").alias("text"), F.max("_ends").alias("whole"))
    both = single.unionAll(parts.select("file", "element", F.when(F.col("whole"), F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("text"), "whole"))
    # what stands between objects: the array's bracket, commas, white space and a byte order mark
    own = both.withColumn("text", F.regexp_replace("text", r"\A[\uFEFF\s,\[]+", ""))
    return own.where(F.regexp_replace("text", r"[\s\]]+", "") != "")
