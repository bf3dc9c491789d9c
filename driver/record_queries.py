"""Parsing of logs, term lists and corrections: lines are made from the tables, cut into stretches, and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.functions.rows import unfolded
from inkfold.operators import numbering
from inkfold.session import written
from inkfold.sources import dictionaries as SD
from inkfold.sources import logs

from . import inputs as I
from .registry import query

#: Texts are full of what must be quoted: quotes, commas, line ends.
_TRICKY = "'[' || replace(replace(text, 'e', '\"e,'), 'n', 'n}{') || ']'"


def _tricky(text):
    return F.concat(F.lit("["), F.replace(F.replace(text, F.lit("e"), F.lit('"e,')), F.lit("n"), F.lit("n}{")), F.lit("]"))


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(records, headers):
    """Lines of CSV files from records (file, ord, text) and {file: header}; stretches of the files end inside records.

    Every seventh record is cut behind its second line, so what follows is read without what stands before it.
    """
    spark = records.sparkSession
    heads = spark.createDataFrame([(f, -7, h) for f, h in headers.items()], "file string, ord long, text string")
    lines = unfolded(heads.unionByName(records), ["file", "ord"], F.split("text", "\n", -1), "value", "pos")
    cut = ((F.pmod("ord", F.lit(7)) == 6) & (F.col("pos") >= 2)).cast("long")
    return written(lines.select("file", (F.floor(F.col("ord") / 7) * 2 + cut).alias("stretch"), (F.shiftleft("ord", 32) + F.col("pos")).alias("at"), "value"))  # a table of lines, as a scan gives them


# --- logs ---------------------------------------------------------------------------------
@query(
    "parse_actions",
    f"WITH {I.SQL['actions']}, l AS (SELECT *, (line_no % 3 << {numbering.LINE_BITS}) + row_number() OVER (PARTITION BY line_no % 3 ORDER BY line_no) AS at_line FROM actions) "
    "SELECT event, docId, chosenCandidate, array_to_string(candidateList, '|') AS candidates, dismissedDangerFlag, candidateRank, at_line AS line_no FROM l WHERE line_no % 50 <> 0",
)
def parse_actions(spark, sf):
    """Log lines of three files in several stretches, one in fifty of them malformed."""
    a = I.actions(spark, sf)
    i = F.col("line_no")
    good = F.to_json(F.struct(*[c for c in a.columns if c != "line_no"]))
    value = F.when(i % 50 == 0, F.concat(F.lit("{broken"), good)).otherwise(good)
    lines = a.select(F.concat(F.lit("log/"), (i % 3).cast("string"), F.lit(".jsonl")).alias("file"), F.floor(i / 700).alias("stretch"), F.floor(i / 3).alias("at"), value.alias("value"))
    lines = written(lines)  # a table of lines, as a scan gives them
    got = logs.good_actions(logs.parse_actions(lines))
    return got.select("event", "docId", "chosenCandidate", F.array_join("candidateList", "|").alias("candidates"), "dismissedDangerFlag", "candidateRank", "line_no")


@query("first_lines", f"WITH {I.SQL['actions']}, l AS (SELECT *, (line_no % 3 << {numbering.LINE_BITS}) + row_number() OVER (PARTITION BY line_no % 3 ORDER BY line_no) AS at_line FROM actions) SELECT suspectSpan, min(at_line) AS first_line, arg_max(chosenCandidate, at_line) AS last_choice FROM l GROUP BY 1")
def first_lines(spark, sf):
    """First appearance and last choice of each span, by file and line."""
    i = F.col("line_no")
    a = I.actions(spark, sf).select("suspectSpan", "chosenCandidate", F.concat(F.lit("log/"), (i % 3).cast("string")).alias("file"), F.floor(i / 700).alias("stretch"), F.floor(i / 3).alias("at"))
    return numbering.ordered(a).groupBy("suspectSpan").agg(F.min("line_no").alias("first_line"), F.max_by("chosenCandidate", "line_no").alias("last_choice"))


# --- term lists -----------------------------------------------------------------------------
_COMMON = "term,normalized,variants,reading,category,domain,priority,protect,source,approved"
_MIXED = "approved,source,note,normalized,term,variants,reading,category,domain,priority,protect"
def _term_rows(two: str) -> str:
    """Documents with ``at_line``, the load order of their records; records of files for which ``two`` holds have two texts."""
    lines = f"len(string_split(text, chr(10))) * CASE WHEN {two} THEN 2 ELSE 1 END - CASE WHEN {two} THEN 1 ELSE 0 END"
    return (
        f"d AS (SELECT *, doc_id % 3 AS f, {_TRICKY} AS body FROM documents), r AS (SELECT *, (f << {numbering.LINE_BITS}) + 2 + "
        f"coalesce(sum({lines}) OVER (PARTITION BY f ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_line FROM d)"
    )


def _term_records(spark, sf, extra=()):
    """One term a document, whose text is its normalized form; the files have their columns in different orders."""
    i = F.col("doc_id")
    s = i.cast("string")
    v = {
        "term": F.when(i % 10 == 9, F.lit("  ")).otherwise(F.concat(F.lit(" 語"), s)), "normalized": _quoted(_tricky(F.col("text"))),
        "variants": _quoted(F.concat(F.lit("a"), s, F.lit("; ;b,"), s)), "reading": F.lit(""), "category": _quoted(F.col("lang")), "domain": F.col("source"),
        "priority": F.when(i % 4 == 0, F.lit("x")).otherwise(((i % 8) / 8).cast("string")), "protect": F.when(i % 2 == 0, F.lit("YES")).otherwise(F.lit("")),
        "source": F.lit('say "hi'), "approved": F.lit("1"), "note": _quoted(F.col("text")),
        "enabled": F.when(i % 3 == 0, F.lit("true")).otherwise(F.lit("0")), "registered_at": F.lit("2026-01-01"), "last_seen_at": F.lit(""), "approval_count": (i % 5).cast("string"),
    }
    heads = {f"f{k}.csv": (_MIXED if k == 1 else _COMMON) for k in range(3)}
    heads = {f: h + "".join("," + c for c in extra if c not in h.split(",") and (c != "approval_count" or f != "f2.csv")) for f, h in heads.items()}
    row = F.coalesce(*[F.when(F.col("file") == f, F.concat_ws(",", *[v[c] for c in h.split(",")])) for f, h in heads.items()])
    d = I.table(spark, sf, "documents").withColumn("file", F.concat(F.lit("f"), (i % 3).cast("string"), F.lit(".csv")))
    return csv_lines(d.select("file", i.alias("ord"), row.alias("text")), heads)


_TERM_OUT = (
    "'語' || doc_id AS term, md5(body) AS normalized, 'a' || doc_id || '|b,' || doc_id AS variants, lang AS category, source AS domain, CASE WHEN doc_id % 4 = 0 THEN {0} ELSE doc_id % 8 / 8.0 END::DOUBLE AS priority, "
    "doc_id % 2 = 0 AS protect, 'say \"hi' AS source, true AS approved"
)


@query("parse_terms", f"WITH {_term_rows('f = 1')} SELECT {_TERM_OUT.format('0.0')}, CAST(at_line AS BIGINT) AS seq, 'f' || f || '.csv' AS source_file FROM r WHERE doc_id % 10 <> 9")
def parse_terms(spark, sf):
    """Term lists whose quoted fields hold whole texts, cut into stretches inside records."""
    t = SD.parse_terms(_term_records(spark, sf))
    return t.select("term", F.md5("normalized").alias("normalized"), F.array_join("variants", "|").alias("variants"), "category", "domain", "priority", "protect", "source", "approved", "seq", "source_file")


@query(
    "parse_temp_terms",
    f"WITH {_term_rows('true')} SELECT {_TERM_OUT.format('0.6')}, md5(text) AS note, doc_id % 3 = 0 AS enabled, CASE WHEN f = 2 THEN 0 ELSE doc_id % 5 END::INTEGER AS approval_count, CAST(at_line AS BIGINT) AS seq, 'f' || f || '.csv' AS source_file "
    "FROM r WHERE doc_id % 10 <> 9",
)
def parse_temp_terms(spark, sf):
    """Temporary lists: one file has no approval_count, and two quoted texts a record in all."""
    t = SD.parse_temp(_term_records(spark, sf, ("enabled", "registered_at", "last_seen_at", "note", "approval_count")))
    return t.where("term <> ''").select("term", F.md5("normalized").alias("normalized"), F.array_join("variants", "|").alias("variants"), "category", "domain", "priority", "protect", "source", "approved",
                    F.md5("note").alias("note"), "enabled", "approval_count", "seq", "source_file")


# --- corrections ------------------------------------------------------------------------------
_CORR = (
    f"{I.SQL['corrections']}, e AS (SELECT c.*, '山\"{{' || chr(10) || ',}}' || suspect_span AS span, 'a\\b' || (ord % 3) AS original FROM corrections c)"
)
_CORR_OUT = (
    "SELECT doc_id, page, page AS save_page, span_id, occurrence_index, span AS suspect_span, {0} AS original_text, selected_candidate, candidate_rank, is_manual_input, time_per_correction, correction_mode FROM e"
)
_CORR_COLUMNS = ["doc_id", "page", "save_page", "span_id", "occurrence_index", "suspect_span", "original_text", "selected_candidate", "candidate_rank", "is_manual_input", "time_per_correction", "correction_mode"]


def _correction_rows(spark, sf):
    c = I.corrections(spark, sf)
    return c.withColumn("suspect_span", F.concat(F.lit('山"{\n,}'), "suspect_span")).withColumn("original_text", F.concat(F.lit("a\\b"), (F.col("ord") % 3).cast("string")))


@query("parse_corrections_csv", f"WITH {_CORR} {_CORR_OUT.format('original')} ")
def parse_corrections_csv(spark, sf):
    """Corrections as two CSV files whose spans hold line ends, quotes and commas; 'null' stands for null."""
    c = _correction_rows(spark, sf)
    names = [n for n in c.columns if n != "ord"]
    text = lambda n: _quoted(F.coalesce(F.col(n).cast("string"), F.lit("null"))) if dict(c.dtypes)[n] == "string" else F.coalesce(F.col(n).cast("string"), F.lit("null"))
    orders = {"a.csv": names, "b.csv": names[::-1]}
    row = F.coalesce(*[F.when(F.col("file") == f, F.concat_ws(",", *[text(n) for n in o])) for f, o in orders.items()])
    files = c.withColumn("file", F.when(F.col("ord") % 2 == 0, "a.csv").otherwise("b.csv"))
    lines = csv_lines(files.select("file", "ord", row.alias("text")), {f: ",".join(o) for f, o in orders.items()})
    return logs.parse_corrections(lines).select(*_CORR_COLUMNS)


def _json_pieces(spark, sf):
    """Two JSON arrays of correction objects with objects inside, in pieces that end at each closing brace; one object in forty is broken."""
    c = _correction_rows(spark, sf)
    i = F.col("ord")
    item = F.to_json(F.struct(*[n for n in c.columns if n not in ("ord", "span_id")], F.col("span_id").alias("spanId"), F.struct(F.lit('}"]{').alias("x"), F.struct(F.lit(1).alias("z")).alias("y")).alias("more")))
    # column by column: an expression inside another's arguments is evaluated for each of them
    c = c.withColumn("_item", item).withColumn("_item", F.when(i % 40 == 7, F.replace("_item", F.lit('"page":'), F.lit('"page" '))).otherwise(F.col("_item")))
    c = c.withColumn("_parts", F.split(F.concat(F.when(i < 2, F.lit("[ ")).otherwise(F.lit(" ,\n")), "_item"), "}", -1))
    rows = unfolded(c, [(i % 2).cast("string").alias("file"), "ord"], F.slice("_parts", F.lit(1), F.size("_parts") - 1), "value", "pos")
    ends = c.groupBy((i % 2).cast("string").alias("file")).agg((F.max("ord") + 2).alias("ord")).select("file", "ord", F.lit(0).alias("pos"), F.lit("]\n").alias("value"))
    cut = ((F.pmod("ord", F.lit(7)) == 6) & (F.col("pos") >= 2)).cast("long")
    return written(rows.unionByName(ends).select("file", (F.floor(F.col("ord") / 7) * 2 + cut).alias("stretch"), (F.shiftleft("ord", 32) + F.col("pos")).alias("at"), "value"))  # a table of pieces, as a scan gives them


@query("parse_corrections_json", f"WITH {_CORR} {_CORR_OUT.format('original')} WHERE ord % 40 <> 7")
def parse_corrections_json(spark, sf):
    """Correction objects of JSON arrays, element by element."""
    return logs.parse_json_corrections(_json_pieces(spark, sf))[0].select(*_CORR_COLUMNS)


@query("broken_corrections", f"WITH {I.SQL['corrections']} SELECT CAST(ord % 2 AS VARCHAR) AS file, ord // 2 + 1 AS element FROM corrections WHERE ord % 40 = 7")
def broken_corrections(spark, sf):
    """The elements of these arrays that are no objects, and their places."""
    return logs.parse_json_corrections(_json_pieces(spark, sf))[1].select("file", "element")


# --- column functions without a query of their own ----------------------------------------------
@query(
    "column_functions",
    "SELECT doc_id, regexp_replace(source || '/' || lang || '.' || doc_id, '[/\\\\:*?\"<>|]', '_', 'g') AS export_name, 'p' || (doc_id % 9) || '_o' || (doc_id % 4) || '_s' || n_chars AS span_id, "
    "doc_id % 2 = 0 AS flag, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE doc_id / 8 END::DOUBLE AS number, array_to_string(list_distinct(list_filter(['a' || (doc_id % 2), 'b', 'a0'], lambda x: true)), ';') <> '' AS some_variants FROM documents",
)
def column_functions(spark, sf):
    """Names for export, span ids, words for yes and no, numbers with a default."""
    i = F.col("doc_id")
    s = i.cast("string")
    return I.table(spark, sf, "documents").select(
        "doc_id", T.safe_export_name(F.concat("source", F.lit("/"), "lang", F.lit("."), s)).alias("export_name"),
        T.span_id((i % 9).cast("int"), (i % 4).cast("int"), F.col("n_chars").cast("int")).alias("span_id"),
        T.parse_bool(F.when(i % 4 == 0, " Yes").when(i % 4 == 2, "T ").when(i % 4 == 1, "no").otherwise("?")).alias("flag"),
        T.parse_float(F.when(i % 3 == 0, "1,5").otherwise((i / 8).cast("string")), 0.5).alias("number"),
        (T.normalize_variants(F.concat(F.lit("a"), (i % 2).cast("string"), F.lit(" ;b,a0"))) != "").alias("some_variants"),
    )
