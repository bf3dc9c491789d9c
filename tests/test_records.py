"""Records over line ends, read from files of several splits, beside Python's own readers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from inkfold.operators import numbering
from inkfold.sources import dictionaries as SD
from inkfold.sources import logs, records

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set(SPLIT, "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.set(SPLIT, old.get(SPLIT, "128m"))


def put(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_lines_rise_in_file_order(spark, tmp, small_splits):
    lines = {f: [f"{f}{i} " + "x" * (i % 40) for i in range(n)] for f, n in (("b", 5), ("a", 200), ("c", 40))}
    for f, rows in lines.items():
        put(f"{tmp}/{f}.txt", "\n".join(rows) + "\n")
    got = numbering.ordered(numbering.scanned(spark.read.text(tmp)))
    assert got.select("stretch").distinct().count() > 5
    rows = got.orderBy("line_no").collect()
    assert [r.value for r in rows] == lines["a"] + lines["b"] + lines["c"]
    assert [r.line for r in rows if r.file.endswith("a.txt")] == list(range(1, 201))


@pytest.mark.parametrize("group", [None, ["g"]])
def test_places_of_a_hot_group(spark, group):
    rows = [(0 if i % 3 else i % 5, (i * 7) % 40, i) for i in range(400)] + [(1, None, 1000), (1, None, 1001)]
    df = spark.createDataFrame(rows, "g int, k int, i int").repartition(7)
    got = numbering.numbered(numbering.written(df), ["k"], group).collect()
    by = {}
    for r in got:
        by.setdefault(r.g if group else 0, []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r.place)
        assert [r.place for r in part] == list(range(len(part))) and {r.total for r in part} == {len(part)}
        keys = [(r.k is not None, r.k or 0) for r in part]
        assert keys == sorted(keys)
    assert len(got) == len(rows)


def test_a_quote_opens_at_a_field_only():
    after = records.quoted_after
    assert after('a,"b', False) and not after('a,5" b', False) and not after('a,"b ""c"""', False)
    assert after('a,"b ""c""', False) and after("x", True) and not after('x",y', True)
    assert after('x","y', True) and not after('""x",', True) and after('x""', True) and not after("", False)


@pytest.mark.parametrize("seed", range(2))
def test_csv_as_the_plain_reader_reads_it(spark, tmp, small_splits, seed):
    rng = random.Random(seed)
    say = lambda: "".join(rng.choice(['"', ",", "\n", "a", "語 ", "\r\n", "null", "'", "\\"]) for _ in range(rng.randint(0, 60)))
    want = {}
    for f in ("y.csv", "x.csv"):
        names = ["k", "p", "q"] if f == "x.csv" else ["q", "k", "extra", "p"]
        out = io.StringIO()
        w = csv.DictWriter(out, names, lineterminator="\r\n" if seed % 2 else "\n")
        w.writeheader()
        for i in range(40):
            w.writerow({"k": str(i), "p": say(), "q": say()} | ({"extra": "e"} if f == "y.csv" else {}))
            if i % 30 == 0:
                out.write("\n")
        put(f"{tmp}/{f}", "﻿" + out.getvalue())
        want[f] = [(r["k"], r["p"].replace("\r\n", "\n"), r["q"].replace("\r\n", "\n")) for r in csv.DictReader(io.StringIO(out.getvalue(), newline=""))]
    rows, headers = records.csv_rows(records.scan_lines(spark, tmp))
    assert {r.file.rsplit("/", 1)[1]: len(r.names) for r in headers.collect()} == {"x.csv": 3, "y.csv": 4}
    got = {}
    for r in rows.select(records.file_name(F.col("file")).alias("f"), "line", *[records.field(c).alias(c) for c in ("k", "p", "q")]).orderBy("f", "line").collect():
        got.setdefault(r.f, []).append((r.k, r.p.replace("\r\n", "\n"), r.q.replace("\r\n", "\n")))
    assert got == want


def test_a_quoted_text_longer_than_many_splits(spark, tmp, small_splits):
    long = "\n".join(f"line {i}, \"\"x\"\"" for i in range(500))
    put(f"{tmp}/a.csv", "term,normalized,variants,reading,category,domain,priority,protect,source,approved\n甲,x,,,,,,,,\n乙,\"" + long + "\",,,,,,,,\n丙,z,,,,,,,,\n")
    got = SD.scan_terms(spark, f"{tmp}/a.csv").orderBy("seq").collect()
    assert [(r.term, r.normalized) for r in got] == [("甲", "x"), ("乙", long.replace('""', '"')), ("丙", "z")]


@pytest.mark.parametrize("seed", range(2))
def test_json_arrays_element_by_element(spark, tmp, small_splits, seed):
    rng = random.Random(seed)
    say = lambda: "".join(rng.choice(['"', "}", "{", "[", "]", "\\", "\n", "語", ",", "x"]) for _ in range(rng.randint(0, 30)))
    rows = [{"doc_id": f"d{i}", "page": i, "spanId": say(), "suspect_span": say(), "more": [{"a": {say(): [1, {}]}}] * (i % 3)} for i in range(60)]
    text = json.dumps(rows, ensure_ascii=False, indent=[None, 2, 1][seed])
    put(f"{tmp}/c.json", text)
    got = sorted((r.page, r.doc_id, r.span_id, r.suspect_span) for r in logs.scan_corrections(spark, f"{tmp}/c.json").collect())
    assert got == [(r["page"], r["doc_id"], r["spanId"], r["suspect_span"]) for r in rows]
    assert logs.broken_corrections(spark, f"{tmp}/c.json").count() == 0
    elements = records.json_elements(records.scan_pieces(spark, f"{tmp}/c.json")).orderBy("element").collect()
    assert [json.loads(r.text) for r in elements] == rows and [r.element for r in elements] == list(range(1, 61))


def test_broken_elements_go_aside(spark, tmp):
    put(f"{tmp}/c.json", '[{"doc_id":"a","span_id":"1"}, {"doc_id": tru}, 5, {"doc_id":"b","span_id":"2"}, {"doc_id":"c", "x":{')
    assert sorted(r.doc_id for r in logs.scan_corrections(spark, f"{tmp}/c.json").collect()) == ["a"]
    bad = {r.element: r.text for r in logs.broken_corrections(spark, f"{tmp}/c.json").collect()}
    assert set(bad) == {2, 3, 4} and "tru" in bad[2] and bad[3].startswith("5") and bad[4].startswith('{"doc_id":"c"')
    put(f"{tmp}/e.json", " [ ] \n")
    assert logs.scan_corrections(spark, f"{tmp}/e.json").count() == 0 == logs.broken_corrections(spark, f"{tmp}/e.json").count()


def counted(spark, df):
    """``df`` and an accumulator of how often its rows are worked out."""
    met = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            met.add(len(batch))
            yield batch

    return df.mapInArrow(run, df.schema), met


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_pieces_are_worked_out_twice_at_most(spark, kind):
    value = "concat(if(id = 0, '[', ','), '{\"page\":', id, '')" if kind == "json" else "concat(id, ',\"a b\"')"
    rows = spark.range(300).selectExpr("'f' AS file", "id AS stretch", "id AS at", f"{value} AS value")  # a stretch for each piece
    pieces, met = counted(spark, rows)
    out = records.json_elements(pieces) if kind == "json" else records.csv_records(pieces)
    assert out.count() == 300
    assert met.value <= 600  # once for the ranges, once to lay them out


def test_notes_are_worked_out_twice_for_their_images(spark):
    from inkfold.sources import notes as N

    rows = spark.range(60).selectExpr("id AS note_id", "concat('n', id) AS name", "if(id % 2 = 0, concat('![[p', id, '.jpg]]'), 'x') AS md")
    images = spark.range(60).selectExpr("if(id % 2 = 0, concat('p', id, '.jpg'), concat('n', id, '.png')) AS image_name").selectExpr("image_name", "concat('i/', image_name) AS image_path")
    notes, met = counted(spark, rows)
    got = {r.note_id: r.image_path for r in N.resolve_images(notes, images).collect()}
    assert got == {i: f"i/p{i}.jpg" if i % 2 == 0 else f"i/n{i}.png" for i in range(60)}
    assert met.value <= 120
