"""Folders of notes, dictionaries, versions, confidence trees, governance edits."""

import os

import pytest
from pyspark.sql import functions as F

from inkfold.operators import governance as G
from inkfold.sources import dictionaries as SD
from inkfold.sources import logs
from inkfold.sources import notes as N


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_scan_notes_and_images(spark, tmp):
    put(f"{tmp}/v/100/が x.md", "---\nid: 7\nimage: a.jpg\nlist: [甲, 3]\n---\nbody")
    put(f"{tmp}/v/b.md", "![[sub/p.png]] ![[q.jpg]]")
    put(f"{tmp}/v/backup/old.md", "no")
    for p in ("a.jpg", "sub/p.png", ".trash/z.jpg"):
        put(f"{tmp}/v/{p}", "i")
    n = N.scan_notes(spark, f"{tmp}/v")
    assert sorted(r.path for r in n.collect()) == ["100/が x", "b"]
    img = N.scan_images(spark, f"{tmp}/v")
    assert sorted(r.image_path for r in img.collect()) == ["a.jpg", "sub/p.png"]
    fm = N.frontmatter_rows(n)
    assert [(r.key, r.value, r.is_text) for r in fm.orderBy("ord").collect()] == [("id", "7", False), ("image", "a.jpg", True), ("list", "甲", True), ("list", "3", False)]
    got = {(r.note_id, r.image_path) for r in N.resolve_images(n, img, fm).collect()}
    assert got == {("100/が x", "a.jpg"), ("b", "sub/p.png")}
    q = spark.createDataFrame([("7",), ("b",), ("が",), ("00/",), ("none",)], "query string")
    assert {r.query: r.rule for r in N.find_notes(n, q, fm).collect()} == {"7": 1, "b": 2, "が": 5, "00/": 6, "none": None}


HEAD = "term,normalized,variants,reading,category,domain,priority,protect,source,approved"


def test_term_lists(spark, tmp):
    put(f"{tmp}/d/b.csv", f"{HEAD}\n秣場,秣場,秣塲; まぐさば;,r,c,d,0.8,false,m,true\n")
    put(f"{tmp}/d/a.csv", f"{HEAD}\n入会,入会,,r,c,d,,YES,m,1\n山論,,,,,,x,,,\n")
    t = SD.scan_terms(spark, f"{tmp}/d").orderBy("seq").collect()
    assert [(r.term, r.variants, r.priority, r.protect) for r in t] == [("入会", [], 0.0, True), ("山論", [], 0.0, False), ("秣場", ["秣塲", "まぐさば"], 0.8, False)]
    put(f"{tmp}/e/a.csv", f"{HEAD}\n,x,,,,,,,,\n")
    assert SD.scan_terms(spark, f"{tmp}/e").collect() == []
    assert [r.reason for r in SD.rejected_terms(spark, f"{tmp}/e").collect()] == ["empty term"]
    put(f"{tmp}/g/a.csv", "term,normalized\nx,y\n")
    with pytest.raises(ValueError, match="lacks"):
        SD.scan_terms(spark, f"{tmp}/g")
    put(f"{tmp}/t/u.csv", f"{HEAD},enabled\n甲,乙,,,,,,,,,true\n丙,丁,,,,,,,,,no\n")
    temp = SD.scan_temp(spark, f"{tmp}/t")
    assert {(r.term, r.enabled, r.approval_count, r.priority) for r in temp.collect()} == {("甲", True, 0, 0.6), ("丙", False, 0, 0.6)}
    u = SD.union_terms(SD.scan_terms(spark, f"{tmp}/d"), None, temp).orderBy("seq").collect()
    assert [r.term for r in u] == ["入会", "山論", "秣場", "甲"] and u[-1].tier == "temporary"


def test_yaml_lists(spark, tmp):
    put(f"{tmp}/y/shape_pairs.yaml", "pairs:\n- {wrong: 末, correct: [未], score: 45.0}\n- {wrong: 土, correct: 士, context: classical_jp}\n- {wrong: '', correct: [x]}\n")
    assert [(r.wrong, r.correct, r.score, r.context) for r in SD.shape_pairs(spark, f"{tmp}/y/shape_pairs.yaml").collect()] == [("末", "未", 45.0, "any"), ("土", "士", 50.0, "classical_jp")]
    put(f"{tmp}/y/proper_nouns.core.yaml", "entries:\n- {term: 入会権, aliases: [入会], weight: 1.3}\n")
    put(f"{tmp}/y/proper_nouns.regions.aichi.yaml", "- {term: 三河, variants: [三州], region: 愛知}\n")
    got = [(r.kind, r.region_key, r.term, r.is_alias, r.regions, r.weight) for r in SD.proper_nouns(spark, f"{tmp}/y").orderBy("seq").collect()]
    assert got == [("core", None, "入会権", False, [], 1.3), ("core", None, "入会", True, [], 1.3), ("regional", "aichi", "三河", False, ["愛知"], 1.0), ("regional", "aichi", "三州", True, ["愛知"], 1.0)]


def test_confidence_trees(spark):
    df = spark.createDataFrame([("n", '{"lines":[{"text":"入會","confidence":0.55,"chars":[{"text":"入","confidence":0.9}]},{"text":"侍","confidence":0.3}],"x":{"y":[[{"text":"z","confidence":1}]]}}'), ("m", "not json")], "note_id string, json string")
    assert {(r.text, r.confidence) for r in N.ocr_chars(df).collect()} == {("入會", 0.55), ("入", 0.9), ("侍", 0.3), ("z", 1.0)}


def test_confidence_trees_of_any_depth_in_their_own_order(spark):
    deep = '{"text":"a","confidence":0.1,"x":' + "[" * 5000 + '{"confidence":2e-1,"text":"b\\"]"}' + "]" * 5000 + "}"
    mixed = '{"z":{"confidence":1,"text":"first"},"a":[{"text":"second","confidence":0},{"text":5,"confidence":1},{"text":"no"}, {}, [], "text", null]}'
    rows = [("d", deep), ("m", mixed), ("n", None), ("o", "[{"), ("p", "]")]
    got = N.ocr_chars(spark.createDataFrame(rows, "note_id string, json string")).orderBy("note_id", "ord").collect()
    assert [(r.note_id, r.text, r.confidence) for r in got] == [("d", "a", 0.1), ("d", 'b"]', 0.2), ("m", "first", 1.0), ("m", "second", 0.0)]


def test_notes_found_by_parts(spark):
    n = spark.createDataFrame([("1", "x/beta", "beta"), ("2", "a/beta2", "beta2"), ("3", "yy/q", "q")], "note_id string, path string, name string")
    q = spark.createDataFrame([("eta",), ("et",), ("a/b",), ("yy/q.md",), ("y/",), ("beta",), ("none",), ("q",), ("/",), ("",)], "query string")
    got = {r.query: (r.note_id, r.rule) for r in N.find_notes(n, q).collect()}
    assert got == {"eta": ("2", 5), "et": ("2", 5), "a/b": ("2", 6), "yy/q.md": ("3", 4), "y/": ("3", 6), "beta": ("1", 2), "none": (None, None), "q": ("3", 2), "/": ("2", 6), "": ("2", 5)}


def test_versions(spark, tmp):
    a = spark.createDataFrame([("甲",)], "term string")
    assert logs.write_version(a, f"{tmp}/dict") == 1 and logs.write_version(a.union(a), f"{tmp}/dict") == 2
    assert logs.read_version(spark, f"{tmp}/dict").count() == 2 and logs.read_version(spark, f"{tmp}/dict", 1).count() == 1


def test_promote(spark):
    cols = "term string, normalized string, variants array<string>, reading string, category string, domain string, priority double, protect boolean, source string, approved boolean, seq bigint, source_file string"
    row = lambda t, n, s, f: (t, n, [], "", "", "", 0.6, False, "m", True, s, f)
    temp = spark.createDataFrame([row("甲", "新", 0, "t.csv"), row("乙", "乙", 1, "t.csv")], cols)
    appr = spark.createDataFrame([row("甲", "旧", 0, "b.csv")], cols)
    req = spark.createDataFrame([(" 甲 ", "t.csv", "b.csv"), ("乙", "t.csv", "b.csv"), ("丙", "t.csv", "b.csv")], "term string, source_file string, target_file string")
    want = {"check": ("conflict", {"甲"}, "旧"), "skip": ("skipped", set(), "旧"), "overwrite": ("overwritten", set(), "新")}
    for mode, (status, left, norm) in want.items():
        t, a, rep = G.promote(temp, appr, req, mode)
        assert {r.term: r.status for r in rep.collect()} == {"甲": status, "乙": "promoted", "丙": "not_found"}
        assert {r.term for r in t.collect()} == left
        assert {r.term: r.normalized for r in a.collect()} == {"甲": norm, "乙": "乙"}


def test_edits_and_guards(spark):
    cols = "term string, normalized string, variants array<string>, protect boolean, enabled boolean, approval_count int, seq bigint, source_file string"
    t = spark.createDataFrame([("甲", "a", [], True, True, 3, 0, "f.csv"), ("乙", "b", [], False, True, 3, 1, "g.csv")], cols)
    e = spark.createDataFrame([
        ("f.csv", "甲", "update", "乙2", " z ", "x,y;x"), ("g.csv", "無", "delete", None, None, None), ("g.csv", " ", "append", None, None, None), ("g.csv", "丁", "append", None, None, "p;q"),
    ], "source_file string, term string, op string, new_term string, normalized string, variants string")
    done, rep = G.edit_terms(t, e)
    got = {r.term: (r.normalized, r.variants, r.approval_count) for r in done.collect()}
    assert got == {"乙2": ("z", ["x", "y"], 0), "乙": ("b", [], 3), "丁": ("丁", ["p", "q"], 0)}
    assert sorted(r.status for r in rep.collect()) == ["done", "done", "not_found", "term_required"]
    with pytest.raises(ValueError):
        G.delete_file(t, "f.csv")
    assert G.delete_file(t, "g.csv").count() == 1
    with pytest.raises(ValueError):
        G.rename_file(t, "f.csv", "g.csv")
    stale = spark.range(1).select(*[G.is_stale(F.lit(x), F.lit("2026-07-01 00:00:00").cast("timestamp")).alias(n) for n, x in (("a", "2026-01-02T00:00:00+00:00"), ("b", "2026-01-02T00:00:01"), ("c", ""), ("d", "bad"))]).first()
    assert (stale.a, stale.b, stale.c, stale.d) == (True, False, False, False)
