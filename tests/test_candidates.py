"""Candidate rules on hand-checked rows."""

from pyspark.sql import functions as F

from inkfold.operators import candidates as C
from inkfold.operators import matching as M

TERMS = ("term string, normalized string, variants array<string>, reading string, category string, domain string, "
         "priority double, protect boolean, source string, approved boolean, tier string, seq bigint")


def term(t, n=None, variants=(), domain="", priority=0.0, protect=False, tier="stable", seq=0):
    return (t, n or t, list(variants), "", "", domain, priority, protect, "", True, tier, seq)


def terms(spark, *rows):
    return spark.createDataFrame([r[:-1] + (i,) for i, r in enumerate(rows)], TERMS)


def spans(spark, *texts, protected=False):
    return spark.createDataFrame([("n", 1, t, protected) for t in texts], "note_id string, page int, suspect_span string, is_protected boolean")


def hints(spark, *rows):
    return spark.createDataFrame([("n", *r) for r in rows], "note_id string, term string, bonus double, is_proper boolean, is_geo boolean")


def offered(spark, span, *rows):
    s = spans(spark, span)
    none = spark.createDataFrame([], "note_id string, page int, suspect_span string, candidate string, score double, ord bigint, bonus_only boolean")
    return {r.candidate: r.score for r in C.bonus_only(s, none, hints(spark, *rows)).collect()}


def test_bonus_only_rules(spark):
    assert "伊賀" not in offered(spark, "伊勢", ("伊勢", 30.0, True, True), ("伊賀", 28.0, True, True))
    assert offered(spark, "甲州街", ("甲州", 30.0, True, True)) == {"甲州": 25.0}
    assert offered(spark, "三", ("三河", 30.0, True, False)) == {"三河": 25.0}
    assert list(offered(spark, "三石", ("三河", 30.0, True, True), ("三石", 25.0, True, False))) == ["三石"]
    assert offered(spark, "山論", ("田中次郎", 26.0, False, False), ("裁判", 26.0, False, False)) == {}
    assert offered(spark, "2", ("三河", 30.0, True, False)) == {}
    assert offered(spark, "山論", ("山論地", 19.0, True, False)) == {}


def test_scores_and_order(spark):
    f = M.term_forms(terms(spark, term("入会", variants=["入會"], priority=1.0, protect=True, domain="d"),
                           term("山諍", "山訴", priority=0.9, tier="experimental"), term("山諍", "山訴", priority=0.1)))
    got = {(r.suspect_span, r.candidate): round(r.score, 6) for r in C.term_candidates(spans(spark, "入會", "山諍", protected=True), f, "d").collect()}
    assert got == {("入會", "入会"): 130.0, ("入會", "入會"): 180.0, ("山諍", "山訴"): 101.0}


def test_rank_suppression_does_not_refill(spark):
    rows = [("n", 1, "s", f"c{i}", 100.0 - i, i, i in (1, 2)) for i in range(7)]
    c = spark.createDataFrame(rows, "note_id string, page int, suspect_span string, candidate string, score double, ord int, bonus_only boolean")
    full = [r.candidate for r in C.rank_candidates(c).orderBy("rank").collect()]
    assert full == ["c0", "c1", "c2", "c3", "c4"]
    assert [r.candidate for r in C.rank_candidates(c, suppress_bonus_only=True).orderBy("rank").collect()] == ["c0", "c3", "c4"]
    assert [r.candidate for r in C.rank_candidates(c, spans=spans(spark, "t")).where("suspect_span='t'").collect()] == ["t"]


def test_dictionary_match_paths_agree(spark):
    f = M.term_forms(terms(spark, term("山"), term("村人", "村民", ["村"]), term("山論", "山論", ["山諍"]), term("申立", "申立")))
    p = spark.createDataFrame([("n", 1, "山村人ノ山諍"), ("n", 2, ""), ("m", 1, "申立")], "note_id string, page int, clean_text string")
    a = {(r.note_id, r.page, r.suspect_span) for r in M.dictionary_match(p, f).collect()}
    b = {(r.note_id, r.page, r.suspect_span) for r in M.dictionary_match(p, f, hint="merge").collect()}
    assert a == b == {("n", 1, "山"), ("n", 1, "村人"), ("n", 1, "村"), ("n", 1, "山諍"), ("m", 1, "申立")}


def test_the_best_of_a_long_menu(spark):
    """A span's own candidates fill the front of its menu; the best others are found behind them."""
    hints = spark.createDataFrame([("n", f"三{chr(0x4E00 + i)}", 20.0 + (i % 7), True, False, i) for i in range(300)], "note_id string, term string, bonus double, is_proper boolean, is_geo boolean, ord long")
    spans = spark.createDataFrame([("n", 1, "甲乙"), ("n", 1, "丙丁"), ("n", 1, "あい")], "note_id string, page int, suspect_span string")
    best = sorted(hints.collect(), key=lambda r: (-min(r.bonus, 25.0), r.ord, r.term))
    own = [r.term for r in best[:40]] + ["別", "物"]
    cands = spark.createDataFrame([("n", 1, "甲乙", c, 1.0, 1, False) for c in own], "note_id string, page int, suspect_span string, candidate string, score double, ord long, bonus_only boolean")
    for k in (1, 5, 8, 9):
        got = {}
        for r in C.bonus_only(spans, cands, hints, k=k).orderBy("suspect_span", F.desc("score"), "ord").collect():
            got.setdefault(r.suspect_span, []).append(r.candidate)
        assert got == {"甲乙": [r.term for r in best[40 : 40 + k]], "丙丁": [r.term for r in best[:k]]}
    assert C.bonus_only(spans, cands, hints).count() == 300 + 260


def test_pieces_of_many_pages_are_handed_on_in_parts():
    import types

    import numpy as np
    import pyarrow as pa

    word = lambda i: "".join(chr(0x4E00 + (i * k) % 977) for k in (3, 5, 7, 11))
    texts = [" ".join(word(i * 13 + j) for j in range(60)) for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"note_id": list(range(3000)), "page": [1] * 3000, "text": texts})
    sent = types.SimpleNamespace(value=np.full(1 << M.FILTER_BITS >> 3, 255, np.uint8).tobytes())  # rules nothing out
    got, largest = 0, 0
    for part in M._pieces(sent, [2, 4])(iter([batch])):
        largest = max(largest, len(part))
        rows = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True))
        assert all(f in texts[i] for i, f in rows) and len(set(rows)) == len(rows)
        got += len(rows)
    assert got == sum(len({t[k : k + n] for k in range(len(t) - n + 1)}) for t in texts for n in (2, 4))
    assert largest < got / 3


def test_bundles_rank_as_rows_do_and_move_once(spark):
    """Repeated rows, null notes and pages, spans without candidates, candidates of no span: both ways give the same, and bundles take one shuffle."""
    from inkfold.operators.bundles import bundled

    cand_type = "note_id string, page int, suspect_span string, candidate string, score double, ord long, bonus_only boolean"
    s = spark.createDataFrame([("n", 1, "甲乙"), ("n", 1, "甲乙"), ("n", 2, "丙丁"), ("n", 1, "あいう"), ("n", None, "甲乙"), (None, 1, "甲乙"), ("m", 1, "x")], "note_id string, page int, suspect_span string")
    c = spark.createDataFrame(
        [("n", 1, "甲乙", "三一", 90.0, 1, False), ("n", 1, "甲乙", "三一", 90.0, 1, False), ("n", 1, "甲乙", "三四五六", 20.0, 2, False), ("n", 1, "戊己", "別", None, 3, False),
         (None, 1, "甲乙", "三一", 5.0, 4, False), ("n", None, "甲乙", "三二", 7.0, 5, False)], cand_type)
    h = spark.createDataFrame(
        [("n", t, b, True, g, o) for t, b, g, o in [("三一", 30.0, False, 1), ("三二", 22.0, False, 2), ("三二", 22.0, False, 2), ("三四五六", 21.0, False, 3), ("三", 24.0, True, 4), ("かきく", 28.0, False, None)]]
        + [(None, "三二", 29.0, True, False, 1)], "note_id string, term string, bonus double, is_proper boolean, is_geo boolean, ord long")
    for k in (2, 5):
        for suppress in (False, True):
            rows = C.hint_boost(c, h).unionByName(C.bonus_only(s, c, h, k=k)).withColumn("ord", F.struct("ord", "candidate"))
            want = sorted((str(r[:5]) for r in C.rank_candidates(rows, k, suppress, s).select(*C.KEY, "candidate", "rank").collect()))
            bs, bc, bh = bundled(s), bundled(c), bundled(h)
            ranked = C.rank_candidates(C.hint_boost(bc, bh), k, suppress, bs, C.bonus_only(bs, bc, bh, k=k))
            each = ranked.select(*C.KEY, F.posexplode("ranked").alias("i", "x")).select(*C.KEY, "x.candidate", (F.col("i") + 1).alias("rank"))
            assert sorted(str(r[:5]) for r in each.collect()) == want and len(want) > 5
            plan = ranked._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("MapInArrow") == 4 and "Join" not in plan
    whole = {(r.page, r.suspect_span): [x.candidate for x in r.offer] for r in C.offer_lists(C.bonus_only(bs, bc, bh)).select("note_id", F.explode("members").alias("m"), "offer").select("m.*", "offer").collect()}
    assert whole == {(1, "甲乙"): ["三二", "三二"], (2, "丙丁"): ["三一", "三二", "三二"], (None, "甲乙"): ["三一", "三二", "三二"], (1, "あいう"): ["かきく"]}
