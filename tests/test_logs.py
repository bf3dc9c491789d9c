"""Logs, metrics, routing, corrections and the streaming jobs."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from inkfold.operators import corrections as X
from inkfold.operators import governance as G
from inkfold.operators import metrics as MT
from inkfold.sources import logs
from inkfold.streaming import jobs
from inkfold.streaming import registration as RG


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n")


EVENTS = (
    [{"event": "span_accepted", "ts": f"2026-05-0{i}", "suspectSpan": "わり", "chosenCandidate": "ヨリ", "candidateList": ["ワリ", "ヨリ"], "rank1FromExperimental": True, "dismissedDangerFlag": i == 1} for i in range(1, 6)]
    + [{"event": "span_rejected", "ts": "2026-05-03", "suspectSpan": "x", "rank1FromExperimental": True, "isDangerous": True}]
    + [{"event": "span_skipped", "suspectSpan": "x", "rank1FromExperimental": True, "isDangerous": True, "dismissTrigger": t, "ts": "2026-05-01"} for t in ("reject", "overlay")]
    + ["", "{broken", {"event": "dictionary_setting_changed", "ts": "2026-05-03", "new_value": False}, {"event": "dictionary_setting_changed", "ts": "2026-05-03", "new_value": True}]
)


def test_golden_metrics(spark, tmp):
    write(f"{tmp}/a.jsonl", EVENTS)
    raw = logs.scan_actions(spark, f"{tmp}/a.jsonl")
    assert [r.line for r in logs.corrupt_actions(raw).collect()] == ["{broken"]
    a = logs.good_actions(raw)
    m = MT.experimental_metrics(a, a).first()
    assert (m.a_accept, m.b_reject, m.c_skip, m.d_accept_danger, m.e_reject_danger, m.f_skip_danger, m.g_accept_rate) == (5, 1, 2, 1, 1, 2, 0.625)
    dropped = logs.load_actions(a, True)
    assert MT.experimental_metrics(dropped, dropped).first().c_skip == 1
    state = {(r.scope, r.state): (r.accept, r.reject, r.skip) for r in MT.metrics_by_state(a, a.where("event = 'dictionary_setting_changed'")).collect()}
    # equal time stamps: the later line (ON) wins; before the first change the state is unknown
    assert state[("all", "ON")] == (3, 1, 0) and state[("all", "unknown")] == (2, 0, 2) and state[("all", "OFF")] == (0, 0, 0)
    s = MT.accepted_summary(a).first()
    assert (s.total, s.manual_rank, s.in_list) == (5, 0, 5)


def test_route_batch_and_stream(spark, tmp):
    write(f"{tmp}/in/a.jsonl", [e for e in EVENTS if isinstance(e, dict)])
    n = logs.route_actions(logs.good_actions(logs.scan_actions(spark, f"{tmp}/in")), f"{tmp}/out")
    assert n == 10
    q = jobs.route_stream(jobs.read_actions_stream(spark, f"{tmp}/in"), f"{tmp}/sout", f"{tmp}/ck")
    q.awaitTermination()
    for out in ("out", "sout"):
        got = {r.sink: r.n for r in spark.read.json(f"{tmp}/{out}").groupBy("sink").agg(F.count("*").alias("n")).collect()}
        assert got == {"span_accepted": 5, "user_actions": 3, "learning_candidates": 2}


REG = "file string, term string, op string, normalized string, enabled boolean, ts timestamp, seq bigint"


def reg(spark, term, ops):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    return [("f", term, op, n, on, t0 + timedelta(hours=i), i) for i, (op, n, on) in enumerate(ops)]


R, OFF, ON = ("register", "n", None), ("toggle", None, False), ("toggle", None, True)
CASES = {
    "one": ([R], 0, True, False), "four": ([R] * 4, 3, True, True), "three": ([R] * 3, 2, True, False),
    "changed": ([R] * 4 + [("update", "m", None)], 0, True, False), "same": ([R] * 4 + [("update", " n ", None)], 3, True, True),
    "off": ([R] * 4 + [OFF], 3, False, False), "on": ([R] * 4 + [OFF, ON], 3, True, True), "again": ([R, R, OFF, R], 2, True, False),
    "early": ([OFF, ("update", "q", None), R, R], 1, True, False),
    "twice": ([R, R, ("update", "m", None), R, ("update", "n", None), R, R], 2, True, False), "back": ([R, R, ("update", "m", None), ("update", "m", None), R], 1, True, False),
}


def test_approval_fold_and_stream(spark, tmp):
    rows = [r for k, (ops, *_) in CASES.items() for r in reg(spark, k, ops)]
    df = spark.createDataFrame(rows, REG)
    got = {r.term: (r.approval_count, r.enabled, r.is_promotion_candidate) for r in G.approval_fold(df).collect()}
    assert got == {k: v[1:] for k, v in CASES.items()}
    df.coalesce(1).write.parquet(f"{tmp}/ev")
    stream = spark.readStream.schema(REG).parquet(f"{tmp}/ev")
    q = jobs.approval_stream(stream, f"{tmp}/ck", path=f"{tmp}/state")
    q.awaitTermination()
    live = {r.term: (r.approval_count, r.enabled, r.is_promotion_candidate) for r in spark.read.parquet(f"{tmp}/state").collect()}
    assert live == got


def test_corrections_csv(spark, tmp):
    head = "doc_id,page,save_page,span_id,occurrence_index,suspect_span,original_text,selected_candidate,candidate_rank,is_manual_input,time_per_correction,exported_at,correction_mode,cleanup_rule"
    write(f"{tmp}/c.csv", ["﻿" + head, 'd,1,1,s1,0,"a,b",x,"say ""hi""",-1,true,,t,single,null', "d,2,2,,0,a,a,b,,0,1.5,t,,null"])
    rows = logs.scan_corrections(spark, f"{tmp}/c.csv").orderBy("page").collect()
    assert (rows[0].suspect_span, rows[0].selected_candidate, rows[0].is_manual_input, rows[0].cleanup_rule, rows[0].time_per_correction) == ("a,b", 'say "hi"', True, None, 0.0)
    good, bad = logs.valid_rows(logs.scan_corrections(spark, f"{tmp}/c.csv"), "d")
    assert good.count() == 1 and bad.count() == 1
    write(f"{tmp}/e.csv", [head])
    with pytest.raises(ValueError):
        logs.scan_corrections(spark, f"{tmp}/e.csv")
    logs.export_corrections(logs.export_rows(good.withColumn("ord", F.lit(1)), "t"), f"{tmp}/x", "csv")
    assert logs.scan_corrections(spark, f"{tmp}/x").first().selected_candidate == 'say "hi"'


def test_offsets_after_edits(spark):
    cols = "note_id string, page int, span_id string, start int, end int"
    spans = spark.createDataFrame([("n", 1, "a", 0, 2), ("n", 1, "b", 3, 5), ("n", 1, "c", 3, 4), ("n", 1, "d", 6, 8)], cols)
    edits = spark.createDataFrame([("n", 1, 0, 2, "XYZ"), ("n", 1, 3, 5, "")], "note_id string, page int, start int, end int, new string")
    got = {r.span_id: (r.new_start, r.new_end) for r in X.shift_offsets(spans, edits).collect()}
    assert got == {"a": (0, 3), "d": (5, 7)}
    keep = {r.span_id: (r.new_start, r.new_end) for r in X.shift_offsets(spans, edits.where("start = 0").union(edits.where("start = 3").withColumn("new", F.lit("Q"))), "keep").collect()}
    assert keep == {"a": (0, 3), "b": (4, 5), "c": (4, 5), "d": (6, 8)}
    pages = spark.createDataFrame([("n", 1, "ab-cd-ef")], "note_id string, page int, clean_text string")
    assert X.apply_edits(pages, edits).first().new_text == "XYZ--ef"


def test_paint_order(spark):
    s = spark.createDataFrame([("n", 1, 0, 4, "s0"), ("n", 1, 6, 7, "s6")], "note_id string, page int, start int, end int, span_id string")
    h = spark.createDataFrame([("n", 1, 2, 3, "h2"), ("n", 1, 4, 5, "h4"), ("n", 1, 6, 7, "h6")], "note_id string, page int, start int, end int, id string")
    assert [r.id for r in X.paint_order(s, h).orderBy("start").collect()] == ["s0", "h4", "s6"]


@pytest.mark.parametrize("stretch", [7, 50, 8192])
def test_paint_order_against_a_plain_loop(spark, stretch):
    rng = random.Random(stretch)
    rows = {(n, p): [(a := rng.randint(0, 300), a + rng.choice([1, 1, 2, 5, 40]), rng.randint(0, 1), f"i{k}") for k in range(rng.choice([1, 5, 80]))] for n in range(4) for p in (1, 2)}
    rows[(9, 1)] = [(0, 1000, 0, "long"), (3, 4, 1, "under"), (999, 1001, 0, "on"), (1000, 1000, 0, "none"), (1000, 1003, 1, "next")]
    want = set()
    for (n, p), items in rows.items():
        cursor = 0
        for a, b, t, i in sorted(items, key=lambda x: (x[0], x[2], x[1], x[3])):
            if a >= cursor and b > a:
                want.add((n, p, a, b, "particle" if t else "analyzed", i))
                cursor = b
    flat = [(n, p, *x) for (n, p), items in rows.items() for x in items]
    part = lambda t, name: spark.createDataFrame([(n, p, a, b, i) for n, p, a, b, k, i in flat if k == t], f"note_id long, page int, start int, end int, {name} string")
    got = X.paint_order(part(0, "span_id"), part(1, "id"), stretch)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_json_export_reads_back_whole(spark, tmp):
    rows = [("d", 1, f"p1_o0_s{i}", i, "語", f"候{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id string, page int, span_id string, occurrence_index int, suspect_span string, selected_candidate string").withColumn("ord", F.col("occurrence_index"))
    logs.export_corrections(logs.export_rows(df, "t").repartition(3), f"{tmp}/c.json", "json")
    back = logs.scan_corrections(spark, f"{tmp}/c.json")
    assert sorted(r.selected_candidate for r in back.collect()) == sorted(r[5] for r in rows)
    with open(f"{tmp}/old.json", "w", encoding="utf-8") as f:
        f.write('[{"doc_id":"d","spanId":"s1","page":2},{"doc_id":"e","span_id":"s2"}]')
    assert sorted(r.span_id for r in logs.scan_corrections(spark, f"{tmp}/old.json").collect()) == ["s1", "s2"]


def folded(events):
    state = {}
    for term, op, norm, enabled, ts, seq in sorted(events, key=lambda e: (e[4], e[5])):
        s = state.get(term)
        if s is None:
            if op == "register":
                state[term] = {"n": norm, "on": True, "count": 0}
            continue
        if op == "register":
            s["count"] += 1
            s["on"] = True
        elif op == "update" and norm is not None:
            if norm != s["n"]:
                s["count"] = 0
            s["n"] = norm
        if op != "register" and enabled is not None:
            s["on"] = enabled
    return {t: (s["n"], s["on"], s["count"]) for t, s in state.items()}


def test_registration_fold_with_one_frequent_term(spark):
    import random
    from datetime import datetime, timedelta

    from inkfold.operators import governance as G

    for seed in range(3):
        rng = random.Random(seed)
        events = []
        for i in range(600):
            term = "hot" if rng.random() < 0.9 else rng.choice("abc")
            op = rng.choice(["register"] * 4 + ["toggle", "update"])
            norm = rng.choice(["x", "y"]) if op == "register" or rng.random() < 0.4 else None
            enabled = rng.random() < 0.5 if op == "toggle" else None
            events.append((term, op, norm, enabled, datetime(2026, 1, 1) + timedelta(minutes=rng.randint(0, 400)), i))
        df = spark.createDataFrame([("f", *e) for e in events], "file string, term string, op string, normalized string, enabled boolean, ts timestamp, seq long")
        got = {r.term: (r.normalized, r.enabled, r.approval_count) for r in G.approval_fold(df).collect()}
        assert got == folded(events)


# --- state that late events and failures don't disturb -------------------------------------------
def plain_state(events):
    state = None
    for e in sorted(events, key=lambda e: (e.ts, e.seq)):
        norm = None if e.normalized is None else e.normalized.strip()
        if e.op == "register":
            state = [True, norm or "", 0, e.ts, e.ts] if state is None else [True, state[1], state[2] + 1, state[3], e.ts]
        elif state and e.op == "toggle":
            state[0] = state[0] if e.enabled is None else e.enabled
        elif state and e.op == "update":
            if norm is not None and norm != state[1]:
                state[1], state[2] = norm, 0
            state[0] = state[0] if e.enabled is None else e.enabled
            state[4] = e.ts
    return state and tuple(state)


def test_changes_compose_in_any_grouping():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randint(0, 12)
        events = [RG.Event(k, k, rng.choice(["register", "update", "toggle", "other"]), rng.choice([None, "a", "b", " a "]), rng.choice([None, True, False])) for k in range(n)]
        cut = sorted(rng.randint(0, n) for _ in range(3))
        parts = [RG.folded(map(RG.change_of, events[a:b])) for a, b in zip([0, *cut], [*cut, n], strict=True)]
        assert parts[0].then(parts[1]).then(parts[2].then(parts[3])).born == plain_state(events)
        start = RG.State(True, "a", 3, -5, -4)
        assert RG.load_change(RG.dump(parts[2])).applied(start) == parts[2].applied(start)


def test_late_batches_and_a_hot_term(spark, tmp):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    t0 = datetime(2026, 1, 1)
    rows = [("f", "hot" if i % 10 else f"t{i % 3}", rng.choice(["register", "register", "update", "toggle"]), rng.choice(["a", "b", None]), rng.choice([True, False, None]), t0 + timedelta(minutes=7 * i), i) for i in range(400)]
    want = {r.term: (r.approval_count, r.enabled, r.normalized, r.registered_at, r.last_seen_at) for r in G.approval_fold(spark.createDataFrame(rows, REG)).collect()}
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], REG).coalesce(1).write.parquet(f"{tmp}/ev/b{k}")
    stream = spark.readStream.schema(REG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp}/ev")
    jobs.approval_stream(stream, f"{tmp}/ck", path=f"{tmp}/state").awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp}/state").orderBy("batch").collect():
        got[r.term] = (r.approval_count, r.enabled, r.normalized, r.registered_at, r.last_seen_at)
    assert spark.read.parquet(f"{tmp}/state").select("batch").distinct().count() == 4
    assert got == want


def test_a_retry_in_a_later_batch_is_dropped(spark, tmp):
    one, two = ({"event": "span_accepted", "ts": f"2026-05-01T10:0{i}:00", "spanId": f"s{i}"} for i in (1, 2))
    write(f"{tmp}/in/a.jsonl", [one, one])
    route = lambda: jobs.route_stream(jobs.read_actions_stream(spark, f"{tmp}/in"), f"{tmp}/out", f"{tmp}/ck", dedupe=True).awaitTermination()
    route()
    write(f"{tmp}/in/b.jsonl", [one, two, {"event": "x", "ts": "no time"}, {"event": "x", "ts": "no time"}])
    route()
    got = spark.read.json(f"{tmp}/out").groupBy("event", "spanId").count().collect()
    assert sorted((r.event, r.spanId or "", r["count"]) for r in got) == [("span_accepted", "s1", 1), ("span_accepted", "s2", 1), ("x", "", 1)]


def test_a_failed_write_leaves_no_version(spark, tmp):
    a = spark.createDataFrame([(i,) for i in range(20)], "i int")
    assert logs.write_version(a, f"{tmp}/d") == 1
    fail = F.when(F.col("i") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("i"))
    with pytest.raises(Exception, match="lost"):
        logs.write_version(a.repartition(5).select(fail.cast("int").alias("i")), f"{tmp}/d")
    assert logs.versions(spark, f"{tmp}/d") == [1] and logs.read_version(spark, f"{tmp}/d").count() == 20
    assert logs.write_version(a.union(a), f"{tmp}/d") == 2 and logs.read_version(spark, f"{tmp}/d").count() == 40
    # a second writer that published the same number first
    os.makedirs(f"{tmp}/d/v=3,data-0")
    a.write.parquet(f"{tmp}/d/data-0")
    assert logs.write_version(a, f"{tmp}/d") == 4
