"""Review metrics, corrections and dictionary governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.functions.rows import unfolded
from inkfold.operators import corrections as X
from inkfold.operators import detectors as D
from inkfold.operators import governance as G
from inkfold.operators import matching as M
from inkfold.operators import metrics as MT
from inkfold.operators import particles as PT
from inkfold.sources import logs

from . import inputs as I
from .candidate_queries import SPANS_SQL, located_spans
from .registry import query
from .text_queries import _KG, _SCAN_TEXT, kana_grammar

_A = f"WITH {I.SQL['actions']}"
_EXP = "coalesce(rank1FromExperimental, false)"


def _acts(spark, sf):
    return I.actions(spark, sf)


@query(
    "experimental_metrics",
    f"{_A}, m AS (SELECT count(*) FILTER (WHERE event = 'span_accepted' AND {_EXP}) AS a_accept, count(*) FILTER (WHERE event = 'span_accepted') AS a_total, "
    f"count(*) FILTER (WHERE event = 'span_rejected' AND {_EXP}) AS b_reject, count(*) FILTER (WHERE event = 'span_rejected') AS b_total, count(*) FILTER (WHERE event = 'span_skipped' AND {_EXP}) AS c_skip, count(*) FILTER (WHERE event = 'span_skipped') AS c_total, "
    f"count(*) FILTER (WHERE event = 'span_accepted' AND {_EXP} AND dismissedDangerFlag) AS d_accept_danger, count(*) FILTER (WHERE event = 'span_rejected' AND {_EXP} AND isDangerous) AS e_reject_danger, "
    f"count(*) FILTER (WHERE event = 'span_skipped' AND {_EXP} AND isDangerous) AS f_skip_danger FROM actions) SELECT *, a_accept / (a_accept + b_reject + c_skip)::DOUBLE AS g_accept_rate FROM m",
)
def experimental_metrics(spark, sf):
    a = _acts(spark, sf)
    return MT.experimental_metrics(a, a)


@query(
    "experimental_metrics_without_reject_skips",
    f"{_A} SELECT count(*) FILTER (WHERE event = 'span_skipped') AS c_total, count(*) FILTER (WHERE event = 'span_skipped' AND {_EXP}) AS c_skip FROM actions WHERE NOT (event = 'span_skipped' AND dismissTrigger = 'reject')",
)
def experimental_metrics_without_reject_skips(spark, sf):
    a = logs.load_actions(_acts(spark, sf), drop_reject_skips=True)
    return MT.experimental_metrics(a, a).select("c_total", "c_skip")


_CHANGES = "changes AS (SELECT ts, new_value, line_no, user_id FROM actions WHERE event = 'dictionary_setting_changed')"


def _changes(spark, sf):
    return _acts(spark, sf).where("event = 'dictionary_setting_changed'")


_STATE = (
    f"{_CHANGES}, ch AS (SELECT ts, arg_max(new_value, line_no) AS new_value FROM changes GROUP BY 1), "
    "st AS (SELECT a.*, CASE WHEN c.new_value IS NULL THEN 'unknown' WHEN c.new_value THEN 'ON' ELSE 'OFF' END AS state FROM (SELECT * FROM actions WHERE event IN ('span_accepted', 'span_rejected', 'span_skipped')) a ASOF LEFT JOIN ch c ON a.ts >= c.ts)"
)


@query("setting_as_of", f"{_A}, {_STATE} SELECT line_no, state FROM st")
def setting_as_of(spark, sf):
    acts = _acts(spark, sf).where(F.col("event").isin("span_accepted", "span_rejected", "span_skipped")).select("ts", "line_no")
    return MT.setting_as_of(acts, _changes(spark, sf)).select("line_no", "state")


@query(
    "setting_as_of_by_user",
    f"{_A}, {_CHANGES}, ch AS (SELECT user_id, ts, arg_max(new_value, line_no) AS new_value FROM changes GROUP BY ALL) SELECT a.line_no, CASE WHEN c.new_value IS NULL THEN 'unknown' WHEN c.new_value THEN 'ON' ELSE 'OFF' END AS state "
    "FROM (SELECT * FROM actions WHERE event IN ('span_accepted', 'span_rejected', 'span_skipped')) a ASOF LEFT JOIN ch c ON a.user_id = c.user_id AND a.ts >= c.ts",
)
def setting_as_of_by_user(spark, sf):
    acts = _acts(spark, sf)
    ev = acts.where(F.col("event").isin("span_accepted", "span_rejected", "span_skipped")).select("ts", "line_no", "docId")
    return MT.setting_as_of(ev, acts.where("event = 'dictionary_setting_changed'"), by="docId").select("line_no", "state")


@query(
    "metrics_by_state",
    f"{_A}, {_STATE}, two AS (SELECT 'all' AS scope, * FROM st UNION ALL SELECT 'experimental', * FROM st WHERE {_EXP}), "
    "c AS (SELECT scope, state, count(*) FILTER (WHERE event = 'span_accepted') AS accept, count(*) FILTER (WHERE event = 'span_rejected') AS reject, count(*) FILTER (WHERE event = 'span_skipped') AS skip FROM two GROUP BY ALL), "
    "f AS (SELECT * FROM (VALUES ('all'), ('experimental')) a(scope), (VALUES ('ON'), ('OFF'), ('unknown')) b(state)) "
    "SELECT scope, state, coalesce(accept, 0) AS accept, coalesce(reject, 0) AS reject, coalesce(skip, 0) AS skip, accept / nullif(accept + reject + skip, 0)::DOUBLE AS accept_rate FROM f LEFT JOIN c USING (scope, state)",
)
def metrics_by_state(spark, sf):
    return MT.metrics_by_state(_acts(spark, sf), _changes(spark, sf))


@query(
    "setting_history",
    f"{_A} SELECT substr(ts, 1, 19) AS ts, NOT new_value AS old_value, new_value, line_no FROM actions WHERE event = 'dictionary_setting_changed'",
)
def setting_history(spark, sf):
    return MT.setting_history(_changes(spark, sf)).select("ts", "old_value", "new_value", "line_no")


@query(
    "span_distribution",
    f"{_A}, x AS (SELECT *, CASE event WHEN 'span_accepted' THEN 0 WHEN 'span_rejected' THEN 1 ELSE 2 END AS r FROM actions WHERE event IN ('span_accepted', 'span_rejected', 'span_skipped') AND {_EXP}) "
    "SELECT suspectSpan AS suspect_span, count(*) AS total, count(*) FILTER (WHERE r = 0) AS accept, count(*) FILTER (WHERE r = 1) AS reject, count(*) FILTER (WHERE r = 2) AS skip, count(*) FILTER (WHERE r = 0) / count(*)::DOUBLE AS accept_rate "
    "FROM x GROUP BY 1 ORDER BY total DESC, min(r * 1000000000 + line_no) LIMIT 20",
)
def span_distribution(spark, sf):
    return MT.span_distribution(_acts(spark, sf))


_IN = "list_contains(candidateList, chosenCandidate)"


@query(
    "accepted_summary",
    f"{_A} SELECT count(*) AS total, count(*) FILTER (WHERE wasBigramSuspect) AS bigram, count(*) FILTER (WHERE particleScript = 'katakana_dominant') AS katakana_dominant, "
    f"count(*) FILTER (WHERE coalesce(candidateRank, coalesce(list_position(candidateList, chosenCandidate), 0) - 1) = -1) AS manual_rank, count(*) FILTER (WHERE {_IN}) AS in_list, count(*) FILTER (WHERE NOT {_IN}) AS manual_input FROM actions WHERE event = 'span_accepted'",
)
def accepted_summary(spark, sf):
    return MT.accepted_summary(_acts(spark, sf))


def _pairs(extra=""):
    return (
        f"{_A} SELECT suspectSpan AS suspect_span, chosenCandidate AS chosen, count(*) AS count, arg_min({_IN}, line_no) AS in_list, coalesce(arg_min(coalesce(hintSource, ''), line_no), '') AS hint_source "
        f"FROM actions WHERE event = 'span_accepted' {extra} GROUP BY ALL ORDER BY count DESC, min(line_no)"
    )


@query("pair_counts", _pairs() + " LIMIT 20")
def pair_counts(spark, sf):
    return MT.pair_counts(_acts(spark, sf))


@query("pair_counts_bigram", _pairs("AND wasBigramSuspect"))
def pair_counts_bigram(spark, sf):
    return MT.pair_counts(_acts(spark, sf), bigram_only=True)


@query(
    "suspect_distribution",
    f"{_A} SELECT suspectSpan AS suspect_span, count(*) AS count FROM actions WHERE event = 'span_accepted' AND particleScript = 'katakana_dominant' GROUP BY 1 ORDER BY count DESC, min(line_no) LIMIT 20",
)
def suspect_distribution(spark, sf):
    return MT.suspect_distribution(_acts(spark, sf))


@query(
    "span_detail",
    f"{_A} SELECT line_no, chosenCandidate, array_to_string(candidateList, '|') AS candidates, wasBigramSuspect, CAST(coalesce(candidateRank, coalesce(list_position(candidateList, chosenCandidate), 0) - 1) AS INTEGER) AS rank, NOT {_IN} AS manual, coalesce(hintSource, '') AS hint_source FROM actions WHERE event = 'span_accepted' AND suspectSpan = '語7'",
)
def span_detail(spark, sf):
    d = MT.span_detail(_acts(spark, sf), "語7")
    return d.withColumn("candidates", F.array_join("candidateList", "|")).drop("candidateList")


@query(
    "promotion_share",
    f"{_A}, p AS (SELECT suspectSpan, chosenCandidate, count(*) AS n, min(line_no) AS l FROM actions WHERE event = 'span_accepted' GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY suspectSpan) AS total, row_number() OVER (PARTITION BY suspectSpan ORDER BY n DESC, l) AS k FROM p) "
    "SELECT suspectSpan AS suspect_span, chosenCandidate AS top_chosen, n AS top_count, CAST(total AS BIGINT) AS total, n / total::DOUBLE AS share, n / total::DOUBLE >= 0.8 AS is_rule_candidate FROM r WHERE k = 1",
)
def promotion_share(spark, sf):
    return MT.promotion_share(_acts(spark, sf))


@query(
    "route_actions",
    f"{_A} SELECT CASE WHEN event = 'span_accepted' THEN 'span_accepted' WHEN event IN ('span_rejected', 'span_skipped', 'manual_selection_corrected') THEN 'user_actions' ELSE 'learning_candidates' END AS sink, event, count(*) AS n FROM actions GROUP BY ALL",
)
def route_actions(spark, sf):
    return logs.routed(logs.keep_for_log(_acts(spark, sf))).groupBy("sink", "event").agg(F.count(F.lit(1)).alias("n"))


# --- corrections ------------------------------------------------------------------------
_C = f"WITH {I.SQL['corrections']}"


@query(
    "last_wins",
    f"{_C}, k AS (SELECT *, CASE WHEN span_id = '' THEN suspect_span ELSE span_id END AS key FROM corrections) SELECT doc_id, page, span_id, arg_max(suspect_span, ord) AS suspect_span, max(ord) AS ord FROM k GROUP BY doc_id, page, key, span_id",
)
def last_wins(spark, sf):
    return logs.last_wins(I.corrections(spark, sf)).select("doc_id", "page", "span_id", "suspect_span", "ord")


@query(
    "last_wins_import",
    f"{_C}, k AS (SELECT *, CASE WHEN span_id = '' THEN suspect_span || '_' || occurrence_index ELSE span_id END AS key FROM corrections) SELECT doc_id, page, max(ord) AS ord FROM k GROUP BY doc_id, page, key",
)
def last_wins_import(spark, sf):
    return logs.last_wins(I.corrections(spark, sf), "import").select("doc_id", "page", "ord")


_OK = "trim(span_id) <> '' AND correction_mode IS NOT NULL AND selected_candidate IS NOT NULL"


@query("valid_rows", f"{_C} SELECT ord, {_OK} AS ok FROM corrections")
def valid_rows(spark, sf):
    good, bad = logs.valid_rows(I.corrections(spark, sf))
    return good.select("ord", F.lit(True).alias("ok")).unionByName(bad.select("ord", F.lit(False).alias("ok")))


@query(
    "export_rows",
    f"{_C}, k AS (SELECT *, CASE WHEN span_id = '' THEN suspect_span ELSE span_id END AS key FROM corrections), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, key ORDER BY ord DESC) AS rn FROM k) "
    "SELECT doc_id, page, span_id, occurrence_index, suspect_span, suspect_span AS original_text, coalesce(selected_candidate, '') AS selected_candidate, coalesce(candidate_rank, -1) AS candidate_rank, is_manual_input, time_per_correction, coalesce(correction_mode, 'single') AS correction_mode FROM x WHERE rn = 1",
)
def export_rows(spark, sf):
    return logs.export_rows(I.corrections(spark, sf), "t").select(
        "doc_id", "page", "span_id", "occurrence_index", "suspect_span", "original_text", "selected_candidate", "candidate_rank", "is_manual_input", "time_per_correction", "correction_mode"
    )


@query(
    "merge_import",
    f"{_C}, cur AS (SELECT * FROM corrections WHERE ord % 2 = 0), imp AS (SELECT * FROM corrections WHERE ord % 2 = 1 AND page <> 2) SELECT doc_id, page, ord FROM imp UNION ALL SELECT doc_id, page, ord FROM cur WHERE NOT EXISTS (SELECT 1 FROM imp WHERE imp.doc_id = cur.doc_id AND imp.page = cur.page)",
)
def merge_import(spark, sf):
    c = I.corrections(spark, sf).withColumn("note_id", F.col("doc_id"))
    return X.merge_import(c.where("ord % 2 = 0"), c.where("ord % 2 = 1 AND page <> 2")).select("doc_id", "page", "ord")


# edits: every word-form hit of a text is replaced by a longer, a shorter or an empty text
def _hits_sql():
    return (
        f"WITH {I.ctes('grammar')}, cut AS (SELECT note_id, page, text, regexp_split_to_array(text, '申立(?:候|レ)') AS pieces, regexp_extract_all(text, '申立(?:候|レ)', 0) AS found FROM grammar), "
        "u AS (SELECT note_id, page, unnest(found) AS s, unnest(range(1, len(found) + 1)) AS k, unnest(pieces[1:len(found)]) AS piece FROM cut), "
        "hits AS (SELECT note_id, page, s, k, CAST(sum(length(piece) + length(s)) OVER w - length(s) AS INTEGER) AS start, CAST(sum(length(piece) + length(s)) OVER w AS INTEGER) AS stop, CASE (k % 3) WHEN 0 THEN '' WHEN 1 THEN '申立仕候共' ELSE '申' END AS new FROM u WINDOW w AS (PARTITION BY note_id, page ORDER BY k)), "
        "pos AS (SELECT *, CAST(start + coalesce(sum(length(new) - length(s)) OVER (PARTITION BY note_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS new_start FROM hits)"
    )


def _edits(spark, sf):
    g = I.grammar(spark, sf)
    e = unfolded(g, ["note_id", "page"], T.matches(F.col("text"), "申立(?:候|レ)"), "m", "_k").select(
        "note_id", "page", (F.col("_k") + 1).alias("k"), F.col("m.start").alias("start"), (F.col("m.start") + 3).alias("end"), F.col("m.text").alias("s"),
    )
    r = F.col("k") % 3
    return g, e.withColumn("new", F.when(r == 0, "").when(r == 1, "申立仕候共").otherwise("申")).withColumn("span_id", F.concat(F.lit("s"), F.col("k").cast("string")))


@query("shift_offsets", f"{_hits_sql()} SELECT note_id, page, 's' || k AS span_id, new_start, CAST(new_start + length(new) AS INTEGER) AS new_end FROM pos WHERE new <> ''")
def shift_offsets(spark, sf):
    _, e = _edits(spark, sf)
    return X.shift_offsets(e.select("note_id", "page", "span_id", "start", "end"), e).select("note_id", "page", "span_id", "new_start", "new_end")


@query(
    "apply_corrections",
    f"{_hits_sql()}, done AS (SELECT u.note_id, u.page, string_agg(piece || new, '' ORDER BY u.k) AS head FROM u JOIN hits USING (note_id, page, k) GROUP BY ALL) "
    "SELECT note_id, page, coalesce(head, '') || pieces[len(found) + 1] AS new_text FROM cut LEFT JOIN done USING (note_id, page)",
)
def apply_corrections(spark, sf):
    g, e = _edits(spark, sf)
    spans = e.select("note_id", "page", "span_id", F.col("s").alias("suspect_span"), "start", "end")
    decisions = e.select("note_id", "page", F.lit("single").alias("mode"), "span_id", F.col("s").alias("suspect_span"), F.col("new").alias("candidate"), "start", "end")
    pages, _ = X.apply_corrections(g, spans, decisions, "text")
    return pages.select("note_id", "page", "new_text")


@query("replay_match", f"{_hits_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY note_id, page, s ORDER BY k) - 1 AS occ FROM hits) SELECT note_id, page, s AS suspect_span, CAST(occ AS INTEGER) AS occurrence_index, start FROM o WHERE occ % 2 = 0")
def replay_match(spark, sf):
    _, e = _edits(spark, sf)
    spans = M.occurrence_index(e.withColumnRenamed("s", "suspect_span"))
    rows = spans.where("occurrence_index % 2 = 0").select("note_id", "page", "suspect_span", "occurrence_index", F.col("new").alias("selected_candidate"))
    ghost = rows.withColumn("suspect_span", F.lit("無"))
    return X.replay_match(rows.unionByName(ghost), spans).select("note_id", "page", "suspect_span", "occurrence_index", "start")


_GRAM_SPANS = f"{_hits_sql()}, sp AS (SELECT note_id, page, 's' || k AS span_id, k, start, CASE s WHEN '申立候' THEN 'accept' ELSE 'reject' END AS verdict FROM hits)"


def _queue_spans(spark, sf):
    _, e = _edits(spark, sf)
    v = F.when(F.col("s") == "申立候", "accept").otherwise("reject")
    return e.select("note_id", "page", "span_id", "k", "start", v.alias("verdict"))


@query("review_queue", f"{_GRAM_SPANS} SELECT note_id, page, span_id, CASE verdict WHEN 'reject' THEN 0 ELSE 2 END AS queue_rank FROM sp WHERE k % 3 <> 0 AND k % 5 <> 0")
def review_queue(spark, sf):
    s = _queue_spans(spark, sf)
    return X.review_queue(s, s.where("k % 3 = 0"), s.where("k % 5 = 0")).select("note_id", "page", "span_id", "queue_rank")


@query("filter_spans", f"{_GRAM_SPANS} SELECT note_id, page, span_id, k % 3 = 0 AS corrected FROM sp")
def filter_spans(spark, sf):
    s = _queue_spans(spark, sf)
    d = s.where("k % 3 = 0")
    yes = X.filter_spans(s, d, "corrected").withColumn("corrected", F.lit(True))
    return yes.unionByName(X.filter_spans(s, d, "uncorrected").withColumn("corrected", F.lit(False))).select("note_id", "page", "span_id", "corrected")


#: Rounds of doubling in the SQL: chains of up to 2 ** 17 items.
_ROUNDS = 17
_PAINT = (
    f"{SPANS_SQL}, {_KG}, {_SCAN_TEXT}, "
    "both_ AS (SELECT note_id, begun AS st, begun + length(s) AS en, 0 AS t, 's' || begun AS id FROM every UNION ALL "
    "SELECT lh.note_id, line_start + pos, line_start + pos + 1, 1, 'particle_' || ch || '_' || CAST(line_start + pos AS INTEGER) FROM lh JOIN lines ON lines.note_id = lh.note_id AND lines.page = lh.page AND lines.line_no = lh.line_no WHERE hit), "
    "item AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY st, t, en, id) AS k FROM both_), at_ AS (SELECT note_id, st, min(k) AS k FROM item GROUP BY ALL), "
    "j0 AS (SELECT i.note_id, i.k, a.k AS n FROM item i ASOF JOIN at_ a ON i.note_id = a.note_id AND i.en <= a.st), m0 AS (SELECT DISTINCT note_id, CAST(1 AS BIGINT) AS k FROM item), "
    + ", ".join(
        f"m{r + 1} AS (SELECT * FROM m{r} UNION SELECT m.note_id, j.n FROM m{r} m JOIN j{r} j ON j.note_id = m.note_id AND j.k = m.k), "
        f"j{r + 1} AS (SELECT a.note_id, a.k, b.n FROM j{r} a JOIN j{r} b ON a.note_id = b.note_id AND a.n = b.k)"
        for r in range(_ROUNDS)
    )
)


@query("paint_order", f"{_PAINT} SELECT i.note_id, CAST(1 AS INTEGER) AS page, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS \"end\", CASE t WHEN 0 THEN 'analyzed' ELSE 'particle' END AS kind, id FROM item i JOIN m{_ROUNDS} m ON m.note_id = i.note_id AND m.k = i.k")
def paint_order(spark, sf):
    """Greedy choice along each page among all detected spans and all particle hits."""
    found = located_spans(spark, sf).withColumn("span_id", F.concat(F.lit("s"), F.col("start").cast("string")))
    return X.paint_order(found, PT.particle_scan(kana_grammar(spark, sf), None, "text"))


# --- governance ---------------------------------------------------------------------------
@query(
    "approval_fold",
    f"WITH {I.SQL['register_events']}, b AS (SELECT file, term, min((ts, seq)) AS born FROM register_events WHERE op = 'register' GROUP BY ALL), live AS (SELECT e.*, row_number() OVER (PARTITION BY file, term ORDER BY ts, seq) AS k FROM register_events e JOIN b USING (file, term) WHERE (ts, seq) >= born), "
    # the form in force before each event: the last update, else the first registration
    "n AS (SELECT *, CASE WHEN op = 'update' OR k = 1 THEN normalized END AS cur FROM live), p AS (SELECT *, last_value(cur IGNORE NULLS) OVER (PARTITION BY file, term ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM n), "
    "r AS (SELECT file, term, max(k) AS last_reset FROM p WHERE k = 1 OR (op = 'update' AND normalized <> prev) GROUP BY ALL), "
    "c AS (SELECT l.file, l.term, count(*) FILTER (WHERE op = 'register' AND k > last_reset) AS approval_count, arg_max(CASE op WHEN 'register' THEN true ELSE enabled END, k) FILTER (WHERE op IN ('register', 'toggle')) AS enabled, arg_max(cur, k) FILTER (WHERE cur IS NOT NULL) AS normalized, "
    "min(ts) AS registered_at, max(ts) FILTER (WHERE op <> 'toggle') AS last_seen_at FROM n l JOIN r USING (file, term) GROUP BY ALL) "
    "SELECT file, term, normalized, enabled, CAST(approval_count AS INTEGER) AS approval_count, epoch_us(registered_at) AS registered_us, epoch_us(last_seen_at) AS last_seen_us, enabled AND approval_count >= 3 AS is_promotion_candidate FROM c",
)
def approval_fold(spark, sf):
    a = G.approval_fold(I.register_events(spark, sf))
    return a.withColumn("registered_us", F.unix_micros(F.col("registered_at").cast("timestamp"))).withColumn("last_seen_us", F.unix_micros(F.col("last_seen_at").cast("timestamp"))).drop("registered_at", "last_seen_at")


@query(
    "stale_terms",
    "SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-07-15 00:00:00') >= 180 * 86400 AND epoch_us(TIMESTAMP '2024-07-15 00:00:00') - epoch_us(ts) >= 180 * 86400000000 AS stale FROM events",
)
def stale_terms(spark, sf):
    e = I.table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return e.select("event_id", G.is_stale(iso, F.lit("2024-07-15 00:00:00").cast("timestamp")).alias("stale"))


# --- evaluation -----------------------------------------------------------------------------
_EV = (
    "ev AS (SELECT CASE event_type WHEN 'view' THEN '愛知' WHEN 'click' THEN '大阪' WHEN 'error' THEN '' ELSE NULL END AS region, (event_id % 3) / 2.0::DOUBLE AS region_multiplier, event_id % 4 = 0 AS rank1_is_proper_noun, event_id FROM events)"
)


def _events(spark, sf):
    e = I.table(spark, sf, "events")
    r = F.when(F.col("event_type") == "view", "愛知").when(F.col("event_type") == "click", "大阪").when(F.col("event_type") == "error", "")
    return e.select(r.alias("region"), ((F.col("event_id") % 3) / 2.0).alias("region_multiplier"), (F.col("event_id") % 4 == 0).alias("rank1_is_proper_noun"), "event_id")


@query(
    "eval_summary",
    f"WITH {_EV} SELECT r AS region, count(*) AS events, count(*) FILTER (WHERE rank1_is_proper_noun) AS rank1_proper_noun, count(*) FILTER (WHERE NOT rank1_is_proper_noun) AS rank1_other, count(*) FILTER (WHERE region_multiplier = 0) AS multiplier_zero FROM (SELECT *, coalesce(region, '(none)') AS r FROM ev) GROUP BY ROLLUP (r)",
)
def eval_summary(spark, sf):
    return MT.eval_summary(_events(spark, sf))


@query("multiplier_check", f"WITH {_EV} SELECT event_id, CASE WHEN rank1_is_proper_noun THEN 'WARNING' ELSE 'ok' END AS flag FROM ev WHERE region_multiplier = 0")
def multiplier_check(spark, sf):
    return MT.multiplier_check(_events(spark, sf)).select("event_id", "flag")


@query(
    "misfires",
    f"WITH {I.ctes('kana', 'words')} SELECT note_id, suspect_span, suspect_span || (['国', '県', '村'])[length(suspect_span) % 3 + 1] AS rank1 FROM words WHERE length(suspect_span) % 3 <> 2",
)
def misfires(spark, sf):
    suffix = F.element_at(F.array(F.lit("国"), F.lit("県"), F.lit("村")), (F.char_length("suspect_span") % 3 + 1).cast("int"))
    s = I.words(spark, sf).withColumn("candidates", F.array(F.concat("suspect_span", suffix)))
    return MT.misfires(s).select("note_id", "suspect_span", "rank1")
