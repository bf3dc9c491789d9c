"""Detectors, particles, lines, cleanup and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold import constants as K
from inkfold.functions import text as T
from inkfold.functions.rows import unfolded
from inkfold.operators import detectors as D
from inkfold.operators import lines as L
from inkfold.operators import matching as M
from inkfold.operators import pages as P
from inkfold.operators import particles as PT

from . import inputs as I
from .registry import query

NLS = "chr(10)"
CUT = "[。（(「」）)]"


def _extract(src, pattern, group=0):
    return (
        f"SELECT note_id, page, unnest(m) AS suspect_span, CAST(unnest(range(0, len(m))) AS INTEGER) AS seq "
        f"FROM (SELECT note_id, page, regexp_extract_all(text, '{pattern}', {group}) AS m FROM {src})"
    )


@query("symbol_runs", f"WITH {I.ctes('grammar')}, x AS ({_extract('grammar', K.SYMBOL_RUN)}) SELECT *, 0.5::DOUBLE AS confidence, 'noise' AS category FROM x")
def symbol_runs(spark, sf):
    return D.symbol_runs(I.grammar(spark, sf), "text").select("note_id", "page", "seq", "suspect_span", "confidence", "category")


@query("isolated_alnum", f"WITH {I.ctes('grammar')}, x AS ({_extract('grammar', K.ISOLATED_ALNUM, 2)}) SELECT *, 0.4::DOUBLE AS confidence FROM x")
def isolated_alnum(spark, sf):
    return D.isolated_alnum(I.grammar(spark, sf), "text").select("note_id", "page", "seq", "suspect_span", "confidence")


_LOW = (
    "length(replace(line, ' ', '')) >= 25 AND "
    "len(list_distinct(string_split(replace(line, ' ', ''), ''))) / CAST(length(replace(line, ' ', '')) AS DOUBLE) < 0.12"
)


@query("low_diversity_lines", f"WITH {I.ctes('grammar')}, {I.lines_cte('grammar')} SELECT note_id, page, trim(line) AS suspect_span, 0.85::DOUBLE AS confidence FROM lines WHERE {_LOW}")
def low_diversity_lines(spark, sf):
    return D.low_diversity_lines(I.grammar(spark, sf), "text").select("note_id", "page", "suspect_span", "confidence")


@query(
    "digit_noise",
    f"WITH {I.ctes('grammar')}, {I.lines_cte('grammar')} SELECT note_id, page, unnest(regexp_extract_all(line, '{K.DIGIT_NOISE}', 0)) AS suspect_span FROM lines WHERE NOT ({_LOW})",
)
def digit_noise(spark, sf):
    return D.digit_noise(I.grammar(spark, sf), "text").select("note_id", "page", "suspect_span")


_RULES = "rules(form, verdict, score, audit, suggestion) AS (VALUES " + ", ".join(
    f"('{f}', '{v}', {s}::DOUBLE, {str(a).lower()}, {'NULL' if g is None else repr(g)})" for f, v, s, _, a, g, _, _ in K.GRAMMAR_RULES
) + ")"


@query(
    "grammar_scan",
    f"WITH {I.ctes('grammar')}, {_RULES}, x AS (SELECT note_id, page, unnest(list_distinct(regexp_extract_all(text, '{K.GRAMMAR_SCAN}', 0))) AS suspect_span FROM grammar) "
    "SELECT note_id, page, suspect_span, verdict, score, audit, suggestion FROM x JOIN rules ON form = suspect_span",
)
def grammar_scan(spark, sf):
    return D.grammar_scan(I.grammar(spark, sf), "text").select(
        "note_id", "page", "suspect_span", "verdict.verdict", "verdict.score",
        F.col("verdict.image_audit_required").alias("audit"), F.col("verdict.suggestion.suggested_candidate").alias("suggestion"),
    )


@query(
    "validate_span",
    f"WITH {I.ctes('grammar')}, {I.lines_cte('grammar')}, x AS (SELECT note_id, line_no, line, ((note_id * 7 + line_no * 13) % 100) / 100.0::DOUBLE AS confidence FROM lines) "
    "SELECT note_id, line_no, CASE " + " ".join(f"WHEN contains(line, '{r[0]}') THEN '{r[1]}'" for r in K.GRAMMAR_RULES)
    + " WHEN confidence >= 0.75 THEN 'accept' WHEN confidence >= 0.45 THEN 'review' ELSE 'reject' END AS verdict, CASE "
    + " ".join(f"WHEN contains(line, '{r[0]}') THEN {r[2]}::DOUBLE" for r in K.GRAMMAR_RULES) + " ELSE confidence END AS score FROM x",
)
def validate_span(spark, sf):
    lines = P.line_table(I.grammar(spark, sf), "text")
    conf = ((F.col("note_id") * 7 + F.col("line_no") * 13) % 100) / 100.0
    v = D.validate_span(F.col("line"), conf)
    return lines.select("note_id", "line_no", v.alias("v")).select("note_id", "line_no", "v.verdict", "v.score")


_N = "length(text)"


def _count(p):
    return f"len(regexp_extract_all(text, '{p}', 0))"


_MODERN = K.MODERN_MARKS.replace("\n", "\\n")
_DOCTYPE_CTE = (
    f"m AS (SELECT note_id, page, {_N} AS n, {_count('[ァ-ヿ゠]')} AS kata, {_count('[ぁ-ゟ]')} AS hira, {_count(K.CLASSICAL_MARKS)} AS cl, {_count(_MODERN)} AS mo FROM src), "
    "r AS (SELECT note_id, page, n, kata / n::DOUBLE AS kr, CASE WHEN kata + hira > 0 THEN kata / (kata + hira)::DOUBLE ELSE 0.5 END AS kk, "
    "cl / greatest(n / 100.0::DOUBLE, 1.0::DOUBLE) AS cd, mo / greatest(n / 100.0::DOUBLE, 1.0::DOUBLE) AS md FROM m), "
    "s AS (SELECT note_id, page, n, (CASE WHEN kr > 0.20 THEN 2.0 WHEN kr > 0.10 THEN 1.0 ELSE 0 END + CASE WHEN kk > 0.85 THEN 2.0 WHEN kk > 0.60 THEN 1.0 ELSE 0 END "
    "+ CASE WHEN cd > 0.5 THEN 1.5 WHEN cd > 0.1 THEN 0.5 ELSE 0 END - CASE WHEN md > 0.1 THEN 3.0 WHEN md > 0.01 THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM r), "
    "doc_types AS (SELECT note_id, page, CASE WHEN n < 100 THEN 'unknown' WHEN score >= 2.5 THEN 'classical' WHEN score <= -2.0 THEN 'modern' ELSE 'unknown' END AS doc_type, "
    "CASE WHEN n < 100 THEN 0.0 WHEN score >= 2.5 THEN round(least(1.0, score / 5.5), 2) WHEN score <= -2.0 THEN round(least(1.0, abs(score) / 5.0), 2) ELSE 0.3 END::DOUBLE AS doc_type_confidence, "
    "CASE WHEN n < 100 THEN 'insufficient_text' ELSE 'heuristic' END AS doc_type_source FROM s)"
)


def _typed(src):
    return f"src AS (SELECT * FROM {src}), {_DOCTYPE_CTE}"


@query("doc_type", f"WITH {I.ctes('katakana')}, {_typed('katakana')} SELECT * FROM doc_types")
def doc_type(spark, sf):
    return D.doc_type(I.katakana(spark, sf), None, "text").select("note_id", "page", "doc_type", "doc_type_confidence", "doc_type_source")


@query(
    "effective_doc_type",
    f"WITH {I.ctes('talk_katakana')}, {_typed('talk')}, n AS (SELECT note_id, CASE WHEN bool_or(doc_type = 'classical') THEN 'classical' ELSE arg_min(doc_type, page) FILTER (WHERE doc_type <> 'unknown') END AS nt FROM doc_types GROUP BY 1) "
    "SELECT note_id, page, doc_type, CASE WHEN doc_type <> 'unknown' THEN doc_type ELSE coalesce(nt, 'unknown') END AS effective_type FROM doc_types JOIN n USING (note_id)",
)
def effective_doc_type(spark, sf):
    return D.effective_doc_type(D.doc_type(I.talk(spark, sf, I.KATAKANA), None, "text"))


# --- particles ---------------------------------------------------------------------
def _style(src):
    """Style of each note from its lines."""
    trio = lambda cs: "(" + " OR ".join(f"ch = '{c}'" for c in cs) + ")"
    kata, hira = PT.KATA_PARTICLES, PT.HIRA_PARTICLES
    near = f"{I.is_kk('after')} AND CASE WHEN ch IN ('ノ', 'の') THEN coalesce(regexp_full_match(before, '[一-龠々]'), false) ELSE {I.is_kk('before')} END"
    return (
        f"{I.lines_cte(src)}, kept AS (SELECT note_id, page * 100000 + line_no AS page, line AS text FROM lines WHERE NOT regexp_matches(line, '{CUT}')), {I.chars_cte('kept', 'sc')}, "
        f"counted AS (SELECT note_id, count(*) FILTER (WHERE {trio(kata)} AND {near}) AS k, count(*) FILTER (WHERE {trio(hira)} AND {near}) AS h FROM sc GROUP BY note_id), "
        f"style AS (SELECT note_id, coalesce(k, 0) AS kata_particle_count, coalesce(h, 0) AS hira_particle_count, CASE WHEN coalesce(k + h, 0) < 10 THEN 'insufficient' WHEN k / (k + h)::DOUBLE >= 0.70 THEN 'katakana_dominant' "
        f"WHEN k / (k + h)::DOUBLE <= 1.0::DOUBLE - 0.70::DOUBLE THEN 'hiragana_dominant' ELSE 'mixed' END AS particle_script FROM (SELECT DISTINCT note_id FROM {src}) LEFT JOIN counted USING (note_id))"
    )


@query("particle_style", f"WITH {I.ctes('talk')}, {_style('talk')} SELECT * FROM style")
def particle_style(spark, sf):
    return PT.style_profile(I.talk(spark, sf), "text").select("note_id", "kata_particle_count", "hira_particle_count", "particle_script")


@query("particle_style_documents", f"WITH {I.ctes('katakana')}, {_style('katakana')} SELECT * FROM style")
def particle_style_documents(spark, sf):
    return PT.style_profile(I.katakana(spark, sf), "text").select("note_id", "kata_particle_count", "hira_particle_count", "particle_script")


_HIT = f"ch IN ('に', 'を', 'は') AND {I.is_kk('before')} AND {I.is_kk('after')}"


@query(
    "particle_hits",
    f"WITH {I.ctes('kana')}, {I.chars_cte('kana')} SELECT note_id, page, pos AS start, CAST(pos + 1 AS INTEGER) AS \"end\", ch AS hira, translate(ch, 'にをは', 'ニヲハ') AS kata FROM chars WHERE {_HIT}",
)
def particle_hits(spark, sf):
    return PT.particle_hits(I.kana(spark, sf), None, "text").select("note_id", "page", "start", "end", "hira", "kata")


@query(
    "particle_count",
    f"WITH {I.ctes('kana')}, {_typed('kana')}, cl AS (SELECT kana.* FROM kana JOIN doc_types USING (note_id, page) WHERE doc_type = 'classical'), {I.chars_cte('cl')} "
    f"SELECT note_id, page, count(*) AS particle_count FROM chars WHERE {_HIT} GROUP BY ALL",
)
def particle_count(spark, sf):
    k = I.kana(spark, sf)
    return PT.particle_count(PT.particle_hits(k, D.doc_type(k, None, "text"), "text"))


@query(
    "particle_samples",
    f"WITH {I.ctes('kana')}, {I.chars_cte('kana')}, h AS (SELECT c.note_id, c.page, c.pos, c.ch AS hira, substr(text, greatest(c.pos - 4, 0) + 1, least(4, c.pos)) || '【' || c.ch || '】' || substr(text, c.pos + 2, 4) AS sample, "
    f"row_number() OVER (PARTITION BY c.note_id, c.page, c.ch ORDER BY c.pos) AS rn FROM chars c JOIN kana k ON k.note_id = c.note_id WHERE {_HIT.replace('ch IN', 'c.ch IN')}) "
    "SELECT note_id, page, hira, count(*) AS count, string_agg(sample, '|' ORDER BY pos) FILTER (WHERE rn <= 3) AS samples FROM h GROUP BY ALL",
)
def particle_samples(spark, sf):
    s = PT.particle_samples(PT.particle_hits(I.kana(spark, sf), None, "text"))
    return s.select("note_id", "page", "hira", "count", F.array_join("samples", "|").alias("samples"))


def _any(kind):
    return "|".join(r[2] for r in K.LINE_RULES if r[4] == kind)


_STATUS = f"CASE WHEN regexp_matches(line, '{_any('include')}') THEN 'include' WHEN regexp_matches(line, '{_any('exclude')}') THEN 'exclude' ELSE 'neutral' END"
_SCAN_TEXT = (
    f"{I.lines_cte('kg')}, st AS (SELECT *, {_STATUS} AS status FROM lines), open_lines AS (SELECT note_id, page * 100000 + line_no AS page, line AS text, status FROM st), "
    f"{I.chars_cte('open_lines', 'lc')}, lh AS (SELECT lc.note_id, lc.page // 100000 AS page, lc.page % 100000 AS line_no, lc.pos, lc.ch, status <> 'exclude' AND {_HIT} AS hit FROM lc JOIN open_lines o ON o.note_id = lc.note_id AND o.page = lc.page)"
)
# a text with all three line kinds: the kana text followed by the grammar text
_KG = "kg AS (SELECT k.note_id, k.page, k.text || chr(10) || g.text AS text FROM kana k JOIN grammar g ON g.note_id = k.note_id)"


def kana_grammar(spark, sf):
    g = I.grammar(spark, sf)
    t = I.table(spark, sf, "documents")
    k = F.translate(F.lower("text"), I.LETTERS, I.KANA)
    src = t.select(F.col("doc_id").alias("note_id"), k.alias("_k"))
    return g.join(src, "note_id").select("note_id", "page", F.concat("_k", F.lit("\n"), "text").alias("text"))


@query(
    "particle_scan",
    f"WITH {I.ctes('kana', 'grammar')}, {_KG}, {_SCAN_TEXT} SELECT lh.note_id, CAST(lh.page AS INTEGER) AS page, CAST(line_start + pos AS INTEGER) AS start, ch AS hira, 'particle_' || ch || '_' || CAST(line_start + pos AS INTEGER) AS id "
    "FROM lh JOIN lines ON lines.note_id = lh.note_id AND lines.page = lh.page AND lines.line_no = lh.line_no WHERE hit",
)
def particle_scan(spark, sf):
    return PT.particle_scan(kana_grammar(spark, sf), None, "text").select("note_id", "page", "start", "hira", "id")


@query(
    "particle_apply",
    f"WITH {I.ctes('kana', 'grammar')}, {_KG}, {_SCAN_TEXT}, done AS (SELECT note_id, page, line_no, string_agg(CASE WHEN hit THEN translate(ch, 'にをは', 'ニヲハ') ELSE ch END, '' ORDER BY pos) AS line FROM lh GROUP BY ALL) "
    "SELECT l.note_id, l.page, string_agg(coalesce(d.line, ''), chr(10) ORDER BY l.line_no) AS new_text FROM lines l LEFT JOIN done d ON d.note_id = l.note_id AND d.page = l.page AND d.line_no = l.line_no GROUP BY ALL",
)
def particle_apply(spark, sf):
    return PT.particle_apply(kana_grammar(spark, sf), None, "text").select("note_id", "page", "new_text")


def _near(n):
    """Distinct hiragana runs touching kanji or katakana, in documents with katakana particles."""
    return f"WITH {I.ctes('katakana')}, {_style('katakana')}, {I.chars_cte('katakana')}"


@query(
    "isolated_hiragana",
    _near(1) + f" SELECT DISTINCT c.note_id, c.page, ch AS suspect_span, chr(ascii(ch) + 96) AS forced FROM chars c JOIN style s ON s.note_id = c.note_id WHERE particle_script = 'katakana_dominant' "
    f"AND regexp_full_match(ch, '[ぁ-ん]') AND ({I.is_kk('before')} OR {I.is_kk('after')})",
)
def isolated_hiragana(spark, sf):
    k = I.katakana(spark, sf)
    return D.isolated_hiragana(k, PT.style_profile(k, "text"), "text").select("note_id", "page", "suspect_span", "forced")


# the match consumes text, so pairs are taken greedily: no look-around in the oracle's regex engine,
# hence runs of hiragana are walked by a recursive query over their start positions
@query(
    "hiragana_bigrams",
    _near(2) + f", p AS (SELECT note_id, page, pos, ch, before, after, lead(after) OVER (PARTITION BY note_id, page ORDER BY pos) AS after2 FROM chars), "
    f"q AS (SELECT p.note_id, p.page, pos, ch || after AS pair FROM p JOIN style s ON s.note_id = p.note_id WHERE particle_script = 'katakana_dominant' AND regexp_full_match(ch, '[ぁ-ん]') "
    f"AND coalesce(regexp_full_match(after, '[ぁ-ん]'), false) AND ({I.is_kk('before')} OR {I.is_kk('after2')})), "
    # a pair is lost only when the pair starting one letter earlier was taken
    "runs AS (SELECT *, pos - row_number() OVER (PARTITION BY note_id, page ORDER BY pos) AS run FROM q), "
    "taken AS (SELECT *, row_number() OVER (PARTITION BY note_id, page, run ORDER BY pos) AS k FROM runs) "
    "SELECT DISTINCT note_id, page, pair AS suspect_span FROM taken WHERE k % 2 = 1",
)
def hiragana_bigrams(spark, sf):
    k = I.katakana(spark, sf)
    return D.hiragana_bigrams(k, PT.style_profile(k, "text"), "text").select("note_id", "page", "suspect_span")


@query(
    "mismatched_particles",
    f"WITH {I.ctes('katakana')}, {_style('katakana')}, {I.chars_cte('katakana')}, ok AS (SELECT l.note_id, l.line_start AS a, l.line_start + length(line) AS b FROM lines l WHERE NOT regexp_matches(line, '{CUT}')) "
    f"SELECT c.note_id, c.page, c.pos AS start, ch AS hira FROM chars c JOIN style s ON s.note_id = c.note_id JOIN ok ON ok.note_id = c.note_id AND c.pos >= a AND c.pos < b WHERE particle_script = 'katakana_dominant' "
    f"AND ch IN ('は', 'に', 'を', 'の', 'と', 'へ', 'て') AND {I.is_kk('after')} AND CASE WHEN ch = 'の' THEN coalesce(regexp_full_match(before, '[一-龠々]'), false) ELSE {I.is_kk('before')} END",
)
def mismatched_particles(spark, sf):
    k = I.katakana(spark, sf)
    return PT.mismatched_particles(k, PT.style_profile(k, "text"), "text").select("note_id", "page", "start", "hira")


# --- kana ------------------------------------------------------------------------------
@query(
    "kana_ratio",
    f"WITH {I.ctes('talk')}, s AS (SELECT note_id, sum({_count('[ぁ-ん]')})::BIGINT AS hira, sum({_count('[ァ-ヶ]')})::BIGINT AS kata FROM talk GROUP BY 1) SELECT *, CASE WHEN hira + kata > 0 THEN kata / (hira + kata)::DOUBLE END AS kana_ratio, "
    "coalesce(kata / nullif(hira + kata, 0)::DOUBLE >= 0.85, false) AS bulk FROM s",
)
def kana_ratio(spark, sf):
    return PT.kana_ratio(I.talk(spark, sf), "text").withColumn("bulk", PT.bulk_katakana_eligible(F.col("kana_ratio")))


@query(
    "kana_frequency",
    f"WITH {I.ctes('talk')} SELECT note_id, page, hira, count(*) AS count, chr(ascii(hira) + 96) AS kata FROM (SELECT note_id, page, unnest(regexp_extract_all(text, '[ぁ-ゖ]', 0)) AS hira FROM talk) GROUP BY ALL",
)
def kana_frequency(spark, sf):
    return PT.kana_frequency(I.talk(spark, sf), column="text")


@query(
    "hiragana_apply",
    f"WITH {I.ctes('kana')} SELECT note_id, page, translate(text, '{T.HIRAGANA_TEXT_LETTERS}', '{T.KATAKANA_TEXT_LETTERS}') AS new_text, CAST({_count('[ぁ-ん]')} AS INTEGER) AS converted FROM kana",
)
def hiragana_apply(spark, sf):
    return PT.hiragana_apply(I.kana(spark, sf), "text").select("note_id", "page", "new_text", "converted")


# --- lines -------------------------------------------------------------------------------
@query("line_table", f"WITH {I.ctes('kana')}, {I.lines_cte('kana')} SELECT * FROM lines")
def line_table(spark, sf):
    return P.line_table(I.kana(spark, sf), "text")


_RULE_VALUES = "line_rules(id, description, pattern, priority, kind, ord) AS (VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}, '{r[4]}', {i})" for i, r in enumerate(K.LINE_RULES)
) + ")"
_MATCHED = "m AS (SELECT l.note_id, l.page, l.line_no, r.* FROM lines l JOIN line_rules r ON regexp_matches(l.line, r.pattern))"


@query(
    "classify_lines",
    f"WITH {I.ctes('grammar')}, {I.lines_cte('grammar')}, {_RULE_VALUES}, {_MATCHED}, a AS (SELECT note_id, page, line_no, string_agg(id, ',' ORDER BY ord) FILTER (WHERE kind = 'include') AS inc, string_agg(id, ',' ORDER BY ord) FILTER (WHERE kind = 'exclude') AS exc FROM m GROUP BY ALL) "
    f"SELECT l.note_id, l.page, l.line_no, {_STATUS} AS status, coalesce(inc, '') AS matched_include, coalesce(exc, '') AS matched_exclude FROM lines l LEFT JOIN a USING (note_id, page, line_no)",
)
def classify_lines(spark, sf):
    c = L.classify_lines(P.line_table(I.grammar(spark, sf), "text"))
    return c.select("note_id", "page", "line_no", "status", F.array_join("matched_include", ",").alias("matched_include"), F.array_join("matched_exclude", ",").alias("matched_exclude"))


@query(
    "line_stats",
    f"WITH {I.ctes('grammar')}, {I.lines_cte('grammar')}, {_RULE_VALUES}, {_MATCHED}, st AS (SELECT *, {_STATUS} AS status FROM lines), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY note_id, page, line_no ORDER BY priority DESC, ord) AS k FROM m WHERE kind = 'exclude'), "
    "why AS (SELECT note_id, page, line_no, string_agg(description, '/' ORDER BY k) AS w FROM top WHERE k <= 2 GROUP BY ALL), "
    "ex AS (SELECT st.*, w, row_number() OVER (PARTITION BY st.note_id, st.page ORDER BY st.line_no) AS k FROM st JOIN why USING (note_id, page, line_no) WHERE status = 'exclude'), "
    "sm AS (SELECT note_id, page, string_agg(CASE WHEN length(line) > 22 THEN substr(line, 1, 22) || '…' ELSE line END || '=' || w, ';' ORDER BY line_no) AS samples FROM ex WHERE k <= 5 GROUP BY ALL) "
    "SELECT note_id, page, count(*) AS total, count(*) FILTER (WHERE status = 'include') AS included, count(*) FILTER (WHERE status = 'exclude') AS excluded, count(*) FILTER (WHERE status = 'neutral') AS neutral, coalesce(any_value(samples), '') AS samples FROM st LEFT JOIN sm USING (note_id, page) GROUP BY note_id, page",
)
def line_stats(spark, sf):
    s = L.line_stats(P.line_table(I.grammar(spark, sf), "text"))
    sample = F.transform("excluded_samples", lambda x: F.concat(x["line_preview"], F.lit("="), F.array_join(x["rules"], "/")))
    return s.select("note_id", "page", "total", "included", "excluded", "neutral", F.array_join(sample, ";").alias("samples"))


# --- cleanup --------------------------------------------------------------------------------
_CLEAN_MATCHES = " UNION ALL ".join(
    f"SELECT note_id, page, '{r}' AS rule, regexp_extract_all(text, '{p}', 0) AS m FROM grammar" for r, _, p in K.CLEANUP_RULES
)


@query(
    "cleanup_counts",
    f"WITH {I.ctes('grammar')}, c AS ({_CLEAN_MATCHES}), t AS (SELECT note_id, page, sum(len(m)) AS total FROM c GROUP BY ALL) SELECT note_id, page, rule, CAST(len(m) AS INTEGER) AS count, array_to_string(m[1:3], '|') AS examples, CAST(total AS INTEGER) AS total FROM c JOIN t USING (note_id, page) WHERE len(m) > 0",
)
def cleanup_counts(spark, sf):
    return L.cleanup_counts(I.grammar(spark, sf), "text").select("note_id", "page", "rule", "count", F.array_join("examples", "|").alias("examples"), "total")


def _cleaned(col="text"):
    for _, _, p in K.CLEANUP_RULES:
        col = f"regexp_replace({col}, '{p}', '', 'g')"
    return col


@query("cleanup_apply", f"WITH {I.ctes('grammar')} SELECT note_id, page, {_cleaned()} AS new_text FROM grammar")
def cleanup_apply(spark, sf):
    return L.cleanup_apply(I.grammar(spark, sf), "text").select("note_id", "page", "new_text")


@query(
    "cleanup_log",
    f"WITH {I.ctes('grammar')}, c AS ({_CLEAN_MATCHES}), u AS (SELECT note_id, page, rule, unnest(m) AS suspect_span, CAST(unnest(range(0, len(m))) AS INTEGER) AS occurrence_index FROM c) SELECT *, 'cleanup_p' || page || '_' || rule || '_' || occurrence_index AS span_id FROM u",
)
def cleanup_log(spark, sf):
    return L.cleanup_log(I.grammar(spark, sf), "text").select("note_id", "page", F.col("cleanup_rule").alias("rule"), "suspect_span", "occurrence_index", "span_id")


# --- scalar functions over all words -----------------------------------------------------------
_KANJI = K.KANJI_BY_NAME.replace("\\\\", "\\")
_KANAC = K.KANA_BY_NAME


@query(
    "dominant_script",
    f"WITH {I.ctes('kana', 'words')}, w AS (SELECT DISTINCT suspect_span AS word FROM words), c AS (SELECT word, len(regexp_extract_all(word, '[{_KANJI}]', 0)) AS kj, len(regexp_extract_all(word, '[{_KANAC}]', 0)) AS kn FROM w) "
    "SELECT word, CASE WHEN regexp_full_match(word, '[\\x00-\\x7F]+') THEN 'ascii' WHEN kj + kn = 0 THEN 'mixed' WHEN kj / (kj + kn)::DOUBLE >= 0.8 THEN 'kanji' WHEN kn / (kj + kn)::DOUBLE >= 0.8 THEN 'kana' ELSE 'mixed' END AS script FROM c",
)
def dominant_script(spark, sf):
    w = I.words(spark, sf).select(F.col("suspect_span").alias("word")).distinct()
    return w.select("word", T.dominant_script(F.col("word")).alias("script"))


@query(
    "noise_tokens",
    "WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) SELECT word, length(word) < 2 OR length(word) > 20 OR regexp_matches(word, 'https?://') OR regexp_matches(word, '^\\d+$') "
    "OR regexp_matches(word, '^\\d{4}([-/]\\d{1,2}){0,2}$') OR regexp_matches(word, '^[A-Za-z0-9_\\-]+$') AS noise FROM w",
)
def noise_tokens(spark, sf):
    w = unfolded(I.table(spark, sf, "documents"), [], F.split("text", "[ \n]+", -1), "word").select("word").distinct()
    return w.select("word", T.is_noise_token(F.col("word")).alias("noise"))


@query(
    "kana_label",
    f"WITH {I.ctes('kana', 'words')}, w AS (SELECT DISTINCT suspect_span AS word FROM words), c AS (SELECT word, regexp_matches(word, '[ぁ-ゖ]') AS h, regexp_matches(word, '[ァ-ヶ]') AS k FROM w) SELECT word, CASE WHEN h AND NOT k THEN 'ひらがな' WHEN k AND NOT h THEN 'カタカナ' END AS label FROM c",
)
def kana_label(spark, sf):
    return I.words(spark, sf).select(F.col("suspect_span").alias("word")).distinct().select("word", T.kana_label(F.col("word")).alias("label"))


# --- positions ---------------------------------------------------------------------------------
def detected(spark, sf):
    g = I.grammar(spark, sf)
    cols = ("note_id", "page", "suspect_span")
    return D.symbol_runs(g, "text").select(*cols).unionByName(D.grammar_scan(g, "text").select(*cols)).distinct()


_SPANS = (
    f"spans AS (SELECT DISTINCT note_id, page, unnest(regexp_extract_all(text, '{K.SYMBOL_RUN}', 0)) AS s FROM grammar UNION SELECT note_id, page, unnest(regexp_extract_all(text, '{K.GRAMMAR_SCAN}', 0)) FROM grammar)"
)
_OCC = (
    f"{_SPANS}, greedy AS (SELECT spans.note_id, s, instr(text, s) AS pos FROM spans JOIN grammar USING (note_id) UNION ALL "
    "SELECT g.note_id, g.s, g.pos + length(g.s) - 1 + instr(substr(text, g.pos + length(g.s)), g.s) FROM greedy g JOIN grammar t ON t.note_id = g.note_id WHERE instr(substr(text, g.pos + length(g.s)), g.s) > 0), "
    "longest AS (SELECT note_id, pos, max(length(s)) AS n FROM greedy GROUP BY ALL), "
    "scan AS (SELECT p.note_id, p.s, p.pos, coalesce(l.n, 0) > length(p.s) AS hidden FROM (SELECT spans.note_id, s, instr(text, s) AS pos FROM spans JOIN grammar USING (note_id)) p LEFT JOIN longest l ON l.note_id = p.note_id AND l.pos = p.pos UNION ALL "
    "SELECT p.note_id, p.s, p.pos, coalesce(l.n, 0) > length(p.s) FROM (SELECT c.note_id, c.s, c.frm - 1 + instr(substr(t.text, c.frm), c.s) AS pos FROM (SELECT note_id, s, CASE WHEN hidden THEN pos + 1 ELSE pos + length(s) END AS frm FROM scan) c "
    "JOIN grammar t ON t.note_id = c.note_id WHERE instr(substr(t.text, c.frm), c.s) > 0) p LEFT JOIN longest l ON l.note_id = p.note_id AND l.pos = p.pos)"
)


@query(
    "occurrences",
    f"WITH RECURSIVE {I.ctes('grammar')}, {_OCC} SELECT note_id, 1 AS page, s AS suspect_span, CAST(pos - 1 AS INTEGER) AS start, CAST(pos - 1 + length(s) AS INTEGER) AS \"end\", "
    "CAST(row_number() OVER (PARTITION BY note_id, s ORDER BY pos) - 1 AS INTEGER) AS occurrence_index FROM scan WHERE NOT hidden",
)
def occurrences(spark, sf):
    return M.occurrences(detected(spark, sf), I.grammar(spark, sf), "text").select("note_id", "page", "suspect_span", "start", "end", "occurrence_index")


@query(
    "drop_bigram_covered",
    f"WITH {I.ctes('kana')}, {I.chars_cte('kana')}, b AS (SELECT note_id, page, pos FROM chars WHERE ch || after = 'にノ') SELECT note_id, page, pos AS start, ch AS suspect_span FROM chars c WHERE ch IN ('に', 'ノ') "
    "AND NOT EXISTS (SELECT 1 FROM b WHERE b.note_id = c.note_id AND b.page = c.page AND (b.pos = c.pos OR b.pos + 1 = c.pos))",
)
def drop_bigram_covered(spark, sf):
    k = I.kana(spark, sf)
    one = k.select("note_id", "page", F.explode(F.array(F.lit("に"), F.lit("ノ"))).alias("suspect_span"))
    two = k.select("note_id", "page", F.lit("にノ").alias("suspect_span"))
    occ = M.all_occurrences(one, k, "text").select("note_id", "page", "start", "suspect_span")
    return M.drop_bigram_covered(occ, M.all_occurrences(two, k, "text"))
