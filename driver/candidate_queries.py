"""Vocabulary matching, candidates, hints, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold import constants as K
from inkfold.functions import text as T
from inkfold.functions.rows import unfolded
from inkfold.operators import candidates as C
from inkfold.operators import detectors as D
from inkfold.operators import governance as G
from inkfold.operators import hints as H
from inkfold.operators import matching as M
from inkfold.operators import numbering
from inkfold.operators.bundles import bundled
from inkfold.plans import analyze as A
from inkfold.session import written
from inkfold.sources import dictionaries as SD

from . import inputs as I
from .registry import query

_BASE = I.ctes("kana", "words", "terms", "forms")
_FIRST = (
    "first_forms AS (SELECT form, arg_min(struct_pack(seq := seq, form_ord := form_ord, normalized := normalized, protect := protect, alone := term = normalized AND variant IS NULL, term := term), seq * 10 + form_ord) AS t "
    "FROM forms WHERE form <> '' AND (form <> normalized OR (term = normalized AND variant IS NULL)) GROUP BY form)"
)
_MATCH = f"{_FIRST}, hit AS (SELECT note_id, page, form, t FROM kana JOIN first_forms ON contains(text, form))"


@query(
    "dictionary_match",
    f"WITH {I.ctes('kana', 'terms', 'forms')}, {_MATCH} SELECT note_id, page, form AS suspect_span, "
    "CASE WHEN t.alone AND form = t.term THEN '辞書に登録された語彙です' ELSE '辞書に登録された異表記です (正規化形: ' || t.normalized || ')' END AS reason, t.protect AS is_protected, t.seq AS seq FROM hit",
)
def dictionary_match(spark, sf):
    m = M.dictionary_match(I.kana(spark, sf), M.term_forms(I.terms(spark, sf)), "text")
    return m.select("note_id", "page", "suspect_span", "reason", "is_protected", "seq")


@query("dictionary_match_by_shuffle", f"WITH {I.ctes('kana', 'terms', 'forms')}, {_MATCH} SELECT note_id, page, form AS suspect_span, t.seq AS seq FROM hit")
def dictionary_match_by_shuffle(spark, sf):
    """The path of a dictionary too large to broadcast."""
    m = M.dictionary_match(I.kana(spark, sf), M.term_forms(I.terms(spark, sf)), "text", hint="merge")
    return m.select("note_id", "page", "suspect_span", "seq")


# No span holds white space, so the oracle works on tokens; what a token shows does not depend on its
# document, because a longer span hides a shorter one only where it stands itself.
_WORDS = (
    f"WITH RECURSIVE {I.ctes('kana', 'grammar', 'terms', 'forms')}, {_FIRST}, "
    "src AS (SELECT k.note_id, string_split(replace(k.text || chr(10) || g.text, chr(10), ' '), ' ') AS ts FROM kana k JOIN grammar g USING (note_id)), "
    "tok0 AS (SELECT note_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS i FROM src), "
    "tok AS (SELECT note_id, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY note_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tok0), "
    "dt AS (SELECT DISTINCT token FROM tok), "
    f"found AS (SELECT token, s, instr(token, s) AS pos FROM (SELECT token, unnest(regexp_extract_all(token, '{K.GRAMMAR_SCAN}', 0)) AS s FROM dt UNION SELECT token, form FROM dt JOIN first_forms ON contains(token, form))), "
    "greedy AS (SELECT token, s, pos, substr(token, pos + length(s)) AS rest FROM found UNION ALL SELECT token, s, pos + length(s) - 1 + instr(rest, s), substr(rest, instr(rest, s) + length(s)) FROM greedy WHERE instr(rest, s) > 0), "
    "longest AS (SELECT token, pos, max(length(s)) AS n FROM greedy GROUP BY ALL), "
    # after a hidden place the scan goes on one letter later, after a visible one behind it
    "scan AS (SELECT f.token, f.s, f.pos, l.n > length(f.s) AS hidden FROM found f JOIN longest l ON l.token = f.token AND l.pos = f.pos UNION ALL "
    "SELECT p.token, p.s, p.pos, coalesce(l.n, 0) > length(p.s) FROM (SELECT token, s, frm - 1 + instr(substr(token, frm), s) AS pos FROM (SELECT token, s, CASE WHEN hidden THEN pos + 1 ELSE pos + length(s) END AS frm FROM scan) "
    "WHERE instr(substr(token, frm), s) > 0) p LEFT JOIN longest l ON l.token = p.token AND l.pos = p.pos), "
    "seen AS (SELECT token, s, pos FROM scan WHERE NOT hidden)"
)


def span_pages(spark, sf):
    """The page of each document that is searched for spans."""
    t = I.table(spark, sf, "documents")
    low = F.lower("text")
    g = F.translate(low, I.GRAMMAR_FROM, I.GRAMMAR_TO)
    tail = F.concat(F.lit("\n一〇、〇〇、一一、〇一\n"), F.repeat(F.substring(g, 1, 1), 30), F.lit("\n□□"), "source", F.lit("・.、……。・。です\n候也"), "lang", F.lit("である。"))
    return t.select(F.col("doc_id").alias("note_id"), F.lit(1).alias("page"), F.concat(F.translate(low, I.LETTERS, I.KANA), F.lit("\n"), g, tail).alias("text"))


def _located(spark, sf, choose):
    """(note_id, w): the chosen findings of each page with their starts."""
    pages = span_pages(spark, sf)
    hits = M.dictionary_match(pages, M.term_forms(I.terms(spark, sf)), "text")
    per_page = hits.groupBy("note_id", "page").agg(F.collect_list("suspect_span").alias("_d"))
    text = F.col("text")
    as_finding = lambda s: D._finding(s, "", 1.0, "dict", "dictionary")
    both = F.concat(
        F.transform(F.coalesce("_d", F.array().cast("array<string>")), as_finding), D.symbol_runs_col(text), D.grammar_col(text)
    )
    p = pages.join(per_page, ["note_id", "page"], "left").withColumn("_first", both)
    found = M.visible_starts_col(text, F.col("_first"))
    return p.select("note_id", choose(found).alias("w"))


def _counts(located):
    return located.where(F.size("w") > 0).select(
        "note_id",
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["starts"])).alias("n_spans"),
        F.size("w").cast("bigint").alias("n_texts"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.aggregate(x["starts"], F.lit(0).cast("bigint"), lambda b, s: b + s)).alias("start_sum"),
    )


# A symbol run also stands inside longer runs of its document, so runs are met per document; they share no letter with words.
_RUN = f"'{K.SYMBOL_RUN}'"
_ALL = (
    f"{_WORDS}, "
    f"run AS (SELECT DISTINCT note_id, unnest(regexp_extract_all(token, {_RUN}, 0)) AS s FROM tok), "
    f"place AS (SELECT r.note_id, t.token, r.s FROM run r JOIN (SELECT DISTINCT note_id, token FROM tok WHERE regexp_matches(token, {_RUN})) t ON t.note_id = r.note_id AND contains(t.token, r.s)), "
    "rgreedy AS (SELECT note_id, token, s, instr(token, s) AS pos FROM place UNION ALL SELECT note_id, token, s, pos + length(s) - 1 + instr(substr(token, pos + length(s)), s) FROM rgreedy WHERE instr(substr(token, pos + length(s)), s) > 0), "
    "rlongest AS (SELECT note_id, token, pos, max(length(s)) AS n FROM rgreedy GROUP BY ALL), "
    "rscan AS (SELECT p.note_id, p.token, p.s, p.pos, coalesce(l.n, 0) > length(p.s) AS hidden FROM (SELECT note_id, token, s, instr(token, s) AS pos FROM place) p LEFT JOIN rlongest l ON l.note_id = p.note_id AND l.token = p.token AND l.pos = p.pos UNION ALL "
    "SELECT p.note_id, p.token, p.s, p.pos, coalesce(l.n, 0) > length(p.s) FROM (SELECT note_id, token, s, frm - 1 + instr(substr(token, frm), s) AS pos FROM (SELECT note_id, token, s, CASE WHEN hidden THEN pos + 1 ELSE pos + length(s) END AS frm FROM rscan) "
    "WHERE instr(substr(token, frm), s) > 0) p LEFT JOIN rlongest l ON l.note_id = p.note_id AND l.token = p.token AND l.pos = p.pos), "
    "every AS (SELECT note_id, s, start + pos - 1 AS begun FROM tok JOIN seen USING (token) UNION ALL SELECT note_id, s, start + pos - 1 FROM tok JOIN rscan USING (note_id, token) WHERE NOT hidden)"
)


#: CTEs up to ``every`` (note_id, s, begun): the places of all visible spans of the pages of :func:`span_pages`.
SPANS_SQL = _ALL


def located_spans(spark, sf):
    """(note_id, page, start, end, suspect_span): the same places."""
    each = unfolded(_located(spark, sf, lambda found: found), ["note_id"], "w", "x").select("note_id", F.col("x.f.suspect_span").alias("suspect_span"), F.col("x.starts").alias("_s"))
    return each.select("note_id", F.lit(1).alias("page"), F.explode("_s").alias("start"), "suspect_span").select(
        "note_id", "page", F.col("start").cast("int").alias("start"), (F.col("start") + F.char_length("suspect_span")).cast("int").alias("end"), "suspect_span"
    )


@query("span_counts_all", f"{_ALL} SELECT note_id, count(*) AS n_spans, count(DISTINCT s) AS n_texts, CAST(sum(begun) AS BIGINT) AS start_sum FROM every GROUP BY 1")
def span_counts_all(spark, sf):
    """Flagship: detectors and vocabulary in one pass, spans located in the row, counts per document, symbol runs included."""
    return _counts(_located(spark, sf, lambda found: found))


@query("span_counts", f"{_ALL} SELECT note_id, s AS suspect_span, count(*) AS n, min(begun) AS first_start FROM every GROUP BY ALL")
def span_counts(spark, sf):
    """Places of every span of each document, symbol runs included."""
    return located_spans(spark, sf).groupBy("note_id", "suspect_span").agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("bigint").alias("first_start"))


# --- candidates -----------------------------------------------------------------------
def spans(spark, sf, lists=None):
    n = F.char_length("suspect_span")
    return I.words(spark, sf, lists).withColumn("is_protected", n % 2 == 0)


_BASE_SCORE = "(100 + priority * 10 + CASE WHEN domain = 'd1' THEN 20 ELSE 0 END) * CASE WHEN tier = 'experimental' THEN 0.8 ELSE 1.0 END"
_TERM_CANDS = (
    f"scored_forms AS (SELECT form, normalized, protect, seq, CAST({_BASE_SCORE} AS DOUBLE) AS base FROM forms), "
    "span AS (SELECT note_id, page, suspect_span, length(suspect_span) % 2 = 0 AS is_protected FROM words), "
    # outcomes depend on the text alone, so they are found once per distinct text
    "texts AS (SELECT DISTINCT suspect_span, is_protected FROM span), "
    "ev AS (SELECT suspect_span, normalized AS candidate, base AS score, seq * 2 AS k FROM texts JOIN scored_forms ON form = suspect_span "
    "UNION ALL SELECT suspect_span, suspect_span, base + 50, seq * 2 + 1 FROM texts JOIN scored_forms ON form = suspect_span WHERE is_protected AND protect), "
    "term_text AS (SELECT suspect_span, candidate, arg_max(score, k) AS score, min(k) AS ord FROM ev GROUP BY ALL), "
    "term_cands AS (SELECT note_id, page, suspect_span, candidate, score, ord FROM span JOIN term_text USING (suspect_span))"
)


@query("term_candidates", f"WITH {_BASE}, {_TERM_CANDS} SELECT note_id, page, suspect_span, candidate, round(score, 6) AS score, CAST(ord AS BIGINT) AS ord FROM term_cands")
def term_candidates(spark, sf):
    c = C.term_candidates(spans(spark, sf), M.term_forms(I.terms(spark, sf)), "d1")
    return c.select("note_id", "page", "suspect_span", "candidate", F.round("score", 6).alias("score"), "ord")


_SHAPE_CANDS = (
    "shape_best AS (SELECT wrong, correct, max(score) AS score, min(seq) AS seq FROM shapes GROUP BY ALL), "
    f"shape_cands AS (SELECT note_id, page, suspect_span, correct AS candidate, CAST(b.score AS DOUBLE) AS score, b.seq + {C.SHAPE_ORD} AS ord FROM span JOIN shape_best b ON wrong = suspect_span "
    "WHERE NOT EXISTS (SELECT 1 FROM term_text t WHERE t.suspect_span = span.suspect_span AND t.candidate = correct))"
)


@query("shape_candidates", f"WITH {_BASE}, {I.SQL['shapes']}, {_TERM_CANDS}, {_SHAPE_CANDS} SELECT note_id, page, suspect_span, candidate, score FROM shape_cands")
def shape_candidates(spark, sf):
    s = spans(spark, sf)
    t = C.term_candidates(s, M.term_forms(I.terms(spark, sf)), "d1")
    return C.shape_candidates(s, I.shape_pairs(spark, sf), "any", t).select("note_id", "page", "suspect_span", "candidate", "score")


_CANDS = (
    f"{_TERM_CANDS}, {_SHAPE_CANDS}, cands AS (SELECT * FROM term_cands UNION ALL SELECT * FROM shape_cands), "
    "boosted AS (SELECT c.note_id, c.page, c.suspect_span, c.candidate, c.score + coalesce(h.bonus * CASE WHEN h.is_proper AND abs(length(c.suspect_span) - length(c.candidate)) >= 2 THEN 0.5 ELSE 1 END, 0) AS score, c.ord, false AS bonus_only "
    "FROM cands c LEFT JOIN hints h ON h.note_id = c.note_id AND h.term = c.candidate)"
)


def _scored(spark, sf, lists=None):
    s = spans(spark, sf, lists)
    t = C.term_candidates(s, M.term_forms(I.terms(spark, sf)), "d1")
    return s, t.unionByName(C.shape_candidates(s, I.shape_pairs(spark, sf), "any", t))


@query("hint_boost", f"WITH {_BASE}, {I.ctes('shapes', 'hints')}, {_CANDS} SELECT note_id, page, suspect_span, candidate, round(score, 6)::DOUBLE AS score FROM boosted")
def hint_boost(spark, sf):
    _, scored = _scored(spark, sf)
    return C.hint_boost(scored, I.hints(spark, sf)).select("note_id", "page", "suspect_span", "candidate", F.round("score", 6).alias("score"))


# scripts as in the dominant_script query, computed once per text
_SCRIPTS = (
    f"all_texts AS (SELECT DISTINCT suspect_span AS x FROM words UNION SELECT DISTINCT term FROM hints), "
    f"sc0 AS (SELECT x, len(regexp_extract_all(x, '[{K.KANJI_BY_NAME}]', 0)) AS kj, len(regexp_extract_all(x, '[{K.KANA_BY_NAME}]', 0)) AS kn FROM all_texts), "
    "sc AS (SELECT x, CASE WHEN regexp_full_match(x, '[\\x00-\\x7F]+') THEN 'ascii' WHEN kj + kn = 0 THEN 'mixed' WHEN kj / (kj + kn)::DOUBLE >= 0.8 THEN 'kanji' WHEN kn / (kj + kn)::DOUBLE >= 0.8 THEN 'kana' ELSE 'mixed' END AS script FROM sc0)"
)
_BONUS = (
    f"{_SCRIPTS}, offer0 AS (SELECT span.note_id, span.page, span.suspect_span, h.term AS candidate, CAST(least(h.bonus, 25.0) AS DOUBLE) AS score, h.ord + {C.MENU_ORD} AS ord "
    "FROM span JOIN sc a ON a.x = span.suspect_span JOIN hints h ON h.note_id = span.note_id JOIN sc b ON b.x = h.term "
    "WHERE h.is_proper AND h.bonus >= 20 AND abs(length(span.suspect_span) - length(h.term)) <= 1 AND NOT (h.is_geo AND length(span.suspect_span) < 3) "
    "AND CASE a.script WHEN 'ascii' THEN b.script = 'ascii' WHEN 'kanji' THEN b.script IN ('kanji', 'mixed') WHEN 'kana' THEN b.script IN ('kana', 'mixed') ELSE true END), "
    "offer1 AS (SELECT o.* FROM offer0 o LEFT JOIN cands c ON c.note_id = o.note_id AND c.suspect_span = o.suspect_span AND c.candidate = o.candidate WHERE c.note_id IS NULL), "
    "offer AS (SELECT * FROM offer1)"
)


def _bundles(spark, sf, unread=("sources",)):
    """Spans, scored candidates and hints (less ``unread`` columns) of each note; the words that all of them are made of are found once."""
    lists = written(I.word_lists(spark, sf), "zstd")
    s, scored = _scored(spark, sf, lists)
    return bundled(s.select(*C.KEY)), bundled(scored), bundled(I.hints(spark, sf, lists).drop(*unread))


@query("bonus_only", f"WITH {_BASE}, {I.ctes('shapes', 'hints')}, {_CANDS}, {_BONUS} SELECT note_id, page, suspect_span, string_agg(candidate, '|' ORDER BY score DESC, ord, candidate) AS offered, min(score) AS least FROM offer GROUP BY ALL")
def bonus_only(spark, sf):
    s, scored, h = _bundles(spark, sf)
    offer = C.offer_lists(C.bonus_only(s, scored, h))
    # a list is joined once for all spans that are offered it
    joined = offer.select("note_id", "members", F.array_join("offer.candidate", "|").alias("offered"), F.array_min("offer.score").alias("least"))
    return joined.select("note_id", F.explode("members").alias("m"), "offered", "least").select("note_id", "m.*", "offered", "least")


_RANKED = (
    f"{_CANDS}, {_BONUS}, everything AS (SELECT * FROM boosted UNION ALL SELECT *, true FROM offer), "
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id, suspect_span ORDER BY score DESC, ord, candidate) AS rank FROM everything) WHERE rank <= 5)"
)


def _ranked(spark, sf, unread=("sources",), **kw):
    """(each span with its ranked candidates, the hints in bundles)."""
    s, scored, h = _bundles(spark, sf, unread)
    # hints of one length share their order, so the text decides last on both sides
    return C.rank_candidates(C.hint_boost(scored, h), spans=s, offers=C.bonus_only(s, scored, h, k=K.TOP_K), **kw), h


def _joined(ranked):
    return ranked.select(*C.KEY, F.array_join("ranked.candidate", "|").alias("candidates"))


@query(
    "ranked_candidates",
    f"WITH {_BASE}, {I.ctes('shapes', 'hints')}, {_RANKED} SELECT note_id, page, suspect_span, string_agg(candidate, '|' ORDER BY rank) AS candidates FROM top GROUP BY ALL "
    "UNION ALL SELECT note_id, page, suspect_span, suspect_span FROM span WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.note_id = span.note_id AND top.suspect_span = span.suspect_span)",
)
def ranked_candidates(spark, sf):
    return _joined(_ranked(spark, sf)[0])


@query(
    "ranked_without_bonus_only",
    f"WITH {_BASE}, {I.ctes('shapes', 'hints')}, {_RANKED}, kept AS (SELECT * FROM top WHERE NOT bonus_only) SELECT note_id, page, suspect_span, string_agg(candidate, '|' ORDER BY rank) AS candidates FROM kept GROUP BY ALL "
    "UNION ALL SELECT note_id, page, suspect_span, suspect_span FROM span WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.note_id = span.note_id AND kept.suspect_span = span.suspect_span)",
)
def ranked_without_bonus_only(spark, sf):
    return _joined(_ranked(spark, sf, suppress_bonus_only=True)[0])


@query(
    "rank1_flags",
    f"WITH {_BASE}, {I.ctes('shapes', 'hints')}, {_RANKED}, r1 AS (SELECT note_id, page, suspect_span, candidate AS rank1 FROM top WHERE rank = 1 UNION ALL SELECT note_id, page, suspect_span, suspect_span FROM span WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.note_id = span.note_id AND top.suspect_span = span.suspect_span)), "
    "ex AS (SELECT DISTINCT form FROM forms WHERE tier = 'experimental'), sp AS (SELECT DISTINCT wrong, correct FROM shapes) "
    "SELECT r1.note_id, page, suspect_span, rank1, coalesce(is_proper, false) AS proper, sp.wrong IS NOT NULL AS shape, ex.form IS NOT NULL AS experimental, coalesce(from_fm, false) AS frontmatter, coalesce(from_body, false) AS body, coalesce(is_proper, false) AND sp.wrong IS NULL AS dangerous "
    "FROM r1 LEFT JOIN hints h ON h.note_id = r1.note_id AND h.term = rank1 LEFT JOIN sp ON wrong = suspect_span AND correct = rank1 LEFT JOIN ex ON form = rank1",
)
def rank1_flags(spark, sf):
    ranked, h = _ranked(spark, sf, unread=())
    r1 = ranked.select("note_id", "page", "suspect_span", F.get("ranked", F.lit(0))["candidate"].alias("rank1"))
    f = C.rank1_provenance(r1, h, I.shape_pairs(spark, sf), M.term_forms(I.terms(spark, sf)))
    return f.select(
        "note_id", "page", "suspect_span", "rank1", F.col("rank1_is_proper_noun").alias("proper"), F.col("rank1_from_shape").alias("shape"),
        F.col("rank1_from_experimental_dict").alias("experimental"), F.col("rank1_from_frontmatter").alias("frontmatter"), F.col("rank1_from_body").alias("body"),
        F.col("is_dangerous").alias("dangerous"),
    )


# --- hints --------------------------------------------------------------------------------
@query(
    "hint_sum",
    f"WITH {I.ctes('kana', 'words')}, c AS (SELECT note_id, substr(suspect_span, 1, 2) AS term, CASE WHEN length(suspect_span) % 2 = 0 THEN 15.0 ELSE 26.0 END AS fixed, CASE WHEN length(suspect_span) % 3 = 0 THEN 20.0 ELSE 0.0 END AS scaled FROM words) "
    "SELECT note_id, term, sum(fixed)::DOUBLE AS fixed, sum(scaled)::DOUBLE AS scaled FROM c GROUP BY ALL",
)
def hint_sum(spark, sf):
    n = F.char_length("suspect_span")
    c = I.words(spark, sf).select(
        "note_id", F.substring("suspect_span", 1, 2).alias("term"), F.when(n % 2 == 0, 15.0).otherwise(26.0).alias("fixed"),
        F.when(n % 3 == 0, 20.0).otherwise(0.0).alias("scaled"), n.cast("bigint").alias("ord"), F.array().cast("array<string>").alias("sources"),
    )
    return H.hint_sum(c).select("note_id", "term", "fixed", "scaled")


NOUN_LISTS = (
    ("core", None, [{"term": "山会", "aliases": ["会山", "村人"], "weight": 1.2}, {"term": "地所", "weight": 1.0}, {"term": "申立", "regions": ["愛知"], "weight": 1.1}]),
    ("prefectures", None, [{"term": "村論", "aliases": ["論村"], "weight": 1.5}]),
    ("regional", "aichi", [{"term": "人判", "aliases": ["判人"], "weight": 1.4}, {"term": "山会", "weight": 0.5}]),
    ("regional", "osaka", [{"term": "訴候", "weight": 1.3}]),
)
# region of a document by its language (fixed for this query set)
REGIONS = {"en": "愛知", "fr": "大阪", "de": "未知", "es": ""}


def noted(spark, sf):
    region = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    return I.kana(spark, sf).withColumn("region", F.coalesce(F.element_at(region, F.col("lang")), F.lit("")))


_NOTED = f"noted AS (SELECT note_id, page, text, lang, CASE lang {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in REGIONS.items())} ELSE '' END AS region FROM kana)"
_ALIAS = "alias(region, name) AS (VALUES " + ", ".join(f"('{r}', '{a}')" for r, al in K.REGION_ALIASES.items() for a in al) + ")"
# names that do occur in the derived texts stand in for the aliases
_MULT = (
    f"{_ALIAS}, names AS (SELECT region, name FROM alias UNION ALL SELECT '未知', '未知'), "
    "hits AS (SELECT n.note_id, n.page, n.region, coalesce(sum((length(n.text2) - length(replace(n.text2, name, ''))) / length(name)), 0) AS k FROM (SELECT *, text || CASE WHEN note_id % 3 = 0 THEN '愛知大阪' WHEN note_id % 3 = 1 THEN '尾張三河浪速未知摂津' ELSE '' END AS text2 FROM noted) n LEFT JOIN names USING (region) GROUP BY ALL), "
    "mult AS (SELECT note_id, page, region, CASE WHEN region = '' THEN 1.0 WHEN k = 0 THEN 0.0 WHEN k = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS region_multiplier FROM hits)"
)


def regioned(spark, sf):
    extra = F.when(F.col("note_id") % 3 == 0, "愛知大阪").when(F.col("note_id") % 3 == 1, "尾張三河浪速未知摂津").otherwise("")
    n = noted(spark, sf)
    info = n.select("note_id", "region")
    return H.region_multiplier(n.drop("region").withColumn("text2", F.concat("text", extra)), info, "text2")


@query("region_multiplier", f"WITH {I.ctes('kana')}, {_NOTED}, {_MULT} SELECT note_id, page, region, region_multiplier FROM mult")
def region_multiplier(spark, sf):
    return regioned(spark, sf).select("note_id", "page", "region", "region_multiplier")


@query(
    "normalize_region",
    f"WITH {_ALIAS}, r AS (SELECT doc_id AS note_id, (['尾張', '大坂', '江戸', '信州', '愛知'])[doc_id % 5 + 1] AS raw FROM documents) SELECT note_id, coalesce(region, raw) AS region FROM r LEFT JOIN alias ON name = raw",
)
def normalize_region(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("尾張", "大坂", "江戸", "信州", "愛知")]), (F.col("doc_id") % 5 + 1).cast("int"))
    n = I.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), raw.alias("region"))
    return H.normalize_region(n, H.region_alias_table(spark)).select("note_id", "region")


def _noun_values():
    rows, seq = [], 0
    for kind, key, entries in NOUN_LISTS:
        for e in entries:
            regions = e.get("regions", [])
            for i, t in enumerate([e["term"], *e.get("aliases", [])]):
                score = 30.0 * e["weight"] if kind == "core" else min(30.0 * e["weight"], 40.0)
                rows.append(f"('{kind}', {repr(key) if key else 'NULL'}, '{t}', {score * (0.85 if i else 1.0)!r}::DOUBLE, {repr(regions[0]) if regions else 'NULL'}, {seq})")
                seq += 1
    return "nouns(kind, region_key, term, score, only_region, seq) AS (VALUES " + ", ".join(rows) + ")"


@query(
    "proper_nouns_applied",
    f"WITH {I.ctes('kana')}, {_NOTED}, {_MULT}, {_noun_values()}, keyed AS (SELECT *, CASE region WHEN '愛知' THEN 'aichi' WHEN '大阪' THEN 'osaka' END AS rk FROM mult), "
    "per_list AS (SELECT k.note_id, k.region_multiplier, n.kind, n.term, max(n.score) AS score FROM keyed k JOIN nouns n ON (n.kind <> 'regional' OR n.region_key = k.rk) AND (n.only_region IS NULL OR k.region = '' OR n.only_region = k.region) GROUP BY ALL) "
    "SELECT note_id, term, round(sum(CASE WHEN kind = 'regional' THEN score * region_multiplier ELSE score END), 6) AS bonus, bool_or(kind = 'prefectures' OR kind = 'regional') AS is_geo FROM per_list WHERE kind <> 'regional' OR score * region_multiplier > 0 GROUP BY ALL",
)
def proper_nouns_applied(spark, sf):
    r = regioned(spark, sf)
    nouns = SD.proper_nouns_from(spark, NOUN_LISTS)
    return H.apply_proper_nouns(r.select("note_id"), nouns, r.select("note_id", "region", "region_multiplier")).select(
        "note_id", "term", F.round("bonus", 6).alias("bonus"), "is_geo"
    )


# --- dictionaries ----------------------------------------------------------------------------
@query(
    "union_terms",
    f"WITH {I.ctes('terms')}, u AS (SELECT term, 'stable' AS tier, 0 AS part, seq FROM terms WHERE tier = 'stable' UNION ALL SELECT term, 'experimental', 1, seq FROM terms WHERE tier = 'experimental' UNION ALL SELECT term, 'temporary', 2, seq FROM terms WHERE protect) "
    "SELECT term, tier, row_number() OVER (ORDER BY part, seq) AS load_order FROM u",
)
def union_terms(spark, sf):
    t = I.terms(spark, sf)
    temp = t.where("protect").withColumn("tier", F.lit("temporary"))
    u = SD.union_terms(t.where("tier = 'stable'"), t.where("tier = 'experimental'"), temp, True)
    placed = numbering.numbered(written(u.select("term", "tier", "seq")), ["seq"])
    return placed.select("term", "tier", (F.col(numbering.PLACE) + 1).cast("bigint").alias("load_order"))


@query(
    "search_terms",
    f"WITH {I.ctes('terms')} SELECT term, normalized, domain, source_file FROM terms WHERE contains(lower(term), '山') OR contains(lower(normalized), '山') OR contains(lower('語'), '山') OR contains(lower(domain), '山')",
)
def search_terms(spark, sf):
    return SD.search_terms(I.terms(spark, sf), "山").select("term", "normalized", "domain", "source_file")


@query(
    "term_counts",
    f"WITH {I.ctes('terms')}, f AS (SELECT DISTINCT source_file FROM terms UNION SELECT 'empty.csv'), p AS (SELECT f.source_file, count(term) AS total, count(*) FILTER (WHERE protect) AS enabled_count FROM f LEFT JOIN terms USING (source_file) GROUP BY 1) "
    "SELECT source_file, total, enabled_count FROM p UNION ALL SELECT NULL, sum(total)::BIGINT, sum(enabled_count)::BIGINT FROM p",
)
def term_counts(spark, sf):
    t = I.terms(spark, sf).withColumn("enabled", F.col("protect"))
    files = t.select("source_file").unionByName(spark.createDataFrame([("empty.csv",)], "source_file string"))
    return G.term_counts(t, files)


@query("has_protected", f"WITH {I.ctes('terms')} SELECT source_file, bool_or(protect) AS has_protected FROM terms GROUP BY 1")
def has_protected(spark, sf):
    return G.has_protected(I.terms(spark, sf))


def _promotion(spark, sf):
    t = I.terms(spark, sf).dropDuplicates(["term", "source_file"])
    first = I.terms(spark, sf).groupBy("term", "source_file").agg(F.min("seq").alias("seq"))
    t = I.terms(spark, sf).join(first, ["term", "source_file", "seq"])
    temp = t.where("seq % 2 = 0").withColumn("enabled", F.lit(True))
    approved = t.where("seq % 3 = 0").withColumn("source_file", F.lit("base.csv"))
    keep = approved.groupBy("term").agg(F.min("seq").alias("seq"))
    approved = approved.join(keep, ["term", "seq"])
    req = temp.where("seq % 5 <> 0").select("term", "source_file", F.lit("base.csv").alias("target_file")).unionByName(
        temp.where("seq % 5 = 0").select(F.concat("term", F.lit("無")).alias("term"), "source_file", F.lit("base.csv").alias("target_file"))
    )
    return temp, approved, req


_PROMO = (
    f"WITH {I.ctes('terms')}, one AS (SELECT term, source_file, arg_min(normalized, seq) AS normalized, min(seq) AS seq FROM terms GROUP BY ALL), temp AS (SELECT * FROM one WHERE seq % 2 = 0), "
    "appr AS (SELECT term, arg_min(normalized, seq) AS normalized, min(seq) AS seq FROM one WHERE seq % 3 = 0 GROUP BY 1), "
    "req AS (SELECT term, source_file FROM temp WHERE seq % 5 <> 0 UNION ALL SELECT term || '無', source_file FROM temp WHERE seq % 5 = 0), "
    "dec AS (SELECT r.term, r.source_file, CASE WHEN t.term IS NULL THEN 'not_found' WHEN a.term IS NULL THEN 'promoted' ELSE 'overwritten' END AS status FROM req r LEFT JOIN temp t USING (term, source_file) LEFT JOIN appr a ON a.term = r.term)"
)


@query("promote_report", f"{_PROMO} SELECT * FROM dec")
def promote_report(spark, sf):
    _, _, report = G.promote(*_promotion(spark, sf), on_conflict="overwrite")
    return report.select("term", "source_file", "status")


@query("promote_temp_left", f"{_PROMO} SELECT term, source_file FROM temp WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.term = temp.term AND dec.source_file = temp.source_file AND status IN ('promoted', 'overwritten'))")
def promote_temp_left(spark, sf):
    left, _, _ = G.promote(*_promotion(spark, sf), on_conflict="overwrite")
    return left.select("term", "source_file")


@query(
    "edit_terms",
    f"WITH {I.ctes('terms')}, one AS (SELECT term, source_file, arg_min(normalized, seq) AS normalized, arg_min(protect, seq) AS protect, min(seq) AS seq FROM terms GROUP BY ALL) "
    "SELECT CASE WHEN seq % 7 = 1 THEN term || '改' ELSE term END AS term, source_file, CASE WHEN seq % 7 = 1 THEN '正' ELSE normalized END AS normalized FROM one WHERE seq % 7 <> 0 "
    "UNION ALL SELECT '新' || term, source_file, '新' || term FROM one WHERE seq % 7 = 2",
)
def edit_terms(spark, sf):
    t = I.terms(spark, sf)
    first = t.groupBy("term", "source_file").agg(F.min("seq").alias("seq"))
    t = t.join(first, ["term", "source_file", "seq"])
    k = F.col("seq") % 7
    op = F.when(k == 0, "delete").when(k == 1, "update").when(k == 2, "append").when(k == 3, "append")
    edits = t.where(k <= 3).select(
        "source_file", op.alias("op"), F.when(k == 2, F.concat(F.lit("新"), "term")).otherwise(F.col("term")).alias("term"),
        F.when(k == 1, F.concat("term", F.lit("改"))).alias("new_term"), F.when(k == 1, " 正 ").alias("normalized"),
    )
    done, _ = G.edit_terms(t, edits)
    return done.select("term", "source_file", "normalized")


# --- OCR confidences ------------------------------------------------------------------------
@query(
    "low_confidence",
    f"WITH {I.ctes('kana', 'words', 'terms', 'forms')}, ch AS (SELECT note_id, suspect_span AS t, (length(suspect_span) * 37 % 100) / 100.0 AS c FROM words), pf AS (SELECT DISTINCT form FROM forms WHERE protect) "
    "SELECT note_id, 1 AS page, t AS suspect_span, CAST(c AS DOUBLE) AS confidence, pf.form IS NOT NULL AS is_protected FROM ch LEFT JOIN pf ON form = t WHERE c < 0.6",
)
def low_confidence(spark, sf):
    """Confidence trees made from the words of each document, walked as nested JSON."""
    from inkfold.sources.notes import ocr_chars

    w = I.words(spark, sf)
    leaf = F.struct(F.col("suspect_span").alias("text"), ((F.char_length("suspect_span") * 37 % 100) / 100.0).alias("confidence"))
    trees = w.groupBy("note_id").agg(F.to_json(F.struct(F.lit(1).alias("v"), F.struct(F.collect_list(leaf).alias("lines")).alias("page"))).alias("json"))
    chars = D.protected_flag(ocr_chars(trees), M.term_forms(I.terms(spark, sf)))
    return D.low_confidence(chars, I.kana(spark, sf), column="text").select("note_id", "page", "suspect_span", "confidence", "is_protected")


# --- the whole analysis -----------------------------------------------------------------------
def config(spark, sf, **kw):
    return A.AnalyzeConfig(
        terms=I.terms(spark, sf), shape_pairs=I.shape_pairs(spark, sf), proper_nouns=SD.proper_nouns_from(spark, NOUN_LISTS), domain_hint="d1", **kw
    )


@query("analyze")
def analyze(spark, sf):
    """Every span of every note with candidates, verdict and flags (no SQL twin: see the tests)."""
    s = A.analyze(I.notes(spark, sf), config(spark, sf))
    return s.groupBy("note_id", "page", "detector", "recommended_verdict").agg(
        F.count(F.lit(1)).alias("n_spans"), F.countDistinct("suspect_span").alias("n_texts"), F.sum("start").alias("start_sum"),
        F.sum(F.size("candidates")).alias("n_candidates"), F.count_if("is_dangerous").alias("n_dangerous"),
        F.count_if("rank1_from_shape").alias("n_shape"), F.count_if("rank1_from_experimental_dict").alias("n_experimental"),
    )


@query(
    "page_report",
    f"WITH {I.ctes('kana')}, {I.SQL['page1']}, src AS (SELECT note_id, 1 AS page, ocr AS text FROM page1), {__import__('driver.text_queries', fromlist=['x'])._DOCTYPE_CTE}, {I.chars_cte('src')}, "
    f"h AS (SELECT note_id, count(*) AS k FROM chars WHERE {__import__('driver.text_queries', fromlist=['x'])._HIT} GROUP BY 1) "
    "SELECT note_id, 1 AS page, doc_type, CAST(CASE WHEN doc_type = 'classical' THEN coalesce(k, 0) ELSE 0 END AS INTEGER) AS particle_count FROM doc_types LEFT JOIN h USING (note_id) "
    "UNION ALL SELECT note_id, 2, 'unknown', 0 FROM page1",
)
def page_report(spark, sf):
    return A.page_report(I.notes(spark, sf), A.AnalyzeConfig()).select("note_id", "page", "doc_type", "particle_count")
