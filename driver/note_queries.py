"""Notes: pages, blocks, frontmatter, images, search, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.session import written
from inkfold.functions import text as T
from inkfold.operators import hints as H
from inkfold.operators import pages as P
from inkfold.plans import analyze as A
from inkfold.plans import review as R
from inkfold.sources import notes as N

from . import inputs as I
from .registry import query

_P = f"WITH {I.ctes('kana')}, {I.SQL['page1']}"


@query(
    "ocr_pages",
    f"{_P} SELECT note_id, 1 AS page, 'img/p1_' || note_id || '.jpg' AS image_link, 'p1_' || note_id || '.jpg' AS image_name, ocr AS ocr_text FROM page1 UNION ALL SELECT note_id, 2, 'p2_' || note_id || '.png', 'p2_' || note_id || '.png', '' FROM page1",
)
def ocr_pages(spark, sf):
    return P.ocr_pages(I.notes(spark, sf))


@query("ocr_text", f"{_P} SELECT note_id, ocr AS ocr_text FROM page1")
def ocr_text(spark, sf):
    return P.ocr_text(I.notes(spark, sf))


@query(
    "clean_text",
    f"WITH {I.ctes('kana')} SELECT note_id, trim(array_to_string(list_transform(string_split(text, chr(10)), lambda l: rtrim(l)), chr(10)), ' ' || chr(10)) AS clean_text FROM kana",
)
def clean_text(spark, sf):
    return P.clean_text(I.kana(spark, sf), "text").select("note_id", "clean_text")


@query("ocr_coverage", f"{_P} SELECT note_id, 2::BIGINT AS n_pages, (ocr <> '')::BIGINT AS n_with_ocr, (ocr <> '')::INTEGER / 2.0::DOUBLE AS coverage FROM page1")
def ocr_coverage(spark, sf):
    return P.ocr_coverage(P.ocr_pages(I.notes(spark, sf)))


@query("pages_missing_ocr", f"{_P} SELECT note_id, 2 AS page FROM page1 UNION ALL SELECT note_id, 1 FROM page1 WHERE ocr = ''")
def pages_missing_ocr(spark, sf):
    return P.pages_missing_ocr(P.ocr_pages(I.notes(spark, sf))).select("note_id", "page")


# --- rewriting: blocks of 3 and 1 old lines, new text = the document's lines --------------------
def _blocks(spark, sf):
    k = I.kana(spark, sf)
    md = F.concat(F.lit("![[a.jpg]]\n> [!ocr]\n> 一\n> 二\n> 三\n\n![[b.jpg]]\n> [!OCR] 頭\n> 四\n終"), "lang")
    return k.select("note_id", md.alias("md")), k.select("note_id", "text")


_L = f"WITH {I.ctes('kana')}, s AS (SELECT note_id, lang, string_split(text, chr(10)) AS l0 FROM kana), t AS (SELECT note_id, lang, CASE WHEN l0[len(l0)] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM s)"
_Q = "array_to_string(list_transform({0}, lambda x: chr(10) || '> ' || x), '')"


@query(
    "embed_corrected",
    f"{_L}, c AS (SELECT *, CAST(greatest(1, round_even(0.75::DOUBLE * len(l), 0)) AS INTEGER) AS k FROM t) SELECT note_id, '![[a.jpg]]' || chr(10) || '> [!ocr]' || {_Q.format('l[1:k]')} || chr(10) || chr(10) || '![[b.jpg]]' || chr(10) || '> [!OCR] 頭' || {_Q.format('l[k + 1:len(l)]')} || chr(10) || '終' || lang AS md FROM c",
)
def embed_corrected(spark, sf):
    n, t = _blocks(spark, sf)
    return P.embed_corrected(n, t)


@query("embed_corrected_pages", f"{_L} SELECT note_id, '![[a.jpg]]' || chr(10) || '> [!ocr]' || chr(10) || '> 一' || chr(10) || '> 二' || chr(10) || '> 三' || chr(10) || chr(10) || '![[b.jpg]]' || chr(10) || '> [!OCR] 頭' || {_Q.format('l')} || chr(10) || '終' || lang AS md FROM t")
def embed_corrected_pages(spark, sf):
    n, t = _blocks(spark, sf)
    return P.embed_corrected_pages(n, t.withColumn("page", F.lit(2)))


@query("upsert_ocr", f"{_L} SELECT note_id, '![[a.jpg]]' || chr(10) || '> [!ocr]' || chr(10) || '> 一' || chr(10) || '> 二' || chr(10) || '> 三' || chr(10) || chr(10) || '![[b.jpg]]' || chr(10) || '> [!ocr]' || {_Q.format('l')} || chr(10) || '終' || lang AS md FROM t")
def upsert_ocr(spark, sf):
    n, t = _blocks(spark, sf)
    return P.upsert_ocr(n, t.withColumn("page", F.lit(2)))


@query(
    "set_frontmatter",
    "SELECT doc_id AS note_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'ocr_status: done' || chr(10) || '---' || chr(10) || text WHEN 1 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'ocr_status: done' || chr(10) || 'b: 2' || chr(10) || '---' || chr(10) || text "
    "ELSE '---' || chr(10) || 'ocr_status2: x' || chr(10) || 'ocr_status: done' || chr(10) || chr(10) || '---' || chr(10) || text END AS md FROM documents",
)
def set_frontmatter(spark, sf):
    d = I.table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    head = F.when(k == 0, "").when(k == 1, "---\na: 1\nocr_status: open\nb: 2\n---\n").otherwise("---\nocr_status2: x\n---\n")
    return P.set_frontmatter(d.select(F.col("doc_id").alias("note_id"), F.concat(head, "text").alias("md")), "ocr_status", "done")


@query("merge_body", "SELECT doc_id AS note_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text AS md FROM documents")
def merge_body(spark, sf):
    d = I.table(spark, sf, "documents").withColumnRenamed("doc_id", "note_id")
    stored = d.select("note_id", F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\nold")).alias("md"))
    return P.merge_body(stored, d.select("note_id", F.concat(F.lit("---\nx: 1\n---\n"), "text").alias("md")))


# --- frontmatter and body tokens -----------------------------------------------------------------
@query(
    "frontmatter_rows",
    "SELECT doc_id AS note_id, unnest(['id', 'region', 'person', 'plaintiff', 'plaintiff', 'tags']) AS key, unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['D' || doc_id, '尾張', '[[人/👤田中' || lang || ']]・山田一郎', '村山人民', '山会村論', '古文']) AS value, true AS is_text FROM documents",
)
def frontmatter_rows(spark, sf):
    return N.frontmatter_rows(I.notes(spark, sf))


@query(
    "frontmatter_tokens",
    "SELECT doc_id AS note_id, unnest(['尾張', '田中' || lang, '山田一郎', '村山人民', '山会村論']) AS token, unnest(['frontmatter:region', 'frontmatter:person', 'frontmatter:person', 'frontmatter:plaintiff', 'frontmatter:plaintiff']) AS sources FROM documents",
)
def frontmatter_tokens(spark, sf):
    t = H.frontmatter_tokens(N.frontmatter_rows(I.notes(spark, sf)))
    return t.select("note_id", "token", F.array_join("sources", ",").alias("sources"))


@query(
    "body_tokens",
    "SELECT doc_id AS note_id, unnest(['本文', '控訴' || lang, 'の件', '入会', '原告', '佐藤' || lang, '判事補', '備品', '覚書' || lang]) AS token, "
    "unnest(['body:text', 'body:wikilink', 'body:text', 'body:text', 'body:text', 'body:wikilink', 'body:list_value', 'body:list_value', 'body:text']) AS sources FROM documents",
)
def body_tokens(spark, sf):
    k = I.notes(spark, sf)
    t = H.body_tokens(k)
    return t.select("note_id", "token", F.array_join("sources", ",").alias("sources"))


@query(
    "party_confirm",
    f"{_P}, tok AS (SELECT note_id, ocr, unnest(['村山人民', '山会村論']) AS token FROM page1), w AS (SELECT note_id, ocr, substr(replace(ocr, chr(10), ''), 1, 6) AS token FROM page1 WHERE length(replace(ocr, chr(10), '')) >= 6 UNION ALL SELECT note_id, ocr, token FROM tok WHERE length(token) >= 4), "
    "two AS (SELECT note_id FROM page1) "
    "SELECT note_id, 1 AS page, token AS suspect_span FROM w WHERE contains(ocr, token) UNION ALL SELECT note_id, 1, string_split(ocr, chr(10))[1] FROM w WHERE NOT contains(ocr, token) AND token = substr(replace(ocr, chr(10), ''), 1, 6) "
    # 村山人民 stands over a line end on page 2, 山会村論 in one line
    "UNION ALL SELECT note_id, 2, '村山' FROM two UNION ALL SELECT note_id, 2, '山会村論' FROM two",
)
def party_confirm(spark, sf):
    """Names from the frontmatter on two pages of text, and the first six letters of each first page, which may span lines."""
    from inkfold.operators import detectors as D

    n = I.notes(spark, sf)
    n = n.withColumn("md", F.concat("md", F.lit("> [!ocr]\n> 論ハ村山\n> 人民ヘ山会村論ト\n")))
    pages = P.ocr_pages(n).withColumnRenamed("ocr_text", "clean_text")
    first = F.substring(F.replace("clean_text", F.lit("\n"), F.lit("")), 1, 6)
    own = pages.where((F.col("page") == 1) & (F.char_length(first) >= 6)).select("note_id", first.alias("token"), F.array(F.lit("frontmatter:judge")).alias("sources"), F.lit(9).cast("bigint").alias("ord"))
    listed = H.frontmatter_tokens(N.frontmatter_rows(n)).select("note_id", "token", "sources", "ord")
    return D.frontmatter_confirm(pages, listed.unionByName(own)).select("note_id", "page", "suspect_span")


# --- images and search -----------------------------------------------------------------------------
def _images(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("i"), "doc_id")
    a = d.where("doc_id % 3 = 0").select(F.concat(F.lit("img/p1_"), "i", F.lit(".jpg")).alias("image_path"))
    b = d.where("doc_id % 3 = 1").select(F.concat(F.lit("other/p1_"), "i", F.lit(".jpg")).alias("image_path"))
    c = d.where("doc_id % 2 = 0").select(F.concat(F.lit("z/p2_"), "i", F.lit(".png")).alias("image_path"))
    e = d.select(F.concat(F.lit("own/n"), "i", F.lit(".png")).alias("image_path"))
    return a.unionByName(b).unionByName(c).unionByName(e).withColumn("image_name", F.substring_index("image_path", "/", -1))


_PATH1 = "CASE doc_id % 3 WHEN 0 THEN 'img/p1_' || doc_id || '.jpg' WHEN 1 THEN 'other/p1_' || doc_id || '.jpg' ELSE '' END"
_PATH2 = "CASE WHEN doc_id % 2 = 0 THEN 'z/p2_' || doc_id || '.png' ELSE '' END"


@query("page_images", f"SELECT doc_id AS note_id, 1 AS page, {_PATH1} AS image_path FROM documents UNION ALL SELECT doc_id, 2, {_PATH2} FROM documents")
def page_images(spark, sf):
    return N.page_images(P.ocr_pages(I.notes(spark, sf)), _images(spark, sf)).select("note_id", "page", "image_path")


@query(
    "resolve_images",
    f"WITH p AS (SELECT doc_id AS note_id, 0 AS ord, {_PATH1} AS image_path FROM documents UNION ALL SELECT doc_id, 1, {_PATH2} FROM documents) SELECT * FROM p WHERE image_path <> '' UNION ALL SELECT doc_id, 0, 'own/n' || doc_id || '.png' FROM documents WHERE doc_id % 3 = 2 AND doc_id % 2 = 1",
)
def resolve_images(spark, sf):
    n = I.notes(spark, sf)
    return N.resolve_images(n, _images(spark, sf), N.frontmatter_rows(n))


_PATH = "'d/' || lang || '/n' || doc_id"


@query(
    "find_notes",
    f"WITH n AS (SELECT doc_id, {_PATH} AS path, 'n' || doc_id AS name FROM documents), "
    "q AS (SELECT doc_id, doc_id % 7 AS k, CASE doc_id % 7 WHEN 0 THEN 'D' || doc_id WHEN 1 THEN 'n' || doc_id WHEN 2 THEN 'd/' || lang || '/n' || doc_id WHEN 3 THEN 'd/' || lang || '/n' || doc_id || '.md' "
    "WHEN 4 THEN CAST(doc_id AS VARCHAR) WHEN 5 THEN lang || '/n' || doc_id || '.md' ELSE 'nothing' || doc_id END AS query FROM documents), "
    "part AS (SELECT q.query, arg_min(n.doc_id, (n.path, n.doc_id)) AS note_id FROM q JOIN n ON CASE k WHEN 4 THEN contains(n.name, q.query) WHEN 5 THEN contains(n.path, replace(q.query, '.md', '')) ELSE false END GROUP BY 1) "
    "SELECT query, CASE WHEN k < 4 THEN doc_id ELSE part.note_id END AS note_id, CAST(CASE k WHEN 6 THEN NULL ELSE k + 1 END AS INTEGER) AS rule FROM q LEFT JOIN part USING (query)",
)
def find_notes(spark, sf):
    """Queries by id, name, path, path with ending, part of a name (4) and part of a path (5)."""
    n = I.notes(spark, sf)
    i, k = F.col("note_id").cast("string"), F.col("note_id") % 7
    lang_path = F.concat("lang", F.lit("/n"), i, F.lit(".md"))
    q = n.select(
        F.when(k == 0, F.concat(F.lit("D"), i)).when(k == 1, F.concat(F.lit("n"), i)).when(k == 2, F.col("path")).when(k == 3, F.concat("path", F.lit(".md")))
        .when(k == 4, i).when(k == 5, lang_path).otherwise(F.concat(F.lit("nothing"), i)).alias("query")
    )
    return N.find_notes(n, q, N.frontmatter_rows(n)).select("query", "note_id", "rule")


_RESCAN = "p AS (SELECT doc_id, 'd/' || lang || '/n' || doc_id AS path, 'n' || doc_id AS name FROM documents)"


@query(
    "rescan_diff",
    f"WITH {_RESCAN} SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS added, count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 4 <> 0) AS removed, count(*) FILTER (WHERE NOT (doc_id % 5 = 0 AND doc_id % 4 <> 0)) AS total FROM p",
)
def rescan_diff(spark, sf):
    return _rescanned(spark, sf)[1]


def _rescanned(spark, sf):
    n = I.notes(spark, sf).select("note_id", "path", "name")
    old, new = n.where("note_id % 4 <> 0"), n.where("NOT (note_id % 5 = 0 AND note_id % 4 <> 0)")
    return N.rescan_diff(old, new)


@query("rescan_added", f"WITH {_RESCAN} SELECT path, name FROM p WHERE doc_id % 4 = 0")
def rescan_added(spark, sf):
    """The notes that a new scan finds and an old one doesn't."""
    return _rescanned(spark, sf)[0]


@query(
    "resolve_sidecars",
    f"{_P} SELECT note_id, 'body-callout' AS method, CASE note_id % 3 WHEN 2 THEN 'medium' ELSE 'medium' END AS confidence, CASE note_id % 3 WHEN 0 THEN 'img/p1_' || note_id || '.jpg' WHEN 1 THEN 'other/p1_' || note_id || '.jpg' END AS image_file, 2::BIGINT AS n_pages FROM page1",
)
def resolve_sidecars(spark, sf):
    n = I.notes(spark, sf)
    imgs = _images(spark, sf)
    name = F.substring_index("image_path", "/", -1)
    files = imgs.select(
        F.col("image_path").alias("path"), F.regexp_replace("image_path", "/?[^/]*$", "").alias("folder"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("basename"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"),
    )
    r = N.resolve_sidecars(n.withColumn("path", F.concat("path", F.lit(".md"))), files, N.frontmatter_rows(n))
    return r.select("note_id", "method", "confidence", "image_file", "n_pages")


@query(
    "strip_wikilink",
    "SELECT doc_id AS note_id, '前 ' || lang || '会 と ' || source || ' 後 頁' AS text FROM documents",
)
def strip_wikilink(spark, sf):
    d = I.table(spark, sf, "documents")
    raw = F.concat(F.lit("前 [[記録/👤"), "lang", F.lit("会.md]] と [[x|"), "source", F.lit("]] 後 [[a/頁#節]]"))
    return d.select(F.col("doc_id").alias("note_id"), T.strip_wikilink(raw).alias("text"))


# --- replay and evaluation ---------------------------------------------------------------------------
@query("replay_corrections")
def replay_corrections(spark, sf):
    """Replay of corrections taken from an analysis of the same notes (checked in the tests)."""
    n = I.notes(spark, sf, I.grammar).withColumn("note_id", F.col("note_id").cast("string"))
    cfg = A.AnalyzeConfig(use_frontmatter=False, use_body=False)
    s = A.analyze(n, cfg)
    rows = written(s.select(
        F.col("note_id").alias("doc_id"), "page", F.col("page").alias("save_page"), "span_id", "occurrence_index", "suspect_span",
        F.get("candidates", F.lit(0)).alias("selected_candidate"), F.lit("single").alias("correction_mode"), F.col("start").alias("ord"),
    ))
    return R.replay_corrections(n, rows, cfg)


@query("evaluate_summary")
def evaluate_summary(spark, sf):
    """Proper-noun events by region over whole notes (checked in the tests)."""
    from inkfold.sources import dictionaries as SD

    from .candidate_queries import NOUN_LISTS

    cfg = A.AnalyzeConfig(proper_nouns=SD.proper_nouns_from(spark, NOUN_LISTS))
    return R.evaluate(I.notes(spark, sf, I.grammar), cfg)["summary"]
