"""Inputs derived from the driver tables, once for Spark and once as SQL text.

The tables hold European prose, so kana texts are made from them by a fixed letter mapping: every
row and every character of the source takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.rows import unfolded
from inkfold.session import spread

LETTERS = "abcdefghijklmnopqrstuvwxyz"
KANA = "山会村論訴候ハ申ニ立人判ヲ地にノ候をはナリ所テ木ト裁"
KATAKANA = "山会村論訴候ハ申ニりわ判ヲ地ノテよトヘナリ所立に人は"
GRAMMAR_FROM = "theaionsrlducmfpgbwvykxqjz.,!?"
GRAMMAR_TO = "申立候レルテ共仕地村論一〇、会人裁判ノニをはにトハヲ。、！？"
NL = "\n"


TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# --- texts ------------------------------------------------------------------------
def documents(spark, sf_dir, letters=KANA, source="documents") -> DataFrame:
    return table(spark, sf_dir, source).select(
        F.col("doc_id").alias("note_id"), F.lit(1).alias("page"), F.translate(F.lower("text"), LETTERS, letters).alias("text"),
        "lang", "source",
    )


def kana(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, KANA)


def katakana(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, KATAKANA)


def grammar(spark, sf_dir) -> DataFrame:
    """Texts rich in word forms and symbols; each gets four noise lines at its end."""
    t = table(spark, sf_dir, "documents")
    g = F.translate(F.lower("text"), GRAMMAR_FROM, GRAMMAR_TO)
    return t.select(
        F.col("doc_id").alias("note_id"), F.lit(1).alias("page"), "lang", "source",
        F.concat(
            g, F.lit(NL), F.lit("一〇、〇〇、一一、〇一"), F.lit(NL), F.repeat(F.substring(g, 1, 1), 30), F.lit(NL),
            F.lit("□□"), "source", F.lit("・.、……。・。です"), F.lit(NL), F.lit("候也"), "lang", F.lit("である。"),
        ).alias("text"),
    )


def talk(spark, sf_dir, letters=KANA) -> DataFrame:
    """Conversations as notes of several short pages."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("note_id"), (F.col("turn") + 1).cast("int").alias("page"),
        F.translate(F.lower("text"), LETTERS, letters).alias("text"), "role",
    )


SQL = {
    "kana": f"kana AS (SELECT doc_id AS note_id, 1 AS page, translate(lower(text), '{LETTERS}', '{KANA}') AS text, lang, source FROM documents)",
    "katakana": f"katakana AS (SELECT doc_id AS note_id, 1 AS page, translate(lower(text), '{LETTERS}', '{KATAKANA}') AS text, lang, source FROM documents)",
    "grammar": (
        f"grammar0 AS (SELECT doc_id AS note_id, 1 AS page, lang, source, translate(lower(text), '{GRAMMAR_FROM}', '{GRAMMAR_TO}') AS g FROM documents), "
        "grammar AS (SELECT note_id, page, lang, source, g || chr(10) || '一〇、〇〇、一一、〇一' || chr(10) || repeat(substr(g, 1, 1), 30) || chr(10) "
        "|| '□□' || source || '・.、……。・。です' || chr(10) || '候也' || lang || 'である。' AS text FROM grammar0)"
    ),
    "talk": f"talk AS (SELECT conv_id AS note_id, CAST(turn + 1 AS INTEGER) AS page, translate(lower(text), '{LETTERS}', '{KANA}') AS text, role FROM conversations)",
    "talk_katakana": f"talk AS (SELECT conv_id AS note_id, CAST(turn + 1 AS INTEGER) AS page, translate(lower(text), '{LETTERS}', '{KATAKANA}') AS text, role FROM conversations)",
}


def ctes(*names: str) -> str:
    return ", ".join(SQL[n] for n in names)


def lines_cte(src: str, name: str = "lines") -> str:
    """Lines of a text table, with number and start offset."""
    return (
        f"{name}0 AS (SELECT note_id, page, unnest(string_split(text, chr(10))) AS line, "
        f"unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM {src}), "
        f"{name} AS (SELECT note_id, page, CAST(line_no AS INTEGER) AS line_no, line, CAST(coalesce(sum(length(line) + 1) OVER "
        f"(PARTITION BY note_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line_start FROM {name}0)"
    )


def chars_cte(src: str, name: str = "chars") -> str:
    """Characters of a text table with offset and neighbours."""
    return (
        f"{name}0 AS (SELECT note_id, page, unnest(string_split(text, '')) AS ch, unnest(range(0, len(string_split(text, '')))) AS pos FROM {src} WHERE text <> ''), "
        f"{name} AS (SELECT note_id, page, CAST(pos AS INTEGER) AS pos, ch, lag(ch) OVER w AS before, lead(ch) OVER w AS after "
        f"FROM {name}0 WINDOW w AS (PARTITION BY note_id, page ORDER BY pos))"
    )


KK = "'[一-龠々ァ-ヶ]'"


def is_kk(col: str) -> str:
    return f"coalesce(regexp_full_match({col}, {KK}), false)"


# --- notes -------------------------------------------------------------------------
def notes(spark, sf_dir, texts=kana) -> DataFrame:
    """Documents as Markdown notes: frontmatter, body, a page with an OCR block, a page without one."""
    k = texts(spark, sf_dir)
    md = F.concat(
        F.lit("---\nid: D"), F.col("note_id").cast("string"), F.lit("\nregion: 尾張\nperson: '[[人/👤田中"), "lang", F.lit("]]・山田一郎'\nplaintiff: [村山人民, 山会村論]\ntags: [古文]\n---\n"),
        F.lit("# 題\n本文 [[記録/"), "lang", F.lit("会.md|控訴"), "lang", F.lit("]] の件、入会［原告］"), "source", F.lit("\n"),
        F.lit("- **裁判官**: [[佐藤"), "lang", F.lit("]] 判事補\n- 備品：机\n"),
        F.lit("![[img/p1_"), F.col("note_id").cast("string"), F.lit(".jpg]]\n> [!OCR]\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")),
        F.lit("\n> [!memo]\n> 覚書"), "lang", F.lit("\n\n![[p2_"), F.col("note_id").cast("string"), F.lit(".png|w]]\n"),
    )
    return k.select("note_id", F.concat(F.lit("d/"), "lang", F.lit("/n"), F.col("note_id").cast("string")).alias("path"),
                    F.concat(F.lit("n"), F.col("note_id").cast("string")).alias("name"), md.alias("md"), "text", "lang", "source")


# the text of page 1: every line stripped, the whole stripped
SQL["page1"] = (
    "page1 AS (SELECT note_id, lang, source, trim(array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(l)), chr(10)), ' ' || chr(10)) AS ocr FROM kana)"
)


# --- word lists ---------------------------------------------------------------------
def word_lists(spark, sf_dir) -> DataFrame:
    """Distinct words of each kana document, two letters and more, in one row."""
    w = F.array_distinct(F.filter(F.split("text", r"[ \n.,!?\"()]+", -1), lambda x: F.char_length(x) >= 2))
    return kana(spark, sf_dir).select("note_id", "page", w.alias("words"))


def words(spark, sf_dir, lists: DataFrame | None = None) -> DataFrame:
    """The same words in rows; ``lists``: those of :func:`word_lists`, where a query reads them several times and so has written them."""
    return unfolded(word_lists(spark, sf_dir) if lists is None else lists, ["note_id", "page"], "words", "suspect_span").drop("_at")


SQL["words"] = (
    "words AS (SELECT note_id, page, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ \\n.,!?\"()]+'), lambda x: length(x) >= 2))) AS suspect_span FROM kana)"
)


def terms(spark, sf_dir) -> DataFrame:
    """A vocabulary from the benchmark texts: one term per item and word."""
    b = table(spark, sf_dir, "benchmark")
    t = F.translate(F.lower("text"), LETTERS, KANA)
    w = F.array_sort(F.array_distinct(F.filter(F.split(t, r"[ \n.,]+", -1), lambda x: F.char_length(x) >= 2)))
    rows = b.select("item_id", F.posexplode(w).alias("i", "term"))
    return rows.select(
        "term", F.concat("term", (F.col("item_id") % 2).cast("string")).alias("normalized"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.concat(F.lit("異"), "term"))).otherwise(F.array().cast("array<string>")).alias("variants"),
        F.lit("").alias("reading"), F.lit("語").alias("category"), F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string")).alias("domain"),
        ((F.col("item_id") % 10) / 10).alias("priority"), (F.col("item_id") % 5 == 0).alias("protect"), F.lit("benchmark").alias("source"),
        F.lit(True).alias("approved"), F.when(F.col("item_id") % 4 == 0, "experimental").otherwise("stable").alias("tier"),
        (F.col("item_id") * 100000 + F.col("i")).cast("bigint").alias("seq"), F.concat(F.lit("f"), (F.col("item_id") % 4).cast("string"), F.lit(".csv")).alias("source_file"),
    )


SQL["terms"] = (
    f"terms0 AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(lower(text), '{LETTERS}', '{KANA}'), '[ \\n.,]+'), lambda x: length(x) >= 2))) AS ws FROM benchmark), "
    "terms1 AS (SELECT item_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS i FROM terms0), "
    "terms AS (SELECT term, term || CAST(item_id % 2 AS VARCHAR) AS normalized, CASE WHEN item_id % 3 = 0 THEN '異' || term END AS variant, "
    "'d' || CAST(item_id % 3 AS VARCHAR) AS domain, (item_id % 10) / 10.0 AS priority, item_id % 5 = 0 AS protect, "
    "CASE WHEN item_id % 4 = 0 THEN 'experimental' ELSE 'stable' END AS tier, item_id * 100000 + i AS seq, 'f' || CAST(item_id % 4 AS VARCHAR) || '.csv' AS source_file FROM terms1)"
)
SQL["forms"] = (
    "forms AS (SELECT term AS form, 0 AS form_ord, * FROM terms UNION ALL SELECT normalized, 1, * FROM terms "
    "UNION ALL SELECT variant, 2, * FROM terms WHERE variant IS NOT NULL)"
)


def shape_pairs(spark, sf_dir) -> DataFrame:
    """Look-alike pairs from the vocabulary: a word and its reverse."""
    return terms(spark, sf_dir).where(F.col("seq") % 3 == 0).select(
        F.col("term").alias("wrong"), F.reverse("term").alias("correct"), (F.lit(30.0) + F.floor(F.col("seq") / 100000) % 40).alias("score"),
        F.when(F.col("seq") % 2 == 0, "any").otherwise("classical_jp").alias("context"), F.col("seq").cast("int").alias("seq"),
    )


SQL["shapes"] = (
    "shapes AS (SELECT term AS wrong, reverse(term) AS correct, 30.0 + floor(seq / 100000) % 40 AS score, CASE WHEN seq % 2 = 0 THEN 'any' ELSE 'classical_jp' END AS context, seq FROM terms WHERE seq % 3 = 0)"
)


def hints(spark, sf_dir, lists: DataFrame | None = None) -> DataFrame:
    """Hints of each note, from its own words."""
    n = F.char_length("suspect_span")
    return words(spark, sf_dir, lists).select(
        "note_id", F.concat("suspect_span", (n % 2).cast("string")).alias("term"), (F.lit(12.0) + (n * 7) % 20).alias("bonus"),
        (n % 3 != 0).alias("is_proper"), (n % 4 == 0).alias("is_geo"), n.cast("bigint").alias("ord"),
        F.when(n % 5 == 0, F.array(F.lit("frontmatter:person"))).when(n % 5 == 1, F.array(F.lit("body:text"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )


SQL["hints"] = (
    "hints AS (SELECT note_id, suspect_span || CAST(length(suspect_span) % 2 AS VARCHAR) AS term, 12.0 + (length(suspect_span) * 7) % 20 AS bonus, "
    "length(suspect_span) % 3 <> 0 AS is_proper, length(suspect_span) % 4 = 0 AS is_geo, CAST(length(suspect_span) AS BIGINT) AS ord, "
    "length(suspect_span) % 5 = 0 AS from_fm, length(suspect_span) % 5 = 1 AS from_body FROM words)"
)


# --- review logs ----------------------------------------------------------------------
EVENT_NAMES = {
    "view": "span_accepted", "click": "span_rejected", "error": "span_skipped",
    "purchase": "dictionary_setting_changed", "signup": "manual_selection_corrected",
}


def actions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])
    i, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    return e.select(
        F.element_at(name, F.col("event_type")).alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.concat(F.lit("u"), s(u)).alias("docId"), F.concat(F.lit("p1_o0_s"), s(i % 40)).alias("spanId"),
        F.concat(F.lit("語"), s((i * 7 + u) % 53)).alias("suspectSpan"), F.concat(F.lit("候"), s(i % 5)).alias("chosenCandidate"),
        F.array(F.lit("候0"), F.lit("候1"), F.concat(F.lit("候"), s(u % 7))).alias("candidateList"), (i % 3 == 0).alias("wasBigramSuspect"),
        F.when(u % 2 == 0, "katakana_dominant").otherwise("mixed").alias("particleScript"), (i % 5 == 0).alias("dismissedDangerFlag"),
        F.when(i % 4 != 0, (i % 3 - 1).cast("int")).alias("candidateRank"), F.when(i % 11 == 0, "manual_override_seed").alias("hintSource"),
        F.when(u % 3 != 1, u % 3 == 0).alias("rank1FromExperimental"), (i % 6 == 0).alias("isDangerous"),
        F.when(i % 2 == 0, "reject").otherwise("overlay").alias("dismissTrigger"), (F.col("value") > 12).alias("new_value"), (F.col("value") <= 12).alias("old_value"),
        F.lit("success").alias("reload_result"), F.lit(None).cast("bigint").alias("elapsedMs"), i.alias("line_no"),
    )


SQL["actions"] = (
    "actions AS (SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END AS event, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, 'u' || user_id AS docId, 'p1_o0_s' || (event_id % 40) AS spanId, "
    "'語' || ((event_id * 7 + user_id) % 53) AS suspectSpan, '候' || (event_id % 5) AS chosenCandidate, ['候0', '候1', '候' || (user_id % 7)] AS candidateList, "
    "event_id % 3 = 0 AS wasBigramSuspect, CASE WHEN user_id % 2 = 0 THEN 'katakana_dominant' ELSE 'mixed' END AS particleScript, event_id % 5 = 0 AS dismissedDangerFlag, "
    "CASE WHEN event_id % 4 <> 0 THEN event_id % 3 - 1 END AS candidateRank, CASE WHEN event_id % 11 = 0 THEN 'manual_override_seed' END AS hintSource, "
    "CASE WHEN user_id % 3 <> 1 THEN user_id % 3 = 0 END AS rank1FromExperimental, event_id % 6 = 0 AS isDangerous, "
    "CASE WHEN event_id % 2 = 0 THEN 'reject' ELSE 'overlay' END AS dismissTrigger, value > 12 AS new_value, event_id AS line_no, user_id FROM events)"
)


def register_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    op = F.when(F.col("event_type") == "error", "toggle").when(F.col("event_type") == "purchase", "update").otherwise("register")
    return e.select(
        F.concat(F.lit("f"), (u % 5).cast("string"), F.lit(".csv")).alias("file"), F.concat(F.lit("語"), u.cast("string")).alias("term"), op.alias("op"),
        F.when(op == "register", F.concat(F.lit("n"), (i % 2).cast("string"))).when(op == "update", F.concat(F.lit("n"), (i % 3).cast("string"))).alias("normalized"),
        F.when(op == "toggle", i % 2 == 0).alias("enabled"), "ts", i.alias("seq"),
    )


SQL["register_events"] = (
    "register_events0 AS (SELECT *, CASE event_type WHEN 'error' THEN 'toggle' WHEN 'purchase' THEN 'update' ELSE 'register' END AS op FROM events), "
    "register_events AS (SELECT 'f' || (user_id % 5) || '.csv' AS file, '語' || user_id AS term, op, CASE op WHEN 'register' THEN 'n' || (event_id % 2) WHEN 'update' THEN 'n' || (event_id % 3) END AS normalized, "
    "CASE WHEN op = 'toggle' THEN event_id % 2 = 0 END AS enabled, ts, event_id AS seq FROM register_events0)"
)


def corrections(spark, sf_dir) -> DataFrame:
    """Correction rows with repeated ids, blank ids and a few invalid rows."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        u.cast("string").alias("doc_id"), (i % 3 + 1).cast("int").alias("page"), (i % 3 + 1).cast("int").alias("save_page"),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("p1_o0_s"), (i % 17).cast("string"))).alias("span_id"), (i % 4).cast("int").alias("occurrence_index"),
        F.concat(F.lit("語"), (i % 9).cast("string")).alias("suspect_span"), F.lit(None).cast("string").alias("original_text"),
        F.when(i % 29 != 0, F.concat(F.lit("候"), (i % 6).cast("string"))).alias("selected_candidate"), F.when(i % 2 == 0, (i % 5).cast("int")).alias("candidate_rank"),
        (i % 7 == 0).alias("is_manual_input"), F.col("value").alias("time_per_correction"), F.lit("").alias("exported_at"),
        F.when(i % 31 != 0, "single").alias("correction_mode"), F.lit(None).cast("string").alias("cleanup_rule"), i.alias("ord"),
    )


SQL["corrections"] = (
    "corrections AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id % 3 + 1 AS INTEGER) AS page, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'p1_o0_s' || (event_id % 17) END AS span_id, "
    "CAST(event_id % 4 AS INTEGER) AS occurrence_index, '語' || (event_id % 9) AS suspect_span, CASE WHEN event_id % 29 <> 0 THEN '候' || (event_id % 6) END AS selected_candidate, "
    "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS INTEGER) END AS candidate_rank, event_id % 7 = 0 AS is_manual_input, value AS time_per_correction, "
    "CASE WHEN event_id % 31 <> 0 THEN 'single' END AS correction_mode, event_id AS ord FROM events)"
)
