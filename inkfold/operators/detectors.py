"""Text detectors: page text in, suspicious spans out.

Each detector is a column expression giving an array of findings for one page text, so that a
whole set of them runs in one pass over the pages without a shuffle.  The DataFrame operators
are thin selections over these expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.rows import unfolded

VERDICT = (
    "struct<verdict:string,score:double,reason:string,image_audit_required:boolean,"
    "suggestion:struct<suggested_candidate:string,suggestion_reason:string,"
    "suggestion_confidence:double,suggestion_type:string>>"
)
FINDING = (
    "struct<suspect_span:string,reason:string,confidence:double,is_protected:boolean,"
    "category:string,detector:string,forced:string,bigram:string,direct:array<string>,"
    f"verdict:{VERDICT}>"
)


def _finding(text, reason, confidence, category, detector, *, protected=None, forced=None,
             bigram=None, direct=None, verdict=None) -> Column:
    as_col = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        as_col(text, "string").alias("suspect_span"),
        as_col(reason, "string").alias("reason"),
        as_col(confidence, "double").alias("confidence"),
        as_col(False if protected is None else protected, "boolean").alias("is_protected"),
        F.lit(category).alias("category"),
        F.lit(detector).alias("detector"),
        as_col(forced, "string").alias("forced"),
        as_col(bigram, "string").alias("bigram"),
        as_col(direct, "array<string>").alias("direct"),
        as_col(verdict, VERDICT).alias("verdict"),
    )


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _rows(df: DataFrame, findings: Column) -> DataFrame:
    return unfolded(df, ["note_id", "page"], findings, "f", "seq").select("note_id", "page", "seq", "f.*")


# --- symbols and stray alphanumerics ------------------------------------------
def symbol_runs_col(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(K.SYMBOL_RUN), F.lit(0)),
        lambda m: _finding(m, K.REASON_SYMBOLS, 0.5, "noise", "symbols"),
    )


def isolated_alnum_col(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(K.ISOLATED_ALNUM), F.lit(2)),
        lambda m: _finding(m, K.REASON_ALNUM, 0.4, "noise", "alnum"),
    )


def symbol_runs(pages: DataFrame, column: str = "clean_text") -> DataFrame:
    return _rows(pages, symbol_runs_col(F.col(column)))


def isolated_alnum(pages: DataFrame, column: str = "clean_text") -> DataFrame:
    return _rows(pages, isolated_alnum_col(F.col(column)))


# --- repetition noise ---------------------------------------------------------
def is_low_diversity(line: Column) -> Column:
    solid = F.regexp_replace(line, rf"(?U)[{K.SPACE}]", "")
    return (F.char_length(solid) >= K.LOW_DIVERSITY_MIN_CHARS) & (
        F.coalesce(T.char_diversity(line), F.lit(1.0)) < K.LOW_DIVERSITY_MAX
    )


def low_diversity_col(text: Column) -> Column:
    return F.transform(
        F.filter(T.newline_lines(text), is_low_diversity),
        lambda l: _finding(T.strip(l), K.REASON_LOW_DIVERSITY, 0.85, "noise", "low_diversity", direct=F.array(F.lit(""))),
    )


def digit_noise_col(text: Column) -> Column:
    """Digit runs outside low-diversity lines; a run never spans lines, so lines decide."""
    calm = F.filter(
        T.newline_lines(text), lambda l: l.rlike(K.DIGIT_NOISE) & ~is_low_diversity(l)
    )
    runs = F.flatten(F.transform(calm, lambda l: F.regexp_extract_all(l, F.lit(K.DIGIT_NOISE), F.lit(0))))
    return F.transform(
        runs, lambda m: _finding(m, K.REASON_DIGITS, 0.85, "noise", "digits", direct=F.array(F.lit("")))
    )


def low_diversity_lines(pages: DataFrame, column: str = "clean_text") -> DataFrame:
    return _rows(pages, low_diversity_col(F.col(column)))


def digit_noise(pages: DataFrame, column: str = "clean_text") -> DataFrame:
    return _rows(pages, digit_noise_col(F.col(column)))


def drop_line_covered(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Matches (note_id, page, line_no, ...) that lie in none of the given lines."""
    return matches.join(lines.select("note_id", "page", "line_no"), ["note_id", "page", "line_no"], "left_anti")


# --- grammar ------------------------------------------------------------------
def validate_span(text: Column, confidence: Column | None = None) -> Column:
    """Verdict on one span: the first word-form rule it contains, else by its confidence."""
    def verdict(v, score, reason, audit, suggestion=None):
        sugg = "struct<suggested_candidate:string,suggestion_reason:string,suggestion_confidence:double,suggestion_type:string>"
        return F.struct(
            F.lit(v).alias("verdict"),
            (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"),
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
            (audit if isinstance(audit, Column) else F.lit(audit)).alias("image_audit_required"),
            (F.lit(None) if suggestion is None else suggestion).cast(sugg).alias("suggestion"),
        ).cast(VERDICT)

    chain = None
    for form, v, score, reason, audit, sugg, sugg_reason, sugg_conf in K.GRAMMAR_RULES:
        suggestion = None
        if sugg is not None:
            suggestion = F.struct(
                F.lit(sugg).alias("suggested_candidate"),
                F.lit(sugg_reason).alias("suggestion_reason"),
                F.lit(sugg_conf).alias("suggestion_confidence"),
                F.lit("ocr_normalization").alias("suggestion_type"),
            )
        result = verdict(v, score, reason, audit, suggestion)
        hit = F.contains(text, F.lit(form))
        chain = F.when(hit, result) if chain is None else chain.when(hit, result)
    if confidence is not None:
        chain = (
            chain.when(confidence >= K.ACCEPT_MIN, verdict(
                "accept", F.round(confidence, 4), F.format_string(K.VERDICT_ACCEPT_BY_SCORE, confidence), False))
            .when(confidence >= K.REVIEW_MIN, verdict(
                "review", F.round(confidence, 4), F.format_string(K.VERDICT_REVIEW_BY_SCORE, confidence), False))
            .when(confidence.isNotNull(), verdict(
                "reject", F.round(confidence, 4), F.format_string(K.VERDICT_REJECT_BY_SCORE, confidence), True))
        )
    return chain


def grammar_col(text: Column) -> Column:
    def finding(m):
        v = validate_span(m)
        return _finding(m, v["reason"], v["score"], "dict", "grammar", verdict=v)

    return F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit(K.GRAMMAR_SCAN), F.lit(0))), finding
    )


def grammar_scan(pages: DataFrame, column: str = "clean_text") -> DataFrame:
    return _rows(pages, grammar_col(F.col(column)))


def recommended_verdict(verdict: Column, confidence: Column) -> Column:
    return F.coalesce(
        verdict,
        F.when(confidence >= K.ACCEPT_MIN, "accept").when(confidence >= K.REVIEW_MIN, "review").otherwise("reject"),
    )


# --- stray hiragana in katakana documents --------------------------------------
_NEAR = "(?<=[{k}])[{h}]{n}|[{h}]{n}(?=[{k}])"


def hiragana_col(text: Column, script: Column) -> Column:
    pattern = _NEAR.format(k=K.KANJI_KATA, h=K.HIRAGANA, n="")
    return F.when(
        script == "katakana_dominant",
        F.transform(
            F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            lambda m: _finding(
                m, F.format_string(K.REASON_HIRAGANA, m, T.hira_to_kata(m)), 0.40, "dict", "hiragana",
                forced=T.hira_to_kata(m),
            ),
        ),
    ).otherwise(no_findings())


def bigram_col(text: Column, script: Column) -> Column:
    pattern = _NEAR.format(k=K.KANJI_KATA, h=K.HIRAGANA, n="{2}")
    return F.when(
        script == "katakana_dominant",
        F.transform(
            F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            lambda m: _finding(
                m, F.format_string(K.REASON_BIGRAM, m, T.hira_to_kata(m)), 0.45, "dict", "bigram",
                bigram=T.hira_to_kata(m),
            ),
        ),
    ).otherwise(no_findings())


def isolated_hiragana(pages: DataFrame, style: DataFrame, column: str = "clean_text") -> DataFrame:
    p = pages.join(style.select("note_id", "particle_script"), "note_id", "left")
    return _rows(p, hiragana_col(F.col(column), F.col("particle_script")))


def hiragana_bigrams(pages: DataFrame, style: DataFrame, column: str = "clean_text") -> DataFrame:
    p = pages.join(style.select("note_id", "particle_script"), "note_id", "left")
    return _rows(p, bigram_col(F.col(column), F.col("particle_script")))


# --- OCR confidence -------------------------------------------------------------
def protected_flag(chars: DataFrame, term_forms: DataFrame) -> DataFrame:
    """Flag texts that equal a form of a protected term."""
    forms = (
        term_forms.where("protect").select(F.col("form").alias("text")).distinct().withColumn("_p", F.lit(True))
    )
    return chars.join(forms, "text", "left").withColumn("is_protected", F.coalesce("_p", F.lit(False))).drop("_p")


def low_confidence(chars: DataFrame, pages: DataFrame, threshold: float = K.OCR_CONFIDENCE_MIN,
                   column: str = "clean_text") -> DataFrame:
    """Characters (note_id, text, confidence[, is_protected]) below the threshold, on the pages holding them.

    Distinct texts of a note travel once; every page of the note then keeps the texts it contains.
    """
    flag = F.col("is_protected") if "is_protected" in chars.columns else F.lit(False)
    ordinal = F.col("ord") if "ord" in chars.columns else F.lit(0)
    low = (
        chars.where(F.col("confidence") < threshold)
        .groupBy("note_id", "text")
        .agg(F.min_by(F.struct("confidence", flag.alias("is_protected"), ordinal.alias("ord")), ordinal).alias("c"))
    )
    return (
        pages.select("note_id", "page", F.col(column).alias("_t"))
        .join(low, "note_id")
        .where(F.contains("_t", "text"))
        .select(
            "note_id", "page", F.col("c.ord").alias("seq"),
            _finding(
                F.col("text"), F.format_string(K.REASON_LOW_CONFIDENCE, F.col("c.confidence")),
                F.col("c.confidence"), "noise", "confidence", protected=F.col("c.is_protected"),
            ).alias("f"),
        )
        .select("note_id", "page", "seq", "f.*")
    )


# --- parties named in the frontmatter -------------------------------------------
def party_col(text: Column, tokens: Column) -> Column:
    """Findings for party names, whole or broken by a line end; ``tokens`` is an array of names."""
    joined = F.replace(text, F.lit("\n"), F.lit(""))
    accept = F.struct(
        F.lit("accept").alias("verdict"), F.lit(1.0).alias("score"),
        F.lit(K.VERDICT_PARTY_BROKEN).alias("reason"), F.lit(False).alias("image_audit_required"),
        F.lit(None).cast(
            "struct<suggested_candidate:string,suggestion_reason:string,suggestion_confidence:double,suggestion_type:string>"
        ).alias("suggestion"),
    )

    def finding(t):
        spread = F.array_join(F.transform(F.split(t, "", -1), T.quote), "\n*")
        head = F.substring_index(F.regexp_substr(text, spread), "\n", 1)
        return (
            F.when(F.contains(text, t), _finding(t, K.REASON_PARTY, 1.0, "file", "party"))
            .when(
                F.contains(joined, t),
                _finding(head, K.REASON_PARTY_BROKEN, 1.0, "file", "party", direct=F.array(t), verdict=accept),
            )
        )

    found = F.filter(F.transform(tokens, finding), lambda f: f.isNotNull() & (f["suspect_span"] != ""))
    return F.when(F.size(tokens) > 0, found).otherwise(no_findings())


def party_tokens(hint_sources: DataFrame, keys=K.PARTY_KEYS, min_len: int = 4) -> DataFrame:
    """Per note the names from party fields, in field order; bounded by the note's frontmatter."""
    wanted = F.exists(F.col("sources"), lambda s: s.isin(*[f"frontmatter:{k}" for k in keys]))
    order = F.col("ord") if "ord" in hint_sources.columns else F.col("token")
    return (
        hint_sources.where(wanted & (F.char_length("token") >= min_len))
        .groupBy("note_id")
        .agg(F.sort_array(F.collect_list(F.struct(order.alias("ord"), "token"))).alias("t"))
        .select("note_id", F.transform("t", lambda x: x["token"]).alias("party_tokens"))
    )


def frontmatter_confirm(pages: DataFrame, hint_sources: DataFrame, keys=K.PARTY_KEYS, min_len: int = 4,
                        column: str = "clean_text") -> DataFrame:
    p = pages.join(party_tokens(hint_sources, keys, min_len), "note_id")
    return _rows(p, party_col(F.col(column), F.col("party_tokens")))


# --- document type ---------------------------------------------------------------
def doc_type_col(text: Column, document_type: Column, era: Column) -> Column:
    """struct(type, confidence, source, kata_ratio, kata_kana_ratio, classical_density, modern_density)."""
    n = F.char_length(text)
    kata = F.regexp_count(text, F.lit(r"[\x{30A0}-\x{30FF}]"))
    hira = F.regexp_count(text, F.lit(r"[\x{3041}-\x{309F}]"))
    kata_ratio = kata / F.greatest(n, F.lit(1))
    kana_ratio = F.coalesce(F.try_divide(kata, kata + hira), F.lit(0.5))
    per = F.greatest(n / 100, F.lit(1.0))
    classical = F.regexp_count(text, F.lit(K.CLASSICAL_MARKS)) / per
    modern = F.regexp_count(text, F.lit(K.MODERN_MARKS)) / per
    return F.struct(
        document_type.alias("explicit"), era.alias("era"), n.alias("n"),
        kata_ratio.alias("kata_ratio"), kana_ratio.alias("kata_kana_ratio"),
        classical.alias("classical_density"), modern.alias("modern_density"),
    )


def _doc_type_result(m: Column) -> Column:
    score = (
        F.when(m["kata_ratio"] > 0.20, 2.0).when(m["kata_ratio"] > 0.10, 1.0).otherwise(0.0)
        + F.when(m["kata_kana_ratio"] > 0.85, 2.0).when(m["kata_kana_ratio"] > 0.60, 1.0).otherwise(0.0)
        + F.when(m["classical_density"] > 0.5, 1.5).when(m["classical_density"] > 0.1, 0.5).otherwise(0.0)
        - F.when(m["modern_density"] > 0.1, 3.0).when(m["modern_density"] > 0.01, 1.0).otherwise(0.0)
    )
    explicit = F.lower(F.coalesce(m["explicit"], F.lit("")))
    by_era = F.coalesce(m["era"], F.lit("")).rlike("|".join(K.CLASSICAL_ERAS))
    short = F.coalesce(m["n"], F.lit(0)) < 100

    def out(t, c, s):
        return F.struct(t.alias("doc_type"), c.cast("double").alias("doc_type_confidence"), F.lit(s).alias("doc_type_source"))

    return (
        F.when(explicit.isin("classical", "modern"), out(explicit, F.lit(1.0), "frontmatter"))
        .when(by_era, out(F.lit("classical"), F.lit(0.75), "frontmatter_era"))
        .when(short, out(F.lit("unknown"), F.lit(0.0), "insufficient_text"))
        .when(score >= 2.5, out(F.lit("classical"), F.round(F.least(F.lit(1.0), score / 5.5), 2), "heuristic"))
        .when(score <= -2.0, out(F.lit("modern"), F.round(F.least(F.lit(1.0), F.abs(score) / 5.0), 2), "heuristic"))
        .otherwise(out(F.lit("unknown"), F.lit(0.3), "heuristic"))
    )


def frontmatter_values(frontmatter: DataFrame, keys) -> DataFrame:
    """Per note the first value of some keys, one column per key."""
    wanted = frontmatter.where(F.col("key").isin(*keys))
    return wanted.groupBy("note_id").agg(
        *[F.min_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("ord"))).alias(k) for k in keys]
    )


def doc_type(pages: DataFrame, frontmatter: DataFrame | None = None, column: str = "clean_text") -> DataFrame:
    """Type of each page with its signals: classical, modern or unknown."""
    if frontmatter is None:
        p = pages.withColumn("document_type", F.lit(None).cast("string")).withColumn("era", F.lit(None).cast("string"))
    else:
        p = pages.join(frontmatter_values(frontmatter, ("document_type", "era")), "note_id", "left")
    p = p.withColumn("_m", doc_type_col(F.col(column), F.col("document_type"), F.col("era")))
    return p.select(
        "note_id", "page", _doc_type_result(F.col("_m")).alias("r"), "_m"
    ).select(
        "note_id", "page", "r.*",
        F.round("_m.kata_ratio", 3).alias("kata_ratio"),
        F.round("_m.kata_kana_ratio", 3).alias("kata_kana_ratio"),
        F.round("_m.classical_density", 2).alias("classical_density"),
        F.round("_m.modern_density", 2).alias("modern_density"),
    )


def effective_doc_type(page_types: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Manual choice, else the page's type, else the note's: classical if any page is, else its first known one."""
    known = F.col("doc_type") != "unknown"
    note = page_types.groupBy("note_id").agg(
        F.when(F.bool_or(F.col("doc_type") == "classical"), F.lit("classical"))
        .otherwise(F.min_by(F.when(known, F.col("doc_type")), F.when(known, F.col("page"))))
        .alias("_note_type")
    )
    joined = page_types.join(note, "note_id", "left")
    if manual is not None:
        joined = joined.join(manual.select("note_id", "page", "manual_type"), ["note_id", "page"], "left")
    else:
        joined = joined.withColumn("manual_type", F.lit(None).cast("string"))
    known_page = F.nullif(F.col("doc_type"), F.lit("unknown"))
    return joined.select(
        "note_id", "page", "doc_type",
        F.coalesce(F.nullif(F.col("manual_type"), F.lit("")), known_page, F.col("_note_type"), F.lit("unknown")).alias("effective_type"),
    )
