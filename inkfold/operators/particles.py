"""Particle script: document style, particle positions, kana statistics and replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.rows import unfolded
from . import lines as L


def _style_pattern(letters: str) -> str:
    no = "ノ" if "ノ" in letters else "の"
    others = letters.replace(no, "")
    return (
        f"(?<=[{K.KANJI_KATA}])[{others}](?=[{K.KANJI_KATA}])"
        f"|(?<=[{K.KANJI}]){no}(?=[{K.KANJI_KATA}])"
    )


KATA_PARTICLES = "".join(k for k, _ in K.PARTICLE_PAIRS)
HIRA_PARTICLES = "".join(h for _, h in K.PARTICLE_PAIRS)


def style_counts_col(text: Column) -> Column:
    """struct(kata, hira): particles between kanji or katakana, in lines without modern marks."""
    kept = F.array_join(F.filter(T.split_lines(text), lambda l: ~l.rlike(K.STYLE_SKIP_LINE)), "\n")
    return T.let(
        kept,
        lambda t: F.struct(
            F.regexp_count(t, F.lit(_style_pattern(KATA_PARTICLES))).alias("kata"),
            F.regexp_count(t, F.lit(_style_pattern(HIRA_PARTICLES))).alias("hira"),
        ),
    )


def style_profile(pages: DataFrame, column: str = "clean_text") -> DataFrame:
    """Particle style of each note over all of its pages."""
    per_page = pages.select("note_id", style_counts_col(F.col(column)).alias("c"))
    sums = per_page.groupBy("note_id").agg(
        F.sum("c.kata").cast("bigint").alias("kata_particle_count"),
        F.sum("c.hira").cast("bigint").alias("hira_particle_count"),
    )
    total = F.col("kata_particle_count") + F.col("hira_particle_count")
    raw = F.when(total < K.MIN_PARTICLES, F.lit(0.0)).otherwise(F.col("kata_particle_count") / total)
    return sums.select(
        "note_id",
        F.when(total < K.MIN_PARTICLES, "insufficient")
        .when(raw >= K.DOMINANCE, "katakana_dominant")
        .when(raw <= 1.0 - K.DOMINANCE, "hiragana_dominant")
        .otherwise("mixed")
        .alias("particle_script"),
        "kata_particle_count",
        "hira_particle_count",
        F.round(raw, 3).alias("kata_ratio"),
        total.alias("total_particles"),
    )


particle_style = style_profile


_TRIO = "".join(h for h, _ in K.NORMALIZED_PARTICLES)
_TRIO_KATA = "".join(k for _, k in K.NORMALIZED_PARTICLES)
_TRIO_PATTERN = f"(?<=[{K.KANJI_KATA}])[{_TRIO}](?=[{K.KANJI_KATA}])"


def _page_hits(pages: DataFrame, column: str, rules=None) -> DataFrame:
    """Hits of に を は between kanji or katakana, by page.

    A phrase of the exclusion list is two or more hiragana long, while both neighbours of a hit
    are kanji or katakana, so no hit can lie inside a phrase: the exclusion needs no work here.
    (``drop_positions`` is the general form; the tests compare both.)
    """
    text = F.col(column)
    lines = T.newline_lines(text)
    if rules is not None:
        # an excluded line is blanked at its own length, which keeps every offset; a line without hits need not be asked
        lines = F.transform(
            lines,
            lambda l: F.when(l.rlike(_TRIO_PATTERN) & (L.line_status_col(l, rules) == "exclude"), F.repeat(F.lit(" "), F.char_length(l))).otherwise(l),
        )
    scanned = F.array_join(lines, "\n") if rules is not None else text
    found = unfolded(pages, ["note_id", "page"], T.matches(scanned, _TRIO_PATTERN, text, 4), "m")
    return found.select(
        "note_id", "page", F.col("m.start").alias("start"), (F.col("m.start") + 1).alias("end"), F.col("m.text").alias("hira"),
        F.concat("m.before", F.lit("【"), "m.text", F.lit("】"), "m.after").alias("sample"),
    ).withColumn("kata", F.translate("hira", _TRIO, _TRIO_KATA))


def particle_hits(pages: DataFrame, doc_type: DataFrame | None = None, column: str = "clean_text") -> DataFrame:
    """Particle positions on classical pages (all pages when no types are given), without a line filter."""
    if doc_type is not None:
        classical = doc_type.where(F.col("doc_type") == "classical").select("note_id", "page")
        pages = pages.join(classical, ["note_id", "page"], "left_semi")
    return _page_hits(pages, column)


def particle_count(hits: DataFrame) -> DataFrame:
    return hits.groupBy("note_id", "page").agg(F.count(F.lit(1)).alias("particle_count"))


def particle_samples(hits: DataFrame, n: int = 3) -> DataFrame:
    """Per page and particle: count and the first ``n`` marked contexts (at least one row per kind found)."""
    w = W.partitionBy("note_id", "page", "hira").orderBy("start")
    ranked = hits.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy("note_id", "page", "hira", "kata").agg(
        F.count(F.lit(1)).alias("count"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("_rn") <= n, F.struct("start", "sample")))),
            lambda x: x["sample"],
        ).alias("samples"),
    )


def sample_n(hits: DataFrame, n: int, keys=("note_id", "page", "hira"), order: str = "start") -> DataFrame:
    """The first ``n`` rows of each group."""
    w = W.partitionBy(*keys).orderBy(order)
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def drop_positions(hits: DataFrame, blocked: DataFrame) -> DataFrame:
    """Hits whose (note_id, page, start) is not among the blocked positions (note_id, page, pos)."""
    b = blocked.select("note_id", "page", F.col("pos").alias("start"))
    return hits.join(b, ["note_id", "page", "start"], "left_anti")


def phrase_positions(pages: DataFrame, phrases=K.PARTICLE_PHRASES, column: str = "clean_text") -> DataFrame:
    """Every character position inside a match of the phrase list: note_id, page, pos."""
    pattern = "|".join(phrases)
    cut = F.split(column, pattern, -1)
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    spans = F.aggregate(
        F.arrays_zip(cut.alias("c"), found.alias("f")),
        F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int>>").alias("a")),
        lambda acc, z: F.struct(
            (acc["p"] + F.char_length(F.coalesce(z["c"], F.lit(""))) + F.char_length(F.coalesce(z["f"], F.lit("")))).cast("int").alias("p"),
            F.when(
                z["f"].isNotNull(),
                F.array_append(
                    acc["a"],
                    F.struct(
                        (acc["p"] + F.char_length(z["c"])).cast("int").alias("s"),
                        (acc["p"] + F.char_length(z["c"]) + F.char_length(z["f"])).cast("int").alias("e"),
                    ),
                ),
            ).otherwise(acc["a"]).alias("a"),
        ),
        lambda acc: acc["a"],
    )
    return (
        pages.where(F.col(column).rlike(pattern))
        .select("note_id", "page", F.explode(spans).alias("x"))
        .select("note_id", "page", F.explode(F.sequence(F.col("x.s"), F.col("x.e") - 1)).alias("pos"))
    )


def particle_scan(pages: DataFrame, rules=None, column: str = "clean_text") -> DataFrame:
    """Particle positions outside excluded lines, with highlight ids."""
    hits = _page_hits(pages, column, L.default_rules() if rules is None else rules)
    return hits.withColumn("id", F.concat(F.lit("particle_"), "hira", F.lit("_"), F.col("start").cast("string")))


def particle_apply_col(text: Column, rules=None) -> Column:
    rules = L.default_rules() if rules is None else rules

    def fix(l):
        done = l
        for hira, kata in K.NORMALIZED_PARTICLES:
            done = F.regexp_replace(done, f"(?<=[{K.KANJI_KATA}]){hira}(?=[{K.KANJI_KATA}])", kata)
        return F.when(~l.rlike(_TRIO_PATTERN) | (L.line_status_col(l, rules) == "exclude"), l).otherwise(done)

    return F.array_join(F.transform(T.newline_lines(text), fix), "\n")


def particle_apply(pages: DataFrame, rules=None, column: str = "clean_text") -> DataFrame:
    """Replace the particles outside excluded lines by katakana."""
    return pages.withColumn("new_text", particle_apply_col(F.col(column), rules))


def mismatched_particles(pages: DataFrame, style: DataFrame, column: str = "clean_text") -> DataFrame:
    """Hiragana particles of katakana documents, with katakana candidate and context."""
    pattern = _style_pattern(HIRA_PARTICLES)
    text = F.col(column)
    kept = F.array_join(
        F.transform(
            T.newline_lines(text),
            lambda l: F.when(l.rlike(K.STYLE_SKIP_LINE), F.repeat(F.lit(" "), F.char_length(l))).otherwise(l),
        ),
        "\n",
    )
    dominant = style.where(F.col("particle_script") == "katakana_dominant").select("note_id")
    found = unfolded(pages.join(dominant, "note_id", "left_semi"), ["note_id", "page"], T.matches(kept, pattern, text, 4), "m")
    return found.select(
        "note_id", "page", F.col("m.start").alias("start"), (F.col("m.start") + 1).alias("end"), F.col("m.text").alias("hira"),
        F.concat("m.before", "m.text", "m.after").alias("context"),
    ).withColumn("kata_candidate", F.translate("hira", HIRA_PARTICLES, KATA_PARTICLES))


# --- kana statistics ---------------------------------------------------------------
def kana_ratio(pages: DataFrame, column: str = "ocr_text") -> DataFrame:
    """Per note: katakana over all kana, null without kana; with the bulk replacement flag."""
    c = F.coalesce(F.col(column), F.lit(""))
    sums = pages.groupBy("note_id").agg(
        F.sum(F.regexp_count(c, F.lit(f"[{K.HIRAGANA}]"))).cast("bigint").alias("hira"),
        F.sum(F.regexp_count(c, F.lit(f"[{K.KATAKANA}]"))).cast("bigint").alias("kata"),
    )
    ratio = F.try_divide(F.col("kata"), F.col("hira") + F.col("kata"))
    return sums.select("note_id", "hira", "kata", ratio.alias("kana_ratio"))


def bulk_katakana_eligible(ratio: Column, threshold: float = K.BULK_KATAKANA_MIN) -> Column:
    return F.coalesce(ratio >= max(threshold, K.BULK_KATAKANA_MIN), F.lit(False))


def kana_frequency(pages: DataFrame, by=("note_id", "page"), column: str = "ocr_text") -> DataFrame:
    """Count of each hiragana letter."""
    kana = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "[^ぁ-ゖ]", "")
    return (
        pages.withColumn("_k", kana)
        .where(F.col("_k") != "")
        .select(*by, F.explode(F.split("_k", "", -1)).alias("hira"))
        .groupBy(*by, "hira")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("kata", T.hira_to_kata(F.col("hira")))
    )


def hiragana_apply(pages: DataFrame, column: str = "ocr_text") -> DataFrame:
    """All hiragana of a text to katakana."""
    return pages.withColumn("new_text", T.hiragana_apply_text(F.col(column))).withColumn(
        "converted", F.regexp_count(column, F.lit(f"[{K.HIRAGANA}]"))
    )
