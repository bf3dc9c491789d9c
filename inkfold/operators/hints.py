"""Context hints: tokens from metadata, frontmatter and body, regions, proper nouns.

A hint's bonus is ``fixed + scaled * multiplier``: only the part that comes from the note's region
depends on how often the region is named on the page at hand.  Keeping both parts makes one row
per (note, term) enough, and one per (region, term) for the noun lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.rows import unfolded
from .pages import marked_lines

NO_REGION, OTHER_REGION = "", "#other"
_TOKENS = "array<struct<token:string,source:string>>"


# --- tokens -------------------------------------------------------------------
def _value_tokens(value: Column, is_text: Column) -> Column:
    tokens = F.when(is_text, T.split_tokens(T.strip_wikilink(value), K.FRONTMATTER_SPLIT)).otherwise(F.array(value))
    return F.filter(tokens, lambda t: ~T.is_noise_token(t))


def _with_sources(rows: DataFrame) -> DataFrame:
    """(note_id, token, source, ord) to one row per token with its sources in first-seen order."""
    first = rows.groupBy("note_id", "token", "source").agg(F.min("ord").alias("ord"))
    return first.groupBy("note_id", "token").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]).alias("sources"),
        F.min("ord").alias("ord"),
    )


def frontmatter_tokens(frontmatter: DataFrame) -> DataFrame:
    """Tokens of all but the skipped keys: note_id, token, sources ('frontmatter:<key>'), ord."""
    rows = frontmatter.where(~F.col("key").isin(*K.FRONTMATTER_SKIP_KEYS) & F.col("value").isNotNull()).withColumnRenamed("ord", "_o")
    rows = unfolded(rows, ["note_id", "key", "_o"], _value_tokens(F.col("value"), F.col("is_text")), "token", "_i")
    return _with_sources(
        rows.select(
            "note_id", "token", F.concat(F.lit("frontmatter:"), "key").alias("source"),
            (F.col("_o") * 1000000 + F.col("_i")).cast("bigint").alias("ord"),
        )
    )


def body_lines_col(md: Column) -> Column:
    """Lines outside the frontmatter, OCR blocks, callout headers and inline-code lines, unquoted."""
    def after_frontmatter(lines):
        fences = F.transform(lines, lambda l: l["raw"].rlike(rf"(?U)^---[{K.SPACE}]*$"))
        closing = F.array_position(F.slice(fences, 2, F.greatest(F.size(fences), F.lit(1))), True)
        start = F.when(F.coalesce(F.get(fences, F.lit(0)), F.lit(False)) & (closing > 0), closing + 1).otherwise(F.lit(0))
        return F.slice(lines, (start + 1).cast("int"), F.size(lines))

    body = T.let(marked_lines(md), after_frontmatter)

    def merge(acc, l):
        plain = F.when(
            F.startswith(l["s"], F.lit(">")), T.strip(F.substring(l["s"], F.lit(2), F.char_length(l["s"])))
        ).otherwise(l["s"])
        keep = (
            (l["s"] != "") & ~l["callout"] & ~acc["ocr"] & ~l["raw"].rlike(rf"(?U)^[{K.SPACE}]*`[^`]") & (plain != "")
        )
        return F.struct(
            F.when(l["s"] == "", F.lit(False)).when(l["callout"], l["header"]).otherwise(acc["ocr"]).alias("ocr"),
            F.when(keep, F.array_append(acc["out"], plain)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(False).alias("ocr"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(body, zero, merge, lambda acc: acc["out"])


def _body_line_tokens(line: Column) -> Column:
    item = line.rlike(rf"(?U)^[-*][{K.SPACE}]+")
    content = F.when(item, F.regexp_replace(line, rf"(?U)^[-*][{K.SPACE}]+", "")).otherwise(line)
    links = F.flatten(F.transform(T.wikilink_texts(content), lambda w: T.split_tokens(w, K.BODY_SPLIT)))
    rest = T.without_wikilinks(content)
    label_pattern = rf"(?U)^(?:\*\*)?(.+?)(?:\*\*)?[{K.SPACE}]*[:：][{K.SPACE}]*(.*)"
    trimmed = T.strip(rest)
    label = T.strip(F.regexp_extract(trimmed, label_pattern, 1))
    value = T.strip(F.regexp_extract(trimmed, label_pattern, 2))
    body = (
        F.when(~item | ~trimmed.rlike(label_pattern), rest)
        .when(label.isin(*K.BODY_SKIP_LABELS), value)
        .otherwise(F.concat(label, F.lit(" "), value))
    )
    words = T.split_tokens(T.strip_emoji(body), K.BODY_SPLIT)

    def tagged(tokens, source):
        return F.transform(
            F.filter(tokens, lambda t: ~T.is_noise_token(t)), lambda t: F.struct(t.alias("token"), source.alias("source"))
        )

    source = F.when(item, F.lit("body:list_value")).otherwise(F.lit("body:text"))
    return F.concat(tagged(links, F.lit("body:wikilink")), tagged(words, source)).cast(_TOKENS)


def body_tokens_col(md: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(body_lines_col(md), _body_line_tokens)))


def body_tokens(notes: DataFrame) -> DataFrame:
    """Tokens of the text around the OCR blocks: note_id, token, sources, ord."""
    rows = unfolded(notes, ["note_id"], body_tokens_col(F.col("md")), "x", "ord")
    return _with_sources(rows.select("note_id", "x.token", "x.source", F.col("ord").cast("bigint").alias("ord")))


def metadata_tokens(frontmatter: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Tokens of the file name (note_id, name) and of the known fields, one row per occurrence."""
    rank = F.array_position(F.array(*[F.lit(k) for k in K.METADATA_KEYS]), F.col("key"))
    rows = frontmatter.where(F.col("key").isin(*K.METADATA_KEYS) & F.col("is_text")).select(
        "note_id", (rank * 1000000 + F.col("ord") * 1000).cast("bigint").alias("_o"), "value"
    )
    if names is not None:
        rows = rows.unionByName(
            names.select("note_id", F.lit(0).cast("bigint").alias("_o"), F.col("name").alias("value"))
        )
    rows = unfolded(rows, ["note_id", "_o"], T.split_tokens(F.col("value"), K.METADATA_SPLIT), "token", "_i")
    return rows.where(F.char_length("token") >= 2).select("note_id", "token", (F.col("_o") + F.col("_i")).alias("ord"))


# --- regions --------------------------------------------------------------------
def region_alias_table(spark: SparkSession) -> DataFrame:
    rows = [(alias, region, i) for region, aliases in K.REGION_ALIASES.items() for i, alias in enumerate(aliases)]
    return spark.createDataFrame(rows, "alias string, region string, ord int")


def normalize_region(notes: DataFrame, region_alias: DataFrame) -> DataFrame:
    """Column ``region``: the prefecture of an alias, else the value itself."""
    m = region_alias.select(F.col("alias").alias("region"), F.col("region").alias("_r"))
    return notes.join(m, "region", "left").withColumn("region", F.coalesce("_r", "region")).drop("_r")


def _alias_map() -> Column:
    return F.create_map(*[F.lit(x) for r, al in K.REGION_ALIASES.items() for a in al for x in (a, r)])


def normalize_region_col(raw: Column) -> Column:
    return F.coalesce(F.element_at(_alias_map(), raw), raw)


def region_from_text_col(name: Column) -> Column:
    """The first prefecture of the alias table a text contains; '' when none."""
    chain = None
    for region in K.REGION_ALIASES:
        hit = F.contains(name, F.lit(region))
        chain = F.when(hit, region) if chain is None else chain.when(hit, region)
    return chain.otherwise("")


def region_aliases_col(region: Column) -> Column:
    """Names of a region: its aliases, or the region itself; empty without a region."""
    table = F.create_map(
        *[x for r, al in K.REGION_ALIASES.items() for x in (F.lit(r), F.array(*[F.lit(a) for a in al]))]
    )
    return F.when(region == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(F.element_at(table, region), F.array(region))
    )


def region_multiplier_col(text: Column, region: Column) -> Column:
    hits = F.aggregate(region_aliases_col(region), F.lit(0), lambda a, x: a + T.count_literal(text, x))
    return (
        F.when((F.coalesce(region, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == ""), 1.0)
        .when(hits == 0, 0.0)
        .when(hits == 1, 0.5)
        .otherwise(1.0)
    )


def region_multiplier(pages: DataFrame, region_info: DataFrame, column: str = "clean_text") -> DataFrame:
    """Adds region and region_multiplier to pages; ``region_info``: note_id, region."""
    p = pages.join(region_info.select("note_id", "region"), "note_id", "left").withColumn(
        "region", F.coalesce("region", F.lit(""))
    )
    return p.withColumn("region_multiplier", region_multiplier_col(F.col(column), F.col("region")))


# --- proper nouns ----------------------------------------------------------------
def noun_scores(nouns: DataFrame) -> DataFrame:
    """Score of every noun row: weight bonus, capped outside the core list, less for an alias."""
    score = F.lit(K.PROPER_NOUN_BONUS) * F.col("weight")
    capped = F.when(F.col("kind") == "core", score).otherwise(F.least(score, F.lit(K.REGIONAL_CAP)))
    scope = F.when(F.col("kind") == "regional", F.col("region_key")).otherwise(F.concat(F.lit("*"), "kind"))
    return nouns.select(
        scope.alias("scope"), "kind", "term", "regions", "seq",
        F.when(F.col("is_alias"), capped * K.ALIAS_FACTOR).otherwise(capped).alias("score"),
    )


def known_regions(nouns: DataFrame) -> DataFrame:
    """Regions that can change the noun list, plus '' and one row standing for all others."""
    spark = nouns.sparkSession
    keyed = spark.createDataFrame(
        [(r, k) for r, k in K.REGION_FILE_KEYS.items()] + [(NO_REGION, None), (OTHER_REGION, None)],
        "region string, region_key string",
    )
    named = nouns.select(F.explode("regions").alias("region")).distinct()
    extra = named.join(keyed, "region", "left_anti").withColumn("region_key", F.lit(None).cast("string"))
    return keyed.unionByName(extra)


def nouns_by_region(nouns: DataFrame) -> DataFrame:
    """Noun bonuses per region: region, term, fixed, scaled, in_fixed, in_scaled, geo_fixed, ord.

    Joined on the list name, so the general lists meet the (few, bounded) regions, not the notes.
    """
    lists = known_regions(nouns).select(
        "region", F.explode(F.array_compact(F.array(F.lit("*core"), F.lit("*prefectures"), F.col("region_key")))).alias("scope")
    )
    rows = lists.join(noun_scores(nouns), "scope").where(
        (F.size("regions") == 0) | (F.col("region") == NO_REGION) | F.array_contains("regions", F.col("region"))
    )
    per_list = rows.groupBy("region", "scope", "kind", "term").agg(F.max("score").alias("score"), F.min("seq").alias("seq"))
    regional = F.col("kind") == "regional"
    return per_list.groupBy("region", "term").agg(
        F.coalesce(F.sum(F.when(~regional, F.col("score"))), F.lit(0.0)).alias("fixed"),
        F.coalesce(F.sum(F.when(regional, F.col("score"))), F.lit(0.0)).alias("scaled"),
        F.bool_or(~regional).alias("in_fixed"),
        F.bool_or(regional).alias("in_scaled"),
        F.bool_or(F.col("kind") == "prefectures").alias("geo_fixed"),
        F.min("seq").alias("ord"),
    )


def nouns_at(noun_table: DataFrame) -> DataFrame:
    """The three effective noun lists of a region: region, region_multiplier, term, bonus, is_geo, ord."""
    m = F.col("region_multiplier")
    return (
        noun_table.withColumn("region_multiplier", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
        .where(F.col("in_fixed") | (F.col("scaled") * m > 0))
        .select(
            "region", "region_multiplier", "term", (F.col("fixed") + F.col("scaled") * m).alias("bonus"),
            (F.col("geo_fixed") | (F.col("in_scaled") & (F.col("scaled") * m > 0))).alias("is_geo"), "ord",
        )
    )


def apply_proper_nouns(notes: DataFrame, nouns: DataFrame, region_info: DataFrame) -> DataFrame:
    """Nouns that count for each note: note_id, term, bonus, is_geo.

    ``region_info``: note_id, region, region_multiplier.  This spells the noun lists out per note;
    :func:`inkfold.plans.analyze.analyze` joins by region instead and never builds it.
    """
    known = known_regions(nouns).select("region", F.lit(True).alias("_k"))
    info = (
        notes.select("note_id").join(region_info, "note_id")
        .join(known, "region", "left")
        .withColumn("region", F.when(F.col("_k"), F.col("region")).otherwise(OTHER_REGION))
    )
    return info.join(nouns_at(nouns_by_region(nouns)), ["region", "region_multiplier"]).select(
        "note_id", "term", "bonus", "is_geo"
    )


# --- sums -------------------------------------------------------------------------
def contributions(metadata: DataFrame, regions: DataFrame, fm_tokens: DataFrame, body: DataFrame) -> DataFrame:
    """All hint contributions of notes: note_id, term, fixed, scaled, ord, sources.

    ``regions``: note_id, region.  ``ord`` keeps first-seen order: metadata, aliases, frontmatter, body.
    """
    none = F.array().cast("array<string>")
    base = 10**15
    aliases = regions.select("note_id", "region", region_aliases_col(F.col("region")).alias("aliases"))
    named = F.array_contains("aliases", F.col("token"))
    bonus = F.lit(K.METADATA_BONUS)
    meta = metadata.join(aliases.select("note_id", "aliases"), "note_id", "left").select(
        "note_id", F.col("token").alias("term"),
        F.when(F.coalesce(named, F.lit(False)), 0.0).otherwise(bonus).alias("fixed"),
        F.when(F.coalesce(named, F.lit(False)), bonus).otherwise(0.0).alias("scaled"),
        F.col("ord").cast("bigint").alias("ord"), none.alias("sources"),
    )
    alias_rows = aliases.select("note_id", F.posexplode("aliases").alias("_i", "term")).select(
        "note_id", "term", F.lit(0.0).alias("fixed"), F.lit(K.REGION_ALIAS_BONUS).alias("scaled"),
        (F.lit(base) + F.col("_i")).cast("bigint").alias("ord"), none.alias("sources"),
    )
    fm = fm_tokens.select(
        "note_id", F.col("token").alias("term"), F.lit(K.FRONTMATTER_BONUS).alias("fixed"), F.lit(0.0).alias("scaled"),
        (F.lit(2 * base) + F.col("ord")).cast("bigint").alias("ord"), "sources",
    )
    bd = body.select(
        "note_id", F.col("token").alias("term"), F.lit(K.BODY_BONUS).alias("fixed"), F.lit(0.0).alias("scaled"),
        (F.lit(3 * base) + F.col("ord")).cast("bigint").alias("ord"), "sources",
    )
    return meta.unionByName(alias_rows).unionByName(fm).unionByName(bd)


def hint_sum(contribs: DataFrame) -> DataFrame:
    """Sum the contributions per note and term."""
    return contribs.groupBy("note_id", "term").agg(
        F.sum("fixed").alias("fixed"),
        F.sum("scaled").alias("scaled"),
        F.min("ord").alias("ord"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )
