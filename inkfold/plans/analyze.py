"""The whole analysis: notes in, located spans with ranked candidates out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.rows import unfolded
from ..operators import candidates as C
from ..operators import detectors as D
from ..operators import hints as H
from ..operators import matching as M
from ..operators import pages as P
from ..operators import particles as PT
from ..sources.notes import frontmatter_col

KEY = C.KEY
SPAN_COLUMNS = (
    "note_id", "page", "span_id", "suspect_span", "start", "end", "occurrence_index", "reason",
    "confidence", "is_protected", "category", "detector", "candidates", "validation",
    "recommended_verdict", "is_bigram_suspect", "soft_hints", "rank1_is_proper_noun",
    "rank1_from_shape", "rank1_from_experimental_dict", "rank1_from_frontmatter",
    "rank1_from_body", "is_dangerous", "region", "region_multiplier",
)


@dataclass
class AnalyzeConfig:
    """Dictionaries and choices of an analysis; every table is optional."""

    terms: DataFrame | None = None          # term, normalized, variants, ..., tier, seq
    shape_pairs: DataFrame | None = None    # wrong, correct, score, context, seq
    proper_nouns: DataFrame | None = None   # kind, region_key, term, is_alias, regions, weight, seq
    ocr_chars: DataFrame | None = None      # note_id, text, confidence[, ord]
    domain_hint: str = ""
    fence: str = "line"                     # frontmatter ends at a line of ---, or ("any") at any later ---
    unit: str = "page"                      # "page", or "note" for the note text as one unit
    use_frontmatter: bool = True
    use_body: bool = True
    use_filename: bool = False
    confidence_threshold: float = K.OCR_CONFIDENCE_MIN


def _fenced(md: Column, config: AnalyzeConfig) -> Column:
    return P.frontmatter_block_any(md) if config.fence == "any" else P.frontmatter_block(md)


def page_profile(notes: DataFrame, config: AnalyzeConfig) -> DataFrame:
    """Pages with all that one page's analysis needs from its note, built in the row.

    Adds clean_text, script (particle style of the whole note), fm (frontmatter entries), region,
    region_multiplier and the frontmatter fields that decide the document type.
    """
    if "md" in notes.columns:
        md = F.col("md")
        name = F.col("name") if "name" in notes.columns else F.lit("")
        fm = frontmatter_col(_fenced(md, config)) if config.use_frontmatter else F.array().cast(
            "array<struct<key:string,ord:int,value:string,is_text:boolean>>"
        )
        base = notes.select("note_id", md.alias("md"), name.alias("name"), fm.alias("fm"))
        if config.unit == "note":
            pages = F.array(F.struct(F.lit("").alias("link"), md.alias("text")))
        else:
            pages = P.ocr_pages_col(md)
        base = base.withColumn("_p", pages)
        base = base.withColumn("_clean", F.transform("_p", lambda p: P.clean_text_col(p["text"])))
    else:
        raise ValueError("notes need an md column")

    counts = F.transform("_clean", PT.style_counts_col)
    zero = F.lit(0).cast("bigint")
    sums = F.aggregate(
        counts, F.struct(zero.alias("kata"), zero.alias("hira")),
        lambda a, c: F.struct((a["kata"] + c["kata"]).alias("kata"), (a["hira"] + c["hira"]).alias("hira")),
    )
    base = base.withColumn("_s", sums).withColumn("_k", F.col("_s.kata")).withColumn("_h", F.col("_s.hira"))
    total = F.col("_k") + F.col("_h")
    script = (
        F.when(total < K.MIN_PARTICLES, "insufficient")
        .when(F.col("_k") / total >= K.DOMINANCE, "katakana_dominant")
        .when(F.col("_k") / total <= 1.0 - K.DOMINANCE, "hiragana_dominant")
        .otherwise("mixed")
    )
    field = lambda key: F.get(F.filter("fm", lambda e: e["key"] == key), F.lit(0))["value"]
    raw_region = F.coalesce(F.nullif(field("region"), F.lit("")), H.region_from_text_col(F.col("name")) if config.use_filename else F.lit(""))
    base = (
        base.withColumn("script", script)
        .withColumn("region", H.normalize_region_col(raw_region))
        .withColumn("document_type", field("document_type"))
        .withColumn("era", field("era"))
    )
    return (
        unfolded(base, ["note_id", "fm", "script", "region", "document_type", "era"], "_clean", "clean_text", "_i")
        .withColumn("page", F.col("_i") + 1)
        .withColumn("region_multiplier", H.region_multiplier_col(F.col("clean_text"), F.col("region")))
        .drop("_i")
    )


def note_hints(notes: DataFrame, config: AnalyzeConfig) -> DataFrame | None:
    """Hints of each note: note_id, region, term, fixed, scaled, ord, sources.

    Kept by the executors (memory, then disk): four joins read it, and parsing the notes is the
    dear part.  What a lost executor held is computed again.
    """
    if not (config.use_frontmatter or config.use_body):
        return None
    spark = notes.sparkSession
    empty_tokens = spark.createDataFrame([], "note_id string, token string, sources array<string>, ord bigint")
    key_type = notes.schema["note_id"].dataType
    empty_tokens = empty_tokens.withColumn("note_id", F.col("note_id").cast(key_type))
    name = F.col("name") if "name" in notes.columns else F.lit("")
    if config.use_frontmatter:
        fm = notes.select("note_id", name.alias("name"), frontmatter_col(_fenced(F.col("md"), config)).alias("fm"))
        rows = unfolded(fm, ["note_id"], "fm", "x").select("note_id", "x.*")
        names = fm.select("note_id", "name") if config.use_filename else None
        meta = H.metadata_tokens(rows, names)
        field = F.get(F.filter("fm", lambda e: e["key"] == "region"), F.lit(0))["value"]
        raw = F.coalesce(F.nullif(field, F.lit("")), H.region_from_text_col(F.col("name")) if config.use_filename else F.lit(""))
        regions = fm.select("note_id", H.normalize_region_col(raw).alias("region"))
        fm_tokens = H.frontmatter_tokens(rows)
    else:
        meta = empty_tokens.select("note_id", "token", "ord")
        regions = empty_tokens.select("note_id", F.col("token").alias("region"))
        fm_tokens = empty_tokens
    body = H.body_tokens(notes) if config.use_body else empty_tokens
    summed = H.hint_sum(H.contributions(meta, regions, fm_tokens, body))
    with_region = summed.join(regions, "note_id", "left").withColumn("region", F.coalesce("region", F.lit("")))
    return with_region.persist(StorageLevel.MEMORY_AND_DISK)


def findings(pages: DataFrame, config: AnalyzeConfig, forms: DataFrame | None) -> DataFrame:
    """Pages with ``found``: the first report of every text, with its visible starts.

    The column detectors run in the row; only the dictionary (and OCR confidences) come by a join.
    """
    def grouped(rows, order):
        item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], D._finding(
            F.col("suspect_span"), F.col("reason"), F.col("confidence"), "x", "x", protected=F.col("is_protected")).alias("f"))
        return rows.groupBy("note_id", "page").agg(F.sort_array(F.collect_list(item)).alias("_x")).select(
            "note_id", "page", F.transform("_x", lambda x: x["f"]).alias("_f"))

    def labelled(a, category, detector):
        return F.transform(
            F.coalesce(a, D.no_findings()),
            lambda f: f.withField("category", F.lit(category)).withField("detector", F.lit(detector)),
        )

    text, script = F.col("clean_text"), F.col("script")
    parts = []
    p = pages
    if config.ocr_chars is not None:
        chars = config.ocr_chars
        if forms is not None:
            chars = D.protected_flag(chars, forms)
        low = D.low_confidence(chars, pages, config.confidence_threshold)
        p = p.join(grouped(low, ["seq"]).withColumnRenamed("_f", "_low"), ["note_id", "page"], "left")
        parts.append(labelled(F.col("_low"), "noise", "confidence"))
    if forms is not None:
        hits = M.dictionary_match(pages, forms)
        p = p.join(grouped(hits, ["seq", "form_ord"]).withColumnRenamed("_f", "_dict"), ["note_id", "page"], "left")
        parts.append(labelled(F.col("_dict"), "dict", "dictionary"))
    party = F.transform(
        F.filter("fm", lambda e: e["key"].isin(*K.PARTY_KEYS)),
        lambda e: F.filter(H._value_tokens(e["value"], e["is_text"]), lambda t: F.char_length(t) >= 4),
    )
    parts += [
        D.symbol_runs_col(text), D.isolated_alnum_col(text), D.low_diversity_col(text), D.digit_noise_col(text),
        D.grammar_col(text), D.hiragana_col(text, script), D.bigram_col(text, script),
        D.party_col(text, F.array_distinct(F.flatten(party))),
    ]
    p = p.withColumn("_first", F.concat(*parts))
    return p.withColumn("found", M.visible_starts_col(text, F.col("_first"))).drop("_first", "_low", "_dict")


def _final_candidates(s: DataFrame) -> DataFrame:
    """Post-steps on the ranked lists, the verdict, and the soft hint."""
    span, normal, alone = F.col("suspect_span"), F.col("lists.normal"), F.col("lists.suppressed")
    self_only = F.array(span)
    direct, forced, bigram = F.col("direct"), F.col("forced"), F.col("bigram")
    start = F.when(direct.isNotNull(), direct).otherwise(normal)
    with_forced = F.when(
        forced.isNotNull(),
        F.concat(F.array(forced), F.slice(F.filter(start, lambda c: c != forced), 1, 4)),
    ).otherwise(start)
    s = s.withColumn("_c", with_forced)
    c = F.col("_c")
    s = s.withColumn(
        "_c",
        F.when(bigram.isNull() | F.array_contains(c, bigram), c)
        .when(c == self_only, F.array(bigram, span))
        .when(F.size(c) < K.TOP_K, F.array_append(c, bigram))
        .otherwise(c),
    )
    soft_span, soft_candidate, soft_source = K.SOFT_HINT
    soft = (
        bigram.isNotNull() & (span == soft_span) & (F.col("script") == "katakana_dominant")
        & ~F.array_contains(F.col("_c"), F.lit(soft_candidate)) & (F.size("_c") < K.TOP_K)
    )
    s = s.withColumn("_soft", soft)
    s = s.withColumn("_c", F.when(F.col("_soft"), F.array_append(F.col("_c"), F.lit(soft_candidate))).otherwise(F.col("_c")))
    s = s.withColumn(
        "soft_hints",
        F.when(F.col("_soft"), F.create_map(F.lit(soft_candidate), F.lit(soft_source))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )
    noise_verdict = F.struct(
        F.lit("reject").alias("verdict"), F.lit(0.0).alias("score"), F.col("reason").alias("reason"),
        F.lit(False).alias("image_audit_required"),
        F.lit(None).cast("struct<suggested_candidate:string,suggestion_reason:string,suggestion_confidence:double,suggestion_type:string>").alias("suggestion"),
    ).cast(D.VERDICT)
    s = s.withColumn(
        "validation",
        F.when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(direct.isNotNull(), noise_verdict)
        .otherwise(D.validate_span(span, F.col("confidence"))),
    )
    v = F.col("validation")
    open_span = forced.isNull() & direct.isNull()
    suppress = open_span & (v["verdict"] == "accept") & (v["score"] >= K.CONFIDENT_ACCEPT) & F.col("has_nouns")
    s = s.withColumn("_c", F.when(suppress, alone).otherwise(F.col("_c")))
    suggestion = v["suggestion"]["suggested_candidate"]
    inject = (
        open_span & (F.coalesce(suggestion, F.lit("")) != "") & (suggestion != span)
        & ((F.col("_c") == self_only) | (F.col("has_hints") & (alone == self_only)))
    )
    s = s.withColumn("candidates", F.when(inject, F.array(suggestion, span)).otherwise(F.col("_c")))
    return s.withColumn("rank1", F.coalesce(F.get("candidates", F.lit(0)), F.lit(""))).drop("_c", "_soft", "lists", "verdict")


def analyze_pages(pages: DataFrame, hints: DataFrame | None, config: AnalyzeConfig) -> DataFrame:
    """Located spans of profiled pages (see :func:`page_profile`)."""
    forms = M.term_forms(config.terms) if config.terms is not None else None
    f = findings(pages, config, forms)
    spans = unfolded(f, ["note_id", "page", "script", "region", "region_multiplier"], "found", "x").select("note_id", "page", "script", "region", "region_multiplier", "x.starts", "x.f.*")
    span = F.col("suspect_span")

    empty_entries = F.lit(None).cast(C._ENTRIES)
    empty_shapes = F.lit(None).cast("array<struct<seq:int,correct:string,score:double>>")
    if forms is not None:
        spans = spans.join(C.form_entries(forms).withColumnRenamed("form", "suspect_span"), "suspect_span", "left")
    else:
        spans = spans.withColumn("entries", empty_entries)
    if config.shape_pairs is not None:
        spans = spans.join(C.shape_entries(config.shape_pairs).withColumnRenamed("wrong", "suspect_span"), "suspect_span", "left")
    else:
        spans = spans.withColumn("shapes", empty_shapes)
    spans = spans.withColumn("_scored", C.term_scores_col(span, F.col("is_protected"), F.col("entries"), config.domain_hint))
    spans = spans.withColumn("_scored", C.with_shapes_col(F.col("_scored"), F.col("shapes"))).drop("entries")

    nouns = None
    if config.proper_nouns is not None:
        # small tables, bounded by the noun lists and the known regions, read by several joins
        table = H.nouns_by_region(config.proper_nouns).persist(StorageLevel.MEMORY_AND_DISK)
        nouns = H.nouns_at(table).persist(StorageLevel.MEMORY_AND_DISK)
        known = H.known_regions(config.proper_nouns).select("region", F.lit(True).alias("_known"))
        spans = spans.join(known, "region", "left").withColumn(
            "noun_region", F.when(F.col("_known"), F.col("region")).otherwise(H.OTHER_REGION)
        ).drop("_known")
        at = nouns.withColumnRenamed("region", "noun_region")
        has = at.select("noun_region", "region_multiplier").distinct().withColumn("has_nouns", F.lit(True))
        spans = spans.join(has, ["noun_region", "region_multiplier"], "left")
        spans = spans.withColumn("len", F.char_length(span)).withColumn("mscript", T.dominant_script(span))
        menu = C.menu_of(at, ["noun_region", "region_multiplier"]).withColumnRenamed("script", "mscript")
        spans = spans.join(menu, ["noun_region", "region_multiplier", "len", "mscript"], "left")
        spans = _with_note_menu(spans, hints, table) if hints is not None else spans.withColumn("_own", F.lit(None).cast(_OWN))
        spans = spans.withColumn("_offer", _offer(span))
    else:
        spans = spans.withColumn("has_nouns", F.lit(None).cast("boolean")).withColumn("_offer", F.array().cast(C.SCORED))
        spans = spans.withColumn("noun_region", F.lit(H.OTHER_REGION))
    spans = spans.withColumn("has_nouns", F.coalesce("has_nouns", F.lit(False)))
    spans = spans.drop("menu", "_own", "len", "mscript")

    # only candidates with a score of their own need their bonus looked up
    carried = [c for c in spans.columns if c not in ("_scored", "note_id", "page", "suspect_span", "noun_region", "region_multiplier")]
    rows = spans.select(
        *KEY, "noun_region", "region_multiplier", F.struct(*carried).alias("s"), F.explode_outer("_scored").alias("c")
    ).select(*KEY, "noun_region", "region_multiplier", "s", "c.candidate", "c.score", "c.ord")
    bonus, proper = F.lit(0.0), F.lit(False)
    if nouns is not None:
        nn = nouns.select(
            F.col("region").alias("noun_region"), "region_multiplier", F.col("term").alias("candidate"), F.col("bonus").alias("_nb")
        )
        rows = rows.join(nn, ["noun_region", "region_multiplier", "candidate"], "left")
        bonus, proper = F.coalesce("_nb", F.lit(0.0)), F.col("_nb").isNotNull()
    if hints is not None:
        nh = hints.select("note_id", F.col("term").alias("candidate"), F.col("fixed").alias("_hf"), F.col("scaled").alias("_hs"))
        rows = rows.join(nh, ["note_id", "candidate"], "left")
        bonus = bonus + F.coalesce(F.col("_hf") + F.col("_hs") * F.col("region_multiplier"), F.lit(0.0))
    score = C.boosted_score(F.col("score"), bonus, proper, span, F.col("candidate"))
    item = F.when(
        F.col("score").isNotNull(),
        F.struct("candidate", score.alias("score"), "ord", F.lit(False).alias("bonus_only")),
    )
    listed = rows.groupBy(*KEY, "noun_region", "region_multiplier").agg(
        F.first("s").alias("s"), F.collect_list(item).alias("_c")
    ).select(*KEY, "noun_region", "region_multiplier", "s.*", "_c")
    offered = F.transform(
        "_offer", lambda o: F.struct(o["candidate"].alias("candidate"), o["score"].alias("score"), o["ord"].alias("ord"), F.lit(True).alias("bonus_only"))
    )
    listed = listed.withColumn("lists", C.ranked_lists(F.concat("_c", offered), span)).drop("_c", "_offer")

    if hints is not None:
        noted = hints.groupBy("note_id").agg(
            F.bool_or(F.col("fixed") > 0).alias("_fixed"), F.bool_or(F.col("scaled") > 0).alias("_scaled")
        )
        own = F.col("_fixed") | (F.col("_scaled") & (F.col("region_multiplier") > 0))
        listed = listed.join(noted, "note_id", "left").withColumn(
            "has_hints", F.col("has_nouns") | F.coalesce(own, F.lit(False))
        ).drop("_fixed", "_scaled")
    else:
        listed = listed.withColumn("has_hints", F.col("has_nouns"))
    done = _final_candidates(listed)
    done = _flags(done, nouns, hints, forms)
    located = done.select("*", F.posexplode("starts").alias("occurrence_index", "start"))
    return (
        located.withColumn("end", F.col("start") + F.char_length(span))
        .withColumn("span_id", T.span_id(F.col("page"), F.col("occurrence_index"), F.col("start")))
        .withColumn("is_bigram_suspect", F.col("bigram").isNotNull())
        .withColumn("is_dangerous", C.is_dangerous(F.col("rank1_is_proper_noun"), F.col("rank1_from_shape")))
        .withColumn("recommended_verdict", D.recommended_verdict(F.col("validation.verdict"), F.col("confidence")))
        .select(*SPAN_COLUMNS)
    )


_OWN = "array<struct<term:string,bonus_fixed:double,bonus_scaled:double,in_fixed:boolean,noun_scaled:double,geo_fixed:boolean,in_scaled:boolean,ord:bigint>>"


def _with_note_menu(spans: DataFrame, hints: DataFrame, table: DataFrame) -> DataFrame:
    """Nouns whose bonus the note itself changes: per note, length and script, with both bonus parts.

    Only tokens of the note that are nouns take part, so the array is bounded by the noun list.
    """
    t = table.select(
        F.col("region").alias("noun_region"), "term", F.col("fixed").alias("_nf"), F.col("scaled").alias("_ns"),
        "in_fixed", "in_scaled", "geo_fixed", F.col("ord").alias("_no"),
    )
    terms = t.select("term").distinct()
    regions = t.select(F.col("noun_region").alias("region"), F.lit(True).alias("_known")).distinct()
    own = (
        hints.join(terms, "term", "left_semi").join(regions, "region", "left")
        .withColumn("noun_region", F.when(F.col("_known"), F.col("region")).otherwise(H.OTHER_REGION))
        .join(t, ["noun_region", "term"])
    )
    n = F.char_length("term")
    # metadata and alias terms come before the noun lists, other tokens after them
    order = F.when(F.col("ord") < 2 * 10**15, F.col("ord") - 2 * 10**15).otherwise(F.col("_no").cast("bigint"))
    item = F.struct(
        "term", (F.col("_nf") + F.col("fixed")).alias("bonus_fixed"), (F.col("_ns") + F.col("scaled")).alias("bonus_scaled"),
        "in_fixed", F.col("_ns").alias("noun_scaled"), "geo_fixed", "in_scaled", order.cast("bigint").alias("ord"),
    )
    menu = (
        own.withColumn("len", F.explode(F.array(n - 1, n, n + 1)))
        .withColumn("mscript", F.explode(T.scripts_accepting(T.dominant_script(F.col("term")))))
        .groupBy("note_id", "noun_region", "len", "mscript")
        .agg(F.collect_list(item).alias("_own"))
    )
    return spans.join(menu, ["note_id", "noun_region", "len", "mscript"], "left")


def _offer(span: Column) -> Column:
    """Bonus-only candidates: the region's menu, with the note's own sums in place of the plain ones."""
    m = F.col("region_multiplier")
    own = F.coalesce(F.col("_own"), F.array().cast(_OWN))
    live = F.filter(own, lambda o: o["in_fixed"] | (o["noun_scaled"] * m > 0))

    def menu(live):
        fit = F.filter(
            F.transform(
                live,
                lambda o: F.struct(
                    o["term"].alias("term"), (o["bonus_fixed"] + o["bonus_scaled"] * m).alias("score"), o["ord"].alias("ord"),
                    (o["geo_fixed"] | (o["in_scaled"] & (o["noun_scaled"] * m > 0))).alias("geo"),
                ),
            ),
            lambda o: (o["score"] >= K.STANDALONE_MIN) & ~(o["geo"] & (F.char_length(span) < 3)),
        )
        own_menu = F.transform(
            fit,
            lambda o: F.struct(
                o["term"].alias("term"), F.least(o["score"], F.lit(K.STANDALONE_CAP)).alias("score"), o["ord"].alias("ord")
            ),
        ).cast(C.MENU)
        plain = F.coalesce(F.col("menu"), F.array().cast(C.MENU))
        rest = T.let(
            F.transform(live, lambda o: o["term"]),
            lambda names: F.filter(plain, lambda x: ~F.array_contains(names, x["term"])),
        )
        return F.concat(rest, own_menu)

    return C.offer_col(T.let(live, menu), F.transform("_scored", lambda c: c["candidate"]), K.TOP_K)


def _flags(s: DataFrame, nouns: DataFrame | None, hints: DataFrame | None, forms: DataFrame | None) -> DataFrame:
    real = F.col("rank1") != ""
    no = F.lit(False)
    if nouns is not None:
        nn = nouns.select(F.col("region").alias("noun_region"), "region_multiplier", F.col("term").alias("rank1"), F.lit(True).alias("_n"))
        s = s.join(nn, ["noun_region", "region_multiplier", "rank1"], "left")
    if forms is not None:
        s = s.join(C.experimental_forms(forms).select(F.col("form").alias("rank1"), F.lit(True).alias("_e")), "rank1", "left")
    if hints is not None:
        nh = hints.where(F.size("sources") > 0).select("note_id", F.col("term").alias("rank1"), F.col("sources").alias("_src"))
        s = s.join(nh, ["note_id", "rank1"], "left")
    has = lambda c: real & F.coalesce(F.col(c), no) if c in s.columns else no
    src = lambda p: real & F.coalesce(F.exists("_src", lambda x: F.startswith(x, F.lit(p))), no) if "_src" in s.columns else no
    shape = real & F.coalesce(F.exists("shapes", lambda x: x["correct"] == F.col("rank1")), no)
    return s.select(
        "*", has("_n").alias("rank1_is_proper_noun"), shape.alias("rank1_from_shape"),
        has("_e").alias("rank1_from_experimental_dict"), src("frontmatter:").alias("rank1_from_frontmatter"),
        src("body:").alias("rank1_from_body"),
    )


def analyze(notes: DataFrame, config: AnalyzeConfig) -> DataFrame:
    """Spans of notes (note_id, md[, name]); see SPAN_COLUMNS.  Order by note, page, start to read them."""
    pages = page_profile(notes, config)
    return analyze_pages(pages, note_hints(notes, config), config)


def page_report(notes: DataFrame, config: AnalyzeConfig) -> DataFrame:
    """Per page: document type, particle script and the number of particle candidates."""
    p = page_profile(notes, config)
    typed = p.withColumn("_m", D.doc_type_col(F.col("clean_text"), F.col("document_type"), F.col("era")))
    typed = typed.select("note_id", "page", "script", "clean_text", D._doc_type_result(F.col("_m")).alias("r"))
    hits = F.regexp_count("clean_text", F.lit(PT._TRIO_PATTERN))
    return typed.select(
        "note_id", "page", F.col("script").alias("particle_script"), "r.*",
        F.when(F.col("r.doc_type") == "classical", hits).otherwise(0).alias("particle_count"),
    )


def order_spans(spans: DataFrame) -> DataFrame:
    return spans.orderBy("note_id", "page", "start", "span_id")


def proper_noun_events(spans: DataFrame, nouns: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per span with a proper noun among its candidates.

    ``spans``: analysis output; ``nouns``: noun dictionary.  The (at most five) candidates of a span
    are looked up by term; a region joins only its own lists.
    """
    at = H.nouns_at(H.nouns_by_region(nouns)).select(
        F.col("region").alias("_nr"), "region_multiplier", F.col("term").alias("candidate")
    )
    known = H.known_regions(nouns).select("region", F.lit(True).alias("_known"))
    keys = ["note_id", "page", "suspect_span", "occurrence_index", "start"]
    base = spans.join(known, "region", "left").withColumn(
        "_nr", F.when(F.col("_known"), F.col("region")).otherwise(H.OTHER_REGION)
    )
    rows = base.select(
        *keys, "region", "region_multiplier", "_nr", "candidates", F.posexplode("candidates").alias("_i", "candidate")
    ).join(at, ["_nr", "region_multiplier", "candidate"])
    out = rows.groupBy(*keys, "region", "region_multiplier").agg(
        F.first("candidates").alias("candidates"),
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "candidate"))), lambda x: x["candidate"]).alias("proper_noun_candidates"),
    )
    rank1 = F.get("candidates", F.lit(0))
    out = out.withColumn("rank1_candidate", rank1).withColumn(
        "rank1_is_proper_noun", F.array_contains("proper_noun_candidates", rank1)
    ).withColumn("source", F.lit("proper_noun"))
    if names is not None:
        out = out.join(names.select("note_id", F.col("name").alias("filename")), "note_id", "left")
    return out
