"""Dictionary governance: registration counts, promotion, edits, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

TERM_KEY = ["file", "term"]


def is_stale(last_seen_at: Column, as_of: Column) -> Column:
    """Not seen for 180 whole days; an empty or unreadable time is not stale."""
    t = F.try_to_timestamp(F.nullif(T.strip(F.coalesce(last_seen_at.cast("string"), F.lit(""))), F.lit("")))
    seconds = F.unix_micros(as_of) - F.unix_micros(t)
    return F.coalesce(F.floor(seconds / F.lit(86_400_000_000)) >= K.STALE_DAYS, F.lit(False))


def is_promotion_candidate(enabled: Column, approval_count: Column) -> Column:
    return enabled & (approval_count >= K.PROMOTION_MIN_APPROVALS)


def approval_fold(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """State of every (file, term) after its events (op register, toggle or update; ts, seq order).

    Events are only summed up per term, per (term, form) and per (term, ``bucket`` of time), all with aggregates that
    combine before the shuffle. An update resets the count when it changes the normalized form: after the last
    update whose form differs from the final one, the next update is that last change. Where that place lies
    within a bucket, the events of that one bucket are looked at again; so events meet a term's row by
    (term, bucket), and a term with most of the events is spread over its buckets.
    """
    e = events.select(
        *TERM_KEY, "op", T.strip(F.coalesce("normalized", F.lit(""))).alias("norm"), F.col("normalized").isNotNull().alias("has_norm"),
        "enabled", "ts", F.struct("ts", "seq").alias("at"), F.date_trunc(bucket, "ts").alias("bucket"),
    )
    register, update = F.col("op") == "register", (F.col("op") == "update") & F.col("has_norm")
    switches = register | ((F.col("op").isin("toggle", "update")) & F.col("enabled").isNotNull())
    # events before the first registration do nothing; the latest ones below are never among them, but for an update
    one = e.groupBy(*TERM_KEY).agg(
        F.min(F.when(register, F.col("at"))).alias("born"), F.min_by("norm", F.when(register, F.col("at"))).alias("first_norm"),
        F.min(F.when(register, F.col("ts"))).alias("registered_at"),
        F.max(F.when(update, F.col("at"))).alias("_updated"), F.max_by("norm", F.when(update, F.col("at"))).alias("_norm"),
        F.max_by(F.when(register, F.lit(True)).otherwise(F.col("enabled")), F.when(switches, F.col("at"))).alias("enabled"),
        F.max(F.when(F.col("op") != "toggle", F.col("ts"))).alias("last_seen_at"),
    ).where(F.col("born").isNotNull())
    final = one.withColumn("normalized", F.when(F.col("_updated") >= F.col("born"), F.col("_norm")).otherwise(F.col("first_norm")))
    forms = e.where(update).groupBy(*TERM_KEY, "norm").agg(F.max("at").alias("_last"))
    other = (
        forms.join(final.select(*TERM_KEY, "normalized", "born"), TERM_KEY)
        .where((F.col("norm") != F.col("normalized")) & (F.col("_last") >= F.col("born")))
        .groupBy(*TERM_KEY).agg(F.max("_last").alias("_other"))
    )
    anchor = final.join(other, TERM_KEY, "left").withColumn(
        "_after", F.coalesce("_other", F.when(F.col("first_norm") != F.col("normalized"), F.col("born")))
    )
    by_time = e.groupBy(*TERM_KEY, "bucket").agg(F.min(F.when(update, F.col("at"))).alias("_first_update"), F.count_if(register).alias("_n"))

    def place(at: str) -> Column:
        return F.date_trunc(bucket, F.col(f"{at}.ts"))

    after = anchor.where(F.col("_after").isNotNull()).select(*TERM_KEY, "_after", place("_after").alias("_b"))
    later = by_time.join(after, TERM_KEY).where(F.col("bucket") > F.col("_b")).select(*TERM_KEY, F.col("_first_update").alias("at"))
    same = e.where(update).join(after.withColumnRenamed("_b", "bucket"), [*TERM_KEY, "bucket"]).where(F.col("at") > F.col("_after")).select(*TERM_KEY, "at")
    reset = later.unionByName(same).groupBy(*TERM_KEY).agg(F.min("at").alias("_reset"))

    floor = final.select(*TERM_KEY, "born").join(reset, TERM_KEY, "left").select(
        *TERM_KEY, F.coalesce(F.greatest("born", "_reset"), F.col("born")).alias("_floor")
    ).withColumn("_b", place("_floor"))
    later = by_time.join(floor, TERM_KEY).where(F.col("bucket") > F.col("_b")).select(*TERM_KEY, F.col("_n").alias("n"))
    same = (
        e.where(register).join(floor.withColumnRenamed("_b", "bucket"), [*TERM_KEY, "bucket"]).where(F.col("at") > F.col("_floor"))
        .groupBy(*TERM_KEY, "bucket").agg(F.count(F.lit(1)).alias("n")).drop("bucket")
    )
    counts = later.unionByName(same).groupBy(*TERM_KEY).agg(F.sum("n").alias("approval_count"))
    out = final.join(counts, TERM_KEY, "left").withColumn("approval_count", F.coalesce("approval_count", F.lit(0)).cast("int"))
    return out.select(
        *TERM_KEY, "normalized", "enabled", "approval_count", "registered_at", "last_seen_at",
        is_promotion_candidate(F.col("enabled"), F.col("approval_count")).alias("is_promotion_candidate"),
    )


def order_terms(terms: DataFrame) -> DataFrame:
    """Promotion candidates first, otherwise by file and row."""
    return terms.orderBy(F.desc("is_promotion_candidate"), "source_file", "seq")


def term_counts(terms: DataFrame, files: DataFrame) -> DataFrame:
    """Entries and enabled entries per file, empty files included, and in total (source_file null)."""
    per_file = terms.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("enabled", F.lit(False))).alias("n_enabled")
    )
    filled = files.select("source_file").distinct().join(per_file, "source_file", "left").na.fill(0, ["n", "n_enabled"])
    return filled.rollup("source_file").agg(F.sum("n").alias("total"), F.sum("n_enabled").alias("enabled_count"))


def has_protected(terms: DataFrame) -> DataFrame:
    return terms.groupBy("source_file").agg(F.bool_or(F.coalesce("protect", F.lit(False))).alias("has_protected"))


def delete_file(terms: DataFrame, source_file: str, temporary: bool = False) -> DataFrame:
    """The dictionary without a file; refused for the default file and for files with protected terms."""
    if temporary and source_file == K.DEFAULT_TEMP_FILE:
        raise ValueError(f"{source_file} may not be deleted")
    if not terms.where((F.col("source_file") == source_file) & F.col("protect")).isEmpty():
        raise ValueError(f"{source_file} holds protected terms")
    return terms.where(F.col("source_file") != source_file)


def rename_file(terms: DataFrame, old: str, new: str, temporary: bool = False) -> DataFrame:
    if temporary and old == K.DEFAULT_TEMP_FILE:
        raise ValueError(f"{old} may not be renamed")
    if old == new:
        raise ValueError("the new name equals the old one")
    if terms.where(F.col("source_file") == old).isEmpty():
        raise ValueError(f"{old} does not exist")
    if not terms.where(F.col("source_file") == new).isEmpty():
        raise ValueError(f"{new} exists")
    return terms.withColumn("source_file", F.when(F.col("source_file") == old, F.lit(new)).otherwise(F.col("source_file")))


def promote(temp: DataFrame, approved: DataFrame, requests: DataFrame, on_conflict: str = "check") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move temporary terms to the approved dictionary: (temp', approved', report).

    ``requests``: term, source_file, target_file.  A term already approved in the target is a
    conflict: 'check' reports it, 'skip' only deletes the temporary row, 'overwrite' updates.
    """
    req = requests.select(
        T.strip(F.col("term")).alias("_k"), "source_file", "target_file"
    ).dropDuplicates(["_k", "source_file", "target_file"])
    t = temp.withColumn("_k", T.strip(F.col("term")))
    a = approved.withColumn("_k", T.strip(F.col("term")))
    found = req.join(t.groupBy("_k", "source_file").agg(F.min_by(F.struct(*temp.columns), "seq").alias("t")), ["_k", "source_file"], "left")
    clash = a.select("_k", F.col("source_file").alias("target_file"), F.lit(True).alias("_c")).distinct()
    status = (
        F.when(F.col("t").isNull(), "not_found")
        .when(F.col("_c").isNull(), "promoted")
        .when(F.lit(on_conflict) == "check", "conflict")
        .when(F.lit(on_conflict) == "skip", "skipped")
        .otherwise("overwritten")
    )
    decided = found.join(clash, ["_k", "target_file"], "left").withColumn("status", status)
    gone = decided.where(F.col("status").isin("promoted", "skipped", "overwritten")).select("_k", "source_file")
    new_temp = t.join(gone, ["_k", "source_file"], "left_anti").select(*temp.columns)
    moved = decided.where(F.col("status").isin("promoted", "overwritten"))
    fresh = moved.select(
        F.col("_k").alias("term"), F.col("t.normalized").alias("normalized"), F.col("t.variants").alias("variants"),
        F.col("t.reading").alias("reading"), F.col("t.category").alias("category"), F.col("t.domain").alias("domain"),
        F.col("t.priority").alias("priority"), F.col("t.protect").alias("protect"), F.lit("promoted").alias("source"),
        F.lit(True).alias("approved"), F.col("t.seq").alias("seq"), F.col("target_file").alias("source_file"), "status", "_k",
    )
    # an overwritten row keeps its place; a new one goes to the end
    old_place = a.select("_k", "source_file", F.col("seq").alias("_s"))
    fresh = fresh.join(old_place, ["_k", "source_file"], "left").withColumn(
        "seq", F.coalesce("_s", F.lit(1 << 57) + F.col("seq")).cast("bigint")
    ).withColumn("tier", F.lit("stable"))
    kept = a.join(fresh.select("_k", "source_file"), ["_k", "source_file"], "left_anti")
    cols = [c for c in approved.columns]
    new_approved = kept.select(*cols).unionByName(fresh.select(*[c for c in cols if c in fresh.columns]), allowMissingColumns=True)
    report = decided.select(F.col("_k").alias("term"), "source_file", "target_file", "status")
    return new_temp, new_approved, report


EDITABLE = ("normalized", "reading", "category", "domain", "priority", "source", "note")


def edit_terms(terms: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of edits, at most one per (source_file, term): (dictionary', report).

    ``edits``: source_file, term, op (append, update, delete, toggle), new_term, and columns named
    as the dictionary's; a null column is left alone.  Refused edits are reported and change nothing:
    an empty or existing term, a missing term, a rename onto an existing term.
    """
    key = ["source_file", "_k"]
    have = set(edits.columns)
    e = edits.withColumn("_k", T.strip(F.coalesce("term", F.lit(""))))
    e = e.withColumn("_new", T.strip(F.coalesce("new_term", F.lit(""))) if "new_term" in have else F.lit(""))
    t = terms.withColumn("_k", T.strip(F.col("term")))
    known = t.select(*key, F.lit(True).alias("_exists")).distinct()
    taken = known.select("source_file", F.col("_k").alias("_new"), F.lit(True).alias("_taken"))
    renames = (F.col("_new") != "") & (F.col("_new") != F.col("_k"))
    checked = e.join(known, key, "left").join(taken, ["source_file", "_new"], "left")
    exists = F.coalesce("_exists", F.lit(False))
    status = (
        F.when(F.col("_k") == "", "term_required")
        .when((F.col("op") == "append") & exists, "already_exists")
        .when((F.col("op") != "append") & ~exists, "not_found")
        .when((F.col("op") == "update") & renames & F.coalesce("_taken", F.lit(False)), "already_exists")
        .otherwise("done")
    )
    checked = checked.withColumn("status", status).drop("_exists", "_taken")
    ok = checked.where("status = 'done'")

    def incoming(c):
        return F.col(f"_e.{c}") if c in have else F.lit(None)

    packed = ok.where("op <> 'append'").select(*key, F.struct(*[F.col(c) for c in ok.columns if c not in key]).alias("_e"))
    j = t.join(packed, key, "left").where(F.coalesce(F.col("_e.op"), F.lit("")) != "delete")
    updates = F.col("_e.op") == "update"
    changed_norm = updates & incoming("normalized").isNotNull() & (T.strip(incoming("normalized").cast("string")) != F.col("normalized"))
    out = []
    for c in terms.columns:
        v = F.col(c)
        if c == "term":
            v = F.when(updates & (F.col("_e._new") != "") & (F.col("_e._new") != F.col("_k")), F.col("_e._new")).otherwise(v)
        elif c == "variants" and c in have:
            v = F.when(updates & incoming(c).isNotNull(), T.split_variants(T.normalize_variants(incoming(c)))).otherwise(v)
        elif c == "enabled" and c in have:
            v = F.when(F.col("_e.op").isin("update", "toggle") & incoming(c).isNotNull(), incoming(c)).otherwise(v)
        elif c in ("protect", "approved") and c in have:
            v = F.when(updates & incoming(c).isNotNull(), incoming(c)).otherwise(v)
        elif c == "approval_count":
            v = F.when(changed_norm, F.lit(0)).otherwise(v)
        elif c == "last_seen_at" and "at" in have:
            v = F.when(updates, incoming("at").cast("string")).otherwise(v)
        elif c in EDITABLE and c in have:
            kind = terms.schema[c].dataType
            new = T.strip(incoming(c)) if kind.typeName() == "string" else incoming(c).cast(kind)
            v = F.when(updates & incoming(c).isNotNull(), new).otherwise(v)
        out.append(v.alias(c))
    kept = j.select(*out)

    defaults = {
        "normalized": F.col("_k"), "variants": F.array().cast("array<string>"), "priority": F.lit(0.8), "protect": F.lit(False),
        "approved": F.lit(True), "source": F.lit("manual"), "enabled": F.lit(True), "approval_count": F.lit(0), "tier": F.lit("stable"),
        "seq": F.lit(1 << 57) + F.xxhash64("source_file", "_k").bitwiseAND((1 << 50) - 1),
    }
    new_cols = []
    for f in terms.schema.fields:
        fallback = defaults.get(f.name, F.lit("") if f.dataType.typeName() == "string" else F.lit(None))
        if f.name == "term":
            v = F.col("_k")
        elif f.name == "source_file":
            v = F.col("source_file")
        elif f.name == "variants" and "variants" in have:
            v = F.coalesce(T.split_variants(T.normalize_variants(F.col("variants"))), fallback)
        elif f.name in have:
            own = T.strip(F.col(f.name)) if f.dataType.typeName() == "string" else F.col(f.name)
            v = F.coalesce(own.cast(f.dataType), fallback.cast(f.dataType))
        else:
            v = fallback
        new_cols.append(v.cast(f.dataType).alias(f.name))
    added = ok.where("op = 'append'").select(*new_cols)
    report = checked.select("source_file", F.col("_k").alias("term"), "op", "status")
    return kept.unionByName(added), report
