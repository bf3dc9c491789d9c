"""Review metrics from the action logs, and the evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _action() -> Column:
    return (
        F.when(F.col("event") == "span_accepted", "accept")
        .when(F.col("event") == "span_rejected", "reject")
        .when(F.col("event") == "span_skipped", "skip")
    )


def experimental_metrics(accepted: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: counts A to F with their totals, and the accept rate."""
    both = accepted.where("event = 'span_accepted'").unionByName(
        actions.where(F.col("event").isin("span_rejected", "span_skipped")), allowMissingColumns=True
    )
    exp = _is("rank1FromExperimental")
    a, r, s = (F.col("event") == e for e in ("span_accepted", "span_rejected", "span_skipped"))
    m = both.agg(
        F.count_if(a & exp).alias("a_accept"), F.count_if(a).alias("a_total"),
        F.count_if(r & exp).alias("b_reject"), F.count_if(r).alias("b_total"),
        F.count_if(s & exp).alias("c_skip"), F.count_if(s).alias("c_total"),
        F.count_if(a & exp & _is("dismissedDangerFlag")).alias("d_accept_danger"),
        F.count_if(r & exp & _is("isDangerous")).alias("e_reject_danger"),
        F.count_if(s & exp & _is("isDangerous")).alias("f_skip_danger"),
    )
    return m.withColumn("g_accept_rate", accept_rate(F.col("a_accept"), F.col("b_reject"), F.col("c_skip")))


def accept_rate(a: Column, r: Column, s: Column) -> Column:
    """Accepts over all three; null without any."""
    return F.try_divide(a, a + r + s)


def setting_as_of(events: DataFrame, changes: DataFrame, ts: str = "ts", by: str | None = None,
                  salts: int = 32, bucket_chars: int = 10) -> DataFrame:
    """Adds ``state`` (ON, OFF, unknown): the last change at or before each event.

    Time stamps are ISO texts compared as texts, so their first characters (the day) are ordered
    buckets.  A bucket's opening state comes from a summary with one row per day; inside a bucket
    the changes are repeated for every salt, which splits a day of any size over many tasks.
    Changes of one time stamp: the later line wins.
    """
    keys = [by] if by else []
    bucket = F.substring(ts, 1, bucket_chars)
    ch = changes.where(F.col(ts).isNotNull()).select(
        *keys, bucket.alias("_b"), F.col(ts).alias("_t"), F.coalesce("new_value", F.lit(False)).alias("_v"),
        F.col("line_no").alias("_l"),
    )
    ev = events.where(F.col(ts).isNotNull()).withColumn("_b", bucket)
    ev = ev.withColumn("_salt", F.pmod(F.xxhash64(ts, "line_no"), F.lit(salts)))

    # opening state of each bucket: one row per day, whatever the number of events
    daily = ch.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct("_t", "_l")).alias("_last"))
    days = ev.select(*keys, "_b").distinct().join(daily, [*keys, "_b"], "left")
    days = days.unionByName(daily.join(ev.select(*keys, "_b").distinct(), [*keys, "_b"], "left_anti"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    opening = days.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_v")).where(F.col("_v").isNotNull())
    opening = opening.select(*keys, "_b", F.lit("").alias("_t"), "_v", F.lit(-1).cast("bigint").alias("_l"))

    marks = opening.unionByName(ch.select(*keys, "_b", "_t", "_v", F.col("_l").cast("bigint").alias("_l"))).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    payload = F.struct(*[F.col(c) for c in events.columns])
    rows = ev.select(*keys, "_b", "_salt", F.col(ts).alias("_t"), F.lit(None).cast("boolean").alias("_v"),
                     F.lit(None).cast("bigint").alias("_l"), F.lit(1).alias("_is_event"), payload.alias("_e"))
    marks = marks.select(*keys, "_b", "_salt", "_t", "_v", "_l", F.lit(0).alias("_is_event"),
                         F.lit(None).cast(rows.schema["_e"].dataType).alias("_e"))
    w = W.partitionBy(*keys, "_b", "_salt").orderBy("_t", "_is_event", "_l").rowsBetween(W.unboundedPreceding, 0)
    value = F.last("_v", ignorenulls=True).over(w)
    state = F.when(value.isNull(), "unknown").when(value, "ON").otherwise("OFF")
    return rows.unionByName(marks).withColumn("state", state).where(F.col("_is_event") == 1).select("_e.*", "state")


def metrics_by_state(actions: DataFrame, changes: DataFrame, by: str | None = None) -> DataFrame:
    """Accepts, rejects and skips by setting state, for all spans and for experimental ones.

    Always the three states, zero filled; rates are null without events.
    """
    acts = actions.withColumn("action", _action()).where(F.col("action").isNotNull() & F.col("ts").isNotNull())
    acts = acts.select("ts", "line_no", "action", _is("rank1FromExperimental").alias("exp"), *([by] if by else []))
    state = setting_as_of(acts, changes, by=by)
    scopes = state.withColumn("scope", F.explode(F.when(F.col("exp"), F.array(F.lit("all"), F.lit("experimental"))).otherwise(F.array(F.lit("all")))))
    counted = scopes.groupBy("scope", "state").pivot("action", ["accept", "reject", "skip"]).count()
    frame = actions.sparkSession.createDataFrame(
        [(sc, st) for sc in ("all", "experimental") for st in ("ON", "OFF", "unknown")], "scope string, state string"
    )
    out = frame.join(counted, ["scope", "state"], "left").na.fill(0, ["accept", "reject", "skip"])
    return out.withColumn("accept_rate", accept_rate(F.col("accept"), F.col("reject"), F.col("skip")))


def setting_history(changes: DataFrame) -> DataFrame:
    return changes.select(F.substring("ts", 1, 19).alias("ts"), "old_value", "new_value", "reload_result", "line_no").orderBy("ts", "line_no")


def top_counts(df: DataFrame, keys, n: int = 20, extra=()) -> DataFrame:
    """The ``n`` most frequent keys; equal counts by first appearance."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"), *extra)
    ordered = counted.orderBy(F.desc("count"), "first_line")
    return ordered.limit(n) if n is not None else ordered


def span_distribution(actions: DataFrame, n: int = 20) -> DataFrame:
    """Experimental suspect texts: totals by action and accept rate, the ``n`` most frequent.

    Ties go by first appearance with accepts read before rejects and skips.
    """
    acts = actions.withColumn("action", _action()).where(F.col("action").isNotNull() & _is("rank1FromExperimental"))
    rank = F.when(F.col("action") == "accept", 0).when(F.col("action") == "reject", 1).otherwise(2)
    acts = acts.select(F.coalesce("suspectSpan", F.lit("")).alias("suspect_span"), "action", F.struct(rank.alias("r"), F.col("line_no").alias("l")).alias("_o"))
    counted = acts.groupBy("suspect_span").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("action") == "accept").alias("accept"),
        F.count_if(F.col("action") == "reject").alias("reject"),
        F.count_if(F.col("action") == "skip").alias("skip"),
        F.min("_o").alias("_o"),
    )
    top = counted.orderBy(F.desc("total"), "_o").limit(n)
    return top.select("suspect_span", "total", "accept", "reject", "skip",
                      accept_rate(F.col("accept"), F.col("reject"), F.col("skip")).alias("accept_rate"))


def candidate_rank() -> Column:
    """Logged rank, else the place of the choice in its list, else -1."""
    chosen = F.coalesce("chosenCandidate", F.lit(""))
    listed = F.coalesce("candidateList", F.array().cast("array<string>"))
    return F.coalesce(F.col("candidateRank"), (F.array_position(listed, chosen) - 1).cast("int"))


def in_list() -> Column:
    return F.array_contains(
        F.coalesce("candidateList", F.array().cast("array<string>")), F.coalesce("chosenCandidate", F.lit(""))
    )


def accepted_summary(accepted: DataFrame) -> DataFrame:
    a = accepted.where("event = 'span_accepted'")
    return a.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("wasBigramSuspect")).alias("bigram"),
        F.count_if(F.col("particleScript") == "katakana_dominant").alias("katakana_dominant"),
        F.count_if(candidate_rank() == -1).alias("manual_rank"),
        F.count_if(in_list()).alias("in_list"),
        F.count_if(~in_list()).alias("manual_input"),
    )


def pair_counts(accepted: DataFrame, bigram_only: bool = False, n: int | None = 20) -> DataFrame:
    """(suspect, chosen) counts; list membership and hint come from the pair's first event."""
    a = accepted.where("event = 'span_accepted'")
    if bigram_only:
        a, n = a.where(_is("wasBigramSuspect")), None
    a = a.select(
        F.coalesce("suspectSpan", F.lit("")).alias("suspect_span"), F.coalesce("chosenCandidate", F.lit("")).alias("chosen"),
        in_list().alias("_in"), F.coalesce("hintSource", F.lit("")).alias("_hint"), "line_no",
    )
    first = F.min_by(F.struct("_in", "_hint"), "line_no").alias("_f")
    top = top_counts(a, ["suspect_span", "chosen"], n, extra=(first,))
    return top.select("suspect_span", "chosen", "count", F.col("_f._in").alias("in_list"), F.col("_f._hint").alias("hint_source"))


def suspect_distribution(accepted: DataFrame, script: str = "katakana_dominant", n: int = 20) -> DataFrame:
    a = accepted.where("event = 'span_accepted'").where(F.col("particleScript") == script)
    a = a.select(F.coalesce("suspectSpan", F.lit("")).alias("suspect_span"), "line_no")
    return top_counts(a, ["suspect_span"], n).select("suspect_span", "count")


def span_detail(accepted: DataFrame, text: str = K.SOFT_HINT[0]) -> DataFrame:
    a = accepted.where("event = 'span_accepted'").where(F.col("suspectSpan") == text)
    return a.select(
        "line_no", "chosenCandidate", "candidateList", "wasBigramSuspect", candidate_rank().alias("rank"),
        (~in_list()).alias("manual"), F.coalesce("hintSource", F.lit("")).alias("hint_source"),
    ).orderBy("line_no")


def promotion_share(accepted: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Share of each text's most chosen candidate; from the threshold on it is a rule candidate."""
    pairs = (
        accepted.where("event = 'span_accepted'")
        .groupBy(F.coalesce("suspectSpan", F.lit("")).alias("suspect_span"), F.coalesce("chosenCandidate", F.lit("")).alias("chosen"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    )
    best = pairs.groupBy("suspect_span").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("first_line")).alias("l"), "chosen")).alias("b")
    )
    share = F.col("b.n") / F.col("total")
    return best.select(
        "suspect_span", F.col("b.chosen").alias("top_chosen"), F.col("b.n").alias("top_count"), "total",
        share.alias("share"), (share >= threshold).alias("is_rule_candidate"),
    )


# --- evaluation -----------------------------------------------------------------------
def eval_summary(events: DataFrame) -> DataFrame:
    """Proper-noun events by region, and in total (region null)."""
    region = F.coalesce("region", F.lit("(none)"))
    good = _is("rank1_is_proper_noun")
    return (
        events.withColumn("_r", region).rollup("_r")
        .agg(
            F.count(F.lit(1)).alias("events"), F.count_if(good).alias("rank1_proper_noun"),
            F.count_if(~good).alias("rank1_other"),
            F.count_if(F.coalesce("region_multiplier", F.lit(1.0)) == 0.0).alias("multiplier_zero"),
        )
        .withColumnRenamed("_r", "region")
    )


def misfires(spans: DataFrame) -> DataFrame:
    """Spans whose first candidate differs from them and ends like a place name."""
    rank1 = F.coalesce(F.get("candidates", F.lit(0)), F.lit(""))
    return spans.withColumn("rank1", rank1).where(
        (F.col("rank1") != "") & (F.col("rank1") != F.col("suspect_span")) & F.col("rank1").rlike(K.PLACE_SUFFIX)
    )


def multiplier_check(events: DataFrame) -> DataFrame:
    zero = events.where(F.coalesce("region_multiplier", F.lit(1.0)) == 0.0)
    return zero.withColumn("flag", F.when(_is("rank1_is_proper_noun"), "WARNING").otherwise("ok"))
