"""What the two classifiers share: the folds, the bounded sample of labelled rows, sums of term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folds by crc32(doc_id as text); fold 0 is held out from all learning.
FOLDS = 5


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def held_out() -> F.Column:
    """True for the held-out fold; a null doc_id is in none."""
    return F.coalesce(fold() == 0, F.lit(False))


def sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label, fold) of about ``per_class`` labelled rows of each class at most, never of the held-out fold.

    Rows are chosen by a hash of doc_id against a threshold, so the choice needs the class counts only.
    Rows without a label or a doc_id are left out; of several labels of a doc_id the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    rows = known.withColumn("fold", fold().cast("int")).where("fold <> 0")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(place < share)


def with_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents of a sample: the sample is bounded by its parameter, so it goes to the documents."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
