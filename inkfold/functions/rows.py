"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfolded(df: DataFrame, keep: list[str], array: Column | str, name: str, at: str = "_at") -> DataFrame:
    """One row per element of an array that is dear to compute: ``keep``, its place ``at``, ``name``.

    An inner explode is filtered on the size of its array, which is then computed again for the filter, and there before
    the rows are dealt out. An outer explode has no such filter; what it gives for an empty or null array goes afterwards.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, name)).where(F.col(at).isNotNull())
