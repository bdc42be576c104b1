"""Last write wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the greatest by ``order``, ties broken by all other columns.

    Only the first row of a window is asked for, so every map task reduces its copies of a key to
    one row before the shuffle (the planner's group limit), and a key with very many copies stays
    cheap.  Rows without a complete key cannot be stored and are left out.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *(c for c in rest if c not in order)]
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    if not rest:
        return df.distinct()
    place = "_place"
    while place in df.columns:
        place = f"_{place}"
    best = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ranked])
    return df.withColumn(place, F.row_number().over(best)).filter(F.col(place) == 1).drop(place)
