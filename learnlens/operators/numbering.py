"""Integer numbers for text keys, made by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, number: str, buckets: int) -> DataFrame:
    """Each distinct ``key`` with its own small integer.

    ``ml.ALS`` wants int ids.  A label indexer would hold all users on the driver; here a hash
    spreads the keys over buckets, each bucket counts its own keys, and the bucket interleaves
    the counts: no two buckets share a number and none waits for another.  The same keys and
    ``buckets`` always give the same numbers, whatever the cluster.
    """
    in_bucket = Window.partitionBy("_bucket").orderBy(key)
    return (
        df.select(key)
        .distinct()
        .withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        .select(
            key,
            ((F.row_number().over(in_bucket) - 1) * buckets + F.col("_bucket")).alias(number),
        )
    )
