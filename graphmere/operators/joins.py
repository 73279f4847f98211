"""Joins whose left side may have a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmere.session import sized, stage

#: Rows of one key that go to one task; a key with more is spread over as many salts as it needs.
KEY_ROWS = 1_000_000
SMALL_ROWS = 200_000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int = KEY_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; a key's rows of ``left`` are spread over salts by their number.

    ``right`` should have few rows of one key: those of a frequent key are repeated for each of its salts.
    Null keys match nothing and are spread as well; rows that are equal in all columns stay together. ``how`` is inner, left, left_semi or left_anti. ``left`` is
    read twice, once for its keys only, unless ``counts`` (key, n) tells how many rows a key has.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.select(key, F.col("n").alias("_n")).filter(F.col("_n") > rows)
    hot = stage(hot.select(F.col(key).alias("_k"), F.ceil(F.col("_n") / rows).cast("int").alias("_n")))
    if not hot.take(1):
        return left.join(right, key, how)
    hot = sized(hot, SMALL_ROWS)  # no more rows than there are in left / rows
    # By content and not by place, so that a task that runs again after a loss sends each row where it went before.
    salt = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("_n"))).otherwise(0).cast("int")
    a = left.join(hot, left[key].eqNullSafe(hot["_k"]), "left").withColumn("_s", salt).drop("_k", "_n")
    salts = F.when(F.col("_n").isNotNull(), F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.lit(0)))
    b = right.join(hot, right[key] == hot["_k"], "left").withColumn("_s", F.explode(salts)).drop("_k", "_n")
    if how in ("left_semi", "left_anti"):
        b = b.select(key, "_s").distinct()
    return a.join(b, [key, "_s"], how).drop("_s")
