"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", broadcast_rows: int = 200_000, hot_rows: int = 20_000, salts: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """rows joined with small on key, which is unique in small. Up to `broadcast_rows` rows small is broadcast. Beyond that, the rows
    of a key with more than `hot_rows` rows are dealt to `salts` tasks by a hash of column `spread`, and only such keys of small are
    copied as often; there are at most (number of rows) / hot_rows of them. Who knows the hot keys already gives them as the only column
    of `hot`, which saves counting the rows."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("small is the copied side, so it can't be kept whole")
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(small), key, how)
    if hot is None:
        hot = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).select(key)
    hot = hot.withColumn("_hot", F.lit(True))
    if hot.isEmpty():
        return rows.join(small, key, how)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(_sized(hot, broadcast_rows), key, "left").withColumn("_salt", salt).drop("_hot")
    right = small.join(_sized(hot, broadcast_rows), key, "left").withColumn("_salt", copies).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _sized(hot: DataFrame, broadcast_rows: int) -> DataFrame:
    return F.broadcast(hot) if hot.limit(broadcast_rows + 1).count() <= broadcast_rows else hot
