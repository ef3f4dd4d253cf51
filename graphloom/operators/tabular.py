"""Tabular operators: ranking by sums, missing rows, distinct keys, group lengths, normalisation, error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.state import settled


def ranked_totals(df: DataFrame, key: str, value: str, total: str = "total", rank: str = "rank") -> DataFrame:
    """Sums by key without null keys, and each key's rank by descending sum, then key.

    Ranks come from a range-partitioned sort and per-partition counts, so no task sees all keys."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(total))
    return with_rank(sums, [F.desc(total), F.asc(key)], rank)


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based positions under a total order, without a window over all rows: rows are ranged over partitions, numbered inside
    each, and shifted by the sizes of the partitions before. Ranges are cut at sampled values, so the ranged rows are written once
    with their partition; both readers see the same cuts."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    shifted = numbered.join(F.broadcast(before.select("_part", "_before")), "_part")  # one row a partition
    return shifted.select(*df.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("long").alias(rank))


def without_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.na.drop("any", subset=columns)


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that comes first in the order, by a map-side combining minimum."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)])


def long_groups(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with at least so many rows. Counting combines before the shuffle, and only keys are joined back."""
    keys = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(keys, key, "left_semi")


def first_rows(df: DataFrame, key: str, order: list[str], count: int) -> DataFrame:
    """The first rows of each key; Spark keeps only so many per key before the shuffle (window group limit)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= count)


def max_normalised(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    top = df.groupBy(*by).agg(F.max(value).alias("_top"))
    return df.join(top, by).select(*df.columns, (F.col(value) / F.nullif(F.col("_top"), F.lit(0.0))).alias(out))


def squared_error(estimate: Column, truth: Column) -> Column:
    """Aggregate: sum of squared errors."""
    return F.sum(F.pow(estimate - truth, F.lit(2.0)))


def normalised_error(estimate: Column, truth: Column) -> Column:
    """Aggregate: squared error over the truth's squared norm."""
    return squared_error(estimate, truth) / F.nullif(F.sum(F.pow(truth, F.lit(2.0))), F.lit(0.0))


def half_unit_accuracy(df: DataFrame, estimate: str, truth: str, labelled: str) -> DataFrame:
    """Share of unlabelled rows whose estimate is within one half of the truth."""
    open_rows = ~F.col(labelled)
    hit = F.count_if(open_rows & (F.abs(F.col(estimate) - F.col(truth)) < 0.5))
    return df.agg((hit / F.nullif(F.count_if(open_rows), F.lit(0))).alias("accuracy"))


def detection_counts(df: DataFrame, truth: str, estimate: str, by: list[str]) -> DataFrame:
    """Hits, false alarms and misses of an edge set, and success: all true edges and nothing else."""
    t, e = F.col(truth), F.col(estimate)
    out = df.groupBy(*by).agg(F.count_if(t & e).alias("hits"), F.count_if(~t & e).alias("false_alarms"), F.count_if(t & ~e).alias("misses"))
    return out.withColumn("success", (F.col("false_alarms") == 0) & (F.col("misses") == 0))


def mean_vector(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Component-wise means of an array column, by keys: components are averaged before they move."""
    parts = df.select(*by, F.posexplode(vector).alias("_k", "_v")).groupBy(*by, "_k").agg(F.avg("_v").alias("_v"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("mean"))


def squared_deviation(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Sum over rows of the squared distance to the mean vector, by keys."""
    gap = F.aggregate(F.zip_with(F.col(vector), F.col("mean"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.join(mean_vector(df, vector, by), by).groupBy(*by).agg(F.sum(gap).alias("deviation"))


def same_set(a: str, b: str) -> Column:
    """Whether two arrays hold the same members, in any order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def running_total(df: DataFrame, key: str, order: list[str], value: str, out: str = "running") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))
