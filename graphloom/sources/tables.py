"""Delimited and image sources, and sinks."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a weather station's observations, in file order: (name, type).
OBSERVATIONS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "timestamp", "temp", "windspeed_10min", "gustspeed_10min", "winddirection_10min", "relative_humidity", "dewpoint")]
    + [T.StructField(n, T.StringType()) for n in ("precipitation_1h", "precipitation_intensity_10min", "snow_depth")]
    + [T.StructField(n, T.DoubleType()) for n in ("pressure", "visibility", "cloud_amount", "present_weather")]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, sep: str = ",", strict: bool = True, header: bool = True) -> DataFrame:
    """A delimited file by an explicit schema; strict reads fail on a malformed row. Empty fields and NaN are null."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", True).csv(path)
    df = df.select(*columns) if columns else df
    return df.select(*[F.nullif(F.col(f.name), F.lit(float("nan"))).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema])


def read_positional(spark: SparkSession, path: str, places: dict[int, tuple[str, str]], sep: str = ",", header: bool = True) -> DataFrame:
    """Columns by their 1-based places, {place: (name, type)}; the others are not parsed."""
    width = max(places)
    schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(1, width + 1)])
    df = spark.read.schema(schema).option("header", header).option("sep", sep).option("enforceSchema", True).csv(path)
    return df.select(*[F.col(f"_c{k}").cast(kind).alias(name) for k, (name, kind) in places.items()])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, OBSERVATIONS, sep=";")


def thousands(text: Column) -> Column:
    """Integers written with a point after every three digits."""
    return F.regexp_replace(text, r"\.", "").cast("double")


def read_funding(spark: SparkSession, folder: str, key: str = "Applicant / Contact person", value: str = "Funding") -> DataFrame:
    """(applicant, funding) of all CSV files of a folder, by their header's names."""
    df = spark.read.option("header", True).option("sep", ";").option("pathGlobFilter", "*.csv").csv(folder)
    return df.select(F.col(f"`{key}`").alias("applicant"), thousands(F.col(f"`{value}`")).alias("funding"))


def pixels(image: DataFrame, step: int = 5) -> DataFrame:
    """Every step-th pixel of an image (row, col, val) but for its last row and column, renumbered."""
    size = image.agg(F.max("row").alias("h"), F.max("col").alias("w"))  # one row
    kept = image.join(F.broadcast(size)).where((F.col("row") < F.col("h")) & (F.col("col") < F.col("w")) & (F.col("row") % step == 0) & (F.col("col") % step == 0))
    return kept.select((F.col("row") / step).cast("int").alias("row"), (F.col("col") / step).cast("int").alias("col"), "val")


def rectangle(nodes: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Whether a pixel lies in a rectangle, ends included, as is_labeled."""
    return nodes.withColumn("is_labeled", F.col("row").between(*rows) & F.col("col").between(*cols))


def level_set(signal: DataFrame, value: str = "x", level: float = 0.5) -> DataFrame:
    return signal.where(F.col(value) > level)


# Sinks ----------------------------------------------------------------------------------------------------------------------


def result_path(folder: str, name: str, moment: datetime | None = None, **parts: int) -> str:
    """folder/name with parts as _key and two-digit value, and a UTC time stamp if one is given."""
    text = name + "".join(f"_{k}{v:02d}" for k, v in parts.items())
    return f"{folder}/{text}" + (f"_{moment.astimezone(UTC):%Y%m%dT%H%M%S}" if moment else "")


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_header: bool = False, one_file: bool = False) -> None:
    """CSV with a header. Results are small, so one_file may gather them; tables stay in parts."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", quote_header).csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def formatted(df: DataFrame, pattern: str = "%2.3e", columns: list[str] | None = None) -> DataFrame:
    """Double columns as text in a C pattern; the others stay."""
    chosen = columns or [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.select(*[F.format_string(pattern, F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def write_observations(df: DataFrame, path: str) -> None:
    """Semicolons and five decimals; the time stamp stays exact instead of being rounded to single precision."""
    stamped = df.withColumn("timestamp", F.format_string("%.0f", F.col("timestamp").cast("double")))
    write_csv(formatted(stamped, "%.5f"), path, sep=";")


def wide_table(signals: DataFrame, node: str, name: str, value: str, names: list[str], rows: list[int] | None = None) -> DataFrame:
    """One column per name and one row per node, of all nodes or the given ones."""
    kept = signals.where(F.col(node).isin(rows)) if rows is not None else signals
    return kept.groupBy(node).pivot(name, names).agg(F.first(value))
