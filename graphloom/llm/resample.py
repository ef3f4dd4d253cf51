"""Importance resampling towards a target distribution, by hashed n-gram counts.

Words and their runs of up to three are hashed into 10,000 buckets. Higher-order functions make each document's bucket array, which is
written once. Counting combines in each task, so only count totals move; the 10,000 gains, log ratios of smoothed target and source shares
in thousandths, come to the driver and go back as one literal array, and a document's weight is a sum over element_at of it: scoring
explodes and shuffles nothing. Documents are then drawn without replacement by Gumbel keys, the noise hashed from their ids.

Defined results: null and empty texts have no features, weight 0 and never take part in the draw; a null id hashes as the empty string and
loses ties; repeated rows are scored alike and drawn one by one; empty tables count 0 everywhere (an empty source gives no rows); other
columns don't matter, whatever their names; texts are read whole, as one array each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.tabular import with_rank

from .common import stored

#: What stands between words once A-Z count as letters: ASCII except digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResampleRules:
    buckets: int = 10_000
    least_words: int = 20  #: words a document needs to take part in the draw
    percent: int = 5  #: of the documents that take part
    seed: int = 42


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() would change other letters too, so it serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), ascii_uppercase, text))


def _but_last(a: str, count: int = 1) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - count, F.lit(0)))


def bucketed(docs: DataFrame, rules: ResampleRules = ResampleRules(), text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, n_words, and buckets: those of all runs of one to three words, repeats included."""
    parts = docs.select(*keep, F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS).alias("_p"))
    first = F.when(F.element_at("_p", 1) == "", 2).otherwise(1)  # only the first and the last part can be empty
    last = F.size("_p") - F.when(F.element_at("_p", -1) == "", 1).otherwise(0)
    words = parts.select(*keep, F.slice("_p", first, F.greatest(last - first + 1, F.lit(0))).alias("_w"))
    beside = lambda a, b: F.concat(a, F.lit(" "), b)
    twos = words.withColumn("_2", F.zip_with(_but_last("_w"), F.slice("_w", 2, F.size("_w")), beside))
    threes = twos.withColumn("_3", F.zip_with(_but_last("_2"), F.slice("_w", 3, F.size("_w")), beside))
    bucket = lambda f: (F.crc32(f) % rules.buckets).cast("smallint")
    return threes.select(*keep, F.size("_w").alias("n_words"), F.transform(F.concat("_w", "_2", "_3"), bucket).alias("buckets"))


def totals(features: DataFrame, name: str) -> DataFrame:
    """(bucket, count): one row per bucket and task moves."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules()) -> list[int]:
    """The gain of each bucket, floor(1000 ln(p_target / p_source)) with one added to every count; a fixed number of rows."""
    spark = source.sparkSession
    every = spark.range(rules.buckets).select(F.col("id").alias("bucket"))
    both = every.join(totals(source, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left").na.fill(0)
    rows = sorted(both.collect())  # rules.buckets rows
    more_s, more_t = (float(sum(r[c] for r in rows) + rules.buckets) for c in ("s", "t"))
    return [math.floor(1000 * math.log((r["t"] + 1.0) * more_s / ((r["s"] + 1.0) * more_t))) for r in rows]


def weighed(features: DataFrame, gain: list[int]) -> Column:
    """The sum of the gains over a document's buckets, a literal array looked up by place."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    return F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))


def noise(doc_id: Column, rules: ResampleRules = ResampleRules()) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    held = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(held, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """A row per document: id, n_features, weight, score, and the rank of those drawn."""
    features = stored(bucketed(docs.select(F.col(id_col).alias("id"), text_col), rules, text_col, ("id",)), "buckets")
    gain = gains(features, bucketed(target.select(target_text), rules, target_text), rules)
    scored = features.select("id", F.size("buckets").cast("long").alias("n_features"), weighed(features, gain).alias("weight"), (F.col("n_words") >= rules.least_words).alias("_in"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("id"), rules))
    drawn = rules.percent * features.where(F.col("n_words") >= rules.least_words).count() // 100
    placed = with_rank(scored, [F.desc("_in"), F.desc("score"), F.asc_nulls_last("id")], "_rank")
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))
