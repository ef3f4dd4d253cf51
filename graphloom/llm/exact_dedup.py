"""Exact duplicates: rows grouped by a 128-bit hash of their text, and bytes compared inside the groups.

One pass makes a narrow table (id, hash, SHA-256, number of such rows). Groups of a hash are counted there, combined before they move.
A second pass sends on only the texts whose hash occurs more than once, and groups them by (hash, text), which compares bytes: each
task sends a text once, however often it has it. Where a hash turns out to stand for one text, its rows take their group by the hash;
where it stands for several, they are joined by the text itself. Hot hashes are dealt to many tasks in every join. All of it is DataFrame
operations.

Defined results: a null text equals the empty one; the row with the largest id (or the smallest, `keep`) stays, null ids come before all
others; of rows alike in id and text exactly one can stay; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.joins import spread_join

from .common import stored


def content_hash(text: Column) -> Column:
    """The 16 bytes of MD5; a collision costs time and changes no result."""
    return F.unhex(F.md5(text))


@dataclass(frozen=True)
class CopyRules:
    keep: str = "largest"  #: id that stays, "largest" or "smallest"
    broadcast_rows: int = 200_000  #: groups up to which they are broadcast
    hot_rows: int = 20_000  #: rows of a group from which it is dealt to several tasks


def groups(docs: DataFrame, rules: CopyRules = CopyRules(), id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """A row per document: id, keep_id, group_size, kept and text_sha256."""
    if rules.keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    best = F.max if rules.keep == "largest" else F.min
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("hash", hashed(F.col("text")))
    rows = stored(texts.groupBy("id", "hash", F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.count("*").alias("rows")), "prints")
    repeated = stored(rows.groupBy("hash").agg(F.sum("rows").alias("size"), best("id").alias("keep_id")).where("size > 1"), "repeated")

    def joined(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
        return spread_join(left, right, key, "id", how, rules.broadcast_rows, rules.hot_rows, hot=right.where(F.col("size") > rules.hot_rows).select(key))

    # bytes are compared here: a text that several rows share moves once from each task
    shared = joined(texts, repeated, "hash", "left_semi") if not repeated.isEmpty() else texts.where("false")
    classes = stored(shared.groupBy("hash", "text").agg(F.count("*").alias("size"), best("id").alias("keep_id")), "classes")
    several = classes.groupBy("hash").agg(F.count("*").alias("texts"), F.sum("size").alias("size")).where("texts > 1").select("hash", "size")
    if several.isEmpty():
        return _resolved(joined(rows, repeated, "hash", "left"), id_col)
    several = stored(several, "several")
    agreed = joined(rows, several, "hash", "left_anti")
    apart = joined(texts, several, "hash", "left_semi").groupBy("id", F.struct("hash", "text").alias("place"), F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.count("*").alias("rows"))
    own = classes.select(F.struct("hash", "text").alias("place"), "size", "keep_id")
    return _resolved(joined(agreed, repeated, "hash", "left"), id_col).unionByName(_resolved(joined(apart, own, "place", "left"), id_col))


def _resolved(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with the size and the kept id of their group, as many as there were; alone in its hash, a row is its own group."""
    held = rows.select("id", F.coalesce("size", "rows").alias("group_size"), F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return held.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
