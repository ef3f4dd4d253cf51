"""Local communities on graphs of any size: pushed personalised rank with a frontier, and the sweep cut by prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.graphs import ends
from graphloom.operators.tabular import with_rank
from graphloom.plans.state import settled

CHUNK = 65_536


def weighted_ends(edges: DataFrame) -> DataFrame:
    """(nid, other, w, strength, far): both directions with the strengths of both ends, made once for all rounds."""
    both = ends(edges).select("nid", "other", "w")
    strength = both.groupBy("nid").agg(F.sum("w").alias("strength"))
    return settled(both.join(strength, "nid").join(strength.select(F.col("nid").alias("other"), F.col("strength").alias("far")), "other"))


def pushed_rank(arcs: DataFrame, seeds: DataFrame, restart: float = 0.15, error: float = 1e-4, most: int = 1000) -> DataFrame:
    """(nid, score, rest, strength) of the nodes that mass has reached: approximate personalised rank of a lazy walk from seeds (nid). In a round
    every node whose rest exceeds error times its strength pushes; only these join the edges. Ends when there are none, so that every
    score is below the exact one by error times the strength at most."""
    count = seeds.select("nid").distinct().count()
    start = seeds.select("nid").distinct().join(arcs.groupBy("nid").agg(F.first("strength").alias("strength")), "nid")
    state = settled(start.select("nid", F.lit(0.0).alias("score"), F.lit(1.0 / max(count, 1)).alias("rest"), "strength"))
    live = F.col("rest") >= error * F.col("strength")
    for _ in range(most):
        active = state.where(live)
        if active.isEmpty():
            break
        sent = active.select("nid", "rest").join(arcs, "nid").select(F.col("other").alias("nid"), F.lit(0.0).alias("score"), ((1 - restart) * F.col("rest") * F.col("w") / (2 * F.col("strength"))).alias("rest"), F.col("far").alias("strength"))
        stay = state.select("nid", F.when(live, F.col("score") + restart * F.col("rest")).otherwise(F.col("score")).alias("score"), F.when(live, (1 - restart) / 2 * F.col("rest")).otherwise(F.col("rest")).alias("rest"), "strength")
        state = settled(stay.unionByName(sent).groupBy("nid").agg(F.sum("score").alias("score"), F.sum("rest").alias("rest"), F.max("strength").alias("strength")))
    return state


def prefix_sums(df: DataFrame, place: str, values: list[str]) -> DataFrame:
    """df with the values replaced by their sums over places up to the row's, places being 1, 2, ...: sums inside chunks of places, and the
    chunks' totals before."""
    chunked = df.withColumn("_chunk", F.floor((F.col(place) - 1) / CHUNK))
    within = Window.partitionBy("_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    totals = chunked.groupBy("_chunk").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    before = totals.select("_chunk", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0.0)).alias(f"_{v}") for v in values])
    summed = chunked.select("_chunk", *[c for c in df.columns if c not in values], *[F.sum(v).over(within).alias(v) for v in values])
    return summed.join(F.broadcast(before), "_chunk").select(*[c for c in df.columns if c not in values], *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def sweep_cut(arcs: DataFrame, scores: DataFrame) -> tuple[DataFrame, float]:
    """members (nid) and conductance of the best prefix of nodes by score per strength (ties by id). An edge adds its weight to the cut where its
    first end comes and takes it away where its second does, so cuts and volumes are prefix sums."""
    total = arcs.agg(F.sum("w")).first()[0] or 0.0
    held = scores.where("score > 0").select("nid", "strength", F.round(F.col("score") / F.col("strength"), 12).alias("by"))
    ranked = settled(with_rank(held, [F.desc("by"), F.asc("nid")], "place").select("nid", "strength", "place"))
    far = ranked.select(F.col("nid").alias("other"), F.col("place").alias("there"))
    sign = F.when(F.col("there") < F.col("place"), -F.col("w")).otherwise(F.col("w"))
    change = arcs.select("nid", "other", "w").join(ranked.select("nid", "place"), "nid").join(far, "other", "left").groupBy("place").agg(F.sum(sign).alias("cut"))
    sums = prefix_sums(ranked.join(change, "place").select("nid", "place", "cut", F.col("strength").alias("volume")), "place", ["cut", "volume"])
    least = F.least("volume", F.lit(total) - F.col("volume"))
    best = sums.where(least > 1e-9 * total).agg(F.min(F.struct(F.round(F.col("cut") / least, 12).alias("c"), "place"))).first()[0]
    if best is None:
        return ranked.where("false").select("nid"), float("inf")
    return ranked.where(F.col("place") <= best["place"]).select("nid"), best["c"]
