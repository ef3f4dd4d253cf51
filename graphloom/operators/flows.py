"""Largest flows and least cuts on graphs of any size, by push and relabel in synchronous rounds over tables.

A node has an excess, a drain (what it may still give to the sink) and a height; an edge has what is left of its capacity in both directions.
Heights are the breadth-first levels from the drains along what is left. In a round every node with excess pushes along edges that lead exactly
one down, in the order of their ends; such edges don't lead down in the other direction, so pushes of a round never meet. When no excess
can go down any more, all heights are set anew: they only grow, and nodes from which no drain can be reached drop out, which spares lifting
them one by one. Only nodes with excess join the edges. A round settles three tables; a node's edges are ordered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.graphs import degrees, ends
from graphloom.plans.state import settled

EPSILON = 1e-9


def _arcs(flows: DataFrame) -> DataFrame:
    """(u, v, left, src, dst, sign) of both directions in which something is left."""
    ways = F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("ahead").alias("left"), F.lit(1.0).alias("sign")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("back").alias("left"), F.lit(-1.0).alias("sign"))))
    return flows.select("src", "dst", ways).where(F.col("left") > EPSILON)


def levels(flows: DataFrame, drains: DataFrame) -> DataFrame:
    """(nid, height): 1 at the drains, and one more for each edge on the shortest way to them along what is left."""
    rim, height = settled(drains.select("nid", F.lit(1).alias("height"))), 1
    seen = rim
    while not rim.isEmpty():
        height += 1
        near = _arcs(flows).join(rim.select(F.col("nid").alias("v")), "v").select(F.col("u").alias("nid")).distinct()
        rim = settled(near.join(seen, "nid", "left_anti").withColumn("height", F.lit(height)))
        seen = seen.unionByName(rim)
        if height % 16 == 0:
            seen = settled(seen)
    return seen


def max_flow(nodes: DataFrame, edges: DataFrame) -> tuple[float, DataFrame]:
    """The value of a largest flow from supplies to drains of nodes (nid, supply, drain), over edges (src, dst, w) that carry up to w either way,
    and sides (nid, source_side) of a least cut. A drain may be infinite, a supply not."""
    flows = settled(edges.select("src", "dst", F.col("w").alias("ahead"), F.col("w").alias("back")))
    soaked = lambda x, d: F.least(x, d)
    begin = nodes.select("nid", F.col("supply").cast("double").alias("x"), F.col("drain").cast("double").alias("d"))
    state = settled(begin.select("nid", (F.col("x") - soaked("x", "d")).alias("excess"), (F.col("d") - soaked("x", "d")).alias("drain"), soaked("x", "d").alias("taken")))
    while True:
        state = settled(state.select("nid", "excess", "drain", "taken").join(levels(flows, state.where(F.col("drain") > EPSILON)), "nid", "left"))
        pushed = False
        while True:
            active = state.where((F.col("excess") > EPSILON) & F.col("height").isNotNull())
            low = state.where("height IS NOT NULL").select(F.col("nid").alias("v"), F.col("height").alias("below"))
            down = _arcs(flows).join(active.select(F.col("nid").alias("u"), "excess", "height"), "u").join(low, "v").where(F.col("below") == F.col("height") - 1)
            before = F.coalesce(F.sum("left").over(Window.partitionBy("u").orderBy("v", "sign").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            sent = down.withColumn("give", F.least("left", F.col("excess") - before)).where(F.col("give") > EPSILON)
            gives = settled(sent.select("u", "v", "src", "dst", (F.col("give") * F.col("sign")).alias("net"), "give"))
            if gives.isEmpty():
                break
            pushed = True
            both = F.inline(F.array(F.struct(F.col("u").alias("nid"), (-F.col("give")).alias("change")), F.struct(F.col("v").alias("nid"), F.col("give").alias("change"))))
            moved = state.join(gives.select(both).groupBy("nid").agg(F.sum("change").alias("change")), "nid", "left")
            excess = F.col("excess") + F.coalesce("change", F.lit(0.0))
            state = settled(moved.select("nid", (excess - soaked(excess, "drain")).alias("excess"), (F.col("drain") - soaked(excess, "drain")).alias("drain"), (F.col("taken") + soaked(excess, "drain")).alias("taken"), "height"))
            nets = gives.groupBy("src", "dst").agg(F.sum("net").alias("net"))
            flows = settled(flows.join(nets, ["src", "dst"], "left").select("src", "dst", (F.col("ahead") - F.coalesce("net", F.lit(0.0))).alias("ahead"), (F.col("back") + F.coalesce("net", F.lit(0.0))).alias("back")))
        if not pushed:  # nothing could move on fresh levels: no excess reaches a drain
            value = state.agg(F.sum("taken")).first()[0] or 0.0
            return value, state.select("nid", F.col("height").isNull().alias("source_side"))


def between(nodes: DataFrame, edges: DataFrame, source: str, sink: str) -> tuple[float, DataFrame]:
    """A largest flow from the nodes where the condition `source` holds to those where `sink` does."""
    strength = degrees(nodes, edges)
    return max_flow(strength.select("nid", F.when(F.expr(source), F.col("strength")).otherwise(0.0).alias("supply"), F.when(F.expr(sink), float("inf")).otherwise(0.0).alias("drain")), edges)


def cut_value(edges: DataFrame, sides: DataFrame) -> float:
    """The weight of the edges between the sides."""
    a, b = sides.select(F.col("nid").alias("src"), F.col("source_side").alias("a")), sides.select(F.col("nid").alias("dst"), F.col("source_side").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").agg(F.sum("w")).first()[0] or 0.0


def improved(edges: DataFrame, members: DataFrame, rounds: int = 50) -> tuple[DataFrame, float]:
    """The subset of members (nid) with the least ratio of cut to volume, and the ratio. From border nodes, which have their border's weight
    times the volume, to all members, which drain the cut times their strength: while not everything drains, the members that reach a drain have a
    lower ratio."""
    both = settled(ends(edges).select("nid", "other", "w"))
    current = settled(members.select("nid").distinct())
    for _ in range(rounds):
        inner = current.select(F.col("nid").alias("other"), F.lit(True).alias("inside"))
        told = settled(both.join(current, "nid").join(inner, "other", "left").groupBy("nid").agg(F.sum("w").alias("strength"), F.sum(F.when(F.col("inside").isNull(), F.col("w")).otherwise(0.0)).alias("border")))
        cut, volume = told.agg(F.sum("border"), F.sum("strength")).first()
        if not cut or cut <= EPSILON:
            return current, 0.0 if volume else float("inf")
        within = edges.join(current.withColumnRenamed("nid", "src"), "src").join(current.withColumnRenamed("nid", "dst"), "dst")
        value, sides = max_flow(told.select("nid", F.col("border").alias("supply"), (F.col("strength") * (cut / volume)).alias("drain")), within.select("src", "dst", "w"))
        better = settled(sides.where("NOT source_side").select("nid"))
        if value >= cut * (1 - 1e-9) or better.isEmpty():
            return current, cut / volume
        current = better
    return current, cut / volume
