"""Best neighbourhoods of every size by branch and bound, in rounds over tables.

The tree holds a target's candidate sets: a node's children add one later candidate. Taking a member out of a Gram block by its Schur
complement leaves what the set explains nothing of, so one elimination a set scores all its children, and eliminating the later candidates from the
last to the first gives each child the energy that no set below it can go under. Scores and bounds are summed over blocks by a grouped
sum; a child stays in the tree only if its bound is not above the best score known for the next size. First scores come from
forward selection, and candidates that explain more come first, which makes the bounds bite.

Work is dealt by block and by chunk of the tree's frontier: a task holds one block's matrix and the sets of one chunk. A member that the others of its set
already give (a pivot of `TINY` of its power or less) explains nothing more; blocks without the target are left out; equal scores go to
the first set by sorted members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.tabular import with_rank
from graphloom.plans.state import settled, ship_package

TINY = 1e-9
CELLS = 2_000_000  #: numbers of the matrices that a task works on together


def eliminated(m: np.ndarray, power: np.ndarray, at: np.ndarray, on: np.ndarray) -> None:
    """Takes row and column `at` out of each of the matrices for which `on` holds, unless hardly anything of its power is left."""
    each = np.arange(len(m))
    pivot = m[each, at, at]
    able = on & (pivot > TINY * power[each, at])
    rows = m[each, at][able]
    m[able] -= rows[:, :, None] * rows[:, None, :] / pivot[able][:, None, None]


def _children(matrix: np.ndarray, orders: np.ndarray, chosen: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of places in its target's order (the target stands last): scores and bounds of its children by place, and which places
    are children."""
    m = matrix[orders[:, :, None], orders[:, None, :]]
    power = np.einsum("eii->ei", m).copy()
    count, own = len(m), m.shape[1] - 1
    size = max((len(c) for c in chosen), default=0)
    for k in range(size):
        eliminated(m, power, np.array([c[k] if len(c) > k else 0 for c in chosen]), np.array([len(c) > k for c in chosen]))
    last = np.array([c[-1] if len(c) else -1 for c in chosen])
    places = np.arange(own)
    child = places[None, :] > last[:, None]
    pivots, cross = np.einsum("eii->ei", m)[:, :own], m[:, own, :own]
    able = pivots > TINY * power[:, :own]
    scores = m[:, own, own][:, None] - np.where(able, cross**2 / np.where(able, pivots, 1.0), 0.0)
    bounds = np.zeros((count, own))
    for k in range(own - 1, -1, -1):
        eliminated(m, power, np.full(count, k), child[:, k])
        bounds[:, k] = m[:, own, own]
    return scores, bounds, child


def _scored(blocks: DataFrame, frontier: DataFrame, kind: str, chunk: int) -> DataFrame:
    """(target, place, chosen, score, bound): every child of the frontier's sets, summed over blocks."""
    placed = with_rank(frontier, [F.asc("target"), F.asc("chosen")], "row").withColumn("chunk", F.floor((F.col("row") - 1) / chunk))
    chunks = placed.groupBy("chunk").agg(F.collect_list(F.struct("target", "order", "chosen")).alias("sets"))  # `chunk` sets at most
    count = -(-frontier.count() // chunk)
    pairs = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(chunks, "chunk")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, flat, sets in zip(frame["names"], frame["flat"], frame["sets"], strict=True):
                at = {n: k for k, n in enumerate(names)}
                # one more row of zeros stands for nodes that the block lacks
                matrix = np.zeros((len(at) + 1, len(at) + 1))
                matrix[:-1, :-1] = np.asarray(flat).reshape(len(at), len(at))
                all_held = [s for s in sets if s["target"] in at]
                together = max(1, CELLS // len(matrix) ** 2)
                for held in (all_held[a : a + together] for a in range(0, len(all_held), together)):
                    orders = np.array([[at.get(n, len(at)) for n in (*s["order"], s["target"])] for s in held])
                    chosen = [list(s["chosen"]) for s in held]
                    scores, bounds, child = _children(matrix, orders, chosen)
                    e, k = np.nonzero(child)
                    yield pd.DataFrame({"target": [held[x]["target"] for x in e], "place": k.astype("int32"), "chosen": [chosen[x] for x in e], "score": scores[e, k], "bound": bounds[e, k]})

    found = pairs.repartition("block", "chunk").select("names", "flat", "sets").mapInPandas(work, f"target {kind}, place int, chosen array<int>, score double, bound double")
    return found.groupBy("target", "place", "chosen").agg(F.sum("score").alias("score"), F.sum("bound").alias("bound"))


def _grown(children: DataFrame) -> DataFrame:
    return children.withColumn("chosen", F.array_append("chosen", F.col("place")))


def best_subsets(grams: DataFrame, size: int, chunk: int = 512, told: list[int] | None = None) -> DataFrame:
    """(target, card, members, energy): for every node and every size 1 ... size the set of others with the least unexplained energy, summed over
    blocks, from Gram blocks (block, i, j, g) that hold every pair of their nodes. Exact. told gets the number of sets scored at each size."""
    ship_package(grams.sparkSession)
    kind = grams.schema["i"].dataType.simpleString()
    entries = F.array_sort(F.collect_list(F.struct("i", "j", "g")))  # an entry a pair of nodes
    listed = grams.groupBy("block").agg(entries.alias("m"))
    blocks = settled(listed.select("block", F.array_sort(F.array_distinct(F.transform("m", lambda e: e["i"]))).alias("names"), F.transform("m", lambda e: e["g"]).alias("flat")))
    nodes = settled(grams.select(F.col("i").alias("target")).distinct())
    others = nodes.count() - 1
    size = min(size, others)
    by_name = nodes.agg(F.array_sort(F.collect_set("target")).alias("order"))  # a model's nodes
    roots = nodes.join(F.broadcast(by_name)).select("target", F.array_except("order", F.array("target")).alias("order"), F.array().cast("array<int>").alias("chosen"))
    if size < 1:
        return roots.select("target", F.lit(0).alias("card"), F.col("order").alias("members"), F.lit(0.0).alias("energy")).where("false")
    single = settled(_scored(blocks, roots, kind, chunk))
    ranked = single.join(roots.select("target", "order"), "target").select("target", "score", F.element_at("order", F.col("place") + 1).alias("node"))
    order = settled(ranked.groupBy("target").agg(F.array_sort(F.collect_list(F.struct(F.round("score", 9).alias("s"), "node"))).alias("o")).select("target", F.transform("o", lambda x: x["node"]).alias("order")))

    known = None  # (target, card, least): by forward selection, sets of places in the order, whichever come first
    greedy = order.select("target", "order", F.array().cast("array<int>").alias("chosen"))
    for card in range(1, size + 1):
        # a set's children are later places only, so forward selection looks at every set without its last places too
        grown = settled(_forward(blocks, greedy, kind, chunk))
        best = grown.groupBy("target").agg(F.min(F.struct("score", "chosen")).alias("b")).select("target", F.lit(card).alias("card"), F.col("b.score").alias("least"), F.col("b.chosen").alias("chosen"))
        known = best.select("target", "card", "least") if known is None else known.unionByName(best.select("target", "card", "least"))
        greedy = settled(best.select("target", "chosen").join(order, "target").select("target", "order", "chosen"))
    known = settled(known)

    frontier = order.select("target", "order", F.array().cast("array<int>").alias("chosen"))
    found = None
    for card in range(1, size + 1):
        children = settled(_grown(_scored(blocks, frontier, kind, chunk)).join(order, "target"))
        if told is not None:
            told.append(children.count())
        members = F.array_sort(F.transform("chosen", lambda k: F.element_at("order", k + 1)))
        least = children.groupBy("target").agg(F.min(F.struct(F.round("score", 9).alias("energy"), members.alias("members"))).alias("b"))
        best = settled(least.select("target", F.lit(card).alias("card"), "b.members", "b.energy"))
        found = best if found is None else found.unionByName(best)
        if card == size:
            break
        limit = known.where(F.col("card") == card + 1).select("target", "least")
        below = children.join(F.broadcast(limit), "target").where((F.col("place") < others - 1) & (F.col("bound") <= F.col("least") + TINY * (1 + F.abs("least"))))  # limit: a row a node
        frontier = settled(below.select("target", "order", "chosen"))
    return found


def _forward(blocks: DataFrame, greedy: DataFrame, kind: str, chunk: int) -> DataFrame:
    """The children of sets by any further place: a set's order is turned so that its members come first."""
    places = F.sequence(F.lit(0), F.size("order") - 1)
    turned = greedy.select("target", F.concat("chosen", F.array_except(places, F.col("chosen"))).alias("turn"), "order", F.size("chosen").alias("n"))
    first = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = turned.select("target", F.transform("turn", lambda k: F.element_at("order", k + 1)).alias("order"), first.alias("chosen"), "turn")
    scored = _scored(blocks, rows.drop("turn"), kind, chunk).join(rows.select("target", "turn"), "target")
    return scored.select("target", "score", F.concat(F.transform("chosen", lambda k: F.element_at("turn", k + 1)), F.array(F.element_at("turn", F.col("place") + 1))).alias("chosen"))
