"""A start for the squared network lasso on one large graph: the best weights that each component can share, and flows that show how good they are.

With n labels, a node pulls at its weights by 1/n of its error, while an edge holds by a bound that doesn't depend on n. So in large graphs a component's nodes
mostly share their weights, which are a least-squares fit, and what proves it are flows that carry all pulls along a spanning tree without passing the bound:
then the duality gap is zero. Where a flow passes the bound it is cut to it, and the gap says that steps must follow.

The tree is found by levels. A part finds the components of its own edges; each becomes a node of the next level, with the sums of its nodes, unless it touches no
other part. FAN parts make a part of the next level, until none touches another. Weights and flows come back the same way: edges between parts first,
then what is left of the pulls inside them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.state import settled

FAN = 8  #: parts that make a part of the next level


def shared_start(home: DataFrame, links: DataFrame, dimension: int, weight: float, primal: float, bound: float, most: int) -> tuple[DataFrame, DataFrame] | None:
    """Weights (nid, w) and flows (src, dst, y; without those of zero) of nodes (nid, feature, label, is_labeled, owner) and edges (src, dst). weight: of a squared error.
    None if a part of a higher level would have more than `most` nodes and edges, as in graphs without locality."""
    d = dimension
    seen = lambda x: F.when(F.col("is_labeled"), x).otherwise(0.0)
    squares = F.flatten(F.transform("feature", lambda x: F.transform("feature", lambda z: seen(x * z))))
    nodes = home.select(F.col("nid").alias("id"), F.col("owner").alias("part"), F.concat(squares, F.transform("feature", lambda x: seen(x * F.col("label")))).alias("sums"))
    edges = links.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    levels = []
    while True:
        nodes = settled(nodes)
        of = lambda end, part: nodes.select(F.col("id").alias(end), F.col("part").alias(part)).hint("merge")  # noqa: E731, B023
        edges = settled(edges.join(of("src", "part"), "src").join(of("dst", "far"), "dst"))
        across = edges.where("part <> far")
        if across.isEmpty():
            levels.append((nodes, edges, None))
            break
        above = settled(_inside(nodes, edges).applyInPandas(_members, "id long, up long"))
        levels.append((nodes, edges, above))
        up = lambda end: above.select(F.col("id").alias(end), F.col("up").alias(f"up_{end}")).hint("merge")  # noqa: E731, B023
        lifted = across.join(up("src"), "src").join(up("dst"), "dst").groupBy(F.col("up_src").alias("src"), F.col("up_dst").alias("dst")).agg(F.min(F.struct("a", "b")).alias("x"))
        edges = settled(lifted.select("src", "dst", "x.a", "x.b"))
        touching = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        summed = nodes.join(above.hint("merge"), "id").groupBy(F.col("up").alias("id")).agg(F.floor(F.min("part") / FAN).cast("long").alias("part"), F.array(*[F.sum(F.element_at("sums", k + 1)) for k in range(d * d + d)]).alias("sums"))
        nodes = settled(summed.join(touching.hint("merge"), "id", "left_semi"))
        sizes = nodes.select("id", "part", F.lit(1).alias("n")).unionByName(edges.join(nodes.select(F.col("id").alias("src"), "part").hint("merge"), "src").select(F.col("src").alias("id"), "part", F.lit(1).alias("n")))
        if sizes.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > most:
            return None

    weights = flows = None
    for nodes, edges, above in reversed(levels):
        if above is None:
            given = nodes.withColumn("w", F.lit(None).cast("array<double>")).withColumn("sent", F.lit(None).cast("array<double>"))
        else:  # weights of what goes on above, and what its edges carry away
            told = above.join(weights.withColumnRenamed("id", "up").hint("merge"), "up").select("id", "w")
            carried = edges.where("part <> far").join(flows.hint("merge"), ["a", "b"])
            ends = carried.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("y").alias("v")), F.struct(F.col("dst").alias("id"), F.transform("y", lambda v: -v).alias("v")))))
            sent = ends.groupBy("id").agg(F.array(*[F.sum(F.element_at("v", k + 1)) for k in range(d)]).alias("sent"))
            given = nodes.join(told.hint("merge"), "id", "left").join(sent.hint("merge"), "id", "left")
        work = lambda key, n, e: _spread(n, e, d, weight, primal, bound)
        out = settled(_inside(given, edges).applyInPandas(work, "a long, b long, v array<double>"))
        weights = out.where("b IS NULL").select(F.col("a").alias("id"), F.col("v").alias("w"))
        along = out.where("b IS NOT NULL").select("a", "b", F.col("v").alias("y"))
        flows = along if flows is None else flows.unionByName(along)
    return weights.withColumnRenamed("id", "nid"), flows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "y")


def _inside(nodes: DataFrame, edges: DataFrame):
    """Nodes of a part beside the edges inside it."""
    return nodes.groupBy("part").cogroup(edges.where("part = far").groupBy("part"))


def _placed(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    nodes = nodes.sort_values("id", ignore_index=True)
    ids = nodes["id"].to_numpy()
    return nodes, np.searchsorted(ids, edges["src"].to_numpy(np.int64)), np.searchsorted(ids, edges["dst"].to_numpy(np.int64))


def _members(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The first node of each node's component."""
    nodes, src, dst = _placed(nodes, edges)
    ids = nodes["id"].to_numpy()
    return pd.DataFrame({"id": ids, "up": ids[components(len(ids), src, dst)]})


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The lowest place in each place's component."""
    first = np.arange(n)
    while True:
        low = first.copy()
        both = np.minimum(first[src], first[dst])
        for end in (first[src], first[dst]):  # a component's first place learns of lower ones
            np.minimum.at(low, end, both)
        low = low[low]
        if (low == first).all():
            return first
        first = low


def forest(first: np.ndarray, src: np.ndarray, dst: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, their parents, edges to these) of every depth of the breadth-first trees from the components' first places, from depth 1."""
    n = len(first)
    tail, head, line = np.concatenate([src, dst]), np.concatenate([dst, src]), np.tile(np.arange(len(src)), 2)
    order = np.argsort(tail, kind="stable")
    head, line, start = head[order], line[order], np.searchsorted(tail[order], np.arange(n + 1))
    rim, out = np.flatnonzero(first == np.arange(n)), []
    reached = np.zeros(n, bool)
    while len(rim):
        reached[rim] = True
        count = start[rim + 1] - start[rim]
        at = np.repeat(start[rim] - np.cumsum(count) + count, count) + np.arange(count.sum())
        parent = np.repeat(rim, count)
        fresh = ~reached[head[at]]
        at, parent = at[fresh], parent[fresh]
        rim, one = np.unique(head[at], return_index=True)
        if len(rim):
            out.append((rim, parent[one], line[at[one]]))
    return out


def _spread(nodes: pd.DataFrame, edges: pd.DataFrame, d: int, weight: float, primal: float, bound: float) -> pd.DataFrame:
    """Weights of the nodes and flows of the trees' edges."""
    nodes, src, dst = _placed(nodes, edges)
    n = len(nodes)
    first = components(n, src, dst)
    sums = np.stack(nodes["sums"].to_list()).astype(float)
    total = np.zeros_like(sums)
    np.add.at(total, first, sums)
    roots = np.unique(first)
    w = np.zeros((n, d))
    w[roots] = np.einsum("kij,kj->ki", np.linalg.pinv(total[roots, : d * d].reshape(-1, d, d), rcond=1e-10, hermitian=True), total[roots, d * d :])
    w = w[first]
    has = nodes["w"].notna().to_numpy()
    if has.any():
        w[has] = np.stack(nodes["w"][has].to_list())
    pull = 2 * weight / primal * (sums[:, d * d :] - np.einsum("kij,kj->ki", sums[:, : d * d].reshape(-1, d, d), w))
    has = nodes["sent"].notna().to_numpy()
    if has.any():
        pull[has] -= np.stack(nodes["sent"][has].to_list())
    y = np.zeros((len(src), d))
    for places, parents, lines in reversed(forest(first, src, dst)):
        flow = pull[places]
        flow = flow * np.minimum(1, bound / np.maximum(np.linalg.norm(flow, axis=1), 1e-300))[:, None]
        y[lines] = flow * np.where(src[lines] == places, 1.0, -1.0)[:, None]
        np.add.at(pull, parents, flow)
    used = np.flatnonzero(y.any(axis=1))
    ends = edges.iloc[used]
    a = np.concatenate([nodes["id"].to_numpy(), ends["a"].to_numpy(np.int64)])
    b = pd.array([None] * n + ends["b"].tolist(), dtype="Int64")
    return pd.DataFrame({"a": a, "b": b, "v": list(w) + list(y[used])})
