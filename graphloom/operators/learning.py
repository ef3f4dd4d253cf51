"""Total-variation learning on graphs by one primal-dual iteration,

    y <- clip(y + c2 D(2 x - x_prev), bound),   x <- prox(x - c1 gamma D'y),   output: running average of x,

with D the edge differences (source less target), gamma one over the degree and D scaled by 1/2. A problem is told by its constants,
its clip and its prox. Two strategies run it: loop() keeps nodes and edges as tables and suits large graphs and few rounds;
solve() runs all rounds of a graph in one NumPy task and suits many graphs that fit a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import added, ball_clip, box_clip, dot, scaled
from graphloom.operators.graphs import degrees, divergence, ends, gradient
from graphloom.plans.state import settled


@dataclass(frozen=True)
class Problem:
    """seed: "clamp" sets labelled nodes to their label, "pull" moves them to (x + gamma label) / (1 + gamma). bound: of the flow, times
    the weight if weighted. shrink: unlabelled nodes are divided by 1 + shrink gamma."""

    primal: float = 0.9
    dual: float = 0.99
    bound: float = 1.0
    weighted: bool = False
    seed: str = "clamp"
    shrink: float = 0.0


SPARSE_LABEL_PROPAGATION = Problem()
BLOCK_MODEL_VARIANT = Problem(primal=1.0, dual=0.9)
FLOW_LASSO = Problem(primal=1.0, dual=1.0, weighted=True, seed="pull")


def local_clustering(bound: float, shrink: float) -> Problem:
    return Problem(primal=1.0, dual=1.0, bound=bound, weighted=True, seed="pull", shrink=shrink)


def _prox(problem: Problem, x: Column) -> Column:
    gamma = F.col("gamma")
    pulled = F.col("label") if problem.seed == "clamp" else (x + gamma * F.col("label")) / (1.0 + gamma)
    return F.when(F.col("is_labeled"), pulled).otherwise(x / (1.0 + problem.shrink * gamma))


def loop(nodes: DataFrame, edges: DataFrame, problem: Problem, rounds: int, settle_every: int = 2) -> tuple[DataFrame, DataFrame]:
    """nodes (nid, label, is_labeled), edges (src, dst, w and y to start from, else 0) after so many rounds: nodes with x and
    average, edges with y. Every round is two equi-joins on node ids and one grouped sum."""
    state = settled(degrees(nodes.select("nid", "label", "is_labeled"), edges).select("nid", "label", "is_labeled", "gamma", F.lit(0.0).alias("x"), F.lit(0.0).alias("prev"), F.lit(0.0).alias("average")))
    flows = edges if "y" in edges.columns else edges.withColumn("y", F.lit(0.0))
    for k in range(1, rounds + 1):
        ahead = state.select("nid", (2.0 * F.col("x") - F.col("prev")).alias("x"))
        bound = F.lit(problem.bound) * F.col("w") if problem.weighted else F.lit(problem.bound)
        flows = gradient(flows, ahead).withColumn("y", box_clip(F.col("y") + problem.dual * 0.5 * F.col("dx"), bound)).drop("dx")
        moved = state.join(divergence(flows), "nid", "left")
        x = _prox(problem, F.col("x") - problem.primal * F.col("gamma") * F.coalesce("div", F.lit(0.0)))
        state = moved.select("nid", "label", "is_labeled", "gamma", x.alias("x"), F.col("x").alias("prev"), F.col("average").alias("_old"))
        state = state.select("nid", "label", "is_labeled", "gamma", "x", "prev", ((F.col("_old") * (k - 1) + F.col("x")) / k).alias("average"))
        if k % settle_every == 0 or k == rounds:
            flows, state = settled(flows), settled(state)
    return state, flows


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int, settle_every: int = 2) -> DataFrame:
    """Neighbour averages, labelled nodes clamped before the first and after every round; isolated nodes keep their value. From 0."""
    both = settled(ends(edges).select("nid", "other"))
    state = nodes.select("nid", "label", "is_labeled", F.when(F.col("is_labeled"), F.col("label")).otherwise(0.0).alias("x"))
    for k in range(1, rounds + 1):
        far = state.select(F.col("nid").alias("other"), F.col("x").alias("v"))
        mean = both.join(far.hint("merge"), "other").groupBy("nid").agg(F.avg("v").alias("mean"))
        x = F.when(F.col("is_labeled"), F.col("label")).otherwise(F.coalesce("mean", "x"))
        state = state.join(mean.hint("merge"), "nid", "left").select("nid", "label", "is_labeled", x.alias("x"))
        if k % settle_every == 0 or k == rounds:
            state = settled(state)
    return state


def run(src: np.ndarray, dst: np.ndarray, w: np.ndarray, label: np.ndarray, seeds: np.ndarray, problem: Problem, rounds: int, flow: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, running average and flow of one graph with nodes 0 ... n - 1."""
    n = len(label)
    degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
    gamma = np.divide(1.0, degree, out=np.zeros(n), where=degree > 0)
    bound = problem.bound * (w if problem.weighted else np.ones(len(src)))
    x, prev, average = np.zeros(n), np.zeros(n), np.zeros(n)
    y = np.zeros(len(src)) if flow is None else flow.astype(float)
    for k in range(1, rounds + 1):
        ahead = 2 * x - prev
        y = np.clip(y + problem.dual * 0.5 * (ahead[src] - ahead[dst]), -bound, bound)
        div = np.bincount(src, y, n) - np.bincount(dst, y, n)
        prev, x = x, x - problem.primal * gamma * div
        pulled = label if problem.seed == "clamp" else (x + gamma * label) / (1 + gamma)
        x = np.where(seeds, pulled, x / (1 + problem.shrink * gamma))
        average += (x - average) / k
    return x, average, y


def solve(nodes: DataFrame, edges: DataFrame, problem: Problem, rounds: int, graph: str = "graph_id") -> DataFrame:
    """(graph, nid, x, average) for many graphs at once; both tables carry the graph's id."""

    def work(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("nid")
        e = e.sort_values(["src", "dst"])
        ids = n["nid"].to_numpy()
        at = lambda c: np.searchsorted(ids, e[c].to_numpy())
        flow = e["y"].to_numpy() if "y" in e else None
        x, average, _ = run(at("src"), at("dst"), e["w"].to_numpy(float), n["label"].fillna(0).to_numpy(float), n["is_labeled"].to_numpy(bool), problem, rounds, flow)
        return pd.DataFrame({graph: key[0], "nid": ids, "x": x, "average": average})

    kind = nodes.schema[graph].dataType.simpleString()
    return nodes.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(work, f"`{graph}` {kind}, nid long, x double, average double")


# Regression with a weight vector at each node: solve_regression() for many graphs, a task each; loop_regression() for a few rounds on
# tables; partitioned.regression() for one graph to convergence -----------------------------------------------------------------------


@dataclass(frozen=True)
class Regression:
    """loss: "squared" with noise variance, or "absolute"; bound: length of an edge's flow vector."""

    loss: str = "squared"
    bound: float = 1 / 9
    primal: float = 0.9
    dual: float = 1.0
    variance: float = 1.0


def regress(src: np.ndarray, dst: np.ndarray, features: np.ndarray, target: np.ndarray, seeds: np.ndarray, problem: Regression, rounds: int) -> np.ndarray:
    """Running average of the nodes' weight vectors, n x d."""
    n, d = features.shape
    degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
    gamma = np.divide(1.0, degree, out=np.zeros(n), where=degree > 0)
    w, prev, average, y = (np.zeros((n, d)) for _ in range(4))
    y = np.zeros((len(src), d))
    at = np.where(seeds)[0]
    f, t = features[at], target[at]
    size = np.maximum((f * f).sum(axis=1), 1e-300)
    for k in range(1, rounds + 1):
        ahead = 2 * w - prev
        y = y + problem.dual * 0.5 * (ahead[src] - ahead[dst])
        length = np.linalg.norm(y, axis=1)
        y *= np.minimum(1, problem.bound / np.maximum(length, 1e-300))[:, None]
        div = np.zeros((n, d))
        np.add.at(div, src, y)
        np.subtract.at(div, dst, y)
        prev, w = w, w - problem.primal * gamma[:, None] * div
        z = w[at]
        if problem.loss == "squared":
            # (x x'/s + tau I)^-1 (x y/s + tau z) with tau = card / (2 gamma), by the rank-one inverse
            tau = len(at) / (2 * np.maximum(gamma[at], 1e-300))
            gap = t - (f * z).sum(axis=1)
            w[at] = z + f * (gap / (problem.variance * tau + size))[:, None]
        else:
            # along x the residual is soft-thresholded by gamma; across x nothing changes
            along = (f * z).sum(axis=1)
            gap = along - t
            new = t + np.sign(gap) * np.maximum(np.abs(gap) - gamma[at] * size, 0)
            w[at] = z + f * ((new - along) / size)[:, None]
        average += (w - average) / k
    return average


def solve_regression(nodes: DataFrame, edges: DataFrame, problem: Regression, rounds: int, graph: str = "graph_id") -> DataFrame:
    """(graph, nid, weights, predicted) of nodes (graph, nid, feature, label, is_labeled)."""

    def work(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("nid")
        e = e.sort_values(["src", "dst"])
        ids, x = n["nid"].to_numpy(), np.stack(n["feature"].to_list())
        w = regress(np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), x, n["label"].fillna(0).to_numpy(float), n["is_labeled"].to_numpy(bool), problem, rounds)
        return pd.DataFrame({graph: key[0], "nid": ids, "weights": list(w), "predicted": (w * x).sum(axis=1)})

    kind = nodes.schema[graph].dataType.simpleString()
    return nodes.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(work, f"`{graph}` {kind}, nid long, weights array<double>, predicted double")


def loop_regression(nodes: DataFrame, edges: DataFrame, problem: Regression, rounds: int, dimension: int, settle_every: int = 2) -> DataFrame:
    """(nid, weights, predicted) of one graph too large for a task: regress() on tables. Vectors are array columns; a round is two
    equi-joins on node ids and one grouped sum of `dimension` numbers, combined before it moves."""
    zero = F.array(*[F.lit(0.0)] * dimension)
    kept = degrees(nodes.select("nid", "feature", F.coalesce("label", F.lit(0.0)).alias("label"), "is_labeled"), edges)
    labelled = nodes.agg(F.count_if("is_labeled").alias("_card"))  # one row
    state = settled(kept.join(F.broadcast(labelled)).select("nid", "feature", "label", "is_labeled", "gamma", "_card", zero.alias("w"), zero.alias("prev"), zero.alias("average")))
    flows = edges.select("src", "dst", zero.alias("y"))
    for k in range(1, rounds + 1):
        ahead = state.select("nid", F.zip_with("w", "prev", lambda a, b: 2.0 * a - b).alias("v"))
        met = flows.join(ahead.select(F.col("nid").alias("src"), F.col("v").alias("_a")), "src").join(ahead.select(F.col("nid").alias("dst"), F.col("v").alias("_b")), "dst")
        step = scaled(F.zip_with("_a", "_b", lambda a, b: a - b), problem.dual * 0.5)
        flows = met.select("src", "dst", ball_clip(added("y", step), problem.bound).alias("y"))
        signed = F.inline(F.array(F.struct(F.col("src").alias("nid"), F.col("y").alias("v")), F.struct(F.col("dst").alias("nid"), scaled("y", -1.0).alias("v"))))
        sums = flows.select(signed).groupBy("nid").agg(F.array(*[F.sum(F.col("v")[d]) for d in range(dimension)]).alias("div"))
        z = F.zip_with("w", F.coalesce("div", zero), lambda a, b: a - problem.primal * F.col("gamma") * b)
        moved = state.join(sums, "nid", "left").withColumn("z", z).withColumn("_c", _regression_step(problem))
        w = added("z", scaled("feature", F.when(F.col("is_labeled"), F.col("_c")).otherwise(0.0)))
        state = moved.select("nid", "feature", "label", "is_labeled", "gamma", "_card", w.alias("w"), F.col("w").alias("prev"), "average")
        state = state.withColumn("average", scaled(added(scaled("average", k - 1.0), "w"), 1.0 / k))
        if k % settle_every == 0 or k == rounds:
            flows, state = settled(flows), settled(state)
    return state.select("nid", F.col("average").alias("weights"), dot("average", "feature").alias("predicted"))


def _regression_step(problem: Regression) -> Column:
    """How far along its feature a labelled node's weights z move; regress() has the formulas."""
    size, along = F.greatest(dot("feature", "feature"), F.lit(1e-300)), dot("feature", "z")
    if problem.loss == "squared":
        tau = F.col("_card") / (2.0 * F.greatest("gamma", F.lit(1e-300)))
        return (F.col("label") - along) / (problem.variance * tau + size)
    gap = along - F.col("label")
    return (F.col("label") + F.signum(gap) * F.greatest(F.abs(gap) - F.col("gamma") * size, F.lit(0.0)) - along) / size


def least_absolute(rows: DataFrame, dimension: int, feature: str = "feature", label: str = "label", rounds: int = 50, floor: float = 1e-6, tolerance: float = 1e-6) -> list[float]:
    """The weights w that minimise the sum of |label - feature . w|, by reweighted least squares: a round is one grouped sum of the moments,
    each row weighted by one over its last residual (at least `floor` of the largest label), and a system of `dimension` unknowns on the driver.
    Zeros without rows."""
    scale = rows.agg(F.max(F.abs(label))).first()[0]
    w = np.zeros(dimension)
    if not scale:
        return w.tolist()
    x = [F.element_at(feature, k + 1) for k in range(dimension)]
    for k in range(rounds):
        left = F.abs(F.col(label) - dot(feature, F.array(*[F.lit(float(v)) for v in w])))
        weight = F.lit(1.0) if not k else 1.0 / F.greatest(left, F.lit(floor * scale))
        held = rows.select(weight.alias("_u"), *[c.alias(f"_x{i}") for i, c in enumerate(x)], F.col(label).alias("_t"))
        columns = [*[f"_x{i}" for i in range(dimension)], "_t"]
        sums = held.agg(*[F.sum(F.col("_u") * F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(columns) for b in columns[i:]]).first().asDict()
        moment = np.array([[sums[f"{a}{b}"] if i <= j else sums[f"{b}{a}"] for j, b in enumerate(columns)] for i, a in enumerate(columns)])
        before, w = w, np.linalg.lstsq(moment[:-1, :-1], moment[:-1, -1], rcond=None)[0]
        if np.abs(w - before).max() <= tolerance * max(1.0, np.abs(w).max()):
            break
    return w.tolist()


def optimality_gap(average: DataFrame, flows: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int, start: DataFrame) -> DataFrame:
    """One row: the average's variation, and the bound (1 / 2k) p' G^-1 p + (d - s)' L^-1 (d - s), with p = 1, d the reference flow in
    `start` (src, dst, d) and s the signs of the average's differences."""
    variation = gradient(edges, average.select("nid", F.col("average").alias("x")))
    degree = degrees(nodes, edges).agg(F.sum("degree").alias("g"))
    off = variation.join(start, ["src", "dst"]).agg(F.sum(F.abs("dx")).alias("variation"), F.sum(2.0 * F.pow(F.col("d") - F.signum("dx"), F.lit(2.0))).alias("dual"))
    return off.join(F.broadcast(degree)).select("variation", (F.col("g") / (2.0 * rounds) + F.col("dual")).alias("bound"))


def chain_reference(first: float, second: float, bound: float, weak: float) -> tuple[float, float, float]:
    """Cluster values of the exact solution on a two-cluster chain, and its error relative to the signal."""
    shift = bound * weak
    a, b = first - shift, second + shift
    return a, b, 2 * shift**2 / (first**2 + second**2)
