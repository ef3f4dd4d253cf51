"""Network lasso on one large graph: the primal-dual iteration of `learning.regress` over parts of the graph, to convergence.

The graph is cut once. Nodes in the order of a locality key make parts of equal size; a part also holds its halo, the nodes up to s edges
away, and all edges between its nodes, so it can take s steps by itself whose results for its own nodes are exact. Then it sends others
what they have of its own: weights and flows of their halos, nothing else moves. s is the largest depth whose halos are together no larger than
the graph (`Parts.spread`); where halos end before it, parts hold whole components and take as many steps as a single part would. Parts and states are tables
bucketed by part: a round merges them where they are, without a shuffle or a broadcast, which would pass through the driver in every round, and
shuffles the border values alone.

After a round, each part adds up its share of two duality gaps, that of the running averages and that of the last weights and flows, which
is often far smaller; the loop ends when one of them is small against the loss of zero weights, and that solution is the result. With a(w) = sum of the losses and lambda = primal bound, the iteration minimises a(w) + lambda sum |w_u - w_v|; for flows y with
s = primal D'y the gap is a(w) + lambda sum |w_u - w_v| + sum sup_v (-s v - a_i(v)), the supremum taken over weights of length up to twice the
longest weights found, as it is infinite without a bound."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graphs import degrees, ends
from graphloom.operators.learning import Regression
from graphloom.operators.levelled import shared_start
from graphloom.operators.tabular import with_rank
from graphloom.plans.state import removed, settled, shared_dir, ship_package

STATE, MESSAGE, SHARE = 0, 1, 2
OUT = "part long, kind int, other long, bytes binary, shares array<double>"


@dataclass(frozen=True)
class Parts:
    nodes: int = 20_000  #: of its own a part has
    deepest: int = 16  #: edges that a halo reaches at most
    alone: int = 100  #: steps of a round if the graph is a single part, or no component reaches beyond its halo
    spread: int = 1  #: halos hold together at most so many times the graph


@dataclass
class Progress:
    steps: int = 0
    rounds: int = 0
    parts: int = 0
    depth: int = 0
    halo: int = 0  #: copies of nodes in halos
    closed: bool = False  #: whether no component reaches beyond its halo
    objective: float = float("nan")
    gap: float = float("nan")
    averaged: bool = True  #: whether the averages are the result, or the last weights


class Buckets:
    """Tables bucketed by part, in the shared folder; joins on part merge them where they are."""

    def __init__(self, spark: SparkSession, parts: int) -> None:
        self.spark, self.parts = spark, parts
        self.base = f"graphloom_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.base}"

    def write(self, df: DataFrame, name: str) -> str:
        df.write.bucketBy(self.parts, "part").option("path", f"{self.folder}/{name}").saveAsTable(f"{self.base}_{name}")
        return f"{self.base}_{name}"

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, f"{self.folder}/{name.removeprefix(self.base + '_')}")


def zorder(feature: Column | str, low: list[float], high: list[float], bits: int = 10) -> Column:
    """A locality key: the first three coordinates, scaled to integers, with their bits in turn."""
    out = F.lit(0).cast("long")
    axes = list(zip(low, high, strict=True))[:3]
    for d, (a, b) in enumerate(axes):
        place = F.floor((F.element_at(feature, d + 1) - a) / max(b - a, 1e-300) * (2**bits - 1)).cast("long")
        for k in range(bits):
            out = out + F.shiftright(place, k).bitwiseAND(F.lit(1)) * F.lit(1 << (k * len(axes) + d)).cast("long")
    return F.coalesce(out, F.lit(0).cast("long"))


def by_features(nodes: DataFrame, dimension: int) -> Column:
    """The Z-order key of the nodes' features; two numbers a coordinate come to the driver."""
    span = nodes.agg(*[f(F.element_at("feature", d + 1)) for d in range(dimension) for f in (F.min, F.max)]).first()
    values = [0.0 if v is None else float(v) for v in span]
    return zorder("feature", values[::2], values[1::2])


def regression(nodes: DataFrame, edges: DataFrame, problem: Regression, dimension: int, most: int = 10_000, tolerance: float = 1e-3, order: Column | None = None, parts: Parts = Parts(), progress: Progress | None = None, balanced: bool = False, levelled: bool = False) -> DataFrame:
    """(nid, weights, predicted) of nodes (nid, feature, label, is_labeled) and edges (src, dst): after the steps that bring a duality gap to
    tolerance times the loss of zero weights, the solution with that gap; if `most` steps don't, the running averages. progress is told how
    it went. balanced: a squared loss, which has a weight of one over the number of labels, is met with steps of weights as many times longer and steps
    of flows as many times shorter; their product and the minimum stay, and the steps needed no longer grow with the number of labels. levelled: with a squared loss, the weights that each component shares
    are tried first, by a round without steps."""
    spark = nodes.sparkSession
    ship_package(spark)
    progress = Progress() if progress is None else progress
    known = F.when(F.col("is_labeled"), F.coalesce("label", F.lit(0.0)))
    count, labelled, squares, sizes = nodes.agg(F.count("*"), F.count_if("is_labeled"), F.sum(known * known), F.sum(F.abs(known))).first()
    at_zero = (squares or 0.0) / (problem.variance * max(labelled, 1)) if problem.loss == "squared" else sizes or 0.0
    if not count:
        return spark.createDataFrame([], "nid long, weights array<double>, predicted double")
    progress.parts = -(-count // parts.nodes)
    home, links, graph, progress.depth, progress.halo, progress.closed = _cut(nodes, edges, dimension, by_features(nodes, dimension) if order is None else order, parts, progress.parts)
    ratio = max(problem.variance * labelled, 1.0) if balanced and problem.loss == "squared" else 1.0
    tables = Buckets(spark, progress.parts)
    bucketed, dropped = tables.write, tables.drop
    fixed = bucketed(graph.repartition(progress.parts, "part"), "graph")
    begin = F.lit(None).cast("binary")
    state = None
    if levelled and problem.loss == "squared" and labelled:
        start = shared_start(home, links, dimension, 1 / (problem.variance * labelled), problem.primal, problem.bound, 16 * parts.nodes)
        if start:
            state = bucketed(_begun(spark.table(fixed), home, *start, dimension).repartition(progress.parts, "part"), "start")
    tried = state is not None
    while True:
        now = spark.table(fixed)
        if state is None:
            joined = now.withColumn("state", begin).withColumn("inbox", F.lit(None).cast("array<struct<sender:bigint,bytes:binary>>"))
        else:
            told = spark.table(state)
            mail = told.where(F.col("kind") == MESSAGE).select(F.col("other").alias("part"), F.struct(F.col("part").alias("sender"), "bytes").alias("m"))
            inbox = mail.repartition(progress.parts, "part").groupBy("part").agg(F.collect_list("m").alias("inbox"))  # an entry a neighbouring part
            joined = now.join(told.where(F.col("kind") == STATE).select("part", F.col("bytes").alias("state")).hint("merge"), "part").join(inbox.hint("merge"), "part", "left")
        steps = progress.depth if not progress.closed else parts.alone if progress.parts == 1 else min(parts.alone, 100 << min(progress.rounds, 20))
        take = 0 if tried else min(steps, most - progress.steps)
        moved = joined.select("part", "graph", "state", "inbox").mapInArrow(lambda batches, take=take: _steps(batches, problem, labelled, take, ratio), OUT)
        before, state = state, bucketed(moved, f"round{progress.rounds}")
        if before:  # the shares tell of the state that the round began with
            names = [f"s{k}" for k in range(8)]
            shares = spark.table(state).where(F.col("kind") == SHARE).select(*[F.element_at("shares", k + 1).alias(n) for k, n in enumerate(names)])
            sums = shares.agg(*[(F.max if k % 4 == 3 else F.sum)(n) for k, n in enumerate(names)]).first()
            gaps = [(objective, objective + fixed_part + slope * 2 * longest) for objective, fixed_part, slope, longest in (sums[:4], sums[4:])]
            good = [gap <= tolerance * at_zero for _, gap in gaps]
            progress.averaged = good[0] or not good[1]
            progress.objective, progress.gap = gaps[0 if progress.averaged else 1]
            dropped(state if any(good) else before)
            if any(good):
                state = before
                break
        if not take and not tried:
            break
        tried = False
        progress.steps, progress.rounds = progress.steps + take, progress.rounds + 1
    last = spark.table(fixed).join(spark.table(state).where(F.col("kind") == STATE).select("part", F.col("bytes").alias("state")).hint("merge"), "part")
    result = settled(last.mapInArrow(lambda batches, averaged=progress.averaged: _results(batches, averaged), "nid long, weights array<double>, predicted double"))
    dropped(state)
    dropped(fixed)
    return result


def _cut(nodes: DataFrame, edges: DataFrame, dimension: int, order: Column, parts: Parts, count: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int, bool]:
    """The nodes with their owners, the edges without loops, (part, graph) with everything a part needs to know, the depth of the halos, their size, and whether nothing lies beyond them."""
    sized = degrees(nodes.select("nid", "feature", F.coalesce("label", F.lit(0.0)).alias("label"), "is_labeled", order.alias("_order")), edges)
    placed = with_rank(sized.select("nid", "feature", "label", "is_labeled", "gamma", "strength", "_order"), [F.asc("_order"), F.asc("nid")], "place")
    home = settled(placed.withColumn("owner", F.floor((F.col("place") - 1) / parts.nodes).cast("long")).drop("place", "_order"))
    links = settled(edges.select("src", "dst", "w").where("src <> dst"))
    both = ends(links).select("nid", "other")
    inside = home.select(F.col("owner").alias("part"), "nid", F.lit(0).alias("far"))
    depth, total, budget, closed = 0, 0, parts.spread * home.count(), count == 1
    held = settled(inside)
    while count > 1 and depth < parts.deepest:
        rim = held.where(F.col("far") == depth).join(both, "nid").select("part", F.col("other").alias("nid")).distinct()
        fresh = settled(rim.join(held, ["part", "nid"], "left_anti").withColumn("far", F.lit(depth + 1)))
        size = fresh.count()
        if not size:
            depth, closed = max(depth, 1), True
            break
        if depth and total + size > budget:
            break
        depth, total, held = depth + 1, total + size, settled(held.unionByName(fresh))
    local = held.join(home, "nid")
    a = held.select("part", F.col("nid").alias("src"))
    b = held.select("part", F.col("nid").alias("dst"))
    owners = home.select(F.col("nid").alias("src"), "owner")
    lines = links.join(a, "src").join(b, ["part", "dst"]).join(owners, "src")
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = local.select("part", F.lit(0).alias("kind"), F.col("nid").alias("a"), nothing("long").alias("b"), F.col("owner").alias("other"), "feature", "label", "is_labeled", "gamma", F.col("strength").alias("w"))
    unset = [nothing("array<double>").alias("feature"), nothing("double").alias("label"), nothing("boolean").alias("is_labeled"), nothing("double").alias("gamma")]
    plain = [*unset, nothing("double").alias("w")]
    rows = rows.unionByName(lines.select("part", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("owner").alias("other"), *unset, "w"))
    rows = rows.unionByName(local.where("owner <> part").select(F.col("owner").alias("part"), F.lit(2).alias("kind"), F.col("nid").alias("a"), nothing("long").alias("b"), F.col("part").alias("other"), *plain))
    rows = rows.unionByName(lines.where("owner <> part").select(F.col("owner").alias("part"), F.lit(3).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("part").alias("other"), *plain))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "graph": [pickle.dumps(_Local.of(int(key[0]), pdf, dimension))]})

    return home, links, rows.groupBy("part").applyInPandas(pack, "part long, graph binary"), depth, total, closed


def _begun(graph: DataFrame, home: DataFrame, weights: DataFrame, flows: DataFrame, dimension: int) -> DataFrame:
    """The parts' states and messages with weights (nid, w) and flows (src, dst, y) that are known."""
    owners = home.select("nid", F.col("owner").alias("part"))
    rows = weights.join(owners.hint("merge"), "nid").select("part", F.col("nid").alias("a"), F.lit(None).cast("long").alias("b"), F.col("w").alias("v"))
    rows = rows.unionByName(flows.join(owners.withColumnRenamed("nid", "src").hint("merge"), "src").select("part", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("y").alias("v")))

    def begin(key: tuple, held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        g = pickle.loads(held["graph"].iloc[0])
        w, y = np.zeros((len(g.nids), dimension)), np.zeros((len(g.src), dimension))
        node, line = known[known["b"].isna()], known[known["b"].notna()]
        if len(node):
            w[pd.Index(g.nids[: g.own]).get_indexer(node["a"])] = np.stack(node["v"].to_list())
        if len(line):
            mine = np.flatnonzero(g.mine)
            at = pd.MultiIndex.from_arrays([g.nids[g.src[mine]], g.nids[g.dst[mine]]]).get_indexer(pd.MultiIndex.from_arrays([line["a"].astype("int64"), line["b"].astype("int64")]))
            y[mine[at]] = np.stack(line["v"].to_list())
        s = _State(0, w, w.copy(), w.copy(), y, y.copy())
        return pd.DataFrame(_told(g, s), columns=["part", "kind", "other", "bytes", "shares"]).astype({"other": "Int64"})

    return graph.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(begin, OUT)


@dataclass
class _Local:
    """A part: its own nodes first, then the halo; edges by the places of their ends; who gets and who sends which places."""

    part: int
    own: int
    nids: np.ndarray
    feature: np.ndarray
    label: np.ndarray
    seeds: np.ndarray
    gamma: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    mine: np.ndarray  #: edges whose source is an own node
    give: dict[int, tuple[np.ndarray, np.ndarray]]
    take: dict[int, tuple[np.ndarray, np.ndarray]]
    w: np.ndarray  #: of the edges
    strength: np.ndarray  #: of the nodes, with edges that the part doesn't hold

    @staticmethod
    def of(part: int, pdf: pd.DataFrame, dimension: int) -> _Local:
        n = pdf[pdf["kind"] == 0]
        n = n.assign(_halo=n["other"] != part).sort_values(["_halo", "a"])
        place = pd.Series(np.arange(len(n)), index=n["a"].to_numpy())
        e = pdf[pdf["kind"] == 1].sort_values(["a", "b"])
        line = pd.Series(np.arange(len(e)), index=pd.MultiIndex.from_arrays([e["a"].to_numpy(), e["b"].astype("int64").to_numpy()]))
        owner_n, owner_e = n["other"].to_numpy(), e["other"].to_numpy()
        give = {}
        out_n, out_e = pdf[pdf["kind"] == 2].sort_values("a"), pdf[pdf["kind"] == 3].sort_values(["a", "b"])
        for to in sorted(set(out_n["other"]) | set(out_e["other"])):
            x, y = out_n[out_n["other"] == to], out_e[out_e["other"] == to]
            give[int(to)] = (place.reindex(x["a"]).to_numpy(np.int64), line.reindex(pd.MultiIndex.from_arrays([y["a"].to_numpy(), y["b"].astype("int64").to_numpy()])).to_numpy(np.int64) if len(y) else np.empty(0, np.int64))
        take = {int(q): (np.flatnonzero(owner_n == q), np.flatnonzero(owner_e == q)) for q in set(owner_n) | set(owner_e) if q != part}
        return _Local(
            part, int((owner_n == part).sum()), n["a"].to_numpy(), np.stack(n["feature"].to_list()).astype(float).reshape(len(n), dimension), n["label"].to_numpy(float), n["is_labeled"].to_numpy(bool),
            n["gamma"].to_numpy(float), place.reindex(e["a"]).to_numpy(np.int64), place.reindex(e["b"].astype("int64")).to_numpy(np.int64), owner_e == part, give, take, e["w"].to_numpy(float), n["w"].to_numpy(float),
        )


@dataclass
class _State:
    step: int
    w: np.ndarray
    prev: np.ndarray
    average: np.ndarray  #: of all nodes; those of the halo as last told
    y: np.ndarray
    flow: np.ndarray  #: average of y, right for edges with an own end


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[_Local, _State | None, list]]:
    inboxes = batch.column("inbox").to_pylist() if "inbox" in batch.schema.names else [None] * batch.num_rows
    for at in range(batch.num_rows):
        graph, state = (batch.column(c)[at].as_py() for c in ("graph", "state"))
        yield pickle.loads(graph), pickle.loads(state) if state else None, inboxes[at] or []


def _steps(batches: Iterator[pa.RecordBatch], problem: Regression, labelled: int, steps: int, ratio: float = 1.0) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, s, inbox in _rows(batch):
            n, d = g.feature.shape
            out = []
            if s is None:
                s = _State(0, *(np.zeros((n, d)) for _ in range(3)), *(np.zeros((len(g.src), d)) for _ in range(2)))
            else:
                for m in inbox:
                    nodes, lines = g.take[m["sender"]]
                    v = np.frombuffer(m["bytes"]).reshape(-1, d)
                    k = len(nodes)
                    s.w[nodes], s.prev[nodes], s.average[nodes], s.y[lines] = v[:k], v[k : 2 * k], v[2 * k : 3 * k], v[3 * k :]
                out.append((g.part, SHARE, None, None, _gap_shares(g, s.average, s.flow, problem, labelled) + _gap_shares(g, s.w, s.y, problem, labelled)))
            _advance(g, s, problem, labelled, steps, ratio)
            out += _told(g, s)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "kind", "other", "bytes", "shares"])


def _told(g: _Local, s: _State) -> list[tuple]:
    """Rows of a part's state and of what it tells others."""
    out = [(g.part, STATE, None, pickle.dumps(s), None)]
    for to, (nodes, lines) in g.give.items():
        out.append((g.part, MESSAGE, to, np.concatenate([s.w[nodes], s.prev[nodes], s.average[nodes], s.y[lines]]).tobytes(), None))
    return out


def _divergence(g: _Local, y: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(g.src, y[:, k], len(g.nids)) - np.bincount(g.dst, y[:, k], len(g.nids)) for k in range(y.shape[1])], axis=1)


def _advance(g: _Local, s: _State, problem: Regression, labelled: int, steps: int, ratio: float = 1.0) -> None:
    """Steps on the part and its halo; what is further from the own nodes than the steps left is wrong and never read."""
    at = np.flatnonzero(g.seeds)
    primal = g.gamma * ratio
    f, t, gamma = g.feature[at], g.label[at], primal[at]
    size = np.maximum((f * f).sum(axis=1), 1e-300)
    for _ in range(steps):
        s.step += 1
        ahead = 2 * s.w - s.prev
        y = s.y + problem.dual / ratio * 0.5 * (ahead[g.src] - ahead[g.dst])
        y *= np.minimum(1, problem.bound / np.maximum(np.linalg.norm(y, axis=1), 1e-300))[:, None]
        s.y, s.prev = y, s.w
        w = s.w - problem.primal * primal[:, None] * _divergence(g, y)
        along = (f * w[at]).sum(axis=1)
        if problem.loss == "squared":
            move = (t - along) / (problem.variance * labelled / (2 * np.maximum(gamma, 1e-300)) + size)
        else:
            gap = along - t
            move = (t + np.sign(gap) * np.maximum(np.abs(gap) - gamma * size, 0) - along) / size
        w[at] += f * move[:, None]
        s.w = w
        s.average[: g.own] += (w[: g.own] - s.average[: g.own]) / s.step
        s.flow += (y - s.flow) / s.step


def _gap_shares(g: _Local, weights: np.ndarray, flow: np.ndarray, problem: Regression, labelled: int) -> list[float]:
    """The part's share of: objective, the fixed part of the supremum and its slope in the bound on weights; and its longest weights."""
    own = g.own
    w, f, t, seeds = weights[:own], g.feature[:own], g.label[:own], g.seeds[:own]
    pull = problem.primal * _divergence(g, flow)[:own]
    length = np.maximum(np.linalg.norm(f, axis=1), 1e-300)
    along = (pull * f).sum(axis=1) / length
    across = np.linalg.norm(pull - along[:, None] * f / length[:, None], axis=1)
    left = t - (f * w).sum(axis=1)
    if problem.loss == "squared":
        weight = 1 / (problem.variance * max(labelled, 1))
        loss, fixed, slope = weight * left**2, -along * t / length + along**2 / (4 * weight * length**2), across
    else:
        over = np.abs(along) > length
        loss, fixed, slope = np.abs(left), np.where(over, np.abs(t), -along * t / length), across + np.where(over, np.abs(along) - length, 0)
    apart = weights[g.src[g.mine]] - weights[g.dst[g.mine]]
    objective = loss[seeds].sum() + problem.primal * problem.bound * np.linalg.norm(apart, axis=1).sum()
    return [float(objective), float(fixed[seeds].sum()), float(slope[seeds].sum() + np.linalg.norm(pull[~seeds], axis=1).sum()), float(np.linalg.norm(w, axis=1).max(initial=0.0))]


def _results(batches: Iterator[pa.RecordBatch], averaged: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g, s, _ in _rows(batch):
            w = (s.average if averaged else s.w)[: g.own]
            yield pa.RecordBatch.from_arrays([pa.array(g.nids[: g.own]), pa.array(list(w), pa.list_(pa.float64())), pa.array((w * g.feature[: g.own]).sum(axis=1))], names=["nid", "weights", "predicted"])
