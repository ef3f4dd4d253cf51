"""Flows, local communities, eigenvectors and smooth models on tables, against the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.kernels import networks
from graphloom.operators import diffusion, flows, solvers


def two_clusters(seed, n=24, across=4):
    g = np.random.default_rng(seed)
    half = n // 2
    pairs = {(min(a, b), max(a, b)) for c in (0, 1) for a, b in g.integers(0, half, (3 * half, 2)) + c * half if a != b}
    pairs |= {(int(g.integers(0, half)), int(g.integers(half, n))) for _ in range(across)} | {(i, i + 1) for i in range(n - 1) if i + 1 != half}
    src, dst = np.array(sorted(pairs)).T
    return n, src, dst, g.integers(1, 5, len(src)).astype(float)


def tables(spark, graph):
    n, src, dst, w = graph
    edges = spark.createDataFrame([(int(a) * 10, int(b) * 10, float(c)) for a, b, c in zip(src, dst, w)], "src long, dst long, w double").repartition(2)
    return spark.createDataFrame([(10 * i,) for i in range(n)], "nid long"), edges


def test_max_flow(spark):
    graph = two_clusters(1, 8, 2)
    nodes, edges = tables(spark, graph)
    value, sides = flows.between(nodes, edges, "nid = 0", "nid = 70")
    assert value == pytest.approx(networks.max_flow(*graph, 0, 7)[0]) == flows.cut_value(edges, sides)
    side = {r.nid: r.source_side for r in sides.collect()}
    assert len(side) == 8 and side[0] and not side[70]


def test_flow_between_sets_and_without_a_way(spark):
    edges = spark.createDataFrame([(0, 2, 3.0), (1, 2, 2.0), (2, 3, 4.0), (2, 4, 0.5), (7, 8, 1.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 7, 8)], "nid long")
    assert flows.between(nodes, edges, "nid < 2", "nid IN (3, 4)")[0] == 4.5
    assert flows.between(nodes, edges, "nid = 0", "nid = 8")[0] == 0.0


def test_flow_improvement(spark):
    n, src, dst, w = graph = two_clusters(3, 8, across=2)
    nodes, edges = tables(spark, graph)
    members = [*range(4), 5]
    want, ratio = networks.flow_improved(n, src, dst, w, members)
    got, found = flows.improved(edges, spark.createDataFrame([(10 * m,) for m in members], "nid long"))
    assert found == pytest.approx(ratio)
    inside = np.isin(np.arange(n), [r.nid // 10 for r in got.collect()])
    assert w[inside[src] != inside[dst]].sum() / (np.bincount(src, w, n) + np.bincount(dst, w, n))[inside].sum() == pytest.approx(ratio)


def test_pushed_rank_and_sweep(spark):
    n, src, dst, w = graph = two_clusters(4)
    _, edges = tables(spark, graph)
    arcs = diffusion.weighted_ends(edges)
    error, restart = 2e-3, 0.15
    state = {r.nid // 10: r for r in diffusion.pushed_rank(arcs, spark.createDataFrame([(0,), (0,), (20,)], "nid long"), restart, error).collect()}
    weight = np.zeros((n, n))
    weight[src, dst] = weight[dst, src] = w
    strength = weight.sum(axis=1)
    seeds = np.isin(np.arange(n), [0, 2]) / 2
    # exact rank of the lazy walk: p = restart s + (1 - restart) p (I + D^-1 W) / 2
    exact = np.linalg.solve((np.eye(n) - (1 - restart) * (np.eye(n) + weight / strength[:, None]) / 2).T, restart * seeds)
    for i in range(n):
        score, rest = (state[i].score, state[i].rest) if i in state else (0.0, 0.0)
        assert rest < error * strength[i] and -1e-12 <= exact[i] - score <= error * strength[i]
    scores = spark.createDataFrame([(10 * i, float(exact[i]), float(strength[i])) for i in range(n)], "nid long, score double, strength double")
    members, conductance = diffusion.sweep_cut(arcs, scores)
    near = networks.adjacency(n, src, dst, w)
    want, best = networks.sweep_cut(near, exact)
    assert conductance == pytest.approx(best) and sorted(r.nid // 10 for r in members.collect()) == want


def test_sweep_of_nothing(spark):
    _, edges = tables(spark, two_clusters(4))
    none = spark.createDataFrame([], "nid long, score double, strength double")
    members, conductance = diffusion.sweep_cut(diffusion.weighted_ends(edges), none)
    assert members.collect() == [] and conductance == float("inf")


def test_prefix_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(diffusion, "CHUNK", 7)
    df = spark.range(1, 41).select(F.col("id").alias("place"), F.col("id").cast("double").alias("v"))
    assert [r.v for r in diffusion.prefix_sums(df, "place", ["v"]).orderBy("place").collect()] == [k * (k + 1) / 2 for k in range(1, 41)]


def test_fiedler(spark):
    n, src, dst, w = graph = two_clusters(5, 16)
    value, vector = networks.fiedler(n, src, dst, w)
    told = solvers.Solved()
    entry = [r.entry for r in solvers.fiedler(*tables(spark, graph), tolerance=1e-9, told=told).orderBy("nid").collect()]
    assert told.value == pytest.approx(value, abs=1e-8) and told.steps <= n and np.abs(np.array(entry) - vector).max() < 1e-6
    assert told.residual <= 1e-9 * 2 * w.sum()


def test_fiedler_of_small_graphs(spark):
    told = solvers.Solved()
    edges = spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, w double")
    assert [tuple(r) for r in solvers.fiedler(spark.createDataFrame([(7,)], "nid long"), edges.where("false")).collect()] == [(7, 0.0)]
    pair = [r.entry for r in solvers.fiedler(spark.createDataFrame([(1,), (2,)], "nid long"), edges, told=told).orderBy("nid").collect()]
    assert told.value == pytest.approx(6.0) and pair == pytest.approx([0.5**0.5, -(0.5**0.5)])


def test_smooth_model(spark):
    n, src, dst, w = graph = two_clusters(6, 16)
    g = np.random.default_rng(6)
    x, y = g.standard_normal((n, 2)), g.standard_normal(n)
    _, _, want = networks.smooth_model(src, dst, w, x, y, 0.7)
    nodes = spark.createDataFrame([(10 * i, x[i].tolist(), float(y[i])) for i in range(n)], "nid long, feature array<double>, label double")
    told = solvers.Solved()
    got = np.array([r.weights for r in solvers.smooth_model(nodes, tables(spark, graph)[1], 0.7, 2, told=told).orderBy("nid").collect()])
    assert np.abs(got - want).max() < 1e-6 and told.steps <= 2 * n + 2 and told.residual <= 1e-8


def test_smooth_model_takes_several_steps_a_round(spark, monkeypatch):
    """Four parts of a ring, two components that lie across parts, one with a single label and one without: the solution, and far fewer tables than steps."""
    g = np.random.default_rng(8)
    n = 96
    x, y = g.uniform(0.2, 1.0, (n, 2)), g.standard_normal(n)
    pairs = [(i, (i + 1) % 80) for i in range(80)] + [(i, (i + 7) % 80) for i in range(0, 80, 5)] + [(i, i + 1) for i in range(80, 87)] + [(i, i + 1) for i in range(88, 95)]
    src, dst = np.array(sorted((min(p), max(p)) for p in pairs)).T
    w = g.integers(1, 4, len(src)).astype(float)
    known = np.where(np.arange(n) < 80, np.arange(n) % 5 == 0, np.arange(n) == 83)
    x[:80, 0] = np.arange(80) / 80  # parts are pieces of the ring
    x[80:, 0] = np.tile([0.1, 0.9], 8)  # and the other components lie in several
    nodes = spark.createDataFrame([(10 * i, x[i].tolist(), float(y[i]) if known[i] else None) for i in range(n)], "nid long, feature array<double>, label double")
    edges = spark.createDataFrame([(10 * int(a), 10 * int(b), float(c)) for a, b, c in zip(src, dst, w)], "src long, dst long, w double").repartition(2)
    written = []
    write = solvers.Buckets.write
    monkeypatch.setattr(solvers.Buckets, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    told = solvers.Solved()
    got = np.array([r.weights for r in solvers.smooth_model(nodes, edges, 0.3, 2, told=told, parts=solvers.Parts(24, 7, spread=4)).orderBy("nid").collect()])
    m = np.zeros((len(src), n))
    m[np.arange(len(src)), src], m[np.arange(len(src)), dst] = np.sqrt(0.3 * w), -np.sqrt(0.3 * w)
    fit = np.zeros((n, n, 2))
    fit[np.flatnonzero(known), np.flatnonzero(known)] = x[known]
    scale = 1 / np.sqrt(np.repeat(0.3 * (np.bincount(src, w, n) + np.bincount(dst, w, n)), 2))
    rows = np.concatenate([np.kron(m, np.eye(2)), fit.reshape(n, -1)]) * scale
    want = np.linalg.lstsq(rows, np.concatenate([np.zeros(2 * len(src)), np.where(known, y, 0)]), rcond=1e-10)[0] * scale
    assert np.abs(got - want.reshape(n, 2)).max() < 1e-6 and told.residual <= 1e-8
    assert told.steps > 20 and len(written) <= 3 + told.steps / 4
