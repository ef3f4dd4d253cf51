"""Exact neighbours against brute force, and what the index skips."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graphs, learning, neighbours


def brute(ids, x, k):
    out = set()
    for i, v in zip(ids, x):
        d = np.round(((x - v) ** 2).sum(axis=1), 6)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out |= {(int(i), int(ids[j]), float(d[j]), r + 1) for r, j in enumerate(order)}
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def frame(spark, ids, x, kind="double"):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], f"vec_id long, embedding array<{kind}>").repartition(3)


@pytest.mark.parametrize("shape", ["clusters", "uniform", "lattice"])
def test_against_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    if shape == "clusters":
        x = rng.standard_normal((20, 6))[rng.integers(0, 20, 500)] * 10 + rng.standard_normal((500, 6)) * 0.1
    else:
        x = rng.uniform(size=(400, 24)) if shape == "uniform" else rng.integers(0, 5, (400, 3))  # many ties and equal vectors
    ids = rng.permutation(1000)[: len(x)]
    work = neighbours.Work()
    got = rows_of(neighbours.nearest(frame(spark, ids, x), 3, block=16, pivots=8, work=work))
    assert got == brute(ids, x.astype(float), 3)
    assert work.met <= work.blocks**2 and (shape != "clusters" or work.skipped > 0.5)


def test_hot_vector(spark):
    """A third of all rows are the same vector; they are one point of the index."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 4)).astype(np.float32)
    x[rng.permutation(300)[:100]] = [1, 2, 3, 4]
    work = neighbours.Work()
    got = rows_of(neighbours.nearest(frame(spark, np.arange(300), x, "float"), 5, block=32, work=work))
    assert got == brute(np.arange(300), x.astype(float), 5) and work.points == 201


@pytest.mark.parametrize("count, k", [(1, 3), (2, 3), (5, 3), (9, 8), (9, 20)])
def test_few_rows(spark, count, k):
    x = np.arange(count)[:, None] ** 2 * np.ones(2)
    assert rows_of(neighbours.nearest(frame(spark, np.arange(count), x), k, block=2)) == brute(np.arange(count), x, k)


def test_empty_and_null(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(none, 2).collect() == []
    some = none.unionByName(frame(spark, [2, 3], [[0.0], [1.0]]))
    assert rows_of(neighbours.nearest(some, 2)) == {(2, 3, 1.0, 1), (3, 2, 1.0, 1)}


def test_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    x = np.random.default_rng(6).standard_normal((120, 3))
    assert rows_of(neighbours.nearest(frame(spark, np.arange(120), x), 4, block=16, pivots=4)) == brute(np.arange(120), x, 4)


def test_work_on_clusters_is_below_quadratic(spark):
    """Three times the vectors, in three times the clusters: block pairs grow about as the blocks, not as their square."""
    met = []
    for clusters in (40, 120):
        rng = np.random.default_rng(7)
        centres = rng.uniform(0, 1000, (clusters, 3))
        x = np.repeat(centres, 32, axis=0) + rng.standard_normal((32 * clusters, 3))
        work = neighbours.Work()
        neighbours.nearest(frame(spark, np.arange(len(x)), x), 3, block=32, pivots=32, work=work).count()
        met.append(work.met)
        assert work.skipped > 0.6
    assert met[1] < 6 * met[0]


def test_vectors_stay_off_the_driver(spark, monkeypatch):
    """Blocks meet in tiles of several sizes by a shuffle; no broadcast holds vectors."""
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(400, 16))
    plans = []
    settled = neighbours.settled
    monkeypatch.setattr(neighbours, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    for size in (1, 5000, 1 << 20):
        monkeypatch.setattr(neighbours, "TILE_BYTES", size)
        assert rows_of(neighbours.nearest(frame(spark, np.arange(400), x), 3, block=32, pivots=4)) == brute(np.arange(400), x, 3)
    met = [p for p in plans if "FlatMapCoGroupsInArrow" in p]
    assert met and not any("strategy=broadcast" in p for p in met)


def test_no_join_may_be_broadcast(spark, monkeypatch):
    """Every join of the search, of degrees, averages and differences, and of label propagation is told to merge, so that none is left for Spark to broadcast."""
    x = np.random.default_rng(8).uniform(size=(400, 4))
    x[:50] = x[50:100]
    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    for module in (neighbours, learning):
        monkeypatch.setattr(module, "settled", lambda df, settled=module.settled: seen(df) or settled(df))
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    near = neighbours.nearest(frame(spark, np.arange(400), x), 3, block=16, pivots=4)
    edges = neighbours.settled(graphs.symmetric(near))
    nodes = spark.range(400).select(F.col("id").alias("nid"), F.lit(1.0).alias("x"), F.lit(1.0).alias("label"), (F.col("id") % 10 == 0).alias("is_labeled"))
    for df in (near, graphs.laplacian(nodes.select("nid"), edges), graphs.neighbour_average(edges, nodes), graphs.total_variation(edges, nodes), learning.label_propagation(nodes, edges, 2)):
        seen(df)
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line and "_part" not in line]  # with_rank's has a row a partition
    assert len(joins) > 10 and [line for line in joins if "Hint=(strategy=" not in line or "broadcast" in line and "_rows" not in line] == []


def test_blocks_of_a_tile_find_what_is_nearer_than_before(monkeypatch):
    """After a point's first block of a tile, only what is no further than its k-th so far is found, so later pairs cost a product and little else."""
    x = np.random.default_rng(9).standard_normal((8 * 64, 16)).astype(np.float32)
    ids = np.arange(len(x)) * 3
    held = pa.table({"block": list(range(8)), "reps": pa.array(ids.reshape(8, 64).tolist()), "m": [b.tobytes() for b in x.reshape(8, 64, 16)]})
    told, closest = [], neighbours.closest
    monkeypatch.setattr(neighbours, "closest", lambda *a: told.append(closest(*a)) or told[-1])
    pairs = [(a, b) for a in range(8) for b in range(8)]
    got = neighbours._compared(pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "worst": [float("inf")] * 64}), held, 3, 6, "f4")
    assert set(zip(*(got.column(c).to_pylist() for c in ("nid", "other", "d2")))) == {r[:3] for r in brute(ids, x.astype(float), 3)}
    assert sum(len(r[0]) for r in told) < 3.5 * 3 * len(x)  # about 1 + 1/2 + ... + 1/8 times three a point, instead of eight times


@pytest.mark.parametrize("made", ["degree", "neighbour_average", "total_variation", "cut_weight"])
def test_what_follows_the_search_merges(spark, made):
    """No join of these queries beyond the search is left for Spark to broadcast."""
    nodes, edges = spark.range(9).select(F.col("id").alias("nid"), F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("cluster")), graphs.chain(spark, 8)
    df = {
        "degree": lambda: graphs.degrees(nodes, edges),
        "neighbour_average": lambda: graphs.neighbour_average(edges, nodes),
        "total_variation": lambda: graphs.total_variation(edges, nodes),
        "cut_weight": lambda: graphs.cut(edges, nodes),
    }[made]()
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)
