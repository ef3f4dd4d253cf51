"""Branch and bound against every set, each solved by itself."""

from itertools import combinations

import numpy as np
import pytest

from graphloom import queries
from graphloom.kernels import regression
from graphloom.operators import selection, series, subsets
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def every_set(blocks, size):
    """{(target, card): least energy} and {(target, card): {set: energy}} of blocks {name: ...} of (names, matrix)."""
    names = sorted({n for held, _ in blocks for n in held})
    out = {}
    for target in names:
        for card in range(1, min(size, len(names) - 1) + 1):
            for members in combinations([n for n in names if n != target], card):
                energy = 0.0
                for held, m in blocks:
                    if target in held:
                        energy += regression.residual(m, held.index(target), tuple(held.index(n) for n in members if n in held))
                out.setdefault((target, card), {})[members] = energy
    return out


def agrees(rows, want):
    assert {(r.target, r.card) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        sets = want[r.target, r.card]
        least = min(sets.values())
        assert abs(r.energy - least) < 1e-6 * (1 + least)
        assert sets[tuple(r.members)] <= least + 1e-6 * (1 + least) and list(r.members) == sorted(r.members)


def gram_table(spark, blocks):
    rows = [(b, i, j, float(m[x, y])) for b, (names, m) in enumerate(blocks) for x, i in enumerate(names) for y, j in enumerate(names)]
    return spark.createDataFrame(rows, "block long, i string, j string, g double").repartition(3)


def sample(seed, p, steps=40, mix=0.4):
    g = np.random.default_rng(seed)
    x = g.standard_normal((steps, p)) @ (np.eye(p) + mix * g.standard_normal((p, p)))
    return [f"n{k}" for k in range(p)], x.T @ x


@pytest.mark.parametrize("p, size, chunk", [(2, 5, 512), (6, 5, 3), (7, 3, 512)])
def test_all_sizes(spark, p, size, chunk):
    blocks = [sample(s, p) for s in range(3)]
    agrees(subsets.best_subsets(gram_table(spark, blocks), size, chunk).collect(), every_set(blocks, size))


def test_odd_blocks(spark):
    """A node that two others make up, one without power, and one that a block lacks."""
    names, m = sample(5, 5)
    g = np.random.default_rng(9).standard_normal((30, 5))
    g[:, 3] = g[:, 0] + g[:, 1]
    g[:, 4] = 0.0
    part = sample(6, 4)
    blocks = [(names, m), (names, g.T @ g), part]
    agrees(subsets.best_subsets(gram_table(spark, blocks), 4).collect(), every_set(blocks, 4))


def test_alone_and_empty(spark):
    assert subsets.best_subsets(gram_table(spark, [(["a"], np.eye(1))]), 3).count() == 0
    assert subsets.best_subsets(gram_table(spark, [sample(1, 2)]).where("false"), 3).count() == 0


def test_branches_are_cut(spark):
    """On a chain of 14 nodes, each made of its neighbours and noise, far fewer sets are scored than there are."""
    p, told = 14, []
    precision = np.eye(p) + 0.45 * (np.eye(p, k=1) + np.eye(p, k=-1))
    blocks = [([f"n{k:02}" for k in range(p)], 100 * np.linalg.inv(precision))]
    rows = subsets.best_subsets(gram_table(spark, blocks), 4, told=told).collect()
    agrees(rows, every_set(blocks, 4))
    total = p * sum(len(list(combinations(range(p - 1), c))) for c in range(1, 5))
    assert sum(told) < 0.5 * total, (told, total)


def test_query_by_brute_force(spark):
    kinds = queries.read(spark, SF, "events").withColumn("kind", F.concat_ws("/", "event_type", (F.col("user_id") % 2).cast("string")))
    grams = selection.gram(series.centred(series.blocked(series.difference(series.hourly_counts(kinds, kind="kind"), 24), 24))).toPandas()
    blocks = []
    for _, g in grams.groupby("block"):
        m = g.pivot(index="i", columns="j", values="g").sort_index().sort_index(axis=1)
        blocks.append((list(m.index), m.to_numpy()))
    agrees(queries.node_scan(spark, SF).collect(), every_set(blocks, 9))
