"""Constrained precision columns against all corners of their linear program, and the spectral lasso against the kernel."""

from itertools import combinations

import numpy as np
import pytest

from graphloom import queries
from graphloom.kernels import regression
from graphloom.operators import precision, series

SF = "/root/testdata/sf0.001"


def least_norm(cov, column, penalty):
    """The least |beta|_1 over all corners of the feasible set: every choice of as many tight constraints or zeros as there are unknowns."""
    p = len(cov)
    e = np.eye(p)[column]
    rows = np.vstack([cov, -cov, np.eye(p)])  # S beta = e + penalty, S beta = e - penalty, beta_k = 0
    sides = np.concatenate([e + penalty, -(e - penalty), np.zeros(p)])
    best = np.inf
    for chosen in combinations(range(3 * p), p):
        m = rows[list(chosen)]
        if abs(np.linalg.det(m)) > 1e-9:
            beta = np.linalg.solve(m, sides[list(chosen)])
            if np.abs(cov @ beta - e).max() <= penalty + 1e-9:
                best = min(best, np.abs(beta).sum())
    return best


def beta_at(path, penalty):
    for (high, a), (low, b) in zip(path, path[1:], strict=False):
        if low <= penalty <= high:
            share = (penalty - low) / (high - low) if high > low else 1.0
            return share * a + (1 - share) * b
    return None


def correlations(seed, p, steps):
    x = np.random.default_rng(seed).standard_normal((steps, p)) @ np.random.default_rng(seed + 1).standard_normal((p, p))
    g = x.T @ x
    return g / np.sqrt(np.outer(np.diag(g), np.diag(g)))


@pytest.mark.parametrize("seed, p, steps", [(0, 2, 9), (1, 3, 20), (2, 4, 30), (3, 4, 6), (4, 4, 2), (5, 1, 5)])
def test_path_is_optimal_everywhere(seed, p, steps):
    cov = correlations(seed, p, steps)
    for column in range(p):
        path = regression.constrained_path(cov, column)
        ends = [x for x, _ in path]
        assert ends[0] == 1.0 and ends == sorted(ends, reverse=True)
        for penalty in (0.9, 0.5, 0.2, 0.05, 0.001):
            beta, want = beta_at(path, penalty), least_norm(cov, column, penalty)
            if beta is None:
                assert want == np.inf
            else:
                assert np.abs(cov @ beta - np.eye(p)[column]).max() <= penalty + 1e-8 and abs(np.abs(beta).sum() - want) < 1e-7


def test_path_meets_the_iteration():
    """The iteration only nears the optimum: it stops a little outside the constraints or above the norm."""
    cov = correlations(7, 12, 100)
    exact = beta_at(regression.constrained_path(cov, 3, 0.1), 0.1)
    near = regression.constrained_column(cov, 3, 0.1, rounds=50_000, tolerance=1e-9)
    assert np.abs(exact - near).max() < 2e-3 * np.abs(exact).max()
    assert np.abs(cov @ exact - np.eye(12)[3]).max() <= 0.1 + 1e-9


def gram_table(spark, blocks):
    rows = [(b, f"n{i}", f"n{j}", float(m[i, j])) for b, m in enumerate(blocks) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "block long, i string, j string, g double").repartition(3)


@pytest.mark.parametrize("columns", [1, 2, 64])
def test_paths_on_tables(spark, columns):
    blocks = [correlations(s, 5, 40) * 3.0 for s in range(3)]
    blocks[2][4, :] = blocks[2][:, 4] = 0.0  # a node without power
    paths = precision.constrained_paths(gram_table(spark, blocks), 0.05, columns)
    got = {(r.block, r.target, round(r.penalty, 9)): dict(zip(r.nodes, r.betas, strict=True)) for r in paths.collect()}
    at = {(r.block, r.target, r.node): r.beta for r in precision.columns_at(paths, 0.2).collect()}
    want_at, count = {}, 0
    for b, m in enumerate(blocks):
        live = 4 if b == 2 else 5
        cov = m[:live, :live] / 3.0
        for c in range(live):
            path = regression.constrained_path(cov, c, 0.05)
            count += len(path)
            for penalty, beta in path:
                found = got[b, f"n{c}", round(penalty, 9)]
                assert np.abs(np.array([found.get(f"n{k}", 0.0) for k in range(live)]) - beta).max() < 1e-7
            want_at |= {(b, f"n{c}", f"n{k}"): v for k, v in enumerate(beta_at(path, 0.2)) if abs(v) > 1e-9}
    assert len(got) == count
    assert {k for k, v in at.items() if abs(v) > 1e-9} == set(want_at) and all(abs(at[k] - v) < 1e-7 for k, v in want_at.items())
    edges = {(r.i, r.j): r.blocks for r in precision.united_edges(precision.columns_at(paths, 0.2)).collect()}
    joined = [(i, j) for (b, i, j), v in want_at.items() if i < j and abs(v) > 1e-4 and abs(want_at.get((b, j, i), 0)) > 1e-4]
    assert edges == {pair: joined.count(pair) for pair in joined}


def test_nothing(spark):
    none = gram_table(spark, [np.eye(2)]).where("false")
    assert precision.constrained_paths(none).count() == 0


def spectra_of(seed, count, p):
    g = np.random.default_rng(seed)
    a = g.standard_normal((count, p, 2 * p)) + 1j * g.standard_normal((count, p, 2 * p))
    return a @ a.conj().transpose(0, 2, 1) / (2 * p)


@pytest.mark.parametrize("width, penalty", [(1, 0.1), (4, 5.0), (100, 30.0)])
def test_spectral_lasso_is_the_kernel(spark, width, penalty):
    s = spectra_of(3, 7, 4)
    rows = [(3 * f, f"n{i}", f"n{j}", float(s[f, i, j].real), float(s[f, i, j].imag)) for f in range(7) for i in range(4) for j in range(4)]
    table = spark.createDataFrame(rows, "freq int, i string, j string, re double, im double").repartition(3)
    want = regression.spectral_lasso(s, penalty)
    found = precision.spectral_lasso(table, penalty, width=width)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(complex(r.re, r.im) - want[r.freq // 3, int(r.i[1]), int(r.j[1])]) < 1e-9
    strength = np.linalg.norm(want, axis=0) / np.sqrt(7) / 2
    for r in precision.spectral_strengths(found, 2.0).collect():
        assert abs(r.strength - strength[int(r.i[1]), int(r.j[1])]) < 1e-9


def test_queries_by_brute_force(spark):
    """The registered queries over whole tables, from the Gram blocks and the smoothed spectrum by the kernels alone."""
    grams = queries.grams(spark, SF).toPandas()
    joined = []
    paths = {}
    for block, g in grams.groupby("block"):
        m = g.pivot(index="i", columns="j", values="g").sort_index().sort_index(axis=1)
        m = m.loc[np.diag(m) > 0, np.diag(m) > 0]
        root = np.sqrt(np.diag(m))
        for c, name in enumerate(m.index):
            paths[block, name] = (list(m.index), regression.constrained_path(m.to_numpy() / np.outer(root, root), c, 0.1))
    near = {(b, t, n) for (b, t), (names, path) in paths.items() if (beta := beta_at(path, 0.2)) is not None for n, v in zip(names, beta, strict=True) if abs(v) > 1e-4}
    joined = [(t, n) for b, t, n in near if t < n and (b, n, t) in near]
    assert {(r.i, r.j): r.blocks for r in queries.clime_union(spark, SF).collect()} == {x: joined.count(x) for x in joined}
    assert queries.clime_paths(spark, SF).count() == sum(len(path) for _, path in paths.values())

    pairs, frequencies = queries.spectrum(spark, SF)
    s = series.smoothed_spectrum(pairs, [1.0, 2.0, 3.0, 2.0, 1.0], frequencies, 8).toPandas().sort_values(["freq", "i", "j"])
    names = sorted(s["i"].unique())
    m = (s["re"].to_numpy() + 1j * s["im"].to_numpy()).reshape(-1, len(names), len(names))
    root = np.sqrt(np.einsum("fii->fi", m).real.mean(axis=0))
    z = regression.spectral_lasso(m / np.outer(root, root), 0.1)
    want = np.linalg.norm(z, axis=0) / np.sqrt(len(z))
    got = queries.events_spectral_lasso(spark, SF).collect()
    assert len(got) == len(names) * (len(names) - 1) // 2
    for r in got:
        assert abs(r.strength - want[names.index(r.i), names.index(r.j)]) < 1e-5
