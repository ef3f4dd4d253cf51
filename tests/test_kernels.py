import itertools
import random

import numpy as np
import pytest

from graphloom.kernels import networks, regression
from graphloom.operators import learning
from graphloom.plans import experiments


def some_graph(n, p, seed):
    g = np.random.default_rng(seed)
    a, b = np.triu_indices(n, 1)
    kept = g.random(len(a)) < p
    return a[kept], b[kept], g.integers(1, 5, kept.sum()).astype(float)


@pytest.mark.parametrize("seed", range(6))
def test_flow_equals_cut(seed):
    src, dst, w = some_graph(8, 0.5, seed)
    value, side = networks.max_flow(8, src, dst, w, 0, 7)
    cuts = []
    for inner in itertools.product([False, True], repeat=6):
        s = np.array([True, *inner, False])
        cuts.append(w[s[src] != s[dst]].sum())
    assert value == pytest.approx(min(cuts)) == pytest.approx(w[side[src] != side[dst]].sum())


def test_fiedler_of_a_path():
    n = 9
    value, vector = networks.fiedler(n, np.arange(n - 1), np.arange(1, n), np.ones(n - 1))
    assert value == pytest.approx(2 - 2 * np.cos(np.pi / n)) and np.linalg.norm(vector) == pytest.approx(1)


def test_smooth_models_agree():
    src, dst, w = some_graph(20, 0.3, 1)
    g = np.random.default_rng(2)
    x, y = g.choice([-1.0, 1.0], (20, 2)), g.standard_normal(20)
    q2, q1, weights = networks.smooth_model(src, dst, w, x, y, 3.0)
    assert np.abs(2 * q2 @ weights.ravel() + q1).max() < 1e-8
    assert np.abs(networks.smooth_model_by_descent(src, dst, w, x, y, 3.0) - weights).max() < 1e-6


def test_group_lasso_is_optimal():
    g = np.random.default_rng(1)
    a, b = g.standard_normal((3, 40, 6)), g.standard_normal((3, 40))
    grams, cross = np.einsum("bti,btj->bij", a, a), np.einsum("bti,bt->bi", a, b)
    z = regression.group_lasso(grams, cross, 8.0, rounds=5000, absolute=1e-10, relative=1e-10)
    grad = cross - np.einsum("bij,bj->bi", grams, z)
    for j in range(6):
        size = np.linalg.norm(z[:, j])
        if size > 1e-6:
            assert np.abs(grad[:, j] - 8.0 * z[:, j] / size).max() < 1e-4
        else:
            assert np.linalg.norm(grad[:, j]) <= 8.0 + 1e-6


def test_best_subset_is_exhaustive():
    g = np.random.default_rng(3)
    x = g.standard_normal((3, 12, 6))
    grams = np.einsum("bti,btj->bij", x, x)
    sets = [t for k in (1, 2, 3) for t in itertools.combinations([0, 1, 3, 4, 5], k)]
    score = lambda t, p: sum(regression.residual(m, 2, t) for m in grams) / 36 + p * len(t)
    for penalty in (0.0, 0.05, 0.5):
        for size in (2, 3):
            want = min((t for t in sets if len(t) <= size), key=lambda t: score(t, penalty))
            assert regression.best_subset(grams, 2, size, 12, penalty) == want


def test_constrained_column_is_feasible_and_sparse():
    k = experiments.chain_precisions(8, 1.0, 1)[0]
    cov = np.linalg.inv(experiments.chain_precisions(8, 1.0, 8)[7])
    beta = regression.constrained_column(cov, 3, 0.05)
    assert np.abs(cov @ beta - np.eye(8)[3]).max() <= 0.05 + 1e-4
    assert np.abs(beta).sum() <= np.abs(k[:, 3]).sum() + 1e-3


def test_least_absolute_ignores_outliers():
    g = np.random.default_rng(4)
    a = g.standard_normal((60, 3))
    b = a @ np.array([1.0, -2.0, 0.5])
    b[:10] += 100
    assert np.abs(regression.least_absolute(a, b, 3000) - [1, -2, 0.5]).max() < 1e-3


def test_spectral_lasso_finds_a_star():
    g = np.random.default_rng(1)
    k = np.eye(5) * 0.5
    k[0, 1] = k[1, 0] = 0.2
    x = experiments.filtered_process(np.linalg.inv(k), 4096, np.array([2.0, 0.3]), g)
    spectra = experiments.smoothed_spectra(x, np.hanning(301)[1:-1], 1024)
    strength = np.linalg.norm(regression.spectral_lasso(spectra, 0.05, rounds=200), axis=0)
    np.fill_diagonal(strength, 0)
    assert np.unravel_index(strength.argmax(), strength.shape) in ((0, 1), (1, 0))


def test_chain_goldens():
    src, dst, w = np.arange(9), np.arange(1, 10), np.where(np.arange(9) == 4, 0.25, 1.0)
    label, seeds = np.where(np.arange(10) < 5, 1.0, 0.0), np.isin(np.arange(10), [1, 6])
    x, _, y = learning.run(src, dst, w, label, seeds, learning.FLOW_LASSO, 10, (np.arange(9) + 1) / 9)
    assert np.round(x, 6).tolist() == [0.405323, 0.407995, 0.451391, 0.502709, 0.540615, 0.390045, 0.275568, 0.251188, 0.240526, 0.241544]
    assert np.round(y, 6).tolist() == [-0.016426, 0.544132, 0.491185, 0.391436, 0.25, -0.02022, -0.42849, -0.356148, -0.136108]
    x, _, y = learning.run(src, dst, w, label, seeds, learning.FLOW_LASSO, 20_000, (np.arange(9) + 1) / 9)
    a, b, error = learning.chain_reference(1.0, 0.0, 1.0, 0.25)
    assert np.allclose(x, np.where(label > 0, a, b), atol=1e-4) and error == 0.125
    assert np.allclose(y, [0, 0.25, 0.25, 0.25, 0.25, 0.25, 0, 0, 0], atol=1e-3)


def test_regressions_fit_their_labels():
    src, dst, _ = some_graph(30, 0.4, 2)
    g = np.random.default_rng(3)
    x = g.standard_normal((30, 2))
    y = x @ np.array([1.0, -1.0])
    seeds = np.arange(30) < 20
    for problem in (learning.Regression(bound=0.5), learning.Regression("absolute", 0.5, 0.5, 0.5)):
        w = learning.regress(src, dst, x, y, seeds, problem, 3000)
        assert np.abs((w * x).sum(axis=1) - y)[20:].mean() < 0.25 * np.abs(y).mean()


def test_communities():
    r = random.Random(1)
    n = 40
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < (0.5 if (a < 20) == (b < 20) else 0.01)]
    src, dst = np.array(pairs).T
    near = networks.adjacency(n, src, dst, np.ones(len(src)))
    for score in (networks.local_rank(near, [0]), networks.release_diffusion(near, [0])):
        assert networks.sweep_cut(near, score)[0] == list(range(20))
    members, ratio = networks.flow_improved(n, src, dst, np.ones(len(src)), list(range(24)))
    assert members == list(range(20)) and ratio < 0.1


def test_least_strength_of_a_chain():
    for f in (1.0, 0.9, 0.8, 1.2):
        assert experiments.least_strength(experiments.chain_precisions(16, f, 4)) == pytest.approx(f * f / 12)


def test_random_models():
    assert np.linalg.eigvalsh(experiments.random_precision(8, 1))[0] > 0
    c = experiments.scaled_covariances(np.eye(4) * 2, 4, 10.0)
    assert np.linalg.eigvalsh(c[0])[0] == pytest.approx(1.1) and c[3, 0, 0] > c[0, 0, 0]
    assert experiments.masked_precision(9, "grid").sum() > experiments.masked_precision(9).sum()
    assert experiments.all_neighbourhoods(np.linalg.inv(experiments.chain_precisions(5, 1.2, 2)), 2000, 2, 0.02, experiments.rng(1))[0] == {1}


@pytest.mark.parametrize(
    ("method", "published"),
    [
        # Shares of 100 runs that miss the neighbours, by samples in four blocks, for chains of 64 nodes.
        ("exhaustive", {40: 1, 80: 0.88, 120: 0.8, 160: 0.46, 200: 0.28, 240: 0.16, 280: 0.14, 320: 0.05, 360: 0.03, 400: 0.02}),
        ("group_lasso", {120: 0.93, 200: 0.6, 320: 0.19}),
    ],
)
def test_error_rates_follow_the_published_curves(method, published):
    """Within three binomial errors of both experiments, whose draws differ."""
    k = experiments.chain_precisions(64, 1.0, 4)
    cov, rho = np.linalg.inv(k), experiments.least_strength(k)
    for samples, rate in published.items():
        length = samples // 4
        missed = np.mean([experiments.select(method, experiments.blockwise_samples(cov, length, experiments.rng(1, 64, length, run)), 1, 2, rho) != {0, 2} for run in range(100)])
        error = np.sqrt((missed * (1 - missed) + rate * (1 - rate)) / 100)
        assert abs(missed - rate) <= 3 * max(error, 0.01), (samples, missed, rate)
