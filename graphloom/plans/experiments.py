"""Monte-Carlo experiments as grouped maps: a table of parameters, one task for each (p, length, run), rates by a grouped mean.

All randomness comes from the seed and the parameters of a run, so a task that runs again gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.kernels import networks, regression
from graphloom.operators import learning
from graphloom.operators.graphs import neighbourhood


def rng(*parts: int) -> np.random.Generator:
    return np.random.default_rng(list(parts))


# Models ---------------------------------------------------------------------------------------------------------------------


def chain_precisions(p: int, factor: float, blocks: int) -> np.ndarray:
    """Unit diagonal, factor / 3 beside it; block b (from 0) lacks the edge (b, b + 1)."""
    k = np.eye(p) + factor / 3 * (np.eye(p, k=1) + np.eye(p, k=-1))
    out = np.repeat(k[None], blocks, axis=0)
    for b in range(min(blocks, p - 1)):
        out[b, b, b + 1] = out[b, b + 1, b] = 0
    return out


def scaled_covariances(covariance: np.ndarray, blocks: int, growth: float) -> np.ndarray:
    """Blocks (1 + (growth - 1) b / blocks) C, C scaled to a smallest eigenvalue of 1.1."""
    c = covariance * 1.1 / np.linalg.eigvalsh(covariance)[0]
    return np.stack([(1 + (growth - 1) * b / blocks) * c for b in range(blocks)])


def masked_precision(p: int, graph: str = "chain") -> np.ndarray:
    """(11'/3 + I) on a chain's or a square grid's edges and diagonal."""
    near = np.eye(p, dtype=bool)
    for i in range(1, p + 1):
        near[i - 1, [j - 1 for j in neighbourhood(graph, i, p)]] = True
    return np.where(near, np.full((p, p), 1 / 3) + np.eye(p), 0.0)


def random_precision(p: int, seed: int, probability: float = 0.5, scale: float = 0.3, tries: int = 10_000) -> np.ndarray:
    """Unit diagonal and a random symmetric pattern, drawn until positive definite."""
    g = rng(seed, p)
    for _ in range(tries):
        upper = np.triu(g.random((p, p)) < probability, 1)
        k = np.eye(p) + scale * (upper + upper.T)
        if np.linalg.eigvalsh(k)[0] > 1e-6:
            return k
    raise ValueError("no positive definite pattern found")


def blockwise_samples(covariances: np.ndarray, length: int, g: np.random.Generator) -> np.ndarray:
    """(blocks, length, p) of centred normal samples."""
    factor = np.linalg.cholesky(covariances)
    return np.einsum("blk,bpk->blp", g.standard_normal((len(covariances), length, covariances.shape[1])), factor)


def filtered_process(covariance: np.ndarray, length: int, taps: np.ndarray, g: np.random.Generator) -> np.ndarray:
    """(length, p): normal noise of the covariance through a finite impulse response."""
    values, vectors = np.linalg.eigh(covariance)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    noise = g.standard_normal((length + len(taps) - 1, len(covariance))) @ root
    return sum(h * noise[len(taps) - 1 - k : len(taps) - 1 - k + length] for k, h in enumerate(taps))


def smoothed_spectra(x: np.ndarray, window: np.ndarray, every: int) -> np.ndarray:
    """(frequencies, p, p): zero-padded periodogram of (N, p) samples, circularly smoothed, decimated."""
    n = len(x)
    f = np.fft.fft(x, 2 * n, axis=0)
    raw = np.einsum("fi,fj->fij", f.conj(), f) / n
    half = len(window) // 2
    smooth = sum(w * np.roll(raw, k - half, axis=0) for k, w in enumerate(window)) / window.sum()
    return smooth[::2][::every]


def least_strength(precisions: np.ndarray) -> float:
    d = np.einsum("bii->bi", precisions)
    rho = (precisions**2 / d[:, :, None] ** 2).mean(axis=0)
    np.fill_diagonal(rho, 0)
    return float(rho[rho > 0].min())


# Selection experiments ------------------------------------------------------------------------------------------------------

SELECTORS = ("exhaustive", "naive", "group_lasso", "constrained")


def select(method: str, samples: np.ndarray, node: int, size: int, rho_min: float, lasso_penalty: float = 20.0) -> set[int]:
    blocks, length, _ = samples.shape
    if method == "group_lasso":
        return set(regression.lasso_neighbours(samples, node, lasso_penalty, rho_min / 2))
    if method == "constrained":
        covs = np.einsum("bti,btj->bij", samples, samples) / length
        return {n for c in covs for n in regression.constrained_neighbours(c, node)}
    grams = np.einsum("bti,btj->bij", samples, samples)
    if method == "exhaustive":
        return set(regression.best_subset(grams, node, size, length, rho_min / 6))
    return {n for b in range(blocks) for n in regression.best_subset(grams[b : b + 1], node, size, length, rho_min / 6)}


def selection_errors(spark: SparkSession, grid: list[tuple[int, float]], lengths: list[int], runs: int, methods: tuple[str, ...] = ("exhaustive",), blocks: int = 4, node: int = 1, size: int = 2, seed: int = 1) -> DataFrame:
    """(method, p, length, samples, scaled, error): share of runs in which the neighbours of the node (0-based) were not found exactly, for
    chains of p nodes and factor f."""
    rows = [(m, p, float(f), n, r) for m in methods for p, f in grid for n in lengths for r in range(runs)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["method", "p", "factor", "length", "run"]))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        method, p, factor, length, run = pdf.iloc[0][["method", "p", "factor", "length", "run"]]
        k = chain_precisions(p, factor, blocks)
        x = blockwise_samples(np.linalg.inv(k), length, rng(seed, p, length, run))
        truth = {n - 1 for n in neighbourhood("chain", node + 1, p)}
        return pd.DataFrame([(method, p, factor, length, run, select(method, x, node, size, least_strength(k)) == truth)], columns=["method", "p", "factor", "length", "run", "found"])

    parts = table.repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism), "method", "p", "length", "run")
    found = parts.groupBy("method", "p", "length", "run").applyInPandas(work, "method string, p int, factor double, length int, run int, found boolean")
    rate = found.groupBy("method", "p", "factor", "length").agg((1 - F.avg(F.col("found").cast("double"))).alias("error"))
    size_ = F.col("length") * blocks
    return rate.select("method", "p", "length", size_.alias("samples"), (size_ * F.pow("factor", F.lit(2.0)) / F.log("p")).alias("scaled"), "error")


def all_neighbourhoods(covariances: np.ndarray, length: int, size: int, penalty: float, g: np.random.Generator) -> list[set[int]]:
    """The chosen neighbours of every node of one sampled data set."""
    x = blockwise_samples(covariances, length, g)
    grams = np.einsum("bti,btj->bij", x, x)
    return [set(regression.best_subset(grams, i, size, length, penalty)) for i in range(covariances.shape[1])]


def spectral_rates(spark: SparkSession, penalties: list[float], runs: int, p: int = 16, length: int = 128, leaves: int = 4, window: int = 9, every: int = 32, seed: int = 1) -> DataFrame:
    """(penalty, detection, false_alarms, success) of the spectral graphical lasso on star graphs."""
    rows = pd.DataFrame([(float(c), r) for c in penalties for r in range(runs)], columns=["penalty", "run"])

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        penalty, run = float(key[0]), int(key[1])
        g = rng(seed, p, run)
        k = 0.5 * np.eye(p)
        ends = 1 + g.permutation(p - 1)[:leaves]
        k[0, ends] = k[ends, 0] = 0.4 / leaves
        taps = np.array([2.0, min(abs(0.2 * g.standard_normal()), 1.0)])
        x = filtered_process(np.linalg.inv(k), length, taps, g)
        spectra = smoothed_spectra(x, np.hanning(window + 2)[1:-1], every)
        edges = regression.spectral_edges(regression.spectral_lasso(spectra, penalty / leaves), float(np.linalg.norm(taps)), 0.4 / leaves / 100)
        truth = (k != 0) & ~np.eye(p, dtype=bool)
        hits, false = int((edges & truth).sum()), int((edges & ~truth).sum())
        return pd.DataFrame([(penalty, run, hits / truth.sum(), false / (~truth).sum(), hits == 2 * leaves and not false)], columns=["penalty", "run", "detection", "false_alarm", "success"])

    found = spark.createDataFrame(rows).groupBy("penalty", "run").applyInPandas(work, "penalty double, run int, detection double, false_alarm double, success boolean")
    return found.groupBy("penalty").agg(F.avg("detection").alias("detection"), F.avg("false_alarm").alias("false_alarms"), F.avg(F.col("success").cast("double")).alias("success"))


# Graph learning experiments -------------------------------------------------------------------------------------------------


def random_two_clusters(n1: int, n2: int, degree: float, boundary: float, g: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.triu_indices(n1 + n2, 1)
    same = (a < n1) == (b < n1)
    kept = g.random(len(a)) < np.where(same, degree / n1, boundary / (n1 * n2))
    a, b = a[kept], b[kept]
    alone = np.setdiff1d(np.arange(n1 + n2), np.concatenate([a, b]))
    anchor = np.where(alone < n1, n1, n1 - 1)
    return np.concatenate([a, np.minimum(alone, anchor)]), np.concatenate([b, np.maximum(alone, anchor)])


def propagation_rates(spark: SparkSession, boundaries: list[float], runs: int, sizes: tuple[int, int] = (100, 100), degree: float = 20, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(boundary, flow_ratio, sparse, averaged): seed-to-seed flow over the cut's weight, and the relative errors of sparse label
    propagation and of neighbour averaging on random two-cluster graphs with one labelled node in each."""
    rows = pd.DataFrame([(float(c), r) for c in boundaries for r in range(runs)], columns=["boundary", "run"])
    n1, n2 = sizes

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        boundary, run = float(key[0]), int(key[1])
        src, dst = random_two_clusters(n1, n2, degree, boundary, rng(seed, int(boundary * 1000), run))
        n, w = n1 + n2, np.ones(len(src))
        truth = np.where(np.arange(n) < n1, 1.0, 0.0)
        crossing = (src < n1) != (dst < n1)
        flow, _ = networks.max_flow(n, src, dst, np.where(crossing, 3.0, np.where(src < n1, 1.0, 1e3)), 0, n - 1)
        seeds = np.zeros(n, bool)
        seeds[[0, n - 1]] = True
        x, average, _ = learning.run(src, dst, w, truth, seeds, learning.SPARSE_LABEL_PROPAGATION, rounds)
        mean = averaged_labels(src, dst, truth, seeds, rounds)
        error = lambda v: float(((v - truth) ** 2).sum() / (truth**2).sum())
        return pd.DataFrame([(boundary, run, flow / max(1, int(crossing.sum())), error(average), error(mean))], columns=["boundary", "run", "flow_ratio", "sparse", "averaged"])

    found = spark.createDataFrame(rows).groupBy("boundary", "run").applyInPandas(work, "boundary double, run int, flow_ratio double, sparse double, averaged double")
    return found.groupBy("boundary").agg(*[F.avg(c).alias(c) for c in ("flow_ratio", "sparse", "averaged")])


def clustering_bounds(spark: SparkSession, nodes: int, edge_counts: list[int], penalty: float = 10.0, noise: float = 0.1, dimension: int = 2, runs: int = 1, least: float = 1e-4, seed: int = 1) -> DataFrame:
    """(edges, run, measured, bound) on random graphs with one cluster: squared deviation of the smooth model's weights from their mean, and
    its bound, noise energy over (Fiedler value times penalty); runs whose denominator is below `least` are left out."""
    rows = pd.DataFrame([(m, r) for m in edge_counts for r in range(runs)], columns=["edges", "run"])

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, run = int(key[0]), int(key[1])
        g = rng(seed, nodes, m, run)
        a, b = np.triu_indices(nodes, 1)
        kept = g.random(len(a)) < m / len(a)
        src, dst = a[kept], b[kept]
        x = g.choice([-1.0, 1.0], (nodes, dimension))
        weights, error = g.random(dimension), noise * g.standard_normal(nodes)
        _, _, w = networks.smooth_model(src, dst, np.ones(len(src)), x, x @ weights + error, penalty)
        value, _ = networks.fiedler(nodes, src, dst, np.ones(len(src)))
        measured = float(((w - w.mean(axis=0)) ** 2).sum())
        return pd.DataFrame([(m, run, value, measured, float((error**2).sum()) / max(value * penalty, 1e-300))], columns=["edges", "run", "fiedler", "measured", "bound"])

    found = spark.createDataFrame(rows).groupBy("edges", "run").applyInPandas(work, "edges int, run int, fiedler double, measured double, bound double")
    return found.where(F.col("fiedler") * penalty >= least)


def success_rate(found: DataFrame, by: list[str], success: str = "found") -> DataFrame:
    return found.groupBy(*by).agg(F.avg(F.col(success).cast("double")).alias("rate"))



def block_model_rates(spark: SparkSession, inside: float, across: list[float], runs: int, sizes: tuple[int, ...] = (10, 10, 10), labelled: int = 5, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(ratio, sparse, averaged): relative errors of sparse label propagation and neighbour averaging on block models, by the ratio of the
    two probabilities; the first `labelled` nodes of a cluster are labelled with its number. Probabilities above 1 count as 1."""
    rows = pd.DataFrame([(float(q), r) for q in across for r in range(runs)], columns=["across", "run"])

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, run = float(key[0]), int(key[1])
        src, dst, cluster = block_graph(sizes, inside, q, rng(seed, int(q * 10_000), run))
        seeds = np.concatenate([np.arange(n) < labelled for n in sizes])
        truth = cluster + 1.0
        _, sparse, _ = learning.run(src, dst, np.ones(len(src)), truth, seeds, learning.BLOCK_MODEL_VARIANT, rounds)
        mean = averaged_labels(src, dst, truth, seeds, rounds)
        error = lambda v: float(((v - truth) ** 2).sum() / (truth**2).sum())
        return pd.DataFrame([(q, run, error(sparse), error(mean))], columns=["across", "run", "sparse", "averaged"])

    found = spark.createDataFrame(rows).groupBy("across", "run").applyInPandas(work, "across double, run int, sparse double, averaged double")
    return found.groupBy((F.lit(float(inside)) / F.col("across")).alias("ratio")).agg(F.avg("sparse").alias("sparse"), F.avg("averaged").alias("averaged"))


def partial_label_rates(spark: SparkSession, shares: list[float], across: list[float], runs: int, size: int = 50, inside: float = 0.3, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(share, across, accuracy): share of unlabelled nodes of a two-cluster block model that sparse label propagation puts within one
    half of their label. The first ceil(share size) nodes of cluster 0 are labelled, and one more in cluster 1."""
    rows = pd.DataFrame([(float(a), float(q), r) for a in shares for q in across for r in range(runs)], columns=["share", "across", "run"])

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        share, q, run = float(key[0]), float(key[1]), int(key[2])
        src, dst, cluster = block_graph((size, size), inside, q, rng(seed, int(share * 1000), int(q * 10_000), run))
        count = int(np.ceil(share * size))
        seeds = np.concatenate([np.arange(size) < count, np.arange(size) < count + 1])
        x, average, _ = learning.run(src, dst, np.ones(len(src)), cluster.astype(float), seeds, learning.BLOCK_MODEL_VARIANT, rounds)
        accuracy = float((np.abs(average - cluster) < 0.5)[~seeds].mean())
        return pd.DataFrame([(share, q, run, accuracy)], columns=["share", "across", "run", "accuracy"])

    found = spark.createDataFrame(rows).groupBy("share", "across", "run").applyInPandas(work, "share double, across double, run int, accuracy double")
    return found.groupBy("share", "across").agg(F.avg("accuracy").alias("accuracy"))


def block_graph(sizes: tuple[int, ...], inside: float, across: float, g: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cluster = np.repeat(np.arange(len(sizes)), sizes)
    a, b = np.triu_indices(len(cluster), 1)
    kept = g.random(len(a)) < np.minimum(1, np.where(cluster[a] == cluster[b], inside, across))
    return a[kept], b[kept], cluster


def averaged_labels(src: np.ndarray, dst: np.ndarray, truth: np.ndarray, seeds: np.ndarray, rounds: int) -> np.ndarray:
    """Neighbour averages with clamped labels, from 0."""
    n = len(truth)
    degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
    x = np.where(seeds, truth, 0.0)
    for _ in range(rounds):
        near = np.bincount(src, x[dst], n) + np.bincount(dst, x[src], n)
        x = np.where(seeds, truth, np.divide(near, degree, out=x.copy(), where=degree > 0))
    return x


def sample_table(spark: SparkSession, p: int, factor: float, blocks: int, length: int, runs: int, seed: int = 1) -> DataFrame:
    """(run, block, t, node, x): blockwise normal samples of chain models in long form, one task per run and block."""
    tasks = spark.range(runs).select(F.col("id").cast("int").alias("run")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        run, block = int(key[0]), int(key[1])
        cov = np.linalg.inv(chain_precisions(p, factor, blocks)[block])
        x = blockwise_samples(cov[None], length, rng(seed, p, run, block))[0]
        t, node = np.meshgrid(np.arange(length), np.arange(p), indexing="ij")
        return pd.DataFrame({"run": run, "block": block, "t": (block * length + t + 1).ravel(), "node": node.ravel(), "x": x.ravel()})

    return tasks.groupBy("run", "block").applyInPandas(work, "run int, block int, t long, node int, x double")
