"""Group lasso, constrained precision columns, spectral graphical lasso and least absolute deviations, on arrays of one task."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def residual(gram: np.ndarray, node: int, members: tuple[int, ...]) -> float:
    """Energy of a node that the members leave unexplained."""
    t = list(members)
    g = gram[t, node]
    return float(gram[node, node] - g @ np.linalg.lstsq(gram[np.ix_(t, t)], g, rcond=None)[0]) if t else float(gram[node, node])


def best_subset(grams: np.ndarray, node: int, size: int, length: int, penalty: float) -> tuple[int, ...]:
    """The set of 1 ... size other nodes with the least penalised mean residual over blocks; vectorised for up to two members."""
    others = np.array([n for n in range(grams.shape[1]) if n != node])
    scale = len(grams) * length
    g, d = grams[:, others, node], np.einsum("bii->bi", grams)[:, others]
    own = grams[:, node, node].sum()
    one = (own - (g**2 / np.maximum(d, 1e-300)).sum(axis=0)) / scale + penalty
    best, value = (int(others[one.argmin()]),), float(one.min())
    if size >= 2:
        m = grams[:, others][:, :, others]
        det = d[:, :, None] * d[:, None, :] - m**2
        gain = (g[:, :, None] ** 2 * d[:, None, :] + g[:, None, :] ** 2 * d[:, :, None] - 2 * g[:, :, None] * g[:, None, :] * m) / np.where(det > 1e-12, det, np.inf)
        two = (own - gain.sum(axis=0)) / scale + 2 * penalty
        two[np.tril_indices(len(others))] = np.inf
        a, b = np.unravel_index(two.argmin(), two.shape)
        if two[a, b] < value:
            best, value = (int(others[a]), int(others[b])), float(two[a, b])
    for card in range(3, size + 1):
        for t in combinations(others.tolist(), card):
            z = sum(residual(k, node, t) for k in grams) / scale + card * penalty
            if z < value:
                best, value = t, z
    return best


def group_lasso(grams: np.ndarray, cross: np.ndarray, penalty: float, rho: float = 1.0, relax: float = 1.0, rounds: int = 1000, absolute: float = 1e-4, relative: float = 1e-2) -> np.ndarray:
    """min 1/2 |A x - b|^2 + penalty sum_j |x_j| over coefficients x (blocks x nodes), grouped by node, for a design that is block
    diagonal in the blocks: grams (blocks, n, n) and cross (blocks, n) are A'A and A'b. Alternating directions; each block's system
    is factored once."""
    blocks, n = cross.shape
    inverse = np.linalg.inv(grams + rho * np.eye(n))
    z, u = np.zeros((blocks, n)), np.zeros((blocks, n))
    for _ in range(rounds):
        x = np.einsum("bij,bj->bi", inverse, cross + rho * (z - u))
        mixed = relax * x + (1 - relax) * z
        v = mixed + u
        length = np.linalg.norm(v, axis=0)
        before, z = z, v * np.maximum(1 - (penalty / rho) / np.maximum(length, 1e-300), 0)
        u = u + mixed - z
        root = np.sqrt(z.size)
        if np.linalg.norm(x - z) < root * absolute + relative * max(np.linalg.norm(x), np.linalg.norm(z)) and np.linalg.norm(rho * (z - before)) < root * absolute + relative * np.linalg.norm(rho * u):
            break
    return z


def lasso_neighbours(samples: np.ndarray, node: int, penalty: float, threshold: float) -> list[int]:
    """Neighbours of a node from samples (blocks, length, nodes): those whose squared coefficient norm exceeds the threshold."""
    others = [n for n in range(samples.shape[2]) if n != node]
    a, b = samples[:, :, others], samples[:, :, node]
    z = group_lasso(np.einsum("bti,btj->bij", a, a), np.einsum("bti,bt->bi", a, b), penalty)
    return [n for n, s in zip(others, (z**2).sum(axis=0), strict=True) if s > threshold]


def constrained_column(cov: np.ndarray, column: int, most: float, rho: float = 1.0, rounds: int = 2000, tolerance: float = 1e-6) -> np.ndarray:
    """min |beta|_1 subject to |S beta - e|_inf <= most, by linearised alternating directions."""
    p = len(cov)
    e = np.zeros(p)
    e[column] = 1.0
    step = 1.0 / (rho * np.linalg.norm(cov, 2) ** 2 + 1e-12)
    beta, r, u = np.zeros(p), np.zeros(p), np.zeros(p)
    for _ in range(rounds):
        moved = beta - step * rho * cov @ (cov @ beta - e - r + u)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step, 0)
        r = np.clip(cov @ new - e + u, -most, most)
        u = u + cov @ new - e - r
        done = np.abs(new - beta).max() < tolerance and np.abs(cov @ new - e - r).max() < 10 * tolerance
        beta = new
        if done:
            break
    return beta


def constrained_neighbours(cov: np.ndarray, node: int, most: float = 0.2, floor: float = 1e-4) -> list[int]:
    """Nodes with a non-zero entry in the node's precision column, symmetrised by the smaller magnitude."""
    beta = constrained_column(cov, node, most)
    near = [n for n in range(len(cov)) if n != node and abs(beta[n]) > floor]
    return [n for n in near if abs(constrained_column(cov, n, most)[node]) > floor]


def spectral_lasso(spectra: np.ndarray, penalty: float, rho: float = 100.0, rounds: int = 10) -> np.ndarray:
    """Inverse spectral densities X (frequencies, p, p) of Hermitian spectra: alternating directions with an eigenvalue step, clipped
    at 1, and one group soft threshold across frequencies for each pair of nodes."""
    count, p, _ = spectra.shape
    x = z = u = np.zeros_like(spectra)
    off = ~np.eye(p, dtype=bool)
    for _ in range(rounds):
        values, vectors = np.linalg.eigh(rho * (z - u) - spectra)
        values = np.minimum((values + np.sqrt(values**2 + 4 * rho)) / (2 * rho), 1.0)
        x = (vectors * values[:, None, :]) @ vectors.conj().transpose(0, 2, 1)
        v = x + u
        length = np.linalg.norm(v, axis=0)
        shrink = np.where(off, np.maximum(1 - np.sqrt(count) * penalty / rho / np.maximum(length, 1e-300), 0), 1.0)
        z = v * shrink
        u = u + x - z
    return z


def spectral_edges(x: np.ndarray, gain: float, least: float) -> np.ndarray:
    """p x p truth values: strength of a pair over frequencies, divided by sqrt(frequencies) gain, of at least `least`."""
    strength = np.linalg.norm(x, axis=0) / (np.sqrt(len(x)) * gain)
    return (strength >= least) & ~np.eye(x.shape[1], dtype=bool)


def least_absolute(a: np.ndarray, b: np.ndarray, rounds: int = 500, rho: float = 1.0) -> np.ndarray:
    """min |A x - b|_1 by alternating directions."""
    inverse = np.linalg.pinv(a)
    x, z, u = np.zeros(a.shape[1]), np.zeros(len(b)), np.zeros(len(b))
    for _ in range(rounds):
        x = inverse @ (b + z - u)
        v = a @ x - b + u
        z = np.sign(v) * np.maximum(np.abs(v) - 1 / rho, 0)
        u = u + a @ x - b - z
    return x


def constrained_path(cov: np.ndarray, column: int, least: float = 0.0, tolerance: float = 1e-10) -> list[tuple[float, np.ndarray]]:
    """min |beta|_1 subject to |S beta - e|_inf <= penalty for every penalty from 1 down to `least`: the corners (penalty, beta) of the path,
    which is linear in between. By the parametric simplex method: beta = 0 is optimal at 1; each pivot takes out the first variable that would turn
    negative as the penalty falls and keeps the costs optimal. Ties go to the first variable. The path ends early where no beta fits any more."""
    p = len(cov)
    e = np.zeros(p)
    e[column] = 1.0
    table = np.hstack([np.vstack([np.hstack([cov, -cov]), np.hstack([-cov, cov])]), np.eye(2 * p)])
    fixed, slope = np.concatenate([e, -e]), np.ones(2 * p)  # a basic variable is fixed + penalty * slope
    cost = np.concatenate([np.ones(2 * p), np.zeros(2 * p)])
    basis = np.arange(2 * p, 4 * p)

    def beta(penalty: float) -> np.ndarray:
        values = np.zeros(4 * p)
        values[basis] = fixed + penalty * slope
        return values[:p] - values[p : 2 * p]

    path = [(1.0, np.zeros(p))]
    for _ in range(1000 * p):
        falls = np.full(2 * p, -np.inf)
        falls[slope > tolerance] = -fixed[slope > tolerance] / slope[slope > tolerance]
        corner = falls.max()
        if corner <= least:
            path.append((least, beta(least)))
            return path
        first = np.where(falls >= corner - tolerance)[0]
        row = first[basis[first].argmin()]
        if corner < path[-1][0] - tolerance:
            path.append((float(corner), beta(corner)))
        able = np.where(table[row] < -tolerance)[0]
        if not len(able):
            return path
        ratio = cost[able] / -table[row, able]
        enters = able[np.where(ratio <= ratio.min() + tolerance)[0][0]]
        scale = table[row, enters]
        table[row] /= scale
        fixed[row], slope[row] = fixed[row] / scale, slope[row] / scale
        other = table[:, enters].copy()
        other[row] = 0.0
        table -= np.outer(other, table[row])
        fixed, slope = fixed - other * fixed[row], slope - other * slope[row]
        cost = cost - cost[enters] * table[row]
        basis[row] = enters
    raise RuntimeError("the pivots go round in circles")
