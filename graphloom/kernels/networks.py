"""Cuts, spectra, diffusions and quadratic models of graphs that fit a task."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def max_flow(n: int, src: np.ndarray, dst: np.ndarray, capacity: np.ndarray, source: int, sink: int, directed: bool = False) -> tuple[float, np.ndarray]:
    """Value of a largest flow, and which nodes are on the source's side of a least cut. Blocking flows on level graphs."""
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in zip(src.tolist(), dst.tolist(), capacity.tolist(), strict=True):
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += [b, a]
        room += [c, 0.0 if directed else c]
    total = 0.0
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return total, np.array(level) >= 0
        at = [0] * n
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                pushed = min(room[e] for e in path)
                total += pushed
                for k, e in enumerate(path):
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[v] < len(head[v]) and not (room[head[v][at[v]]] > 1e-12 and level[to[head[v][at[v]]]] == level[v] + 1):
                at[v] += 1
            if at[v] < len(head[v]):
                path.append(head[v][at[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def laplacian_matrix(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((n, n))
    np.add.at(out, (src, dst), -w)
    np.add.at(out, (dst, src), -w)
    out[np.arange(n), np.arange(n)] = -out.sum(axis=1)
    return out


def fiedler(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The second smallest eigenvalue of the Laplacian, and its unit vector with a positive first non-zero entry."""
    values, vectors = np.linalg.eigh(laplacian_matrix(n, src, dst, w))
    v = vectors[:, 1]
    first = v[np.abs(v) > 1e-9]
    return float(values[1]), v * (np.sign(first[0]) if len(first) else 1.0)


def smooth_model(src: np.ndarray, dst: np.ndarray, w: np.ndarray, features: np.ndarray, target: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q, q and the minimiser (n x d) of w'Qw + q'w: squared errors at every node plus the penalty times the edges' squared
    differences."""
    n, d = features.shape
    q2 = penalty * np.kron(laplacian_matrix(n, src, dst, w), np.eye(d))
    for i, x in enumerate(features):
        q2[i * d : (i + 1) * d, i * d : (i + 1) * d] += np.outer(x, x)
    q1 = (-2 * target[:, None] * features).ravel()
    return q2, q1, np.linalg.lstsq(2 * q2, -q1, rcond=None)[0].reshape(n, d)


def smooth_model_by_descent(src: np.ndarray, dst: np.ndarray, w: np.ndarray, features: np.ndarray, target: np.ndarray, penalty: float, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """The same minimiser by conjugate gradients, without a matrix: for graphs whose nd x nd matrix is too large."""

    def apply(v: np.ndarray) -> np.ndarray:
        diff = w[:, None] * (v[src] - v[dst])
        out = features * (features * v).sum(axis=1, keepdims=True)
        np.add.at(out, src, penalty * diff)
        np.subtract.at(out, dst, penalty * diff)
        return out

    x = np.zeros_like(features)
    r = target[:, None] * features
    p, size = r.copy(), float((r * r).sum())
    for _ in range(rounds):
        if size < tolerance**2:
            break
        ap = apply(p)
        step = size / float((p * ap).sum())
        x, r = x + step * p, r - step * ap
        new = float((r * r).sum())
        p, size = r + (new / size) * p, new
    return x


def adjacency(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> list[list[tuple[int, float]]]:
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        out[a].append((b, c))
        out[b].append((a, c))
    return out


def local_rank(near: list[list[tuple[int, float]]], seeds: list[int], restart: float = 0.15, error: float = 1e-4) -> np.ndarray:
    """Approximate personalised rank: mass is pushed from nodes whose rest exceeds `error` times their strength (lazy walk)."""
    strength = np.array([sum(c for _, c in x) for x in near])
    p, r = np.zeros(len(near)), np.zeros(len(near))
    r[seeds] = 1.0 / len(seeds)
    queue = deque(seeds)
    while queue:
        v = queue.popleft()
        if strength[v] <= 0 or r[v] < error * strength[v]:
            continue
        mass = r[v]
        p[v] += restart * mass
        r[v] = (1 - restart) * mass / 2
        for u, c in near[v]:
            before = r[u]
            r[u] += (1 - restart) * mass * c / (2 * strength[v])
            if before < error * strength[u] <= r[u]:
                queue.append(u)
        if r[v] >= error * strength[v]:
            queue.append(v)
    return p


def sweep_cut(near: list[list[tuple[int, float]]], score: np.ndarray) -> tuple[list[int], float]:
    """The prefix of nodes by score per strength with the least conductance."""
    strength = np.array([sum(c for _, c in x) for x in near])
    total = strength.sum()
    held = np.where(score > 0)[0]
    order = held[np.argsort(-score[held] / strength[held], kind="stable")]
    inside, cut, volume, best, size = set(), 0.0, 0.0, np.inf, 0
    for k, v in enumerate(order.tolist(), 1):
        cut += sum(-c if u in inside else c for u, c in near[v])
        volume += strength[v]
        inside.add(v)
        if 0 < min(volume, total - volume) and cut / min(volume, total - volume) < best:
            best, size = cut / min(volume, total - volume), k
    return sorted(order[:size].tolist()), float(best)


def release_diffusion(near: list[list[tuple[int, float]]], seeds: list[int], rounds: int = 10, capacity: float = 3.0, height: int = 20) -> np.ndarray:
    """Capacity-releasing diffusion: mass on the seeds is doubled each round and flows downhill by push and relabel; edges carry at most
    `capacity` a round, nodes settle mass up to their strength. Returns the mass settled per strength in the last round."""
    strength = np.array([sum(c for _, c in x) for x in near])
    mass = np.zeros(len(near))
    mass[seeds] = strength[seeds]
    for _ in range(rounds):
        mass = 2 * mass
        level = np.zeros(len(near), int)
        carried: dict[tuple[int, int], float] = {}
        queue = deque(np.where(mass > strength)[0].tolist())
        while queue:
            v = queue.popleft()
            while mass[v] > strength[v] + 1e-12 and level[v] < height:
                moved = False
                for u, c in near[v]:
                    room = capacity * c - carried.get((v, u), 0.0) + carried.get((u, v), 0.0)
                    push = min(mass[v] - strength[v], room, max(0.0, 2 * strength[u] - mass[u]))
                    if level[v] == level[u] + 1 and push > 1e-12:
                        carried[v, u] = carried.get((v, u), 0.0) + push
                        mass[v] -= push
                        mass[u] += push
                        moved = True
                        if mass[u] > strength[u]:
                            queue.append(u)
                        if mass[v] <= strength[v] + 1e-12:
                            break
                if not moved:
                    level[v] += 1
        if (mass > strength).any() and mass[mass > strength].sum() - strength[mass > strength].sum() > 0.1 * mass.sum():
            break  # the mass no longer finds room: the cluster is full
        mass = np.minimum(mass, strength)
    return np.divide(mass, strength, out=np.zeros_like(mass), where=strength > 0)


def flow_improved(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, members: list[int]) -> tuple[list[int], float]:
    """The subset of the members with the least ratio of cut to volume, by flows on the members' graph until none improves."""
    strength = np.bincount(src, w, n) + np.bincount(dst, w, n)
    current = sorted(members)
    while current:
        inside = np.zeros(n, bool)
        inside[current] = True
        border = inside[src] != inside[dst]
        cut, volume = float(w[border].sum()), float(strength[current].sum())
        if cut <= 1e-12:
            break
        place = np.full(n, -1)
        place[current] = np.arange(len(current))
        within = inside[src] & inside[dst]
        a, b, c = place[src[within]], place[dst[within]], w[within] * volume
        out = np.bincount(np.where(inside[src[border]], place[src[border]], place[dst[border]]), w[border] * volume, len(current))
        s, t = len(current), len(current) + 1
        ids = np.arange(len(current))
        tails = np.concatenate([a, b, np.full(len(current), s), ids])
        heads = np.concatenate([b, a, ids, np.full(len(current), t)])
        caps = np.concatenate([c, c, out, cut * strength[current]])
        value, side = max_flow(len(current) + 2, tails, heads, caps, s, t, directed=True)
        if value >= cut * volume * (1 - 1e-9):
            break
        better = [v for v, x in zip(current, side[: len(current)], strict=True) if not x]
        if not better or len(better) == len(current):
            break
        current = better
    inside = np.zeros(n, bool)
    inside[current] = True
    volume = float(strength[current].sum())
    return current, float(w[inside[src] != inside[dst]].sum()) / volume if volume else np.inf


def per_graph(nodes: DataFrame, edges: DataFrame, work, schema: str, graph: str = "graph_id") -> DataFrame:
    """Applies work(graph, nodes, edges) with edge ends as places in the sorted node ids (columns s, d), one task a graph."""

    def call(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("nid", ignore_index=True)
        e = e.sort_values(["src", "dst"], ignore_index=True)
        ids = n["nid"].to_numpy()
        return work(key[0], n, e.assign(s=np.searchsorted(ids, e["src"]), d=np.searchsorted(ids, e["dst"])))

    return nodes.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(call, schema)
