"""Sparse neighbourhood selection from blockwise samples.

Samples (block, t, node, x) are reduced once to Gram blocks, the sufficient statistics (block, i, j, g); every candidate
neighbourhood of up to three is then scored from at most ten numbers a block, by column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import dense_inverse_term


def gram(blocks: DataFrame, node: str = "series") -> DataFrame:
    """g(i, j) = sum over a block of x_i x_j, both triangles. One step's values meet in one row, and products are summed before
    they move: one shuffle of samples, one of partial sums."""
    rows = blocks.groupBy("block", "t").agg(F.collect_list(F.struct(F.col(node).alias("node"), "x")).alias("v"))  # one entry a node
    pairs = rows.select("block", "v", F.explode("v").alias("a")).select("block", "a", F.explode("v").alias("b"))
    return pairs.groupBy("block", F.col("a.node").alias("i"), F.col("b.node").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("g"))


def covariance(samples: DataFrame, node: str = "series") -> DataFrame:
    """Centred covariances (n - 1) of all pairs of nodes over t."""
    rows = samples.groupBy("t").agg(F.collect_list(F.struct(F.col(node).alias("node"), "x")).alias("v"))  # one entry a node
    pairs = rows.select("v", F.explode("v").alias("a")).select("a", F.explode("v").alias("b"))
    return pairs.groupBy(F.col("a.node").alias("i"), F.col("b.node").alias("j")).agg(F.covar_samp("a.x", "b.x").alias("cov"))


def partial_strength(precisions: DataFrame) -> DataFrame:
    """rho(i, j): mean over blocks of K_ij^2 / K_ii^2, off the diagonal, from precisions (block, i, j, v). Divided by the row's
    diagonal, so not symmetric."""
    diagonal = precisions.where("i = j").select("block", "i", F.col("v").alias("d"))
    ratio = F.pow(F.col("v"), F.lit(2.0)) / F.nullif(F.pow(F.col("d"), F.lit(2.0)), F.lit(0.0))
    blocks = precisions.select("block").distinct().agg(F.count("*").alias("blocks"))  # one row
    sums = precisions.where("i <> j").join(diagonal, ["block", "i"]).groupBy("i", "j").agg(F.sum(ratio).alias("s"))
    return sums.join(F.broadcast(blocks)).select("i", "j", (F.col("s") / F.col("blocks")).alias("rho"))


def least_strength(precisions: DataFrame) -> DataFrame:
    """rho_min, the smallest non-zero strength, and the penalty rho_min / 6."""
    return partial_strength(precisions).where(F.col("rho") > 0).agg(F.min("rho").alias("rho_min")).withColumn("penalty", F.col("rho_min") / 6)


def candidates(nodes: DataFrame, node: str, size: int) -> DataFrame:
    """(members, card): all sets of 1 ... size nodes, members ascending. Nodes are the columns of a model, not data rows."""
    ids = nodes.select(F.col(node).alias("n")).distinct()
    level = ids.select(F.array("n").alias("members"))
    out = level
    for k in range(2, size + 1):
        level = level.join(ids, F.element_at("members", -1) < F.col("n")).select(F.array_append("members", F.col("n")).alias("members"))
        out = out.unionAll(level)
    return out.select("members", F.size("members").alias("card"))


def residuals(grams: DataFrame, node: object, size: int = 2, candidate_sets: DataFrame | None = None) -> DataFrame:
    """(block, members, card, z): the node's energy in a block that a candidate set leaves unexplained, G_ii - g' G_TT^-1 g. A set whose Gram
    matrix is singular in a block explains nothing there.

    Sets of up to three are made inside their block, by equi-joins, and scored by column expressions; larger ones by NumPy in batches.
    Candidates times blocks is the result's own size."""
    own = grams.where((F.col("i") == F.lit(node)) & (F.col("j") == F.lit(node))).select("block", F.col("g").alias("own"))
    row = grams.where((F.col("i") == F.lit(node)) & (F.col("j") != F.lit(node))).select("block", "j", "g").join(own, "block")
    diagonal = grams.where("i = j").select("block", F.col("j").alias("j"), F.col("g").alias("d"))
    one = row.join(diagonal, ["block", "j"])
    out = None
    for card in range(1, min(size, 3) + 1):
        part = one.select("block", "own", F.col("j").alias("n0"), F.col("g").alias("g0"), F.col("d").alias("m00"))
        for a in range(1, card):
            later = one.select("block", F.col("j").alias(f"n{a}"), F.col("g").alias(f"g{a}"), F.col("d").alias(f"m{a}{a}"))
            part = part.join(later, "block").where(F.col(f"n{a - 1}") < F.col(f"n{a}"))
            for b in range(a):
                part = part.join(grams.select("block", F.col("i").alias(f"n{b}"), F.col("j").alias(f"n{a}"), F.col("g").alias(f"m{b}{a}")), ["block", f"n{b}", f"n{a}"])
        matrix = [[F.col(f"m{min(a, b)}{max(a, b)}") for b in range(card)] for a in range(card)]
        explained = dense_inverse_term([F.col(f"g{a}") for a in range(card)], matrix)
        members = F.array(*[F.col(f"n{a}") for a in range(card)])
        part = part.select("block", members.alias("members"), F.lit(card).alias("card"), (F.col("own") - F.coalesce(explained, F.lit(0.0))).alias("z"))
        if candidate_sets is not None:
            part = part.join(candidate_sets.select("members"), "members", "left_semi")
        out = part if out is None else out.unionByName(part)
    if size > 3:
        large = _large_residuals(grams, node, size)
        out = out.unionByName(large if candidate_sets is None else large.join(candidate_sets.select("members"), "members", "left_semi"))
    return out


def _large_residuals(grams: DataFrame, node: object, size: int, batch: int = 20_000) -> DataFrame:
    """residuals() of sets of 4 ... size nodes. A row holds a block's matrix and one first member, and its task makes the sets that
    begin there, `batch` at a time; the matrix is the model's size and is copied once per node."""
    kinds = {f.name: f.dataType.simpleString() for f in grams.schema}
    entries = grams.groupBy("block").agg(F.collect_list(F.struct("i", "j", "g")).alias("m"))  # an entry a pair of nodes
    firsts = F.explode(F.array_sort(F.array_distinct(F.transform("m", lambda e: e["i"])))).alias("first")
    rows = entries.select("block", "m", firsts).where(F.col("first") != F.lit(node))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, m, first in zip(frame["block"], frame["m"], frame["first"], strict=True):
                names = sorted({e["i"] for e in m})
                at = {n: k for k, n in enumerate(names)}
                matrix = np.zeros((len(names), len(names)))
                for e in m:
                    matrix[at[e["i"]], at[e["j"]]] = e["g"]
                if node in at:
                    yield from sets(block, names, matrix, at[first], at[node])

    def sets(block: object, names: list, matrix: np.ndarray, first: int, own: int) -> Iterator[pd.DataFrame]:
        later = [k for k in range(first + 1, len(names)) if k != own]
        for card in range(4, size + 1):
            found = ((first, *rest) for rest in combinations(later, card - 1))
            while chunk := list(islice(found, batch)):
                t = np.array(chunk)
                gram, g = matrix[t[:, :, None], t[:, None, :]], matrix[t, own]
                solvable = np.linalg.det(gram) != 0
                explained = np.zeros(len(t))
                explained[solvable] = (g[solvable] * np.linalg.solve(gram[solvable], g[solvable][:, :, None])[:, :, 0]).sum(axis=1)
                yield pd.DataFrame({"block": block, "members": [[names[k] for k in row] for row in chunk], "card": card, "z": matrix[own, own] - explained})

    return rows.repartition("block", "first").mapInPandas(work, f"block {kinds['block']}, members array<{kinds['i']}>, card int, z double")


def scores(residual: DataFrame, length: int, penalty: float = 0.0) -> DataFrame:
    """(members, card, score): mean residual energy per sample over all blocks, plus the penalty per member."""
    return residual.groupBy("members", "card").agg((F.sum("z") / (F.count("*") * length) + F.first("card") * F.lit(float(penalty))).alias("score"))


def best(scored: DataFrame, by: list[str], score: str = "score", digits: int = 9) -> DataFrame:
    """The set with the least score; equal scores go to the smaller, then the first set."""
    least = F.min(F.struct(F.round(score, digits).alias("score"), "card", "members")).alias("b")
    return scored.groupBy(*by).agg(least).select(*by, *[f"b.{c}" for c in ("members", "card", "score") if c not in by])


def naive_union(residual: DataFrame, length: int, penalty: float = 0.0) -> DataFrame:
    """Each block's own best set, and the union of them over blocks: (node, blocks)."""
    z = residual.withColumn("score", F.col("z") / length + F.col("card") * F.lit(float(penalty)))
    return best(z, ["block"]).select("block", F.explode("members").alias("node")).groupBy("node").agg(F.count("*").alias("blocks"))


def subset_curve(residual: DataFrame, own: DataFrame, length: int) -> DataFrame:
    """Best mean residual for every set size, from 0 (the node's own power, in `own` as block, g), and each divided by the largest."""
    curve = best(scores(residual, length), ["card"]).select("card", F.col("score").alias("least"))
    power = own.agg(F.round(F.sum("g") / (F.count("*") * length), 9).alias("least")).select(F.lit(0).alias("card"), "least")
    both = power.unionAll(curve)
    top = both.agg(F.max("least").alias("top"))  # one row
    return both.join(F.broadcast(top)).select("card", "least", (F.col("least") / F.nullif(F.col("top"), F.lit(0.0))).alias("share"))


def significance(curve: DataFrame, control: DataFrame) -> DataFrame:
    """For each size s: the gain of one more neighbour over the gain by a neighbour of pure noise,
    (least(s) - least(s + 1)) / (least(s) - control(s)), control(s) being the residual with the noise node added to the best set."""
    later = curve.select((F.col("card") - 1).alias("card"), F.col("least").alias("later"))
    both = curve.join(later, "card").join(control, "card")
    return both.select("card", (F.col("least") - F.col("later")).alias("gain"), ((F.col("least") - F.col("later")) / F.nullif(F.col("least") - F.col("control"), F.lit(0.0))).alias("ratio"))
