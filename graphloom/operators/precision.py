"""Sparse precision structure on tables: constrained columns over all penalties, block by block, and the spectral graphical lasso with its
frequencies dealt to tasks.

Both keep a model's matrix (nodes x nodes) in a task, never the blocks or frequencies together. Nodes without power in a block have no column
there; null values don't occur in Gram blocks; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.kernels import regression
from graphloom.plans.state import settled, ship_package


def constrained_paths(grams: DataFrame, least: float = 0.0, columns: int = 64) -> DataFrame:
    """(block, target, penalty, nodes, betas): the corners of every precision column's path over the penalties, for each block's
    correlations. A block's columns are dealt to tasks, `columns` to each, and each such task has a copy of that block's matrix alone."""
    ship_package(grams.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in grams.schema}
    shares = -(-grams.select("i").distinct().count() // columns)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="g").sort_index().sort_index(axis=1)
        power = np.diag(m.to_numpy())
        m = m.loc[power > 0, power > 0]
        root = np.sqrt(power[power > 0])
        corr = m.to_numpy() / np.outer(root, root)
        rows = []
        for c in range(int(key[1]), len(m), shares):
            for penalty, beta in regression.constrained_path(corr, c, least):
                held = np.abs(beta) > 1e-12
                rows.append((key[0], m.index[c], penalty, list(m.index[held]), beta[held].tolist()))
        return pd.DataFrame(rows, columns=["block", "target", "penalty", "nodes", "betas"])

    dealt = grams.select("block", "i", "j", "g", F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))).alias("share"))
    return dealt.groupBy("block", "share").applyInPandas(work, f"block {kinds['block']}, target {kinds['i']}, penalty double, nodes array<{kinds['i']}>, betas array<double>")


def columns_at(paths: DataFrame, penalty: float) -> DataFrame:
    """(block, target, node, beta) at one penalty, on the straight line between the corners about it. Where a path ends above the penalty, no
    column fits and there are no rows."""
    later = Window.partitionBy("block", "target").orderBy(F.desc("penalty"))  # a path's corners
    sides = paths.withColumn("low", F.lead(F.struct("penalty", "nodes", "betas")).over(later))
    here = sides.where((F.col("penalty") >= penalty) & F.coalesce(F.col("low.penalty") < penalty, F.col("penalty") == penalty))
    share = F.coalesce((F.lit(penalty) - F.col("low.penalty")) / (F.col("penalty") - F.col("low.penalty")), F.lit(1.0))
    part = lambda nodes, betas, w: F.transform(F.coalesce(F.arrays_zip(F.col(nodes).alias("node"), F.col(betas).alias("beta")), F.array()), lambda x: F.struct(x["node"].alias("node"), (x["beta"] * w).alias("beta")))
    terms = F.concat(part("nodes", "betas", share), part("low.nodes", "low.betas", 1 - share))
    return here.select("block", "target", F.explode(terms).alias("x")).groupBy("block", "target", F.col("x.node").alias("node")).agg(F.sum("x.beta").alias("beta"))


def united_edges(columns: DataFrame, floor: float = 1e-4) -> DataFrame:
    """(i, j, blocks): pairs i < j whose entries exceed the floor in both columns of a block, and in how many blocks they do."""
    near = columns.where((F.col("target") != F.col("node")) & (F.abs("beta") > floor))
    back = near.select("block", F.col("target").alias("node"), F.col("node").alias("target"))
    both = near.select("block", "target", "node").join(back, ["block", "target", "node"])
    return both.where("target < node").groupBy(F.col("target").alias("i"), F.col("node").alias("j")).agg(F.count("*").alias("blocks"))


def unit_power(spectra: DataFrame) -> DataFrame:
    """Spectra (freq, i, j, re, im) scaled so that every node's power is 1 on average over frequencies; nodes without power go."""
    power = spectra.where("i = j").groupBy("i").agg(F.sqrt(F.avg("re")).alias("root")).where("root > 0")
    both = spectra.join(F.broadcast(power), "i").join(F.broadcast(power.select(F.col("i").alias("j"), F.col("root").alias("other"))), "j")  # a row a node
    return both.select("freq", "i", "j", (F.col("re") / (F.col("root") * F.col("other"))).alias("re"), (F.col("im") / (F.col("root") * F.col("other"))).alias("im"))


def spectral_lasso(spectra: DataFrame, penalty: float, rho: float = 100.0, rounds: int = 10, width: int = 64) -> DataFrame:
    """(freq, i, j, re, im): inverse spectral densities by alternating directions. Spectra (freq, i, j, re, im) hold every pair at every frequency. In a
    round tasks take the eigenvalue step of the frequencies in their range of `width`; a pair's norm over all frequencies is a grouped
    sum, by which its entries shrink together."""
    ship_package(spectra.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in spectra.schema}
    state = settled(spectra.select(F.floor(F.col("freq") / width).alias("part"), "freq", "i", "j", F.col("re").alias("sre"), F.col("im").alias("sim"), *[F.lit(0.0).alias(c) for c in ("zre", "zim", "ure", "uim")]))
    count = state.select("freq").distinct().count()
    schema = f"part long, freq {kinds['freq']}, i {kinds['i']}, j {kinds['j']}, sre double, sim double, vre double, vim double"

    def eigenvalue_step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["freq", "i", "j"], ignore_index=True)
        p = int(round(np.sqrt(len(pdf) / pdf["freq"].nunique())))
        s, z, u = ((pdf[f"{c}re"].to_numpy() + 1j * pdf[f"{c}im"].to_numpy()).reshape(-1, p, p) for c in "szu")
        values, vectors = np.linalg.eigh(rho * (z - u) - s)
        values = np.minimum((values + np.sqrt(values**2 + 4 * rho)) / (2 * rho), 1.0)
        v = ((vectors * values[:, None, :]) @ vectors.conj().transpose(0, 2, 1) + u).ravel()
        return pdf[["part", "freq", "i", "j", "sre", "sim"]].assign(vre=v.real, vim=v.imag)

    for _ in range(rounds):
        moved = settled(state.groupBy("part").applyInPandas(eigenvalue_step, schema))
        length = F.sqrt(F.sum(F.col("vre") * F.col("vre") + F.col("vim") * F.col("vim")))
        keeps = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(1 - F.lit(float(np.sqrt(count) * penalty / rho)) / F.greatest("length", F.lit(1e-300)), F.lit(0.0)))
        lengths = moved.groupBy("i", "j").agg(length.alias("length")).select("i", "j", keeps.alias("keeps"))
        shrunk = moved.join(lengths, ["i", "j"])
        z = [(F.col(c) * F.col("keeps")) for c in ("vre", "vim")]
        state = shrunk.select("part", "freq", "i", "j", "sre", "sim", z[0].alias("zre"), z[1].alias("zim"), (F.col("vre") - z[0]).alias("ure"), (F.col("vim") - z[1]).alias("uim"))
    return state.select("freq", "i", "j", F.col("zre").alias("re"), F.col("zim").alias("im"))


def spectral_strengths(inverse: DataFrame, gain: float = 1.0) -> DataFrame:
    """(i, j, strength) of pairs i < j: the norm over frequencies, divided by the root of their number and the gain."""
    power = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return inverse.where("i < j").groupBy("i", "j").agg((F.sqrt(power / F.count("*")) / gain).alias("strength"))
