"""Fast Fourier transforms of series that are dealt over many tasks.

The four steps, for a length n = n1 n2: sample j = n2 j1 + j2 belongs to column j2; every column is transformed (length n1), its entry k1
is turned by exp(-2 pi i j2 k1 / n), entries go to row k1, every row is transformed (length n2), and entry k2 of row k1 is the
coefficient at k1 + n1 k2. That is two shuffles of n rows a series; a task holds a few columns or rows of about sqrt(n) entries, never a
series. A length without a balanced divisor is turned into a circular convolution with a chirp, whose length is a power of two."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.state import settled, ship_package

CELLS = 65_536  #: entries that a task transforms at once, if a column has no more
POINTS = "series string, place long, re double, im double"


@dataclass(frozen=True)
class Split:
    rows: int  #: n1, length of a column
    columns: int  #: n2, length of a row

    @property
    def size(self) -> int:
        return self.rows * self.columns


def balanced(size: int, longest: int = CELLS) -> Split | None:
    """The two factors nearest to the root, the smaller first; none if the larger exceeds `longest`."""
    root = math.isqrt(size)
    if size // max(root, 1) > longest:
        return None
    rows = next((k for k in range(root, 0, -1) if size % k == 0), 1)
    return Split(rows, size // rows) if size // rows <= longest else None


def power_of_two(least: int) -> Split:
    bits = max(0, least - 1).bit_length()
    return Split(1 << bits // 2, 1 << (bits - bits // 2))


def _lines(points: DataFrame, line: Column, at: Column, length: int, lines: int, sign: int, turn: int | None) -> DataFrame:
    """Transforms every line (a column or a row) of `length` entries; missing entries are 0. Gives (series, line, at, re, im). With turn,
    the entries are turned by exp(sign 2 pi i line at / turn)."""
    together = max(1, CELLS // length)
    kind = points.schema["series"].dataType.simpleString()

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * together
        count = min(together, lines - first)
        grid = np.zeros((count, length), complex)
        grid[pdf["line"].to_numpy() - first, pdf["at"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        out = np.fft.fft(grid, axis=1) if sign < 0 else np.fft.ifft(grid, axis=1) * length
        number, entry = np.arange(first, first + count)[:, None], np.arange(length)[None, :]
        if turn:
            out *= np.exp(sign * 2j * math.pi / turn * (number * entry % turn))
        flat = out.ravel()
        return pd.DataFrame({"series": key[0], "line": np.repeat(number.ravel(), length), "at": np.tile(entry.ravel(), count), "re": flat.real, "im": flat.imag})

    dealt = points.select("series", line.cast("long").alias("line"), at.cast("long").alias("at"), "re", "im")
    return dealt.groupBy("series", F.floor(F.col("line") / together).cast("long").alias("bundle")).applyInPandas(work, f"series {kind}, line long, at long, re double, im double")


def four_step(points: DataFrame, split: Split, sign: int = -1) -> DataFrame:
    """(series, place, re, im) of the transform of points (series, place, re, im) with places 0 ... size - 1, not normalised; sign +1 gives
    the inverse one times its length."""
    ship_package(points.sparkSession)
    n1, n2 = split.rows, split.columns
    place = F.col("place")
    columns = _lines(points, place % n2, F.floor(place / n2), n1, n2, sign, split.size)
    rows = _lines(columns, F.col("at"), F.col("line"), n2, n1, sign, None)
    return rows.select("series", (F.col("line") + n1 * F.col("at")).alias("place"), "re", "im")


def _times(re: Column, im: Column, other_re: Column, other_im: Column) -> tuple[Column, Column]:
    return re * other_re - im * other_im, re * other_im + im * other_re


def chirp(points: DataFrame, size: int) -> DataFrame:
    """The transform of any length as a convolution: with w(j) = exp(-pi i j^2 / n), the coefficient at k is w(k) times the sum over j of
    x(j) w(j) conj(w(k - j)). j k = (j^2 + k^2 - (k - j)^2) / 2; squares are taken modulo 2 n, exactly."""
    split = power_of_two(2 * size - 1)
    angle = lambda j: F.pmod(j * j, F.lit(2 * size)) * F.lit(math.pi / size)
    turned = lambda df: df.select("series", "place", *[c.alias(n) for c, n in zip(_times(F.col("re"), F.col("im"), F.cos(angle(F.col("place"))), -F.sin(angle(F.col("place")))), ("re", "im"), strict=True)])
    spread = turned(points)
    j = F.col("id")
    kernel = points.sparkSession.range(1 - size, size).select(F.lit("").alias("series"), F.pmod(j, F.lit(split.size)).alias("place"), F.cos(angle(j)).alias("re"), F.sin(angle(j)).alias("im"))
    response = settled(four_step(kernel, split).select("place", F.col("re").alias("kre"), F.col("im").alias("kim")))
    both = four_step(spread, split).join(response, "place")
    re, im = _times(F.col("re"), F.col("im"), F.col("kre"), F.col("kim"))
    back = four_step(both.select("series", "place", (re / split.size).alias("re"), (im / split.size).alias("im")), split, 1)
    return turned(back.where(F.col("place") < size))


def transform(samples: DataFrame, size: int, longest: int = CELLS) -> DataFrame:
    """(series, place, re, im): Fourier coefficients of samples (series, t, x) at places 0 ... size - 1. Steps beyond `size` are left out, and
    missing ones count as 0. longest: entries that a task may hold of one series."""
    points = samples.where(F.col("t").between(1, size)).select("series", (F.col("t") - 1).cast("long").alias("place"), F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"))
    split = balanced(size, longest)
    return four_step(points, split) if split else chirp(points, size)
