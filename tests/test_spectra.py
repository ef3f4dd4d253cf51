"""Four-step and chirp transforms against NumPy, in balanced, unbalanced and prime lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import series, spectra


def table(spark, rows):
    return spark.createDataFrame([(s, t + 1, float(v)) for s, x in rows.items() for t, v in enumerate(x)], "series string, t long, x double").repartition(3)


def coefficients(df, size):
    out = {}
    for r in df.collect():
        out.setdefault(r["series"], np.full(size, np.nan, complex))[r["freq"]] = complex(r["re"], r["im"])
    return out


@pytest.mark.parametrize("size, longest", [(1, 9), (2, 9), (12, 9), (360, 40), (720, 720), (127, 127), (127, 12), (254, 20), (1009, 50)])
def test_against_numpy(spark, size, longest):
    rng = np.random.default_rng(size)
    rows = {"a": rng.standard_normal(size), "b": rng.integers(0, 50, size), "short": rng.standard_normal(max(1, size // 3)), "long": rng.standard_normal(size + 5)}
    got = coefficients(series.fourier(table(spark, rows), size, longest=longest), size)
    assert set(got) == set(rows)
    for name, x in rows.items():
        want = np.fft.fft(np.r_[x, np.zeros(max(0, size - len(x)))][:size])
        assert np.abs(got[name] - want).max() < 1e-9 * max(1, np.abs(want).max())


def test_split():
    assert spectra.balanced(720) == spectra.Split(24, 30) and spectra.balanced(1440) == spectra.Split(36, 40)
    assert spectra.balanced(127, 100) is None and spectra.balanced(127).size == 127
    assert spectra.power_of_two(253) == spectra.Split(16, 16) and spectra.power_of_two(1).size == 1


def test_missing_steps_and_few_frequencies(spark):
    x = np.zeros(60)
    x[[3, 17, 40]] = [2.0, -1.0, 5.0]
    df = spark.createDataFrame([(7, int(t) + 1, float(x[t])) for t in (3, 17, 40)], "series int, t long, x double")
    got = series.fourier(df, 60, 10).orderBy("freq").collect()
    assert [r["freq"] for r in got] == list(range(10)) and {r["series"] for r in got} == {7}
    assert np.allclose([complex(r["re"], r["im"]) for r in got], np.fft.fft(x)[:10])
    assert series.fourier(df.where("false"), 60).collect() == []


def test_cost_grows_like_n_log_n(spark):
    """Rows that the steps send on, counted at two lengths: twice n at both, not n times frequencies; and no line longer than the root allows."""
    counts = {}
    for size in (4096, 16384):
        split = spectra.balanced(size)
        points = spark.range(size).select(F.lit("a").alias("series"), F.col("id").alias("place"), F.rand(1).alias("re"), F.lit(0.0).alias("im"))
        columns = spectra._lines(points, F.col("place") % split.columns, F.floor(F.col("place") / split.columns), split.rows, split.columns, -1, size)
        counts[size] = columns.count() + spectra.four_step(points, split).count()
        assert split.columns**2 <= 4 * size
    assert counts == {4096: 2 * 4096, 16384: 2 * 16384}
