"""Time-series operators over the long relation (series, t, x), t = 1, 2, ... without gaps.

Shifts are equi-joins on (series, t + lag): a long series is dealt over all tasks instead of being sorted in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import spectra


def hourly_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by hour and kind, zeros included; t = 1 is the first hour of the table."""
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", F.col(ts))) / 3600).cast("long")
    counts = events.where(F.col(ts).isNotNull() & F.col(kind).isNotNull()).groupBy(F.col(kind).alias("series"), hour.alias("hour")).agg(F.count("*").alias("n"))
    spans = counts.groupBy("series").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    bounds = spans.agg(F.min("lo").alias("first"), F.max("hi").alias("last"))  # one row
    grid = spans.select("series").join(F.broadcast(bounds)).select("series", "first", F.explode(F.sequence("first", "last")).alias("hour"))
    dense = grid.join(counts, ["series", "hour"], "left")
    return dense.select("series", (F.col("hour") - F.col("first") + 1).alias("t"), F.coalesce("n", F.lit(0)).cast("double").alias("x"))


def shifted(samples: DataFrame, lag: int, name: str = "later") -> DataFrame:
    """samples with the value `lag` steps later; rows without one go."""
    ahead = samples.select("series", (F.col("t") - lag).alias("t"), F.col("x").alias(name))
    return samples.join(ahead, ["series", "t"])


def difference(samples: DataFrame, lag: int = 1) -> DataFrame:
    """d(t) = x(t + lag) - x(t)."""
    return shifted(samples, lag).select("series", "t", (F.col("later") - F.col("x")).alias("x"))


def ordered_difference(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Differences of neighbouring rows where no gapless t exists."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("diff", F.col(value) - F.lag(value).over(w)).where("diff IS NOT NULL")


def pair_average(samples: DataFrame, places: DataFrame) -> DataFrame:
    """Half the sum of series 2k - 1 and 2k, by their places 1, 2, ... in (series, place); the result is series "k"."""
    placed = samples.join(places.select("series", "place"), "series")
    return placed.groupBy(F.floor((F.col("place") + 1) / 2).cast("string").alias("series"), "t").agg((F.sum("x") / 2).alias("x"))


def with_noise(samples: DataFrame, count: int, scale: float = 1000.0, seed: int = 0) -> DataFrame:
    """Adds series noise1 ... of seeded normal noise over the same t."""
    from graphloom.functions.arrays import hash_normal

    steps = samples.select("t").distinct()
    noise = steps.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return samples.select("series", "t", "x").unionByName(noise.select(F.concat(F.lit("noise"), F.col("k").cast("string")).alias("series"), "t", (hash_normal("t", "k", seed) * scale).alias("x")))


def blocked(samples: DataFrame, length: int) -> DataFrame:
    """Whole blocks of `length` steps, numbered from 0; the rest at the end is dropped."""
    last = samples.agg(F.max("t").alias("_last"))  # one row
    block = F.floor((F.col("t") - 1) / length).cast("long")
    return samples.join(F.broadcast(last)).withColumn("block", block).where((F.col("block") + 1) * length <= F.col("_last")).drop("_last")


def centred(blocks: DataFrame) -> DataFrame:
    """Each block's values less their mean, by series."""
    return blocks.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("series", "block")))


def chunk_means(df: DataFrame, key: str, order: list[str], value: str, chunks: int) -> DataFrame:
    """Means of `chunks` equal runs of a key's rows, floor(n / chunks) long; the rest is dropped, keys with fewer rows too."""
    w = Window.partitionBy(key).orderBy(*order)
    sized = df.select(key, value, F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    length = F.floor(F.col("n") / chunks)
    held = sized.where(F.col("n") >= chunks).withColumn("length", length).withColumn("chunk", F.floor((F.col("rn") - 1) / F.col("length")).cast("long"))
    return held.where(F.col("chunk") < chunks).groupBy(key, "chunk").agg((F.sum(value) / F.first("length")).alias("mean"))


def filtered(samples: DataFrame, taps: list[float]) -> DataFrame:
    """Finite impulse response: y(t) = sum over k of h(k) x(t - k), from the first t with all terms on. Each sample is sent to the
    outputs that it is part of, and sums combine before the shuffle."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(h)).alias("h")) for k, h in enumerate(taps)]))
    terms = samples.select("series", "t", "x", parts.alias("tap")).select("series", (F.col("t") + F.col("tap.k")).alias("t"), (F.col("tap.h") * F.col("x")).alias("y"))
    return terms.groupBy("series", "t").agg(F.sum("y").alias("x"), F.count("*").alias("n")).where(F.col("n") == len(taps)).drop("n")


def autocovariance(samples: DataFrame, lags: int) -> DataFrame:
    """Mean of x(t) x(t + m) over the series' length, for m = 0 ... lags; not centred."""
    later = samples.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select("series", (F.col("t") - F.col("lag")).alias("t"), "lag", F.col("x").alias("later"))
    sizes = samples.groupBy("series").agg(F.count("*").alias("n"))
    sums = samples.join(later, ["series", "t"]).groupBy("series", "lag").agg(F.sum(F.col("x") * F.col("later")).alias("s"))
    return sums.join(F.broadcast(sizes), "series").select("series", "lag", (F.col("s") / F.col("n")).alias("acov"))  # a row a series


def fourier(samples: DataFrame, size: int, frequencies: int | None = None, longest: int = spectra.CELLS) -> DataFrame:
    """Discrete Fourier coefficients (series, freq, re, im) of the first `size` steps, zero-padded if the series is shorter, by the
    four-step transform: n log n work and two shuffles of n rows a series, no task holding a series longer than `longest`."""
    found = spectra.transform(samples, size, longest)
    kept = found if frequencies is None else found.where(F.col("place") < frequencies)
    return kept.select("series", F.col("place").cast("int").alias("freq"), "re", "im")


def cross_periodogram(coefficients: DataFrame, length: int) -> DataFrame:
    """(freq, i, j, re, im) of conj(f_i) f_j / length, all pairs of series at a frequency."""
    rows = coefficients.groupBy("freq").agg(F.collect_list(F.struct("series", "re", "im")).alias("fs"))  # one entry a series
    pairs = rows.select("freq", F.explode("fs").alias("a"), "fs").select("freq", "a", F.explode("fs").alias("b"))
    re = (F.col("a.re") * F.col("b.re") + F.col("a.im") * F.col("b.im")) / length
    im = (F.col("a.re") * F.col("b.im") - F.col("a.im") * F.col("b.re")) / length
    return pairs.select("freq", F.col("a.series").alias("i"), F.col("b.series").alias("j"), re.alias("re"), im.alias("im"))


def smoothed_spectrum(spectrum: DataFrame, window: list[float], size: int, every: int = 1) -> DataFrame:
    """Circular moving average over frequencies with the window's weights (centred), of which every `every`th is kept."""
    half, total = len(window) // 2, float(sum(window))
    parts = F.explode(F.array(*[F.struct(F.lit(k - half).alias("k"), F.lit(w / total).alias("w")) for k, w in enumerate(window)]))
    terms = spectrum.select("*", parts.alias("p")).withColumn("to", F.pmod(F.col("freq") + F.col("p.k"), F.lit(size)))
    kept = terms.where(F.col("to") % every == 0)
    return kept.groupBy(F.col("to").alias("freq"), "i", "j").agg(F.sum(F.col("p.w") * F.col("re")).alias("re"), F.sum(F.col("p.w") * F.col("im")).alias("im"))


def scaled_size(samples: Column, factor: Column, nodes: Column) -> Column:
    """Sample size on the axis on which error curves of different dimensions meet."""
    return samples * factor * factor / F.log(nodes)
