"""The registered queries of the time-series, selection and graph operators, each with its SQL.

Doubles are rounded to six decimals on both sides, and + 0.0 turns a negative zero into zero."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.functions import arrays
from graphloom.kernels import networks, regression
from graphloom.operators import diffusion, graphs, learning, partitioned, precision, selection, series, solvers, subsets, tabular
from graphloom.plans import experiments
from graphloom.plans.state import settled, shared_dir
from graphloom.sources import observations as weather
from graphloom.sources import tables
from graphloom.streaming import events as streams


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


# Shared SQL -----------------------------------------------------------------------------------------------------------------

HOURLY = """
c AS (SELECT event_type AS series, CAST(floor(epoch(date_trunc('hour', ts)) / 3600) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT min(h) AS lo, max(h) AS hi FROM c),
g AS (SELECT series, unnest(generate_series(lo, hi)) AS h FROM (SELECT DISTINCT series FROM c), b),
s AS (SELECT g.series, CAST(g.h - b.lo + 1 AS BIGINT) AS t, CAST(coalesce(c.n, 0) AS DOUBLE) AS x FROM g JOIN b ON true LEFT JOIN c ON c.series = g.series AND c.h = g.h)
"""
DIFFS = HOURLY + ", d AS (SELECT a.series, a.t, z.x - a.x AS x FROM s a JOIN s z ON z.series = a.series AND z.t = a.t + 24)"
DAYS = DIFFS + """,
k AS (SELECT series, t, x, CAST((t - 1) // 24 AS BIGINT) AS block FROM d WHERE ((t - 1) // 24 + 1) * 24 <= (SELECT max(t) FROM d)),
m AS (SELECT series, t, block, x - avg(x) OVER (PARTITION BY series, block) AS x FROM k)
"""
GRAM = DAYS + ", gr AS (SELECT a.block, a.series AS i, b.series AS j, sum(a.x * b.x) AS g FROM m a JOIN m b ON a.block = b.block AND a.t = b.t GROUP BY 1, 2, 3)"
NODE = "view"
PENALTY = 0.05


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hourly_counts(read(spark, sf_dir, "events"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.centred(series.blocked(series.difference(hours(spark, sf_dir), 24), 24))


def grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram blocks, made once: every candidate is scored from them, and they are far smaller than the samples."""
    return settled(selection.gram(days(spark, sf_dir)))


# Tabular --------------------------------------------------------------------------------------------------------------------


@query("""
SELECT c_name AS applicant, round(sum(o_totalprice), 6) + 0.0 AS total, row_number() OVER (ORDER BY round(sum(o_totalprice), 6) DESC, c_name) AS rank
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name IS NOT NULL GROUP BY c_name
""")
def funding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.where("c_name IS NOT NULL").groupBy(F.col("c_name").alias("applicant")).agg(six(F.sum("o_totalprice")).alias("total"))
    return tabular.with_rank(sums, [F.desc("total"), F.asc("applicant")])


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that carry a column beyond the order."""
    return tabular.with_rank(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(f"WITH {HOURLY} SELECT series, t, x FROM s")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir)


@query(f"""
WITH {HOURLY}, p AS (SELECT t, x, dense_rank() OVER (ORDER BY series) AS c FROM s)
SELECT CAST((c + 1) // 2 AS VARCHAR) AS series, t, sum(x) / 2 AS x FROM p GROUP BY 1, 2
""")
def pair_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = hours(spark, sf_dir)
    return series.pair_average(counts, tabular.with_rank(counts.select("series").distinct(), [F.asc("series")], "place"))


@query(f"WITH {DIFFS} SELECT series, t, x FROM d")
def seasonal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.difference(hours(spark, sf_dir), 24)


@query("""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT * FROM (SELECT user_id, CAST(rn AS BIGINT) AS rn, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn), 6) + 0.0 AS diff FROM n WHERE c >= 20 AND rn <= 20) WHERE diff IS NOT NULL
""")
def first_diff_minlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    kept = tabular.first_rows(tabular.long_groups(events, "user_id", 20), "user_id", ["ts", "event_id"], 20)
    return series.ordered_difference(kept, "user_id", ["rn"], "value").select("user_id", "rn", six("diff").alias("diff"))


@query("""
SELECT event_type, min(ts) AS ts, min_by(user_id, (ts, event_id)) AS user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type
""")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    return tabular.first_by_key(events, ["event_type"], ["ts", "event_id"]).select("event_type", "ts", "user_id", "event_id")


@query("""
SELECT c_mktsegment, round(max(c_acctbal), 6) + 0.0 AS top, CAST(count(*) FILTER (c_acctbal / (SELECT max(c_acctbal) FROM customer x WHERE x.c_mktsegment = c.c_mktsegment) > 0.5) AS BIGINT) AS upper_half FROM customer c GROUP BY c_mktsegment
""")
def max_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = tabular.max_normalised(read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), "c_acctbal", ["c_mktsegment"], "share")
    return shares.groupBy("c_mktsegment").agg(six(F.max("c_acctbal")).alias("top"), F.count_if(F.col("share") > 0.5).alias("upper_half"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST((rn - 1) // (n // 4) AS BIGINT) AS chunk, round(sum(value) / (max(n) // 4), 6) + 0.0 AS mean
FROM r WHERE n >= 4 AND (rn - 1) // (n // 4) < 4 GROUP BY 1, 2
""")
def feature_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = series.chunk_means(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 4)
    return means.select("user_id", "chunk", six("mean").alias("mean"))


# Series ---------------------------------------------------------------------------------------------------------------------


@query(f"WITH {DAYS} SELECT series, t, block, round(x, 6) + 0.0 AS x FROM m")
def block_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).select("series", "t", "block", six("x").alias("x"))


@query(f"WITH {GRAM} SELECT block, i, j, round(g, 6) + 0.0 AS g FROM gr")
def block_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gram(days(spark, sf_dir)).select("block", "i", "j", six("g").alias("g"))


@query(f"WITH {HOURLY} SELECT a.series AS i, b.series AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM s a JOIN s b ON a.t = b.t GROUP BY 1, 2")
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.covariance(hours(spark, sf_dir)).select("i", "j", six("cov").alias("cov"))


def whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The hourly series, made once, and their number of hours (1 without events)."""
    samples = settled(hours(spark, sf_dir))
    return samples, samples.agg(F.max("t")).first()[0] or 1


@query(f"""
WITH {HOURLY}, l AS (SELECT max(t) AS n FROM s), f AS (SELECT n, unnest(generate_series(0, n - 1)) AS freq FROM l)
SELECT series, CAST(freq AS INTEGER) AS freq, round(sum(x * cos(2 * pi() / n * ((freq * (t - 1)) % n))), 6) + 0.0 AS re, round(sum(-x * sin(2 * pi() / n * ((freq * (t - 1)) % n))), 6) + 0.0 AS im
FROM s, f GROUP BY 1, 2
""")
def dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, length = whole(spark, sf_dir)
    return series.fourier(samples, length).select("series", "freq", six("re").alias("re"), six("im").alias("im"))


SPECTRUM = f"""
{HOURLY}, l AS (SELECT max(t) AS n FROM s), fr AS (SELECT n, unnest(generate_series(0, 2 * n - 1)) AS freq FROM l),
co AS (SELECT series, freq, n, sum(x * cos(pi() / n * ((freq * (t - 1)) % (2 * n)))) AS re, sum(-x * sin(pi() / n * ((freq * (t - 1)) % (2 * n)))) AS im FROM s, fr GROUP BY 1, 2, 3),
pg AS (SELECT a.freq, a.n, a.series AS i, b.series AS j, (a.re * b.re + a.im * b.im) / a.n AS re, (a.re * b.im - a.im * b.re) / a.n AS im FROM co a JOIN co b USING (freq))
"""


def spectrum(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The periodogram of all hours, zero-padded to twice their number, and its number of frequencies."""
    samples, length = whole(spark, sf_dir)
    return series.cross_periodogram(series.fourier(samples, 2 * length), length), 2 * length


@query(f"WITH {SPECTRUM} SELECT CAST(freq AS INTEGER) AS freq, i, j, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM pg")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum(spark, sf_dir)[0].select("freq", "i", "j", six("re").alias("re"), six("im").alias("im"))


@query(f"""
WITH {SPECTRUM}, w AS (SELECT * FROM (VALUES (-2, 1.0), (-1, 2.0), (0, 3.0), (1, 2.0), (2, 1.0)) v(k, h))
SELECT CAST((freq + k + 2 * n) % (2 * n) AS INTEGER) AS freq, i, j, round(sum(h / 9 * re), 6) + 0.0 AS re, round(sum(h / 9 * im), 6) + 0.0 AS im
FROM pg, w WHERE ((freq + k + 2 * n) % (2 * n)) % 8 = 0 GROUP BY 1, 2, 3
""")
def smoothed_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, frequencies = spectrum(spark, sf_dir)
    return series.smoothed_spectrum(pairs, [1.0, 2.0, 3.0, 2.0, 1.0], frequencies, 8).select("freq", "i", "j", six("re").alias("re"), six("im").alias("im"))


@query(f"WITH {HOURLY} SELECT a.series, a.t, 2.0 * a.x + 0.5 * b.x + 0.25 * c.x AS x FROM s a JOIN s b ON b.series = a.series AND b.t = a.t - 1 JOIN s c ON c.series = a.series AND c.t = a.t - 2")
def fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.filtered(hours(spark, sf_dir), [2.0, 0.5, 0.25])


@query(f"""
WITH {HOURLY}, l AS (SELECT unnest(generate_series(0, 5)) AS lag)
SELECT a.series, CAST(lag AS INTEGER) AS lag, round(sum(a.x * z.x) / (SELECT max(t) FROM s), 6) + 0.0 AS acov FROM l, s a JOIN s z ON z.series = a.series AND z.t = a.t + lag GROUP BY 1, 2
""")
def autocov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.autocovariance(hours(spark, sf_dir), 5).select("series", "lag", six("acov").alias("acov"))


# Selection ------------------------------------------------------------------------------------------------------------------

CANDIDATES = f"""
o AS (SELECT DISTINCT i AS n FROM gr WHERE i <> '{NODE}'),
one AS (SELECT r.block, [r.j] AS members, 1 AS card, own.g - coalesce(r.g * r.g / nullif(d.g, 0), 0) AS z
  FROM gr r JOIN gr own ON own.block = r.block AND own.i = r.i AND own.j = r.i JOIN gr d ON d.block = r.block AND d.i = r.j AND d.j = r.j WHERE r.i = '{NODE}' AND r.j <> '{NODE}'),
two AS (SELECT a.block, [a.j, b.j] AS members, 2 AS card, own.g - coalesce((a.g * a.g * db.g - 2 * a.g * b.g * m.g + b.g * b.g * da.g) / nullif(da.g * db.g - m.g * m.g, 0), 0) AS z
  FROM gr a JOIN gr b ON a.block = b.block AND a.i = b.i AND a.j < b.j JOIN gr own ON own.block = a.block AND own.i = a.i AND own.j = a.i
  JOIN gr da ON da.block = a.block AND da.i = a.j AND da.j = a.j JOIN gr db ON db.block = a.block AND db.i = b.j AND db.j = b.j
  JOIN gr m ON m.block = a.block AND m.i = a.j AND m.j = b.j WHERE a.i = '{NODE}' AND a.j <> '{NODE}' AND b.j <> '{NODE}'),
z AS (SELECT * FROM one UNION ALL SELECT * FROM two),
sc AS (SELECT members, card, sum(z) / (count(*) * 24) + card * {PENALTY} AS score FROM z GROUP BY members, card)
"""


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("members", F.array_join("members", ","))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.scores(selection.residuals(grams(spark, sf_dir), NODE), 24, PENALTY)


@query(f"WITH {GRAM}, {CANDIDATES} SELECT array_to_string(members, ',') AS members, card, round(score, 6) + 0.0 AS score FROM sc")
def neighbour_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(scored(spark, sf_dir)).select("members", "card", six("score").alias("score"))


@query(f"WITH {GRAM}, {CANDIDATES} SELECT array_to_string(members, ',') AS members, card, round(score, 6) + 0.0 AS score FROM sc ORDER BY round(score, 9), card, members LIMIT 1")
def neighbour_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(selection.best(scored(spark, sf_dir), [])).select("members", "card", six("score").alias("score"))


@query(f"""
WITH {GRAM}, {CANDIDATES}, best AS (SELECT block, members, row_number() OVER (PARTITION BY block ORDER BY round(z / 24 + card * {PENALTY}, 9), card, members) AS r FROM z)
SELECT node, count(*) AS blocks FROM (SELECT block, unnest(members) AS node FROM best WHERE r = 1) GROUP BY node
""")
def naive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.naive_union(selection.residuals(grams(spark, sf_dir), NODE), 24, PENALTY)


CURVE = f"""
cv AS (SELECT 0 AS card, round(sum(g) / (count(*) * 24), 9) AS least FROM gr WHERE i = '{NODE}' AND j = '{NODE}'
  UNION ALL SELECT card, min(round(zz, 9)) FROM (SELECT members, card, sum(z) / (count(*) * 24) AS zz FROM z GROUP BY members, card) GROUP BY card)
"""


def curve(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = grams(spark, sf_dir)
    res = selection.residuals(g, NODE)
    return selection.subset_curve(res, g.where((F.col("i") == NODE) & (F.col("j") == NODE)), 24), res


@query(f"WITH {GRAM}, {CANDIDATES}, {CURVE} SELECT card, round(least, 6) + 0.0 AS least, round(least / (SELECT max(least) FROM cv), 6) + 0.0 AS share FROM cv")
def subset_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir)[0].select("card", six("least").alias("least"), six("share").alias("share"))


@query(f"""
WITH {GRAM}, {CANDIDATES}, {CURVE}, ct AS (SELECT len(list_filter(members, lambda m: m <> 'error')) AS card, min(round(zz, 9)) AS control
  FROM (SELECT members, card, sum(z) / (count(*) * 24) AS zz FROM z GROUP BY members, card) WHERE list_contains(members, 'error') GROUP BY 1)
SELECT CAST(a.card AS INTEGER) AS card, round(a.least - b.least, 6) + 0.0 AS gain, round((a.least - b.least) / nullif(a.least - control, 0), 6) + 0.0 AS ratio
FROM cv a JOIN cv b ON b.card = a.card + 1 JOIN ct ON ct.card = a.card
""")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type "error" serves as the control node."""
    points, res = curve(spark, sf_dir)
    held = selection.scores(res, 24).where(F.array_contains("members", "error"))
    control = held.groupBy((F.col("card") - 1).alias("card")).agg(F.min(F.round("score", 9)).alias("control"))
    return selection.significance(points, control).select("card", six("gain").alias("gain"), six("ratio").alias("ratio"))


STEP = "g{0} AS (SELECT x.i, x.j, x.g - l.g * r.g / d.g AS g FROM g{1} x JOIN o ON o.k = {0} JOIN g{1} l ON l.i = x.i AND l.j = o.n JOIN g{1} r ON r.i = o.n AND r.j = x.j JOIN g{1} d ON d.i = o.n AND d.j = o.n)"


@query(f"""
WITH {DIFFS}, g0 AS (SELECT a.series AS i, b.series AS j, sum(a.x * b.x) AS g FROM d a JOIN d b ON a.t = b.t GROUP BY 1, 2),
o AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT DISTINCT i AS n FROM g0 WHERE i <> '{NODE}')),
{', '.join(STEP.format(k, k - 1) for k in range(1, 5))}
SELECT (SELECT string_agg(n, ',' ORDER BY n) FROM o WHERE k <= 4) AS members, 4 AS card, round(g / 1000, 6) + 0.0 AS score FROM g4 WHERE i = '{NODE}' AND j = '{NODE}'
""")
def full_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node's residual on its four fellow series together, one block of all hours; the SQL eliminates them one after another."""
    whole_gram = selection.gram(series.difference(hours(spark, sf_dir), 24).withColumn("block", F.lit(0)))
    sets = selection.scores(selection.residuals(settled(whole_gram), NODE, 4), 1000).where("card = 4")
    return flat(sets).select("members", "card", six("score").alias("score"))


@query("SELECT array_to_string([a.k, b.k], ',') AS members, 2 AS card FROM (SELECT DISTINCT n_nationkey AS k FROM nation) a, (SELECT n_nationkey AS k FROM nation) b WHERE a.k < b.k UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 1 FROM nation UNION ALL SELECT array_to_string([a.n_nationkey, b.n_nationkey, c.n_nationkey], ','), 3 FROM nation a, nation b, nation c WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = selection.candidates(read(spark, sf_dir, "nation"), "n_nationkey", 3)
    return sets.select(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "card")


CHAIN_PRECISION = """
k AS (SELECT b.block, i.i, j.j, CASE WHEN i.i = j.j THEN 1.0 WHEN least(i.i, j.j) = b.block THEN 0.0 ELSE 0.3 END AS v
FROM (SELECT unnest(generate_series(1, 4)) AS block) b, (SELECT unnest(generate_series(1, 64)) AS i) i, (SELECT unnest(generate_series(1, 64)) AS j) j WHERE abs(i.i - j.j) <= 1),
r AS (SELECT k.i, k.j, sum(k.v * k.v / (d.v * d.v)) / 4 AS rho FROM k JOIN k d ON d.block = k.block AND d.i = k.i AND d.j = k.i WHERE k.i <> k.j GROUP BY 1, 2)
"""


@query(f"WITH {CHAIN_PRECISION} SELECT round(min(rho), 6) + 0.0 AS rho_min, round(min(rho) / 6, 6) + 0.0 AS penalty FROM r WHERE rho > 0")
def rho_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.least_strength(graphs.chain_precision(spark, 64, 0.9, 4)).select(six("rho_min").alias("rho_min"), six("penalty").alias("penalty"))


@query(f"WITH {CHAIN_PRECISION} SELECT i, j, round(rho, 6) + 0.0 AS rho FROM r")
def partial_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.partial_strength(graphs.chain_precision(spark, 64, 0.9, 4)).select("i", "j", six("rho").alias("rho"))


# Graphs ---------------------------------------------------------------------------------------------------------------------

UNIFORM = "((i * 7919 + j * 104729) % 1000003) / 1000003.0"
KNN = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
di AS (SELECT a.vec_id AS nid, b.vec_id AS other, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id),
rk AS (SELECT nid, other, d2, row_number() OVER (PARTITION BY nid ORDER BY d2, other) AS rank FROM di),
kn AS (SELECT DISTINCT least(nid, other) AS src, greatest(nid, other) AS dst, 1.0 AS w FROM rk WHERE rank <= 3),
en AS (SELECT src AS nid, dst AS other FROM kn UNION ALL SELECT dst, src FROM kn)
"""


def knn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = read(spark, sf_dir, "embeddings")
    nodes = vectors.select(F.col("vec_id").alias("nid"), F.col("label").cast("double").alias("label"), (F.col("vec_id") % 10 == 0).alias("is_labeled"))
    return nodes, graphs.symmetric(graphs.nearest(vectors, 3))


@query(f"WITH {KNN} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM kn")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir)[1]


@query(f"WITH {KNN} SELECT vec_id AS nid, CAST(count(other) AS BIGINT) AS degree, round(coalesce(1.0 / nullif(count(other), 0), 0), 6) + 0.0 AS gamma FROM embeddings LEFT JOIN en ON nid = vec_id GROUP BY vec_id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knn(spark, sf_dir)
    return graphs.degrees(nodes.select("nid"), edges).select("nid", "degree", six("gamma").alias("gamma"))


@query(f"WITH {KNN} SELECT nid AS i, nid AS j, CAST(count(*) AS DOUBLE) AS v FROM en GROUP BY nid UNION ALL SELECT nid, other, -1.0 FROM en")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knn(spark, sf_dir)
    return graphs.laplacian(nodes.select("nid"), edges)


@query(f"WITH {KNN}, d AS (SELECT a.label - b.label AS d FROM kn JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst) SELECT CAST(sum(abs(d)) AS DOUBLE) AS absolute, CAST(sum(d * d) AS DOUBLE) AS squared FROM d")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knn(spark, sf_dir)
    return graphs.total_variation(edges, nodes.withColumnRenamed("label", "x"))


@query(f"WITH {KNN} SELECT CAST(count(*) AS BIGINT) AS edges, CAST(greatest(1, coalesce(sum(w), 0)) AS DOUBLE) AS weight FROM kn JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label")
def cut_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knn(spark, sf_dir)
    return graphs.cut(edges, nodes.select("nid", F.col("label").alias("cluster")))


@query(f"WITH {KNN}, x AS (SELECT other, avg(label) AS mean FROM en JOIN embeddings ON vec_id = nid GROUP BY other) SELECT other AS nid, round(mean, 6) + 0.0 AS mean FROM x")
def neighbour_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knn(spark, sf_dir)
    return graphs.neighbour_average(edges, nodes, "label").select("nid", six("mean").alias("mean"))


POINTS = "pt AS (SELECT s_suppkey AS nid, ((s_suppkey * 7919) % 1000003) / 1000003.0 AS x, ((s_suppkey * 104729) % 1000003) / 1000003.0 AS y FROM supplier)"


def points(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("nid"), arrays.hash_uniform(key).alias("x"), arrays.hash_uniform(F.lit(0), key).alias("y"))


@query(f"WITH {POINTS} SELECT a.nid AS src, b.nid AS dst, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) + 0.0 AS d2 FROM pt a JOIN pt b ON a.nid < b.nid WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 0.01")
def radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.radius_graph(points(read(spark, sf_dir, "supplier"), "s_suppkey"), 0.1).select("src", "dst", six("d2").alias("d2"))


@query(f"WITH {POINTS}, cu AS (SELECT c_custkey AS cid, ((c_custkey * 7919 + 15485863) % 1000003) / 1000003.0 AS x, ((c_custkey * 104729 + 15485863) % 1000003) / 1000003.0 AS y FROM customer) SELECT cid, nid, round((cu.x - pt.x) * (cu.x - pt.x) + (cu.y - pt.y) * (cu.y - pt.y), 6) + 0.0 AS d2 FROM cu, pt WHERE (cu.x - pt.x) * (cu.x - pt.x) + (cu.y - pt.y) * (cu.y - pt.y) < 0.05 * 0.05")
def weather_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for observations and suppliers for stations."""
    stations = points(read(spark, sf_dir, "supplier"), "s_suppkey").select("nid", F.col("x").alias("lon"), F.col("y").alias("lat"))
    observed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), arrays.hash_uniform("c_custkey", seed=1).alias("lon"), arrays.hash_uniform(F.lit(0), "c_custkey", seed=1).alias("lat"))
    return graphs.match_within(observed, stations, 0.05, "cid", "nid").select("cid", "nid", six("d2").alias("d2"))


def _pairs(count: int, probability: str, extra: str = "") -> str:
    return f"SELECT i AS src, j AS dst{extra} FROM (SELECT unnest(generate_series(0, {count - 1})) AS i) a, (SELECT unnest(generate_series(0, {count - 1})) AS j) b WHERE i < j AND {UNIFORM} < {probability}"


@query(_pairs(100, "0.1"))
def er_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.erdos_renyi(spark, 100, probability=0.1).select("src", "dst")


SBM = _pairs(30, "CASE WHEN i // 10 = j // 10 THEN 0.6 ELSE 0.05 END", ", CAST(i // 10 AS INTEGER) AS c_src, CAST(j // 10 AS INTEGER) AS c_dst")


@query(SBM)
def sbm_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.block_model(spark, [10, 10, 10], 0.6, 0.05)[1].select("src", "dst", "c_src", "c_dst")


TWO = f"""
nd AS (SELECT unnest(generate_series(0, 199)) AS nid),
e0 AS ({_pairs(200, "CASE WHEN (i < 100) = (j < 100) THEN 0.03 ELSE 0.001 END")}),
al AS (SELECT nid FROM nd WHERE nid NOT IN (SELECT src FROM e0 UNION SELECT dst FROM e0)),
te AS (SELECT src, dst FROM e0 UNION ALL SELECT DISTINCT least(nid, CASE WHEN nid < 100 THEN 100 ELSE 99 END), greatest(nid, CASE WHEN nid < 100 THEN 100 ELSE 99 END) FROM al)
"""


@query(f"WITH {TWO} SELECT src, dst FROM te")
def two_cluster_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.two_clusters(spark, 100, 100, 3.0, 10.0)[1].select("src", "dst")


@query(f"WITH {TWO} SELECT nid FROM al")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.block_model(spark, [100, 100], 0.03, 0.001)
    return graphs.isolated(nodes, edges).select("nid")


@query("SELECT id AS eid, id AS src, id + 1 AS dst, CASE WHEN id = 5 THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM (SELECT unnest(generate_series(1, 9)) AS id)")
def chain_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.chain(spark, 10, weak_edge=5)


@query("SELECT r * 12 + c AS src, r * 12 + c + 1 AS dst FROM (SELECT unnest(generate_series(0, 11)) AS r) a, (SELECT unnest(generate_series(0, 10)) AS c) b UNION ALL SELECT r * 12 + c, r * 12 + c + 12 FROM (SELECT unnest(generate_series(0, 10)) AS r) a, (SELECT unnest(generate_series(0, 11)) AS c) b")
def grid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.grid(spark, 12, 12).select("src", "dst")


IMAGE = "px AS (SELECT r AS row, c AS col, CASE WHEN (r - 3) * (r - 3) + (c - 3) * (c - 3) < 8 THEN 200 WHEN (r - 8) * (r - 8) + (c - 8) * (c - 8) < 8 THEN 120 ELSE 30 END + (r * 7 + c * 3) % 5 AS val FROM (SELECT unnest(generate_series(0, 11)) AS r) a, (SELECT unnest(generate_series(0, 11)) AS c) b)"


def image(spark: SparkSession) -> DataFrame:
    """A 12 x 12 grey image with two discs."""
    r, c = F.floor(F.col("id") / 12).cast("int"), (F.col("id") % 12).cast("int")
    disc = lambda k: (r - k) * (r - k) + (c - k) * (c - k) < 8
    return spark.range(144).select(r.alias("row"), c.alias("col"), (F.when(disc(3), 200).when(disc(8), 120).otherwise(30) + (r * 7 + c * 3) % 5).alias("val"))


@query(f"WITH {IMAGE} SELECT a.row * 12 + a.col AS src, b.row * 12 + b.col AS dst, round(exp(-pow((a.val - b.val) / 20.0, 2)), 6) + 0.0 AS w FROM px a JOIN px b ON (a.row = b.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND a.col = b.col)")
def image_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.image_graph(image(spark)).select("src", "dst", six("w").alias("w"))


@query("WITH l AS (SELECT CAST(ceil(sqrt(max(p_partkey) + 1)) AS BIGINT) AS w FROM part), e AS (SELECT p_partkey // w AS r, p_partkey % w AS c, p_size AS val FROM part, l) SELECT CAST(r // 5 AS INTEGER) AS row, CAST(c // 5 AS INTEGER) AS col, val FROM e WHERE r % 5 = 0 AND c % 5 = 0 AND r < (SELECT max(r) FROM e) AND c < (SELECT max(c) FROM e)")
def pixel_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one square image, row by row in the order of their keys."""
    part = read(spark, sf_dir, "part")
    width = part.agg(F.ceil(F.sqrt(F.max("p_partkey") + 1)).alias("w"))  # one row
    laid = part.join(F.broadcast(width)).select(F.floor(F.col("p_partkey") / F.col("w")).alias("row"), (F.col("p_partkey") % F.col("w")).alias("col"), F.col("p_size").alias("val"))
    return tables.pixels(laid)


@query("""
SELECT a.nid, CAST(floor(((a.nid * 7919 + 7 * 104729) % 1000003) / 1000003.0 * 3) AS INTEGER) AS cluster,
  round(list_sum([CASE WHEN ((a.nid * 7919 + (k + 13) * 104729 + 2 * 15485863) % 1000003) / 1000003.0 < 0.5 THEN -1.0 ELSE 1.0 END
    * ((((CAST(floor(((a.nid * 7919 + 7 * 104729) % 1000003) / 1000003.0 * 3) AS BIGINT) + 1000) * 7919 + k * 104729 + 15485863) % 1000003) / 1000003.0) FOR k IN [0, 1]]), 6) + 0.0 AS label
FROM (SELECT unnest(generate_series(0, 99)) AS nid) a
""")
def attributed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.attributed_nodes(spark, 100, 3, 2)[0].select("nid", "cluster", six("label").alias("label"))


@query("""
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
m AS (SELECT label, k, avg(x) AS mean FROM v GROUP BY 1, 2)
SELECT v.label, round(sum((x - mean) * (x - mean)), 6) + 0.0 AS deviation FROM v JOIN m USING (label, k) GROUP BY v.label
""")
def squared_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return tabular.squared_deviation(vectors, "v", ["label"]).select("label", six("deviation").alias("deviation"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS running FROM orders")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return tabular.running_total(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", six("running").alias("running"))


# Learning -------------------------------------------------------------------------------------------------------------------


def _loop_sql(setup: str, rounds: int, problem: learning.Problem, out: str) -> str:
    """A recursive query over lists; setup gives n (pl, label, seed) and e (pl, a, b, w, y) with places from 1."""
    bound = f"{problem.bound!r} * ew[k]" if problem.weighted else repr(problem.bound)
    pulled = "lab[i]" if problem.seed == "clamp" else "(v[i] + gam[i] * lab[i]) / (1 + gam[i])"
    return f"""
WITH RECURSIVE {setup},
fixed AS MATERIALIZED (SELECT (SELECT list(CAST(label AS DOUBLE) ORDER BY pl) FROM n) AS lab, (SELECT list(seed ORDER BY pl) FROM n) AS sd,
  (SELECT list(a ORDER BY pl) FROM e) AS ea, (SELECT list(b ORDER BY pl) FROM e) AS eb, (SELECT list(CAST(w AS DOUBLE) ORDER BY pl) FROM e) AS ew, (SELECT list(CAST(y AS DOUBLE) ORDER BY pl) FROM e) AS y0,
  (SELECT list(c ORDER BY pl) FROM (SELECT n.pl, [x.k FOR x IN list(struct_pack(k := e.pl)) IF x.k IS NOT NULL] AS c FROM n LEFT JOIN e ON e.a = n.pl GROUP BY n.pl)) AS outs,
  (SELECT list(c ORDER BY pl) FROM (SELECT n.pl, [x.k FOR x IN list(struct_pack(k := e.pl)) IF x.k IS NOT NULL] AS c FROM n LEFT JOIN e ON e.b = n.pl GROUP BY n.pl)) AS ins),
start AS MATERIALIZED (SELECT *, list_transform(generate_series(1, len(lab)), lambda i: CASE WHEN len(outs[i]) + len(ins[i]) = 0 THEN 0.0 ELSE 1.0 / (len(outs[i]) + len(ins[i])) END) AS gam FROM fixed),
it AS (
  SELECT 0 AS k, list_transform(lab, lambda v: CAST(0 AS DOUBLE)) AS x, list_transform(lab, lambda v: CAST(0 AS DOUBLE)) AS p, list_transform(lab, lambda v: CAST(0 AS DOUBLE)) AS m, y0 AS y FROM start
  UNION ALL
  SELECT k, x, p, m, y FROM (
    SELECT k + 1 AS k, list_transform(generate_series(1, len(v)), lambda i: CASE WHEN sd[i] THEN {pulled} ELSE v[i] / (1 + {problem.shrink!r} * gam[i]) END) AS x, x AS p,
           list_transform(generate_series(1, len(v)), lambda i: (m[i] * k + CASE WHEN sd[i] THEN {pulled} ELSE v[i] / (1 + {problem.shrink!r} * gam[i]) END) / (k + 1)) AS m, y
    FROM (SELECT *, list_transform(generate_series(1, len(x)), lambda i: x[i] - {problem.primal!r} * gam[i] * (coalesce(list_sum(list_transform(outs[i], lambda q: y[q])), 0) - coalesce(list_sum(list_transform(ins[i], lambda q: y[q])), 0))) AS v
      FROM (SELECT it.k, it.x, it.p, it.m, list_transform(generate_series(1, len(it.y)), lambda k: greatest(-({bound}), least({bound}, it.y[k] + {problem.dual / 2!r} * ((2 * it.x[ea[k]] - it.p[ea[k]]) - (2 * it.x[eb[k]] - it.p[eb[k]]))))) AS y, start.* FROM it, start WHERE it.k < {rounds})))
)
{out}
"""


CHAIN_N = "n AS (SELECT pl, CASE WHEN pl <= 5 THEN 1.0 ELSE 0.0 END AS label, pl IN (2, 7) AS seed FROM (SELECT unnest(generate_series(1, 10)) AS pl)), e AS (SELECT pl, pl AS a, pl + 1 AS b, CASE WHEN pl = 5 THEN 0.25 ELSE 1.0 END AS w, pl / 9.0 AS y FROM (SELECT unnest(generate_series(1, 9)) AS pl))"


def chain_problem(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = graphs.node_range(spark, 10, 1).select("nid", F.when(F.col("nid") <= 5, 1.0).otherwise(0.0).alias("label"), F.col("nid").isin(2, 7).alias("is_labeled"))
    return nodes, graphs.chain(spark, 10, weak_edge=5).withColumn("y", F.col("eid") / 9.0)


@query(_loop_sql(CHAIN_N, 10, learning.FLOW_LASSO, "SELECT CAST(i AS BIGINT) AS nid, round(x[i], 6) + 0.0 AS x, round(m[i], 6) + 0.0 AS average FROM it, (SELECT unnest(generate_series(1, 10)) AS i) WHERE k = 10"))
def chain_nlasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = chain_problem(spark)
    return learning.loop(nodes, edges, learning.FLOW_LASSO, 10)[0].select("nid", six("x").alias("x"), six("average").alias("average"))


@query(_loop_sql(CHAIN_N, 10, learning.FLOW_LASSO, "SELECT CAST(i AS BIGINT) AS eid, round(y[i], 6) + 0.0 AS y FROM it, (SELECT unnest(generate_series(1, 9)) AS i) WHERE k = 10"))
def chain_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = chain_problem(spark)
    return learning.loop(nodes, edges, learning.FLOW_LASSO, 10)[1].select("eid", six("y").alias("y"))


LOCAL_N = "n AS (SELECT pl, 1.0 AS label, pl = 1 AS seed FROM (SELECT unnest(generate_series(1, 10)) AS pl)), e AS (SELECT pl, pl AS a, pl + 1 AS b, CASE WHEN pl = 2 THEN 1.0 ELSE 1.25 END AS w, 0.0 AS y FROM (SELECT unnest(generate_series(1, 9)) AS pl))"


@query(_loop_sql(LOCAL_N, 10, learning.local_clustering(1 / 3, 0.1), "SELECT CAST(i AS BIGINT) AS nid, round(m[i], 6) + 0.0 AS average FROM it, (SELECT unnest(generate_series(1, 10)) AS i) WHERE k = 10"))
def local_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.node_range(spark, 10, 1).select("nid", F.lit(1.0).alias("label"), (F.col("nid") == 1).alias("is_labeled"))
    edges = graphs.chain(spark, 10, weight=1.25, weak_edge=2, weak_weight=1.0)
    return learning.loop(nodes, edges, learning.local_clustering(1 / 3, 0.1), 10)[0].select("nid", six("average").alias("average"))


SBM_N = f"n AS (SELECT i + 1 AS pl, CASE WHEN i < 10 THEN 1.0 WHEN i < 20 THEN 2.0 ELSE 3.0 END AS label, i % 10 < 5 AS seed FROM (SELECT unnest(generate_series(0, 29)) AS i)), e AS (SELECT row_number() OVER (ORDER BY src, dst) AS pl, src + 1 AS a, dst + 1 AS b, 1.0 AS w, 0.0 AS y FROM ({SBM}))"


def sbm_problem(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graphs.block_model(spark, [10, 10, 10], 0.6, 0.05)
    return nodes.select("nid", (F.col("cluster") + 1.0).alias("label"), (F.col("nid") % 10 < 5).alias("is_labeled")), edges.select("src", "dst", "w")


@query(_loop_sql(SBM_N, 10, learning.BLOCK_MODEL_VARIANT, "SELECT CAST(i - 1 AS BIGINT) AS nid, round(m[i], 6) + 0.0 AS average FROM it, (SELECT unnest(generate_series(1, 30)) AS i) WHERE k = 10"))
def sparse_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.loop(*sbm_problem(spark), learning.BLOCK_MODEL_VARIANT, 10)[0].select("nid", six("average").alias("average"))


@query(_loop_sql(SBM_N, 200, learning.BLOCK_MODEL_VARIANT, "SELECT CAST(0 AS INTEGER) AS graph_id, CAST(i - 1 AS BIGINT) AS nid, round(m[i], 6) + 0.0 AS average FROM it, (SELECT unnest(generate_series(1, 30)) AS i) WHERE k = 200"))
def sparse_label_propagation_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = (x.withColumn("graph_id", F.lit(0)) for x in sbm_problem(spark))
    return learning.solve(nodes, edges, learning.BLOCK_MODEL_VARIANT, 200).select("graph_id", "nid", six("average").alias("average"))


@query(f"""
WITH RECURSIVE {KNN},
q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS pl, vec_id, CAST(label AS DOUBLE) AS label, vec_id % 10 = 0 AS seed FROM embeddings),
nb AS MATERIALIZED (SELECT list(c ORDER BY pl) AS near FROM (SELECT a.pl, list(b.pl) AS c FROM q a JOIN en ON en.nid = a.vec_id JOIN q b ON b.vec_id = en.other GROUP BY a.pl)),
fx AS MATERIALIZED (SELECT list(label ORDER BY pl) AS lab, list(seed ORDER BY pl) AS sd FROM q),
it AS (
  SELECT 0 AS k, list_transform(generate_series(1, len(lab)), lambda i: CASE WHEN sd[i] THEN lab[i] ELSE 0.0 END) AS x FROM fx
  UNION ALL
  SELECT k + 1, list_transform(generate_series(1, len(lab)), lambda i: CASE WHEN sd[i] THEN lab[i] ELSE list_avg(list_transform(near[i], lambda j: x[j])) END) FROM it, fx, nb WHERE k < 10)
SELECT vec_id AS nid, round(x[pl], 6) + 0.0 AS x FROM it, q WHERE k = 10
""")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = knn(spark, sf_dir)
    return learning.label_propagation(nodes, edges, 10).select("nid", six("x").alias("x"))


def user_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users with three block means of their values as features, a fourth as label, linked to their three nearest."""
    means = series.chunk_means(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 4)
    rows = means.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "mean"))).alias("m"))  # four entries
    users = settled(rows.select(F.lit(0).alias("graph_id"), F.col("user_id").alias("nid"), F.transform(F.slice("m", 1, 3), lambda s: s["mean"] / 100.0).alias("feature"), (F.element_at("m", 4)["mean"] / 100.0).alias("label"), (F.col("user_id") % 5 == 0).alias("is_labeled")))  # once, as the search reads them several times
    edges = graphs.symmetric(graphs.nearest(users, 3, "nid", "feature"))
    return users, edges.withColumn("graph_id", F.lit(0))


def converged(users: DataFrame, edges: DataFrame, problem: learning.Regression) -> DataFrame:
    """Until the duality gap is a thousandth of the loss of zero weights, ten times the surveyed scripts' 10,000 steps at most."""
    return partitioned.regression(users.drop("graph_id"), edges.drop("graph_id"), problem, 3, 100_000, 1e-3, parts=partitioned.Parts(alone=10_000), balanced=True, levelled=True)


def _regression(spark: SparkSession, sf_dir: str, problem: learning.Regression) -> DataFrame:
    users, edges = (settled(x) for x in user_graph(spark, sf_dir))
    out = converged(users, edges, problem).join(users.select("nid", "label", "is_labeled"), "nid")
    return out.select("nid", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), six("predicted").alias("predicted"), six("label").alias("label"), "is_labeled")


USERS = """
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
cm AS (SELECT user_id, (rn - 1) // (n // 4) AS chunk, sum(value) / (max(n) // 4) AS mean FROM r WHERE n >= 4 AND (rn - 1) // (n // 4) < 4 GROUP BY 1, 2),
u AS MATERIALIZED (SELECT user_id AS nid, max(mean) FILTER (chunk = 0) / 100.0 AS f0, max(mean) FILTER (chunk = 1) / 100.0 AS f1, max(mean) FILTER (chunk = 2) / 100.0 AS f2, max(mean) FILTER (chunk = 3) / 100.0 AS label, user_id % 5 = 0 AS seed FROM cm GROUP BY user_id),
rk AS (SELECT nid, other, row_number() OVER (PARTITION BY nid ORDER BY d2, other) AS rank FROM (SELECT a.nid, b.nid AS other, round((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2), 6) AS d2 FROM u a JOIN u b ON a.nid <> b.nid)),
kn AS MATERIALIZED (SELECT DISTINCT least(nid, other) AS src, greatest(nid, other) AS dst FROM rk WHERE rank <= 3),
dg AS (SELECT nid, 1.0 / count(*) AS gamma FROM (SELECT src AS nid FROM kn UNION ALL SELECT dst FROM kn) GROUP BY nid),
"""


def _regression_sql(problem: learning.Regression, rounds: int) -> str:
    """The rounds as one relation after another: s holds weights w, those before p and averages m of the nodes, y the flows."""
    each = lambda text: ", ".join(text.replace("#", str(d)) for d in range(3))
    dotted = lambda a, b: " + ".join(f"{a}{d} * {b}{d}" for d in range(3))
    along, size = dotted("f", "z"), f"greatest({dotted('f', 'f')}, 1e-300)"
    if problem.loss == "squared":
        move = f"(label - ({along})) / ({problem.variance!r}::DOUBLE * (SELECT count(*) FROM u WHERE seed) / (2.0 * greatest(gamma, 1e-300)) + {size})"
    else:
        move = f"(label + sign({along} - label) * greatest(abs({along} - label) - gamma * {size}, 0.0) - ({along})) / {size}"
    parts = ["s0 AS MATERIALIZED (SELECT u.*, coalesce(gamma, 0.0) AS gamma, " + each("0.0::DOUBLE AS w#, 0.0::DOUBLE AS p#, 0.0::DOUBLE AS m#") + " FROM u LEFT JOIN dg USING (nid))", "y0 AS MATERIALIZED (SELECT src, dst, " + each("0.0::DOUBLE AS y#") + " FROM kn)"]
    for k in range(1, rounds + 1):
        parts += [
            f"t{k} AS (SELECT src, dst, " + each(f"y# + {problem.dual / 2!r}::DOUBLE * ((2 * a.w# - a.p#) - (2 * b.w# - b.p#)) AS t#") + f" FROM y{k - 1} JOIN s{k - 1} a ON a.nid = src JOIN s{k - 1} b ON b.nid = dst)",
            f"y{k} AS MATERIALIZED (SELECT src, dst, " + each(f"t# * coalesce(least(1.0, {problem.bound!r}::DOUBLE / nullif(sqrt({dotted('t', 't')}), 0)), 1.0) AS y#") + f" FROM t{k})",
            f"d{k} AS (SELECT nid, " + each("sum(v#) AS d#") + " FROM (SELECT src AS nid, " + each("y# AS v#") + f" FROM y{k} UNION ALL SELECT dst, " + each("-y#") + f" FROM y{k}) GROUP BY nid)",
            f"z{k} AS (SELECT s.*, " + each(f"w# - {problem.primal!r}::DOUBLE * gamma * coalesce(d#, 0) AS z#") + f" FROM s{k - 1} s LEFT JOIN d{k} USING (nid))",
            f"c{k} AS (SELECT *, CASE WHEN seed THEN {move} ELSE 0.0 END AS c FROM z{k})",
            f"s{k} AS MATERIALIZED (SELECT nid, f0, f1, f2, label, seed, gamma, " + each(f"z# + f# * c AS w#, w# AS p#, (m# * {k - 1} + z# + f# * c) / {k} AS m#") + f" FROM c{k})",
        ]
    return "WITH " + USERS + ",\n".join(parts) + "\nSELECT nid, " + each("round(m#, 6) + 0.0 AS w#") + f", round({dotted('m', 'f')}, 6) + 0.0 AS predicted FROM s{rounds}"


def _regression_table(spark: SparkSession, sf_dir: str, problem: learning.Regression, rounds: int) -> DataFrame:
    users, edges = (settled(x.drop("graph_id")) for x in user_graph(spark, sf_dir))
    out = learning.loop_regression(users, edges, problem, rounds, 3)
    return out.select("nid", *[six(F.col("weights")[d]).alias(f"w{d}") for d in range(3)], six("predicted").alias("predicted"))


SQUARED = learning.Regression()
ABSOLUTE = learning.Regression("absolute", 1 / 7, 0.5, 0.5)


@query(_regression_sql(SQUARED, 4))
def nlasso_squared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds on tables; nlasso_squared runs to convergence on parts of the graph."""
    return _regression_table(spark, sf_dir, SQUARED, 4)


@query(_regression_sql(ABSOLUTE, 4))
def nlasso_absolute_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regression_table(spark, sf_dir, ABSOLUTE, 4)


@query()
def nlasso_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regression(spark, sf_dir, SQUARED)


@query()
def nlasso_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regression(spark, sf_dir, ABSOLUTE)


@query()
def prediction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative errors on unlabelled users: network lasso, and least absolute deviations on the labelled ones."""
    users, edges = (settled(x) for x in user_graph(spark, sf_dir))
    lasso = converged(users, edges, ABSOLUTE).join(users.where("NOT is_labeled").select("nid", "label"), "nid")
    weights = learning.least_absolute(users.where("is_labeled"), 3)
    plain = users.where("NOT is_labeled").select(arrays.dot("feature", F.array(*map(F.lit, weights))).alias("predicted"), "label")
    error = lambda df, name: df.agg(six(tabular.normalised_error(F.col("predicted"), F.col("label"))).alias(name))
    return error(lasso, "nlasso").join(F.broadcast(error(plain, "least_absolute")))  # a row each


# Networks -------------------------------------------------------------------------------------------------------------------


def small_graphs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Five two-cluster graphs of 40 nodes, seeded."""
    nodes = edges = None
    for k in range(5):
        n, e = graphs.two_clusters(spark, 20, 20, 6.0, 4.0 + 2 * k, seed=k)
        n, e = n.withColumn("graph_id", F.lit(k)), e.select("src", "dst", "w").withColumn("graph_id", F.lit(k))
        nodes, edges = (n, e) if nodes is None else (nodes.unionAll(n), edges.unionAll(e))
    return nodes, edges


@query()
def max_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow between the border seeds of each graph, and its ratio to the cut between the clusters."""

    def work(graph: int, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s, d = e["s"].to_numpy(), e["d"].to_numpy()
        crossing = (s < 20) != (d < 20)
        value, side = networks.max_flow(len(n), s, d, np.where(crossing, 3.0, 1.0) * e["w"].to_numpy(), 0, len(n) - 1)
        return pd.DataFrame({"graph_id": [graph], "flow": [value], "source_side": [int(side.sum())], "ratio": [round(value / max(1, int(crossing.sum())), 6)]})

    return networks.per_graph(*small_graphs(spark), work, "graph_id int, flow double, source_side long, ratio double")


@query()
def fiedler(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(graph: int, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        value, vector = networks.fiedler(len(n), e["s"].to_numpy(), e["d"].to_numpy(), e["w"].to_numpy())
        return pd.DataFrame({"graph_id": graph, "nid": n["nid"], "fiedler": round(value, 6), "entry": vector.round(6)})

    return networks.per_graph(*small_graphs(spark), work, "graph_id int, nid long, fiedler double, entry double")


@query()
def gtvmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(graph: int, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = experiments.rng(3, graph)
        x = g.choice([-1.0, 1.0], (len(n), 2))
        y = x @ np.array([0.5, -0.25]) + 0.1 * g.standard_normal(len(n))
        _, _, w = networks.smooth_model(e["s"].to_numpy(), e["d"].to_numpy(), e["w"].to_numpy(), x, y, 10.0)
        return pd.DataFrame({"graph_id": graph, "nid": n["nid"], "weights": list(w.round(6))})

    return networks.per_graph(*small_graphs(spark), work, "graph_id int, nid long, weights array<double>")


@query()
def local_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members found from node 0 by pushed rank, capacity-releasing diffusion and flow improvement, with their conductance."""

    def work(graph: int, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s, d, w = (e[c].to_numpy() for c in ("s", "d", "w"))
        near = networks.adjacency(len(n), s, d, w)
        rank = networks.sweep_cut(near, networks.local_rank(near, [0]))
        release = networks.sweep_cut(near, networks.release_diffusion(near, [0]))
        improved = networks.flow_improved(len(n), s, d, w, rank[0])
        rows = [(graph, m, c, round(x, 6)) for m, (c, x) in (("rank", rank), ("release", release), ("improved", improved))]
        return pd.DataFrame(rows, columns=["graph_id", "method", "members", "conductance"])

    return networks.per_graph(*small_graphs(spark), work, "graph_id int, method string, members array<long>, conductance double")


# Large graphs: the same questions on tables, without a task that holds a graph ------------------------------------------------


def neighbour_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of nearest vectors, made once."""
    nodes, edges = knn(spark, sf_dir)
    return settled(nodes), settled(edges)


@query()
def knn_fiedler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second eigenpair of the Laplacian of the graph of nearest vectors."""
    nodes, edges = neighbour_graph(spark, sf_dir)
    told = solvers.Solved()
    entry = solvers.fiedler(nodes.select("nid"), edges, tolerance=1e-4, told=told)
    return entry.select("nid", F.lit(told.value).alias("fiedler"), "entry")


@query()
def knn_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community of the first vector: pushed rank from it, and the prefix with the least conductance."""
    nodes, edges = neighbour_graph(spark, sf_dir)
    arcs = diffusion.weighted_ends(edges)
    rank = diffusion.pushed_rank(arcs, nodes.orderBy("nid").limit(1).select("nid"), error=1e-3)
    members, conductance = diffusion.sweep_cut(arcs, rank)
    return rank.join(members.withColumn("member", F.lit(True)), "nid", "left").select("nid", "score", F.coalesce("member", F.lit(False)).alias("member"), F.lit(conductance).alias("conductance"))


@query()
def smooth_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all users that fit the labelled ones' labels and vary little along the edges."""
    users, edges = (settled(x.drop("graph_id")) for x in user_graph(spark, sf_dir))
    known = users.select("nid", "feature", F.when(F.col("is_labeled"), F.col("label")).alias("label"))
    weights = solvers.smooth_model(known, edges, 0.1, 3, most=10_000, tolerance=1e-6)  # 500 steps don't do for 90,000 users
    return weights.join(users.select("nid", "feature"), "nid").select("nid", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), six(arrays.dot("weights", "feature")).alias("predicted"))


# Model kernels and experiments ----------------------------------------------------------------------------------------------


def dealt(df: DataFrame) -> DataFrame:
    """A copy of a model's matrix for each of a fixed number of tasks; each solves the columns whose place falls to it."""
    return df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(df.sparkSession.sparkContext.defaultParallelism - 1))))


@query()
def group_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' coefficients on the others, grouped over the days, from Gram blocks: the series are dealt to the tasks."""
    shares = spark.sparkContext.defaultParallelism

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(pdf["i"].unique())
        at = {n: k for k, n in enumerate(nodes)}
        blocks = {b: k for k, b in enumerate(sorted(pdf["block"].unique()))}
        m = np.zeros((len(blocks), len(nodes), len(nodes)))
        m[pdf["block"].map(blocks), pdf["i"].map(at), pdf["j"].map(at)] = pdf["g"]
        rows = []
        for t in range(int(key[0]), len(nodes), shares):
            others = [k for k in range(len(nodes)) if k != t]
            z = regression.group_lasso(m[:, others][:, :, others], m[:, others, t], 20.0)
            rows += [(nodes[t], nodes[k], float(s)) for k, s in zip(others, (z**2).sum(axis=0).round(6), strict=True)]
        return pd.DataFrame(rows, columns=["target", "node", "strength"])

    return dealt(grams(spark, sf_dir)).groupBy("share").applyInPandas(work, "target string, node string, strength double")


@query()
def clime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse precision columns of the hourly counts' correlation: the columns are dealt to the tasks."""
    shares = spark.sparkContext.defaultParallelism

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1)
        scale = np.sqrt(np.diag(m.to_numpy()))
        corr = m.to_numpy() / np.outer(scale, scale)
        rows = [(m.index[c], m.index[r], round(float(v), 4)) for c in range(int(key[0]), len(m), shares) for r, v in enumerate(regression.constrained_column(corr, c, 0.1))]
        return pd.DataFrame(rows, columns=["target", "node", "beta"])

    return dealt(settled(selection.covariance(hours(spark, sf_dir)))).groupBy("share").applyInPandas(work, "target string, node string, beta double")


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type AS series, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2
""")
def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream: hourly windows as they close, two hours behind the latest event, written to a table. The last hours stay open."""
    schema = read(spark, sf_dir, "events").schema
    folder = f"{shared_dir(spark)}/hourly-{uuid.uuid4().hex}"
    # a pattern, as a stream takes a plain path for a directory and the table may be one file
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = streams.hourly(events).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    running = windows.writeStream.format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{folder}/windows").select("hour", "series", "n", six("total").alias("total"))


@query()
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best neighbourhood of every size, up to all nine others, of each kind of event of users with even and odd ids."""
    kinds = read(spark, sf_dir, "events").withColumn("kind", F.concat_ws("/", "event_type", (F.col("user_id") % 2).cast("string")))
    hourly = series.hourly_counts(kinds, kind="kind")
    blocks = settled(selection.gram(series.centred(series.blocked(series.difference(hourly, 24), 24))))
    return subsets.best_subsets(blocks, 9).select("target", "card", "members", six("energy").alias("energy"))


@query()
def clime_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of each day's sparse precision columns over the penalties down to a tenth."""
    return precision.constrained_paths(grams(spark, sf_dir), 0.1)


@query()
def clime_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of series joined in some day's precision at a penalty of 0.2, and in how many days."""
    paths = settled(precision.constrained_paths(grams(spark, sf_dir), 0.1))
    return precision.united_edges(precision.columns_at(paths, 0.2))


@query()
def events_spectral_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly pairs of series hang together over all frequencies, others given: from the events' own smoothed spectrum."""
    pairs, frequencies = spectrum(spark, sf_dir)
    smooth = series.smoothed_spectrum(pairs, [1.0, 2.0, 3.0, 2.0, 1.0], frequencies, 8)
    return precision.spectral_strengths(precision.spectral_lasso(precision.unit_power(smooth), 0.1, width=512)).select("i", "j", six("strength").alias("strength"))


@query()
def spectral_glasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.spectral_rates(spark, [0.1, 1.0, 10.0], 4).select("penalty", six("detection").alias("detection"), six("false_alarms").alias("false_alarms"), six("success").alias("success"))


@query()
def mc_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.selection_errors(spark, [(16, 1.0)], [10, 50, 100], 10, ("exhaustive", "naive", "group_lasso", "constrained")).select("method", "p", "length", "samples", six("scaled").alias("scaled"), six("error").alias("error"))


@query()
def propagation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.propagation_rates(spark, [4.0, 20.0], 3, rounds=300)


@query()
def block_model_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.block_model_rates(spark, 0.8, [0.05, 0.2, 1.5], 4, rounds=300)


@query()
def partial_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.partial_label_rates(spark, [0.1, 0.3], [0.01, 0.1], 3, rounds=300)


@query()
def sampled_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in long form, through the Gram blocks and the column expressions: the best neighbours of node 1."""
    samples = experiments.sample_table(spark, 8, 1.2, 4, 200, 1).where("run = 0")
    scored = selection.scores(selection.residuals(selection.gram(samples, "node"), 1), 200, 0.02)
    return selection.best(scored, []).select(F.transform("members", lambda m: m.cast("string")).alias("members"), "card", six("score").alias("score"))


@query()
def clustering_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.clustering_bounds(spark, 60, [200, 400, 800])


@query("SELECT CAST(i % 3 AS INTEGER) AS penalty, count(*) FILTER (i % 5 = 0 AND i % 7 < 5) AS hits, count(*) FILTER (i % 5 <> 0 AND i % 7 < 5) AS false_alarms, count(*) FILTER (i % 5 = 0 AND i % 7 >= 5) AS misses, false AS success FROM (SELECT unnest(generate_series(0, 999)) AS i) GROUP BY 1")
def roc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.range(1000).select((F.col("id") % 3).cast("int").alias("penalty"), (F.col("id") % 5 == 0).alias("truth"), (F.col("id") % 7 < 5).alias("found"))
    return tabular.detection_counts(found, "truth", "found", ["penalty"])


@query("SELECT p, n AS samples, round(n * f * f / ln(p), 6) + 0.0 AS scaled FROM (VALUES (64, 1.0), (128, 0.9), (256, 0.8), (512, 1.2)) v(p, f), (SELECT unnest(generate_series(40, 400, 40)) AS n)")
def scaled_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(64, 1.0), (128, 0.9), (256, 0.8), (512, 1.2)], "p int, f double").withColumn("samples", F.explode(F.sequence(F.lit(40).cast("long"), F.lit(400).cast("long"), F.lit(40).cast("long"))))
    return grid.select("p", "samples", six(series.scaled_size(F.col("samples"), F.col("f"), F.col("p"))).alias("scaled"))


REPLY = """<wfs:FeatureCollection xmlns:wfs="w" xmlns:om="o" xmlns:gmlcov="c" xmlns:gml="g" xmlns:xlink="x">
<om:observedProperty xlink:href="http://example.com/meta?observableProperty=observation&amp;param=temp,wind&amp;language=eng"/>
<gmlcov:positions> 60.1 24.9 1300000000
 60.1 24.9 1300003600
 61.5 23.7 1300000000
 61.5 23.7 1300003600 </gmlcov:positions>
<gml:doubleOrNilReasonTupleList> 1.5 3.0
 2.5 NaN
 -1.0 4.5
 0.5 2.0 </gml:doubleOrNilReasonTupleList></wfs:FeatureCollection>"""


@query("SELECT CAST('a' AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS pos, lat, lon, CAST(epoch AS BIGINT) AS epoch, param, CAST(value AS DOUBLE) AS value FROM (VALUES (0, 60.1::DOUBLE, 24.9::DOUBLE, 1300000000, 'temp', 1.5), (0, 60.1, 24.9, 1300000000, 'wind', 3.0), (1, 60.1, 24.9, 1300003600, 'temp', 2.5), (1, 60.1, 24.9, 1300003600, 'wind', NULL), (2, 61.5, 23.7, 1300000000, 'temp', -1.0), (2, 61.5, 23.7, 1300000000, 'wind', 4.5), (3, 61.5, 23.7, 1300003600, 'temp', 0.5), (3, 61.5, 23.7, 1300003600, 'wind', 2.0)) v(pos, lat, lon, epoch, param, value)")
def coverage_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.observations(spark.createDataFrame([("a", REPLY)], "doc_id string, xml string"))
