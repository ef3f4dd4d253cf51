"""Registered queries of the components that the other queries don't reach: vector functions, sinks read back, small generators and
error measures, each with its SQL. Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.functions import arrays
from graphloom.operators import graphs, learning, series, tabular
from graphloom.plans import experiments
from graphloom.plans.state import shared_dir
from graphloom.queries import HOURLY, IMAGE, hours, image, read, six
from graphloom.sources import tables

TWO_PI = "6.283185307179586"


def _hash_sql(i: str, j: str, seed: int = 0) -> str:
    return f"((({i}) * 7919 + ({j}) * 104729 + {seed * 15485863}) % 1000003) / 1000003.0"


def _normal_sql(i: str, j: str, seed: int = 0) -> str:
    return f"sqrt(-2.0 * ln(1.0 - {_hash_sql(i, j, 2 * seed)})) * cos({TWO_PI} * {_hash_sql(j, i, 2 * seed + 1)})"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Functions ------------------------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v)
SELECT vec_id, round(l, 6) + 0.0 AS length, round(sign(e[1]) * greatest(abs(e[1]) - 0.05, 0.0), 6) + 0.0 AS soft,
  round(e[3] * coalesce(greatest(1.0 - 0.5 / nullif(l, 0), 0.0), 0.0), 6) + 0.0 AS shortened, round(e[3] * coalesce(least(1.0, 0.5 / nullif(l, 0)), 1.0), 6) + 0.0 AS inside,
  round(greatest(-0.1, least(0.1, e[2])), 6) + 0.0 AS boxed, round(e[2] * e[3], 6) + 0.0 AS product, round(e[1] + 2.0 * e[1], 6) + 0.0 AS added FROM n
""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms, thresholds, clips, outer products and sums of the vectors."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    third = lambda c: F.element_at(c, 3)
    product = F.element_at(F.element_at(arrays.outer("e", "e"), 2), 3)
    return v.select(
        "vec_id",
        six(arrays.norm("e")).alias("length"),
        six(arrays.soft_threshold(F.element_at("e", 1), 0.05)).alias("soft"),
        six(third(arrays.group_soft_threshold("e", 0.5))).alias("shortened"),
        six(third(arrays.ball_clip("e", 0.5))).alias("inside"),
        six(arrays.box_clip(F.element_at("e", 2), 0.1)).alias("boxed"),
        six(product).alias("product"),
        six(F.element_at(arrays.added("e", arrays.scaled("e", 2.0)), 1)).alias("added"),
    )


@query("""
SELECT c_custkey, CASE WHEN abs(c_acctbal) < 100 THEN 0.0 ELSE c_acctbal END AS floored, CASE WHEN c_acctbal < 100 THEN 0.0 ELSE c_acctbal END AS positive,
  CAST(c_acctbal > 5000 AS INTEGER) AS high FROM customer
""")
def floored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise floor, by magnitude and as the surveyed scripts have it, and the binary threshold."""
    balance = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", arrays.noise_floor(balance, 100.0).alias("floored"), arrays.noise_floor(balance, 100.0, keep_negative=False).alias("positive"), arrays.binary(balance, 5000.0).alias("high"))


@query("SELECT CAST(k AS INTEGER) AS k, round(0.5 + k * (9.5 / 19), 6) + 0.0 AS value, round(1.0 / (0.5 + k * (9.5 / 19)), 6) + 0.0 AS inverse FROM (SELECT unnest(generate_series(0, 19)) AS k)")
def even_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(1).select(F.posexplode(arrays.linspace(0.5, 10.0, 20)).alias("k", "v"))
    return steps.select("k", six("v").alias("value"), six(1.0 / F.col("v")).alias("inverse"))


# Projections ----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {HOURLY}, st AS (SELECT DISTINCT t FROM s)
SELECT series, t, x FROM s UNION ALL SELECT 'noise' || k, t, round({_normal_sql('t', 'k')}, 6) + 0.0 FROM st, (SELECT unnest([1, 2]) AS k)
""")
def noisy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_noise(hours(spark, sf_dir), 2, 1.0).select("series", "t", six("x").alias("x"))


@query("SELECT c_custkey, c_nationkey AS nation, CAST(c_acctbal AS DOUBLE) AS balance FROM customer WHERE c_nationkey <> 3 AND c_acctbal >= 0")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 3 is made null and debts are made NaN; rows that lack a value go."""
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    holes = read(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), balance.alias("balance"))
    return tabular.without_missing(holes)


@query(f"WITH {IMAGE} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, row BETWEEN 2 AND 5 AND col BETWEEN 1 AND 4 AS is_labeled FROM px WHERE val > 100")
def seed_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bright pixels of the two-disc image, those in a rectangle as seeds."""
    return tables.level_set(tables.rectangle(image(spark), (2, 5), (1, 4)), "val", 100).select("row", F.col("col").cast("int").alias("col"), "is_labeled")


@query("""
SELECT a.kind, CAST(a.node AS BIGINT) AS node, CAST(b.node AS BIGINT) AS other FROM (SELECT unnest(['chain', 'grid']) AS kind, 1 AS one) k
JOIN (SELECT 'chain' AS kind, unnest(generate_series(1, 16)) AS node UNION ALL SELECT 'grid', unnest(generate_series(1, 16))) a ON a.kind = k.kind
JOIN (SELECT unnest(generate_series(1, 16)) AS node) b ON (a.kind = 'chain' AND abs(a.node - b.node) = 1)
  OR (a.kind = 'grid' AND abs((a.node - 1) // 4 - (b.node - 1) // 4) + abs((a.node - 1) % 4 - (b.node - 1) % 4) = 1)
""")
def true_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each node of a chain and of a square grid of 16 nodes."""
    rows = [(kind, node, other) for kind in ("chain", "grid") for node in range(1, 17) for other in graphs.neighbourhood(kind, node, 16)]
    return spark.createDataFrame(rows, "kind string, node long, other long")


# Generators -----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH h AS (SELECT j FROM (SELECT unnest(generate_series(2, 32)) AS j) ORDER BY {_hash_sql('j', '0', 3)}, j LIMIT 5)
SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS j, CAST(0.5 AS DOUBLE) AS v FROM (SELECT unnest(generate_series(1, 32)) AS i) UNION ALL SELECT 1, j, 0.08 FROM h UNION ALL SELECT j, 1, 0.08 FROM h
""")
def star_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.star_precision(spark, 32, 5, 0.4, 3).select("i", "j", six("v").alias("v"))


@query("""
WITH b AS (SELECT unnest(generate_series(0, 3)) AS block), n AS (SELECT unnest(generate_series(0, 7)) AS i)
SELECT CAST(block AS INTEGER) AS block, CAST(n.i AS INTEGER) AS i, CAST(m.i AS INTEGER) AS j,
  round((1 + block / 4.0) * 1.1 / (1 - 0.6 * cos(pi() / 9)) * CASE WHEN n.i = m.i THEN 1.0 ELSE 0.3 END, 6) + 0.0 AS v FROM b, n, n m WHERE abs(n.i - m.i) <= 1
""")
def scaled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four growing covariances of eight nodes with 0.3 beside the diagonal, whose least eigenvalue is known in closed form."""
    blocks = experiments.scaled_covariances(0.3 * (np.eye(8, k=1) + np.eye(8, k=-1)) + np.eye(8), 4, 2.0)
    rows = [(b, i, j, float(blocks[b, i, j])) for b in range(4) for i in range(8) for j in range(max(0, i - 1), min(8, i + 2))]
    return spark.createDataFrame(rows, "block int, i int, j int, v double").withColumn("v", six("v"))


@query("""
WITH n AS (SELECT unnest(generate_series(0, 15)) AS i)
SELECT g.graph, CAST(n.i AS INTEGER) AS i, CAST(m.i AS INTEGER) AS j, round(1.0 / 3 + CASE WHEN n.i = m.i THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS v
FROM (SELECT unnest(['chain', 'grid']) AS graph) g, n, n m
WHERE CASE WHEN g.graph = 'chain' THEN abs(n.i - m.i) <= 1 ELSE abs(n.i // 4 - m.i // 4) + abs(n.i % 4 - m.i % 4) <= 1 END
""")
def masked_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(kind, i, j, float(v)) for kind in ("chain", "grid") for (i, j), v in np.ndenumerate(experiments.masked_precision(16, kind)) if v]
    return spark.createDataFrame(rows, "graph string, i int, j int, v double").withColumn("v", six("v"))


GEOMETRIC = f"""
nd AS (SELECT nid, CAST(nid >= 60 AS INTEGER) AS cluster, {_hash_sql('nid', '0')} + CAST(nid >= 60 AS INTEGER) * 1.0 AS x, {_hash_sql('0', 'nid')} AS y FROM (SELECT unnest(generate_series(0, 119)) AS nid))
"""


@query(f"WITH {GEOMETRIC} SELECT a.nid AS src, b.nid AS dst FROM nd a JOIN nd b ON a.nid < b.nid AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) < 0.2 * 0.2")
def geometric_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.geometric_clusters(spark, 60, 60, 0.2)[1].select("src", "dst")


@query(f"WITH {GEOMETRIC} SELECT (SELECT nid FROM nd WHERE cluster = 0 ORDER BY x, nid LIMIT 1) AS leftmost, (SELECT nid FROM nd WHERE cluster = 1 ORDER BY x DESC, nid DESC LIMIT 1) AS rightmost")
def geometric_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.geometric_clusters(spark, 60, 60, 0.2)[2]


@query(f"""
WITH nd AS (SELECT nid, {_normal_sql('nid', '1')} AS a, {_normal_sql('nid', '2')} AS b FROM (SELECT unnest(generate_series(1, 100)) AS nid)),
u AS (SELECT nid, a / sqrt(a * a + b * b) AS a, b / sqrt(a * a + b * b) AS b FROM nd)
SELECT nid, round(a, 6) + 0.0 AS first, round(b, 6) + 0.0 AS second, round((a + b) / sqrt(2) * CASE WHEN nid % 2 = 0 THEN 1 ELSE -1 END, 6) + 0.0 AS label FROM u
""")
def unit_feature_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.unit_features(graphs.node_range(spark, 100, 1).withColumn("cluster", (F.col("nid") % 2).cast("int")), 2, 1.0)
    return nodes.select("nid", six(F.element_at("feature", 1)).alias("first"), six(F.element_at("feature", 2)).alias("second"), six("label").alias("label"))


# Measures -------------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, list_sort(list_distinct([n_nationkey % 3, n_regionkey])) = list_sort(list_distinct([n_regionkey, n_nationkey % 4, n_regionkey])) AS same FROM nation")
def same_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    sets = read(spark, sf_dir, "nation").select("n_nationkey", F.array(key % 3, region).alias("a"), F.array(region, key % 4, region).alias("b"))
    return sets.select("n_nationkey", tabular.same_set("a", "b").alias("same"))


@query("""
SELECT c_mktsegment, round(sum(pow(c_acctbal / 1000 - c_nationkey, 2)), 6) + 0.0 AS error, round(sum(pow(c_acctbal / 1000 - c_nationkey, 2)) / nullif(sum(pow(c_nationkey, 2)), 0), 6) + 0.0 AS relative
FROM customer GROUP BY c_mktsegment
""")
def squared_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimate, truth = F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(six(tabular.squared_error(estimate, truth)).alias("error"), six(tabular.normalised_error(estimate, truth)).alias("relative"))


@query("SELECT round(count(*) FILTER (abs(c_acctbal / 1000 - c_nationkey) < 0.5) / count(*), 6) + 0.0 AS accuracy FROM customer WHERE c_custkey % 10 <> 0")
def half_unit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("estimate"), F.col("c_nationkey").alias("truth"), (F.col("c_custkey") % 10 == 0).alias("labelled"))
    return tabular.half_unit_accuracy(rows, "estimate", "truth", "labelled").select(six("accuracy").alias("accuracy"))


@query("SELECT o_orderpriority, round(avg(CAST(o_totalprice > 100000 AS INTEGER)), 6) + 0.0 AS rate FROM orders GROUP BY o_orderpriority")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") > 100000).alias("found"))
    return experiments.success_rate(runs, ["o_orderpriority"]).select("o_orderpriority", six("rate").alias("rate"))


@query("""
WITH e AS (SELECT k AS src, k + 1 AS dst, (k * k) % 7 - ((k + 1) * (k + 1)) % 7 AS dx FROM (SELECT unnest(generate_series(1, 9)) AS k))
SELECT CAST(sum(abs(dx)) AS DOUBLE) AS variation, round(18 / (2.0 * 50) + sum(2.0 * pow(0.5 - sign(dx), 2)), 6) + 0.0 AS bound FROM e
""")
def flow_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duality gap's two sides for a fixed signal and a flow of one half on a chain, after 50 rounds."""
    nodes, edges = graphs.node_range(spark, 10, 1), graphs.chain(spark, 10)
    average = nodes.select("nid", ((F.col("nid") * F.col("nid")) % 7).cast("double").alias("average"))
    gap = learning.optimality_gap(average, edges, nodes, edges, 50, edges.select("src", "dst", F.lit(0.5).alias("d")))
    return gap.select("variation", six("bound").alias("bound"))


@query("""
SELECT CAST(k AS INTEGER) AS k, round(1.0 - k / 10.0 * 0.25, 6) + 0.0 AS first, round(k / 10.0 * 0.25, 6) + 0.0 AS second, round(2 * pow(k / 10.0 * 0.25, 2), 6) + 0.0 AS error
FROM (SELECT unnest(generate_series(1, 10)) AS k)
""")
def chain_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact two-cluster solution and its error for ten bounds of the flow."""
    rows = [(k, *map(float, learning.chain_reference(1.0, 0.0, k / 10, 0.25))) for k in range(1, 11)]
    table = spark.createDataFrame(rows, "k int, first double, second double, error double")
    return table.select("k", *[six(c).alias(c) for c in ("first", "second", "error")])


# Sinks, read back -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a CSV sink and the typed source."""
    folder = _folder(spark, "customers")
    tables.write_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), folder)
    return tables.read_csv(spark, folder, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", ["c_custkey", "c_name", "c_acctbal"])


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer")
def positional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and fifth columns of a file by their places."""
    folder = _folder(spark, "positional")
    tables.write_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"), folder)
    return tables.read_positional(spark, folder, {1: ("id", "long"), 5: ("value", "double")})


@query("""
SELECT c_name AS applicant, CAST(c_custkey * 1000 + c_nationkey AS DOUBLE) AS funding FROM customer
""")
def funding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with a point after every three digits, in a folder of semicolon-separated files."""
    folder = _folder(spark, "funding")
    amount = F.regexp_replace(F.format_number(F.col("c_custkey") * 1000 + F.col("c_nationkey"), 0), ",", ".")
    tables.write_csv(read(spark, sf_dir, "customer").select(F.col("c_name").alias("Applicant / Contact person"), amount.alias("Funding")), folder, sep=";")
    return tables.read_funding(spark, folder)


@query("SELECT vec_id, label FROM embeddings")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a table that is partitioned by label."""
    folder = _folder(spark, "labels")
    tables.write_partitioned(read(spark, sf_dir, "embeddings").select("vec_id", "label"), folder, ["label"])
    return spark.read.parquet(folder).select("vec_id", F.col("label").cast("int").alias("label"))


@query(f"WITH {HOURLY} SELECT t, max(x) FILTER (series = 'click') AS click, max(x) FILTER (series = 'view') AS view, max(x) FILTER (series = 'purchase') AS purchase FROM s GROUP BY t")
def wide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.wide_table(hours(spark, sf_dir), "t", "series", "x", ["click", "view", "purchase"])


@query(f"WITH {HOURLY} SELECT series, t, printf('%2.3e', x) AS x FROM s")
def formatted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.formatted(hours(spark, sf_dir)).select("series", "t", "x")
