"""Sources, sinks, functions, loops, experiments and streams on small frames."""

import math
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import arrays
from graphloom.operators import graphs, learning, selection, series, tabular
from graphloom.plans import experiments, joins
from graphloom.queries import REPLY
from graphloom.sources import observations, tables
from graphloom.streaming import events as streams


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<double>, b array<double>")
    one = lambda c: df.select(c.alias("c")).first().c
    assert one(arrays.dot("a", "b")) == 11 and one(arrays.norm("a")) == 5 and one(arrays.squared_distance("a", "b")) == 8
    assert one(arrays.outer("a", "b")) == [[3, 6], [4, 8]] and one(arrays.added("a", "b")) == [4, 6]
    assert one(arrays.group_soft_threshold("a", 2.5)) == [1.5, 2.0] and one(arrays.group_soft_threshold("a", 9.0)) == [0, 0]
    assert one(arrays.ball_clip("a", 1.0)) == pytest.approx([0.6, 0.8]) and one(arrays.ball_clip("a", 9.0)) == [3, 4]
    assert one(arrays.soft_threshold(F.lit(-3.0), 1.0)) == -2 and one(arrays.box_clip(F.lit(-3.0), 1.0)) == -1
    assert one(arrays.noise_floor(F.lit(-5.0))) == -5 and one(arrays.noise_floor(F.lit(-5.0), keep_negative=False)) == 0
    assert one(arrays.linspace(0.0, 1.0, 5)) == [0, 0.25, 0.5, 0.75, 1] and one(arrays.binary(F.lit(0.2))) == 1
    x = spark.range(2000).select(arrays.hash_normal("id", F.lit(3)).alias("x")).toPandas()["x"]
    assert abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "x int, y double")
    path = str(tmp_path / tables.result_path("", "Raw", datetime(2020, 1, 1, tzinfo=UTC), p=1, task=0).lstrip("/"))
    assert path.endswith("Raw_p01_task00_20200101T000000")
    tables.write_csv(df, path, one_file=True)
    assert sorted(map(tuple, tables.read_csv(spark, path, "x int, y double").collect())) == [(1, 2.5), (2, None)]
    assert sorted(map(tuple, tables.read_positional(spark, path, {2: ("v", "double")}).collect()), key=str) == [(2.5,), (None,)]
    tables.write_partitioned(df, str(tmp_path / "parts"), ["x"])
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    bad = tmp_path / "bad.csv"
    bad.write_text("x,y\n1,a\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|parse"):
        tables.read_csv(spark, str(bad), "x int, y double").collect()


def test_funding_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Other;Applicant / Contact person;Funding\nx;Ann;1.234.567\nx;;5\n")
    (tmp_path / "b.csv").write_text("Applicant / Contact person;Funding\nAnn;3\nBo;10\n")
    (tmp_path / "c.txt").write_text("no;table\n")
    rows = tables.read_funding(spark, str(tmp_path / "a.csv")).unionByName(tables.read_funding(spark, str(tmp_path / "b.csv")))
    assert [tuple(r) for r in tabular.ranked_totals(rows, "applicant", "funding").orderBy("rank").collect()] == [("Ann", 1234570.0, 1), ("Bo", 10.0, 2)]


def test_observation_files(spark, tmp_path):
    fields = ["60.1", "24.9", "1300000000"] + ["1.5"] * 6 + ["a", "b", "c"] + ["", "NaN", "2", "3"]
    (tmp_path / "obs.csv").write_text(";".join(tables.OBSERVATIONS.names) + "\r\n" + ";".join(fields) + "\r\n")
    df = tables.read_observations(spark, str(tmp_path / "obs.csv"))
    row = df.first()
    assert row.pressure is None and row.visibility is None and row.snow_depth == "c" and row.present_weather == 3
    assert tabular.without_missing(df).count() == 0 and tabular.without_missing(df, ["lat"]).count() == 1
    tables.write_observations(df, str(tmp_path / "out"))
    assert "60.10000;24.90000;1300000000;" in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_wide_and_formatted(spark):
    df = spark.createDataFrame([(n, k, n * 10.0 + k) for n in (1, 2, 10) for k in (0, 1)], "node int, run int, v double")
    wide = tables.wide_table(df.withColumn("name", F.format_string("lambda%d", "run")), "node", "name", "v", ["lambda0", "lambda1"], [1, 10])
    assert sorted(map(tuple, wide.collect())) == [(1, 10.0, 11.0), (10, 100.0, 101.0)]
    assert tables.formatted(df.where("node = 1 AND run = 0")).first().v == "1.000e+01"


def test_replies(spark):
    replies = spark.createDataFrame([("a", REPLY)], "doc_id string, xml string")
    assert [r.param for r in observations.parameters(replies).orderBy("field").collect()] == ["temp", "wind"]
    meta = spark.createDataFrame([("<c xmlns:o='o' xmlns:g='g'><o:ObservableProperty g:id='temp'><o:label>Air temperature</o:label></o:ObservableProperty><o:ObservableProperty g:id='wind'><o:label> Wind </o:label></o:ObservableProperty></c>",)], "xml string")
    assert sorted(map(tuple, observations.labels(meta).collect())) == [("temp", "Air temperature"), ("wind", "Wind")]


def test_coverage_source(spark, tmp_path):
    windows = observations.day_windows(datetime(2020, 1, 1), datetime(2020, 1, 3, 12))
    assert len(windows) == 3 and windows[-1] == (datetime(2020, 1, 3), datetime(2020, 1, 3, 12))
    assert "starttime=2020-01-01T00%3A00%3A00Z" in observations.request_url("http://h", "q", "1,2,3,4", *windows[0])
    reader = observations.CoverageReader({"url": "http://h", "start": "2020-01-01", "end": "2020-01-02T06:00:00"})
    assert len(reader.partitions()) == 2 and observations.CoverageSource.name() == "coverage"


def test_noise_and_pairs(spark):
    df = spark.createDataFrame([(s, t, float(t)) for s in "ab" for t in range(1, 6)], "series string, t long, x double")
    noisy = series.with_noise(df, 2)
    assert noisy.count() == 20 and noisy.where("series = 'noise1'").select("x").distinct().count() == 5


def test_large_sets_match_numpy(spark):
    """Sets of up to five of six nodes, named by text; one block's node 3 is constant, so sets with it are singular there."""
    g = np.random.default_rng(5)
    x = g.standard_normal((2, 30, 7))
    x[1, :, 3] = 0.0
    grams = np.einsum("bti,btj->bij", x, x)
    rows = [(b, f"n{i}", f"n{j}", float(grams[b, i, j])) for b in range(2) for i in range(7) for j in range(7)]
    df = spark.createDataFrame(rows, "block int, i string, j string, g double")
    from graphloom.kernels.regression import residual

    found = selection.residuals(df, "n2", 5).collect()
    assert len(found) == 2 * (6 + 15 + 20 + 15 + 6) == len({(r["block"], *r["members"]) for r in found})
    for r in found:
        members = tuple(int(n[1]) for n in r["members"])
        assert r["card"] == len(members) and list(r["members"]) == sorted(r["members"]) and 2 not in members
        whole = grams[1, 2, 2] if r["block"] == 1 and 3 in members else residual(grams[r["block"]], 2, members)
        assert r["z"] == pytest.approx(whole)
    some = spark.createDataFrame([(["n0", "n1", "n4", "n5"],), (["n0"],)], "members array<string>")
    assert selection.residuals(df, "n2", 4, some).count() == 4
    assert selection.residuals(df, "absent", 4).count() == 0 == selection.residuals(df.limit(0), "n2", 4).count()


def test_three_regressors_match_numpy(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((2, 9, 5))
    grams = np.einsum("bti,btj->bij", x, x)
    rows = [(b, i, j, float(grams[b, i, j])) for b in range(2) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "block int, i int, j int, g double")
    from graphloom.kernels.regression import residual

    for r in selection.residuals(df, 0, 3).collect():
        assert r.z == pytest.approx(residual(grams[r.block], 0, tuple(r.members)), abs=1e-8)
    assert selection.residuals(df, 0, 3).count() == 2 * (4 + 6 + 4)
    some = spark.createDataFrame([([1, 2],)], "members array<int>")
    assert selection.residuals(df, 0, 2, some).count() == 2


def test_loop_equals_kernel(spark):
    nodes, edges = graphs.block_model(spark, [8, 8], 0.6, 0.1)
    nodes = nodes.select("nid", (F.col("cluster") + 1.0).alias("label"), (F.col("nid") % 4 == 0).alias("is_labeled"))
    for problem in (learning.SPARSE_LABEL_PROPAGATION, learning.local_clustering(0.3, 0.1)):
        a = {r.nid: r for r in learning.loop(nodes, edges.select("src", "dst", "w"), problem, 6)[0].collect()}
        b = learning.solve(nodes.withColumn("graph_id", F.lit(1)), edges.select("src", "dst", "w", F.lit(1).alias("graph_id")), problem, 6).collect()
        assert all(abs(a[r.nid].x - r.x) < 1e-9 and abs(a[r.nid].average - r.average) < 1e-9 for r in b) and len(b) == 16


def test_gap_and_borders(spark):
    nodes = spark.range(1, 11).select(F.col("id").alias("nid"), F.lit(1.0).alias("average"))
    edges = graphs.chain(spark, 10)
    gap = learning.optimality_gap(nodes, edges, nodes.select("nid"), edges, 10, edges.select("src", "dst", F.lit(0.0).alias("d"))).first()
    assert gap.variation == 0 and gap.bound == pytest.approx(18 / 20)
    points = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.1), (3, 1, 0.9), (4, 1, 2.0)], "nid long, cluster int, x double")
    assert tuple(graphs.border_nodes(points).first()) == (2, 4)
    px = tables.rectangle(spark.createDataFrame([(39, 70), (40, 72)], "row int, col int"), (39, 41), (68, 71))
    assert [r.is_labeled for r in px.orderBy("row").collect()] == [True, False]
    assert tables.level_set(spark.createDataFrame([(1, 0.4), (2, 0.6)], "nid int, x double")).count() == 1


def test_star_and_neighbourhoods(spark):
    k = graphs.star_precision(spark, 10, 3).collect()
    assert len(k) == 10 + 6 and sum(r.v for r in k if r.i != r.j) == pytest.approx(0.8)
    assert graphs.neighbourhood("chain", 1, 5) == [2] and graphs.neighbourhood("grid", 5, 9) == [2, 4, 6, 8] and graphs.neighbourhood("grid", 1, 9) == [2, 4]


def test_measures(spark):
    df = spark.createDataFrame([(1.0, 1.2, False), (1.0, 0.2, False), (0.0, 0.4, True)], "t double, e double, l boolean")
    assert tabular.half_unit_accuracy(df, "e", "t", "l").first().accuracy == 0.5
    assert df.agg(tabular.normalised_error(F.col("e"), F.col("t")).alias("n")).first().n == pytest.approx(0.84 / 2)
    found = spark.createDataFrame([(1, True), (1, False)], "k int, found boolean")
    assert experiments.success_rate(found, ["k"]).first().rate == 0.5


def test_error_falls_with_length(spark):
    rate = {(r.method, r.length): r.error for r in experiments.selection_errors(spark, [(12, 1.2)], [10, 150], 12, ("exhaustive", "group_lasso")).collect()}
    assert rate["exhaustive", 150] <= 0.1 < 0.5 <= rate["exhaustive", 10] and rate["group_lasso", 150] < rate["group_lasso", 10]


def test_hourly_stream(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streams.hourly(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 1000


def test_difference_stream(spark, tmp_path):
    rows = pd.DataFrame({"event_id": range(6), "user_id": [1, 1, 2, 2, 1, 2], "ts": pd.to_datetime(["2020-01-01"] * 6) + pd.to_timedelta(range(6), "h"), "value": [1.0, 3.0, 5.0, 5.5, 10.0, 6.0]})
    df = spark.createDataFrame(rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.differences(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("diffs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r["diff"]) for r in spark.table("diffs").collect()) == [(1, 2.0), (1, 7.0), (2, 0.5), (2, 0.5)]


def test_scaled_axis(spark):
    got = spark.range(1).select(series.scaled_size(F.lit(40.0), F.lit(1.2), F.lit(512)).alias("s")).first().s
    assert got == pytest.approx(40 * 1.44 / math.log(512))


def test_models_with_attributes(spark):
    nodes, weights = graphs.attributed_nodes(spark, 60, 3, 2)
    held = {r.cluster: r.weights for r in weights.collect()}
    for r in nodes.collect():
        assert r.label == pytest.approx(np.dot(r.feature, held[r.cluster])) and set(r.feature) <= {-1.0, 1.0}
    unit = graphs.unit_features(nodes.select("nid", "cluster")).collect()
    assert all(np.linalg.norm(r.feature) == pytest.approx(1) for r in unit)
    points, edges, border = graphs.geometric_clusters(spark, 40, 40, 0.2)
    assert points.count() == 80 and edges.where("src >= dst").count() == 0 and border.first().rightmost >= 40


def test_sets_and_samples(spark):
    df = spark.createDataFrame([([1, 2], [2, 1, 1]), ([1], [2])], "a array<int>, b array<int>")
    assert [r.s for r in df.select(tabular.same_set("a", "b").alias("s")).collect()] == [True, False]
    samples = experiments.sample_table(spark, 3, 1.0, 2, 5, 2)
    assert samples.count() == 2 * 2 * 5 * 3 and samples.where("block = 1").agg(F.min("t")).first()[0] == 6
    assert sorted(map(tuple, samples.collect())) == sorted(map(tuple, samples.collect()))


def test_ranks_with_further_columns(spark):
    """300,000 rows over many ranges: each rank once, in the order, each row's other column with it."""
    rows = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("x"), F.col("id").alias("payload"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    for adaptive in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        ranked = tabular.with_rank(rows, [F.desc("x")]).toPandas().sort_values("rank", ignore_index=True)
        assert ranked["rank"].tolist() == list(range(1, 300_001))
        assert ranked["x"].is_monotonic_decreasing and (ranked["payload"] * 7919 % 300_007 == ranked["x"]).all()
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spread_join(spark):
    """Beyond the broadcast, hot keys are dealt out; all forms give what a plain join gives."""
    rows = spark.range(900).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, rows.join(small, "k", how).collect()))
        for limits in ({}, {"broadcast_rows": 1, "hot_rows": 100}, {"broadcast_rows": 1}, {"broadcast_rows": 1, "hot_rows": 3}):
            assert sorted(map(str, joins.spread_join(rows, small, "k", "v", how, **limits).collect())) == want


@pytest.mark.parametrize("problem", [learning.Regression(variance=0.5), learning.Regression("absolute", 1 / 7, 0.5, 0.5)])
def test_regression_loop_equals_kernel(spark, problem):
    """An isolated node, a null label and a zero feature included."""
    g = np.random.default_rng(3)
    x, y = g.standard_normal((9, 2)), g.standard_normal(9)
    x[4] = 0.0
    seeds = np.arange(9) % 2 == 0
    src, dst = np.array([0, 0, 1, 2, 3, 5, 4]), np.array([1, 2, 3, 3, 5, 6, 7])  # node 8 alone
    nodes = spark.createDataFrame([(i, x[i].tolist(), float(y[i]) if i != 3 else None, bool(seeds[i])) for i in range(9)], "nid long, feature array<double>, label double, is_labeled boolean")
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(src, dst, strict=True)], "src long, dst long, w double")
    want = learning.regress(src, dst, x, np.where(np.arange(9) == 3, 0, y), seeds, problem, 7)
    found = {r["nid"]: r for r in learning.loop_regression(nodes, edges, problem, 7, 2).collect()}
    for i in range(9):
        assert found[i]["weights"] == pytest.approx(want[i].tolist(), abs=1e-9) and found[i]["predicted"] == pytest.approx(float(want[i] @ x[i]), abs=1e-9)
