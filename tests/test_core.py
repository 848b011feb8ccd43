"""Scoring against the published vector, brute force, and every documented quirk."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint import ClusterSizeError, LocalOutlierProbability, LoOP, LoOPModel, MissingValuesError, ValidationError
from farpoint.functions.erf import erf_column
from farpoint.operators import knn, recipes, scoring
from farpoint.operators.validate import profile, to_points

# The published vector and its scores (k = 10, extent 3).
X20 = [0.02059752, 0.32629926, 0.63036653, 0.94409321, 0.63251097, 0.47598494, 0.80204026, 0.34845067, 0.81556468, 0.89183,
       0.25210317, 0.11460502, 0.19953434, 0.36955067, 0.06038041, 0.34527368, 0.56621582, 0.90533649, 0.33773613, 0.71573306]
Y20 = [0.6356276742921594, 0, 0, 0.48490790006974044, 0, 0, 0, 0, 0.021728288376168012, 0.28285086151683225,
       0, 0.18881886507113213, 0, 0, 0.45350246469681843, 0, 0.07886635748113013, 0.3349068501560546, 0, 0]
X8 = [(-2, -1), (-1, -1), (-1, -2), (1, 2), (1, 2), (2, 1), (5, 3), (-4, 2)]


def by_force(x, k, extent=3, labels=None):
    """Scores by the textbook, ties to the smaller position."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    labels = labels or [0] * len(x)
    near = []
    for i in range(len(x)):
        d = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(len(x)) if j != i and labels[j] == labels[i])
        near.append(d[:k])
    pd = [extent * math.sqrt(sum(d for d, _ in n) / k) for n in near]
    ev = [sum(pd[j] for _, j in n) / k for n in near]
    plof = [p / (e or 1e-8) - 1 for p, e in zip(pd, ev)] if pd != ev else [0.0] * len(x)
    out = []
    for i in range(len(x)):
        mine = [plof[j] ** 2 for j in range(len(x)) if labels[j] == labels[i]]
        n = extent * math.sqrt(sum(mine) / len(mine))
        out.append(max(0.0, math.erf(plof[i] / (n * math.sqrt(2)))) if n else (float("nan") if any(plof) else 0.0))
    return out


def frame(spark, x, labels=None):
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    names = [f"v{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), (labels or [0] * len(x))[i]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", label int"), names


def scores(spark, x, k, labels=None, **kw):
    df, names = frame(spark, x, labels)
    return [r["score"] for r in LoOP(names, "id", "label", n_neighbors=k, **kw).fit(df).scores.orderBy("id").collect()]


def test_erf(spark):
    y = [i / 300 for i in range(2100)]
    got = spark.createDataFrame([(v,) for v in y], "y double").select("y", erf_column("y").alias("e")).collect()
    assert max(abs(r["e"] - math.erf(r["y"])) for r in got) < 1e-15


@pytest.mark.parametrize("strategy", ["sql", "block"])
def test_published_vector(spark, strategy):
    assert np.allclose(scores(spark, X20, 10, strategy=strategy), Y20, atol=1e-9)


@pytest.mark.parametrize("strategy", ["sql", "block"])
def test_brute_force_with_clusters_and_ties(spark, strategy):
    r = random.Random(1)
    x = [(r.randrange(6), r.randrange(6), r.random()) for _ in range(120)]
    labels = [r.randrange(3) for _ in x]
    assert np.allclose(scores(spark, x, 5, labels, strategy=strategy), by_force(x, 5, 3, labels), atol=1e-9)


def test_block_strategy_equals_sql_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    df, names = frame(spark, np.round(rng.normal(size=(600, 2)), 1), [int(v) for v in rng.integers(0, 2, 600)])
    points = to_points(df, "id", names, "label")
    edge = lambda e: sorted((r["id"], r["rank"], r["nid"]) for r in e.collect())
    assert edge(knn.block_edges(points, 7, 600, block=32)) == edge(knn.sql_edges(points, 7))


def test_outliers_of_the_toy_set(spark):
    s = scores(spark, X8, 5)
    assert set(np.argsort(s)[-2:]) == {6, 7} and np.allclose(s, by_force(X8, 5), atol=1e-9)


def test_quality(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([0.3 * rng.normal(size=(120, 2)), rng.uniform(-4, 4, size=(20, 2))])
    s = scores(spark, x, 139)
    df = spark.createDataFrame([(float(v), int(i >= 120)) for i, v in enumerate(s)], "score double, y int")
    assert recipes.roc_auc(df, "score", "y").first()["auc"] >= 0.95


def test_extent_lowers_scores_and_is_shared(spark):
    df, names = frame(spark, X20)
    points = to_points(df, "id", names)
    together = scoring.score_extents(knn.sql_edges(points, 10), 10).collect()
    means = []
    for x in (1, 2, 3):
        alone = scores(spark, X20, 10, extent=x)
        assert np.allclose(sorted(r["score"] for r in together if r["extent"] == x), sorted(alone), atol=1e-9)
        means.append(np.mean(alone))
    assert means[0] > means[1] > means[2]


def test_metamorphic(spark):
    base = scores(spark, X8, 4)
    assert np.allclose(scores(spark, [(3 * a + 7, 3 * b - 2) for a, b in X8], 4), base, atol=1e-9)
    # without ties the order of rows does not matter
    assert np.allclose(scores(spark, X20[::-1], 10)[::-1], Y20, atol=1e-9)


def test_equal_points_score_zero_and_one_level_cluster_is_nan(spark):
    assert scores(spark, [1.0] * 12, 3) == [0.0] * 12
    s = scores(spark, [1.0] * 6 + [1, 2, 4, 8, 16, 32.0], 3, [0] * 6 + [1] * 6)
    # the first cluster reads 0 / 1e-8 - 1 = -1 for all its rows
    assert s[:6] == [0.0] * 6 and all(0 <= v <= 1 for v in s[6:])


def test_errors_and_warnings(spark):
    with pytest.raises(MissingValuesError):
        scores(spark, [1.3, 1.1, 0.9, 1.4, 1.5, float("nan"), 3.2], 3)
    with pytest.raises(ClusterSizeError):
        scores(spark, X8, 3, [0] * 6 + [1] * 2)
    with pytest.raises(ClusterSizeError):
        scores(spark, [1.0], 1)
    with pytest.raises(ValidationError):
        LoOP(["a"], edges=True)
    with pytest.raises(ValidationError):
        to_points(spark.createDataFrame([(1, "x")], "id long, s string"), "id", ["s"])
    with pytest.warns(UserWarning, match="not below the number of rows"):
        assert len(scores(spark, X8, 50)) == 8
    with pytest.warns(UserWarning, match="not positive"):
        assert len(scores(spark, X20, 0)) == 20
    with pytest.warns(UserWarning, match="extent is meant"):
        LoOP(["a"], extent=4)


def test_array_features_equal_columns(spark):
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X8)], "id long, v array<double>")
    got = [r["score"] for r in LoOP(["v"], n_neighbors=5).fit(df).scores.orderBy("id").collect()]
    assert np.allclose(got, scores(spark, X8, 5), atol=1e-12)


def edges_of(x, k):
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    i = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, i, axis=1), i


def test_matrix_mode_equals_points(spark):
    d, n = edges_of(X20, 10)
    m = LocalOutlierProbability(distance_matrix=d, neighbor_matrix=n, n_neighbors=10, spark=spark).fit()
    assert np.allclose(m.local_outlier_probabilities, Y20, atol=1e-9)
    # one distance stands for all neighbours
    far, near = m.stream(np.array([5.0])), m.stream(np.array([0.001]))
    assert far > 0.99 and near == 0


def test_matrix_mode_skips_missing_distances(spark):
    d, n = edges_of(X20, 10)
    d[4] = np.nan
    s = LocalOutlierProbability(distance_matrix=d, neighbor_matrix=n, spark=spark).fit().local_outlier_probabilities
    assert math.isnan(s[4]) and not any(math.isnan(v) for i, v in enumerate(s) if i != 4)


def test_facade_warns(spark):
    with pytest.warns(UserWarning, match="neither data"):
        LocalOutlierProbability(spark=spark)
    with pytest.warns(UserWarning, match="both given"):
        LocalOutlierProbability(np.ones((3, 1)), distance_matrix=np.ones((3, 1)), spark=spark)
    with pytest.warns(UserWarning, match="differ in shape"):
        LocalOutlierProbability(distance_matrix=np.ones((3, 2)), neighbor_matrix=np.ones((3, 1)), n_neighbors=2, spark=spark)
    with pytest.warns(UserWarning, match="n_jobs"):
        assert LocalOutlierProbability(np.ones((3, 1)), n_jobs=0, spark=spark).n_jobs == 1
    with pytest.warns(UserWarning, match="ndarray"):
        m = LocalOutlierProbability([1.3, 1.1, 0.9, 1.4, 1.5, 3.2], n_neighbors=3, spark=spark).fit()
    assert len(m.local_outlier_probabilities) == 6


def stream_by_force(x, model_rows, q, k):
    d = sorted(float(((np.asarray(q) - np.asarray(p)) ** 2).sum()) for p in x)[:k]
    pd = 3 * math.sqrt(sum(d) / k)
    mean_ev = np.mean([r["ev"] for r in model_rows])
    top = max(r["nplof"] for r in model_rows)
    return max(0.0, math.erf((pd / mean_ev - 1) / (top * math.sqrt(2))))


def test_stream_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    df, names = frame(spark, x)
    m = LoOP(names, n_neighbors=6).fit(df)
    rows = m.scores.collect()
    q = [(0.1, 0.2), (3.0, 3.0), (float("nan"), 0.0)]
    new = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "id long, v0 double, v1 double")
    got = [r["score"] for r in m.transform(new).orderBy("id").collect()]
    assert np.allclose(got[:2], [stream_by_force(x, rows, v, 6) for v in q[:2]], atol=1e-9) and got[2] > 0.999


@pytest.mark.parametrize("block", [16, 1024])
def test_large_models_score_by_near_blocks(spark, monkeypatch, block):
    """Blocks give what the broadcast gives: clumps, repeated rows and points, missing, infinite and far values; few pairs, no product."""
    from farpoint import streaming

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.2, size=(150, 2)) for c in (0, 6, 12, 18)] + [np.full((200, 2), 3.0)])
    df, names = frame(spark, x)
    m = LoOP(names, n_neighbors=6).fit(df)
    q = [*map(tuple, rng.normal(6, 5, size=(120, 2))), (3.0, 3.0), (3.0, 3.0), (0.0, -0.0), (1e12, 0.0), (float("inf"), 1.0), (float("nan"), 0.0), (None, 1.0)]
    new = spark.createDataFrame([(i // 2, None if a is None else float(a), float(b)) for i, (a, b) in enumerate(q)], "id long, v0 double, v1 double")
    want = [tuple(r) for r in m.transform(new).select("id", "v0", "v1", F.round("score", 9)).collect()]
    seen = []
    close = knn._close
    monkeypatch.setattr(knn, "_close", lambda *a: seen.append(close(*a)) or seen[-1])
    got = streaming.score_by_blocks(new, names, m.points, ["f0", "f1"], 6, 3, *m.stats, block=block)
    assert got.columns == [*new.columns, "score"]
    assert sorted(map(str, (tuple(r) for r in got.select("id", "v0", "v1", F.round("score", 9)).collect()))) == sorted(map(str, want))
    if block == 16:  # new rows spread as the points are
        like = np.vstack([rng.normal(c, 0.2, size=(100, 2)) for c in (0, 6, 12, 18)])
        got = streaming.score_by_blocks(frame(spark, like)[0], names, m.points, ["f0", "f1"], 6, 3, *m.stats, block=block)
        seen = seen[-1:]
        a, b = (seen[0].select(c).distinct().count() for c in ("block", "other"))
        assert seen[0].count() < a * b / 4
        assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert streaming.score_by_blocks(new.limit(0), names, m.points, ["f0", "f1"], 6, 3, *m.stats).count() == 0


def test_stream_warns_before_fit_and_on_clusters(spark):
    m = LocalOutlierProbability(np.array(X8, dtype=float), n_neighbors=3, spark=spark)
    with pytest.warns(UserWarning, match="fitting first"):
        assert 0 <= m.stream(np.array([0.0, 0.0])) <= 1
    c = LocalOutlierProbability(np.array(X8 + X8, dtype=float), n_neighbors=3, cluster_labels=[0] * 8 + [1] * 8, spark=spark).fit()
    with pytest.warns(UserWarning, match="in clusters"):
        c.stream(np.array([0.0, 0.0]))


def test_save_and_load(spark, tmp_path):
    df, names = frame(spark, X8)
    m = LoOP(names, n_neighbors=4).fit(df)
    m.save(str(tmp_path))
    again = LoOPModel.load(spark, str(tmp_path))
    a, b = (sorted((r["id"], r["score"]) for r in x.transform(df).collect()) for x in (m, again))
    assert a == b


def test_streaming_equals_batch(spark, tmp_path):
    df, names = frame(spark, X8)
    m = LoOP(names, n_neighbors=4).fit(df)
    df.write.parquet(f"{tmp_path}/in")
    stream = m.transform(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("scored_x8").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["id"], r["score"]) for r in spark.table("scored_x8").collect()) == sorted((r["id"], r["score"]) for r in m.transform(df).collect())


def test_plans_push_down_and_limit_groups(spark):
    from farpoint.plans.queries import customers

    points = customers(spark, "/root/testdata/sf0.001")
    text = knn.sql_edges(points, 5)._jdf.queryExecution().explainString(
        spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "WindowGroupLimit" in text and "c_name" not in text
    assert profile(points).rows == 150


def test_entry_without_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = __import__("pathlib").Path(__file__).resolve().parents[1]
    shutil.copytree(root / "farpoint", tmp_path / "farpoint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": __import__("os").environ["PATH"]})


def test_recipes(spark):
    assert recipes.suggested_neighbours(150) % 2 == 1
    df = spark.createDataFrame([(1, 0.5, 0.1), (2, float("nan"), 0.2), (3, 0.05, 0.05)], "id long, score double, b double")
    assert [r["id"] for r in recipes.above(df, 0.1).collect()] == [1] and [r["id"] for r in recipes.top(df, 5).collect()] == [1, 3]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert df.filter("id <> 2").agg(recipes.rmse("score", "b").alias("r")).first()["r"] == pytest.approx(math.sqrt(0.16 / 2))


def test_block_strategy_keeps_string_ids_and_equals_sql_over_many_blocks(spark):
    r = random.Random(5)
    rows = [(f"id{i:04}", float(r.gauss(0, 3)), float(r.gauss(i % 3, 1)), "ab"[i % 7 == 0]) for i in range(900)]
    rows += [(f"dup{i}", 0.5, 0.5, "a") for i in range(20)]
    points = to_points(spark.createDataFrame(rows, "id string, x double, y double, c string"), "id", ["x", "y"], "c")
    want = {tuple(x) for x in knn.sql_edges(points, 4).select("id", "rank", "nid").collect()}
    for block in (16, 1024):
        got = knn.block_edges(points, 4, len(rows), block=block)
        assert dict(got.dtypes)["id"] == "string" and {tuple(x) for x in got.select("id", "rank", "nid").collect()} == want
    ints = to_points(spark.createDataFrame([(i, float(i * i)) for i in range(50)], "id int, x double"), "id", ["x"])
    assert dict(knn.block_edges(ints, 3, 50).dtypes)["nid"] == "int"


def test_block_pairs_are_few_and_without_a_product(spark):
    points = to_points(spark.range(20_000).select("id", (F.col("id") * 1.0).alias("x")), "id", ["x"])
    seen = []
    close = knn._close
    knn._close, kept = (lambda *a: seen.append(close(*a)) or seen[-1]), close
    try:
        assert knn.block_edges(points, 3, 20_000, block=64).count() == 60_000
    finally:
        knn._close = kept
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert seen[0].count() <= 4 * 20_000 / 64


def test_auc_and_zscores_hold_no_group_in_one_window(spark):
    r = random.Random(2)
    rows = [(r.choice([0.1, 0.2, r.random()]), int(r.random() < 0.3), "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "s double, y int, c string")
    pos, neg = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(recipes.roc_auc(df, "s", "y").first()["auc"] - want) < 1e-9
    assert recipes.roc_auc(df.limit(0), "s", "y").first()["auc"] is None
    z = recipes.zscores(df, ["s"], "c")
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and abs(z.filter("c = 'a'").agg(F.avg("s")).first()[0]) < 1e-9


def test_labels_of_matrix_mode_keep_their_values(spark):
    from farpoint.sources import edges_from

    d, n = np.array([[1.0], [1.0], [2.0], [2.0]]), np.array([[1], [0], [3], [2]])
    for labels in ([0.5, 0.5, 0.9, 0.9], ["a", "a", "b", "b"], np.array([1, 1, 2, 2])):
        got = edges_from(spark, d, n, labels).orderBy("id").collect()
        assert [r["cluster"] for r in got] == list(labels)


def test_rows_to_score_may_have_any_columns(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, x double")
    model = LoOP(["x"], "id", n_neighbors=3).fit(df)
    got = model.transform(df.limit(3).select("*", F.lit(1).alias("ssd"), F.lit("s").alias("score"), F.lit(2).alias("_y")))
    assert got.columns.count("score") == 1 and all(0 <= r["score"] <= 1 and r["ssd"] == 1 for r in got.collect())
    model.release()
    clustered = LoOP(["x"], "id", "c", n_neighbors=3).fit(df.withColumn("c", F.col("id") % 2))
    with pytest.warns(UserWarning, match="in clusters"):
        clustered.transform(df.limit(1))


def test_params_ids_and_arrays(spark):
    est = LoOP(["x"], "id", n_neighbors=3)
    assert est.copy({est.nNeighbors: 5}).n_neighbors == 5 and est.n_neighbors == 3
    with pytest.raises(ValidationError):
        LoOP(["x"], n_neighbors="5")
    with pytest.raises(ValidationError):
        est.fit(spark.createDataFrame([(None if i == 2 else i, float(i)) for i in range(9)], "id long, x double"))
    ragged = spark.createDataFrame([(i, [1.0 * i] * (1 + (i == 7))) for i in range(9)], "id long, x array<double>")
    with pytest.raises(MissingValuesError):
        est.fit(ragged)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 9, 1.0)], "id long, nid long, dist double")
    with pytest.raises(ValidationError):
        LoOP(edges=True, n_neighbors=1).fit(edges)
    with_self = spark.createDataFrame([(0, 1, 0, 0.0), (0, 2, 1, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 3.0)], "id long, rank int, nid long, dist double")
    assert sorted(map(tuple, recipes.without_self(with_self, 1).select("id", "rank", "nid").collect())) == [(0, 1, 1), (1, 1, 0)]


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev", "canberra", "braycurtis", "hamming", "cosine"])
def test_blocks_of_other_metrics_equal_sql(spark, metric):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.integers(-4, 5, (150, 2)), np.zeros((30, 2)), rng.normal(size=(120, 2))])
    df, names = frame(spark, x, [int(v) for v in rng.integers(0, 2, len(x))])
    points = to_points(df, "id", names, "label")
    edge = lambda e: sorted((r["id"], r["rank"], r["nid"], r["d2"]) for r in e.collect())
    assert edge(knn.block_edges(points, 5, len(x), block=32, metric=metric)) == edge(knn.sql_edges(points, 5, metric))


def test_metrics_past_the_switch_build_no_pairs(spark):
    points = to_points(spark.range(4000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")), "id", ["x", "y"])
    for metric in ("manhattan", "hamming"):
        best = knn.knn_edges(points, 3, 4000 * 4000, 4000, metric=metric)
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan or "_l0" in plan
        assert best.count() == 12_000


@pytest.mark.parametrize("some", [0, 7])
def test_equal_points_are_searched_once(spark, some):
    """A constant feature, or mostly one, makes no pairs of blocks."""
    x = F.when(F.col("id") % some == 0, F.col("id") * 1.0).otherwise(0.0) if some else F.lit(1.0)
    points = to_points(spark.range(3000).select("id", x.alias("x")), "id", ["x"])
    seen = []
    close = knn._close
    knn._close, kept = (lambda *a: seen.append(close(*a)) or seen[-1]), close
    try:
        got = {r["id"]: r["nid"] for r in knn.block_edges(points, 3, 3000, block=16).filter("rank = 1").collect()}
    finally:
        knn._close = kept
    assert len(got) == 3000 and seen[0].count() <= 100
    assert [got[0], got[1], got[2]] == [1, 0, 0]


@pytest.mark.parametrize("width", [1, 2, 20])
def test_index_of_training_points_equals_all_distances(width):
    from farpoint.streaming import Near, kth_sum

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(2000, width)), 1)
    x[:700] = 0.0
    x[705], x[707] = np.nan, 1e13
    q = np.vstack([rng.normal(size=(200, width)) * 2, x[:20]])
    q[3], q[4] = np.inf, 1e12
    for k in (1, 10):
        with np.errstate(all="ignore"):
            want = kth_sum(knn.kernels.squared_distances(q, x), k)
        assert np.allclose(Near(x, k).sums(q), want, rtol=1e-12)
        assert np.allclose(Near(x[:3], 10).sums(q), kth_sum(np.nan_to_num(knn.kernels.squared_distances(q, x[:3]), nan=np.inf), 10), rtol=1e-12)
    assert len(Near(np.ones((5000, width)), 10).x) == 10


def test_edges_brought_over_all_customers_are_no_pairs(spark):
    from importlib import import_module

    plans = import_module("farpoint.plans.queries")
    plan = plans.matrix_edges(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_moments_in_row_order_round_as_one_pass_does(spark):
    r = random.Random(3)
    rows = [(i, "ab"[i % 3 == 0], r.random() * 1e3 + 0.1) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, c string, x double")
    got = {t["id"]: t["x"] for t in recipes.zscores(df.repartition(7), ["x"], "c", order="id").collect()}
    for c in "ab":
        mine, n, s, m, q = [(i, x) for i, k, x in rows if k == c], 0, 0.0, 0.0, 0.0
        for _, x in mine:
            n, s = n + 1, s + x
            d = x - m
            m += d / n
            q += d * (x - m)
        assert all(got[i] == (x - s / n) / math.sqrt(q / n) for i, x in mine)
