"""Hand-computed cases, straight-line twins in numpy, and properties."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideloom.functions import linalg as la
from tideloom.functions import params as pa
from tideloom.functions.ordered import with_position
from tideloom.operators import control, learners, preprocess, server, workers
from tideloom.plans import pipeline as pl
from tideloom.sources import records


def one(df):
    return df.first()[0]


def test_polynomial(spark):
    x = F.array(F.lit(2.0), F.lit(3.0))
    assert one(spark.range(1).select(preprocess.polynomial(x, 2))) == [2, 3, 4, 6, 6, 9]
    want = [2, 3, 4, 6, 6, 9, 4, 6, 6, 9, 8, 12, 12, 18, 12, 18, 18, 27]
    assert one(spark.range(1).select(preprocess.polynomial(x, 3))) == want
    assert preprocess.polynomial_width(2, 3) == len(want)


def test_scaler(spark):
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate([1.0, 3.0, 5.0])], "i long, k int, x double")
    running = [r["z_x"] for r in preprocess.scale_running(df, ["k"], "i", ["x"], block=2).orderBy("i").collect()]
    assert running == pytest.approx([1.0, 1.0, 1.224745], abs=1e-6)
    batch = [r["z_x"] for r in preprocess.scale_batch(df, ["x"]).orderBy("i").collect()]
    assert batch == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "i long, x double")
    assert [r["z_x"] for r in preprocess.scale_batch(flat, ["x"]).collect()] == [0.0, 0.0]


def _fit(spark, rows, kind="PA", **options):
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(rows)], "k int, i long, x array<double>, y double")
    return learners.fit_in_order(df, ["k"], "i", kind, **options).first()


def test_pa_classifier(spark):
    out = _fit(spark, [([1.0, 2.0], 1.0), ([2.0, 0.0], 0.0)])
    assert out["w"] == pytest.approx([-63 / 3080, 110 / 3080]) and out["b"] == pytest.approx(-4 / 3080) and out["fitted"] == 2
    skipped = _fit(spark, [([1.0, 2.0], 1.0), ([1.0, 2.0], 2.0), ([1.0, 2.0], None), ([1.0], 1.0)])
    assert skipped["fitted"] == 1


def test_pa_regressor(spark):
    out = _fit(spark, [([1.0], 3.0)], "regressorPA")
    assert out["w"] == pytest.approx([3 / 52]) and out["b"] == pytest.approx(3 / 52)
    still = _fit(spark, [([1.0], 3.0)], "regressorPA", epsilon=3.0)
    assert still["w"] == [0.0]


def test_margin_zero_is_one(spark):
    assert one(spark.range(1).select(learners.classify(F.lit(0.0)))) == 1.0


def test_folds_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, rng.normal(size=3).tolist(), float(rng.choice([-1, 1]))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i long, x array<double>, y double")
    streamed = learners.fit_in_order(df, ["k"], "i").first()
    listed = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("ord"), "x", "y"))).alias("r"))
    native = listed.select(learners.fold_batch(F.col("r"), pa.unflatten(la.zeros(4))).alias("m")).first()["m"]
    w, b = np.zeros(3), 0.0
    for _, _, x, y in rows:
        x = np.array(x)
        tau = max(0.0, 1 - y * (w @ x + b)) / (x @ x + 1 + 50) * y
        w, b = w + tau * x, b + tau
    for got in (streamed, native):
        assert got["w"] == pytest.approx(w.tolist()) and got["b"] == pytest.approx(b)


def test_ridge(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "f double, y double")
    state = learners.ridge_state(learners.ridge_sums(df, [], ["f"], "y"), 1)
    row = state.withColumn("w", learners.ridge_solution(0.0)(F.col("A"), F.col("b"))).first()
    assert row["A"] == [[5, 3], [3, 2]] and row["b"] == [10, 6]
    assert row["w"][0] * 3 + row["w"][1] == pytest.approx(6)
    single = learners.ridge_state(learners.ridge_sums(df.limit(0).union(spark.createDataFrame([(1.0, 2.0)], "f double, y double")), [], ["f"], "y"), 1)
    w = single.select(learners.ridge_solution(0.0)(F.col("A"), F.col("b"))).first()[0]
    assert w[0] * 3 + w[1] == pytest.approx(4)


def test_average_over_rounds(spark):
    delta = lambda vs: spark.createDataFrame([(1, k, [v], 1) for k, v in enumerate(vs)], "p int, worker int, delta array<double>, fitted long")
    first = server.averaged(delta([4.0]), None, ["p"], 4)
    assert first.first()["v"] == [1.0]
    second = server.averaged(delta([2.0, 6.0]), first, ["p"], 4).first()
    assert second["v"] == [3.0] and second["fitted"] == 3


def test_holdout_and_sampler(spark):
    df = workers.assigned(spark.range(80).withColumnRenamed("id", "i"), 4, F.col("i"))
    held = workers.holdout(df, "i").where("held").select("worker", "position").collect()
    assert sorted((r["worker"], r["position"]) for r in held) == [(0, 8), (0, 9), (0, 18), (0, 19)]
    updates = spark.range(12).selectExpr("1 AS pipeline", "id AS seq", "0 AS worker", "1 AS op")
    got = control.sampled_updates(updates, 4).collect()
    assert sorted((r["seq"], r["worker"]) for r in got) == [(s, w) for s in (5, 11) for w in range(4)]


def test_lifecycle(spark):
    verbs = ["Create", "Create", "Query", "Update", "Delete", "Query", "Create"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(verbs)], "id int, seq long, request string")
    judged = control.lifecycle(df)
    kept = judged.where("effective").orderBy("seq")
    assert [r["request"] for r in kept.collect()] == ["Create", "Query", "Update", "Delete", "Create"]
    sizes = {r["seq"]: r["count"] for r in control.fan_out(kept, 4).groupBy("seq").count().collect()}
    assert [sizes.get(i, 0) for i in range(7)] == [4, 0, 1, 4, 4, 0, 4]


@pytest.mark.parametrize(
    "text, fate",
    [
        ('{"id": 1, "operation": "training", "numericFeatures": [1.0], "target": 1.0}', True),
        ('{"id": 1, "operation": "training", "numericFeatures": [1.0]}', True),
        ('{"id": 1, "operation": "forecasting", "numericFeatures": [1.0], "more": 1}', True),
        ('{"id": 1, "operation": "forecasting", "numericFeatures": [1.0], "target": 1.0}', False),
        ('{"id": 1, "operation": "resting", "numericFeatures": [1.0]}', False),
        ('{"id": 1, "operation": "training", "numericFeatures": [], "discreteFeatures": []}', False),
        ('{"id": 1, "operation"', False),
    ],
)
def test_record_rules(spark, text, fate):
    df = spark.createDataFrame([(text,)], "value string")
    assert records.records(df).count() == int(fate) and records.rejects(df).count() == int(not fate)


@pytest.mark.parametrize(
    "change, ok",
    [
        ({}, True), ({"id": -1}, False), ({"request": "Drop"}, False), ({"learner": None}, False), ({"learner": {"hyperparameters": {}}}, False),
        ({"training_configuration": {"protocol": "Synchronous"}}, True), ({"training_configuration": {"protocol": "Gossip"}}, False),
        ({"training_configuration": {"mini_batch_size": 0}}, False), ({"training_configuration": {"mini_batch_size": "x"}}, False),
        ({"training_configuration": {"mini_batch_size": 32}}, True), ({"request": "Query"}, False), ({"request": "Query", "requestId": 4}, True),
        ({"request": "Update", "learner": None}, False), ({"preprocessors": [{"hyperparameters": {}}]}, False),
    ],
)
def test_request_rules(spark, change, ok):
    text = json.dumps({"id": 1, "request": "Create", "learner": {"name": "PA", "hyperparameters": {"C": 1}}} | change)
    df = spark.createDataFrame([(text,)], "value string")
    assert records.requests(df).count() == int(ok)


def test_request_file_with_a_list(spark):
    each = {"id": 1, "request": "Create", "learner": {"name": "PA"}, "protocol": "Asynchronous"}
    df = spark.createDataFrame([(json.dumps({"requests": [each, each | {"id": 2}]}),)], "value string")
    assert sorted(r["id"] for r in records.requests(df).collect()) == [1, 2]


def test_linear_algebra(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [3.0, 4.0, 0.0])], "a array<double>, b array<double>")
    sparse = df.select(la.to_sparse("a").alias("s"), la.to_sparse("b").alias("t"), "a", "b")
    row = sparse.select(
        la.to_dense("s"), la.sparse_dot("s", "t"), la.sparse_dot_dense("s", "b"), la.outer("a", "b"), la.equal("a", la.to_dense("s")),
        la.sparse_at("s", F.lit(2)), la.sparse_at("s", F.lit(1)), la.dot("a", F.slice("b", 1, 2)), la.transpose(la.outer("a", "b")), la.updated("a", 1, 9.0),
        la.sparse_outer("s", "t"), la.matrix_vector(la.identity(3), "b"),
    ).first()
    assert row[0] == [1, 0, 2] and row[1] == 3 and row[2] == 3 and row[4] and row[5] == 2 and row[6] == 0 and row[7] is None
    assert np.array_equal(row[3], np.outer([1, 0, 2], [3, 4, 0])) and np.array_equal(row[8], np.outer([3, 4, 0], [1, 0, 2]))
    assert row[9] == [1, 9, 2] and [tuple(p) for p in row[10]] == [(0, 0, 3), (0, 1, 4), (2, 0, 6), (2, 1, 8)] and row[11] == [3, 4, 0]


def test_parameters_round_trip(spark):
    p = pa.linear(F.array(F.lit(1.0), F.lit(2.0)), F.lit(3.0))
    row = spark.range(1).select(pa.flatten(pa.unflatten(pa.flatten(p))), pa.bucket_slice(pa.flatten(p), 1, 2), pa.bucket_slice(pa.flatten(p), 1, 3), pa.descriptor(p, F.lit(7))).first()
    assert row[0] == [1, 2, 3] and row[1] == [2, 3] and row[2] is None and row[3]["sizes"] == [2, 1] and row[3]["bucket"]["end"] == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50)), max_size=40, unique=True))
def test_positions_across_blocks(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    df = spark.createDataFrame(rows, "k int, o long")
    got = {(r["k"], r["o"]): r["position"] for r in with_position(df, ["k"], "o", block=7).collect()}
    want = {(k, o): sorted(x for j, x in rows if j == k).index(o) for k, o in rows}
    assert got == want


def test_pipeline_from_request():
    made = pl.Pipeline.from_request(
        {"preprocessors": [{"name": "PolynomialFeatures", "hyperparameters": {"degree": 3}}, {"name": "StandardScaler"}], "learner": {"name": "ORR", "hyperparameters": {"lambda": 1}}, "protocol": "Synchronous"}
    )
    assert made.width(2) == 18 and made.config.batch == 256 and made.config.protocol == "Synchronous" and made.learner.ridge == 1.0
    pa_with = lambda **more: {"learner": {"name": "PA"} | more}
    for bad in (
        {"learner": {"name": "Tree"}}, pa_with(hyperparameters={"C": "x"}), pa_with(hyperparameters={"epsilon": 1}), pa_with(hyperparameters={"C": 0}),
        pa_with(parameters={"a": [1.0]}), pa_with() | {"training_configuration": {"mini_batch_size": 0}}, pa_with() | {"preprocessors": [{"name": "PolynomialFeatures", "hyperparameters": {"power": 2}}]},
        pa_with() | {"preprocessors": [{"name": "StandardScaler", "parameters": {"mean": [1.0]}}]}, {"learner": {"name": "ORR", "parameters": {"a": [[1.0, 0.0]], "b": [1.0]}}},
    ):
        with pytest.raises(pl.ConfigError):
            pl.Pipeline.from_request(bad)


def test_scaler_carries_on(spark):
    df = spark.createDataFrame([([1.0],), ([3.0],)], "x array<double>")
    scaler = pl.StandardScaler(start={"n": 1, "mean": [5.0], "variance": [0.0]})
    scaler.transform(df)
    assert scaler.state["n"] == 3 and scaler.state["mean"] == pytest.approx([3.0]) and scaler.state["variance"] == pytest.approx([8 / 3])


def test_frozen_scaler_without_a_start_changes_nothing(spark):
    df = spark.createDataFrame([([1.0],), ([3.0],)], "x array<double>")
    scaler = pl.StandardScaler(learn=False)
    assert [r["x"] for r in scaler.transform(df).collect()] == [[1.0], [3.0]] and scaler.state is None
    scaler.enable()
    scaler.transform(df)
    scaler.freeze()
    assert scaler.state["n"] == 2 and not scaler.learn


def test_warm_starts(spark):
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([([2.0, 0.0], 0.0)])], "k int, i long, x array<double>, y double")
    start = {"name": "PA", "hyperparameters": {"C": 0.01}, "parameters": {"a": [1 / 56, 2 / 56], "b": 1 / 56}}
    out = pl.Pipeline.from_request({"learner": start}).fit(df, ["k"], "i", 2).first()
    assert out["w"] == pytest.approx([-63 / 3080, 110 / 3080]) and out["b"] == pytest.approx(-4 / 3080)
    ridge = {"name": "ORR", "parameters": {"A": [[1.0, 1.0], [1.0, 1.0]], "b": [2.0, 2.0]}}
    point = spark.createDataFrame([(1, 0, [2.0], 4.0)], "k int, i long, x array<double>, y double")
    out = pl.Pipeline.from_request({"learner": ridge}).fit(point, ["k"], "i", 1).first()
    assert 3 * out["w"][0] + out["b"] == pytest.approx(6)


def test_pipelines_clear_and_merge():
    one = pl.Pipeline.from_request({"learner": {"name": "PA"}, "preprocessors": [{"name": "StandardScaler"}]})
    one.preprocessors[0].state, one.fitted = {"n": 2, "mean": [0.0], "variance": [1.0]}, 7
    two = pl.Pipeline.from_request({"learner": {"name": "ORR"}})
    two.fitted = 5
    assert one.clear().fitted == 0 and one.preprocessors[0].state is None
    one.fitted = 7
    assert one.merge(two).fitted == 12 and one.learner.name == "ORR" and one.preprocessors == []
    assert one.remove_learner().learner is None and one.add_learner(two.learner).learner is two.learner


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["PA", "regressorPA"]), st.integers(1, 6))
def test_segments_fold_like_single_points(seed, kind, n_keys):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 12, n_keys)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    x, y = rng.normal(size=(lengths.sum(), 3)), rng.choice([-1.0, 1.0], lengths.sum())
    w = rng.normal(size=(n_keys, 4))
    got = learners.fold_segments(kind, x, y, starts, w, 0.01, 0.1)
    for k in range(n_keys):
        v, b = w[k, :3], w[k, 3]
        for i in range(starts[k], starts[k] + lengths[k]):
            v, b = learners._step(kind, x[i], y[i], v, b, 0.01, 0.1)
        assert got[k] == pytest.approx([*v, b])


def test_fit_across_arrow_batches(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), i, rng.normal(size=2 + (k == 3)).tolist(), float(rng.choice([-1, 0, 1, 5]))) for i, k in enumerate(np.sort(rng.integers(0, 6, 400)))]
    rows += [(7, 1000, None, 1.0), (7, 1001, [1.0], None), (8, 1002, [1.0], 1.0), (8, 1003, [1.0, 2.0], 1.0)]
    df = spark.createDataFrame(rows, "k int, i long, x array<double>, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r["k"]: r for r in learners.fit_in_order(df, ["k"], "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {r[0] for r in rows}:
        w, n = None, 0
        for _, _, x, y in (r for r in rows if r[0] == k):
            target = learners._normal("PA", y)
            if x is None or target is None:
                continue
            w = np.zeros(len(x) + 1) if w is None else w
            if len(x) == len(w) - 1:
                v, b = learners._step("PA", np.array(x), target, w[:-1], w[-1], 0.01, 0.0)
                w, n = np.append(v, b), n + 1
        assert got[k]["fitted"] == n and [*got[k]["w"], got[k]["b"]] == pytest.approx([0.0] if w is None else w.tolist())


def test_buffers(spark):
    df = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(3 + b)], "b int, i long").withColumn("k", F.lit(0))
    merged = workers.interleaved(df, ["k"], "b", "i").orderBy("place").collect()
    assert [(r["b"], r["i"]) for r in merged] == [(1, 0), (2, 0), (1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3), (2, 4)]
    for some in (workers.random_out, workers.oldest_out):
        assert sorted(map(tuple, some(df, ["b"], "i", 2).groupBy("b").count().collect())) == [(1, 2), (2, 2)]
    kept = workers.reservoir(df.where("b = 2"), "i", 2).where("kept")
    assert kept.count() == 2 and workers.reservoir(df.limit(0), "i", 2).count() == 0


def test_sparse_orders_make_full_blocks(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id * 1000000007 AS o")
    got = with_position(df, ["k"], "o", block=64).selectExpr("k", "o", "position").collect()
    assert all(r["position"] == r["o"] // 1000000007 // 2 for r in got)
