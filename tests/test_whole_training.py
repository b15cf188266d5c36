"""Training on all records, against brute force."""

import numpy as np
import pandas as pd
import pytest

from tideloom.operators import learners, server
from tideloom.plans import catalog


@pytest.fixture(scope="module")
def few_events(spark, tmp_path_factory):
    """3,000 events in a folder of their own, and the same rows with x and y."""
    rng = np.random.default_rng(3)
    ids = np.arange(3000)
    rows = pd.DataFrame({"event_id": ids, "user_id": ids % 17, "event_type": rng.choice(["purchase", "view"], 3000), "value": rng.uniform(0, 300, 3000).round(2)})
    rows["ts"] = pd.Timestamp("2024-01-01")
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows).write.parquet(f"{folder}/events.parquet")
    rows["x"] = [np.array([v / 100.0, i % 7 / 7.0]) for v, i in zip(rows["value"], ids)]
    rows["y"] = np.where(rows["event_type"] == "purchase", 1.0, -1.0)
    return folder, rows


def fold(points, target, w=None):
    w = np.zeros(3) if w is None else w.copy()
    for x, y in zip(points["x"], points[target]):
        x = np.append(x, 1.0)
        m = float(x @ w)
        sign, loss = (y, 1 - y * m) if target == "y" else (1.0 if y >= m else -1.0, abs(y - m))
        w += max(loss, 0.0) / (float(x @ x) + 50) * sign * x
    return w


def two_folds(rows):
    training = rows[rows["event_id"] % 10 < 8]
    return {1: fold(training, "y"), 2: fold(training, "value")}


def expected(rows):
    models, test = two_folds(rows), rows[rows["event_id"] % 10 >= 8]
    margin = lambda k, x: float(np.append(x, 1.0) @ models[k])
    return {(i, k): float(margin(k, x) >= 0) if k == 1 else margin(k, x) for i, x in zip(test["event_id"], test["x"]) for k in (1, 2)}


def test_predictions_use_all_training_records(spark, few_events):
    folder, rows = few_events
    want = expected(rows)
    got = {(r["event_id"], r["pipeline"]): r["prediction"] for r in catalog.QUERIES["predict_all_pipelines"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=2e-5)
    told = catalog.QUERIES["prediction_json"](spark, folder).collect()
    assert {(r["id"], r["pipeline"]): r["prediction"] for r in told} == pytest.approx(want, abs=2e-5)


def test_responses_count_all_training_records(spark, few_events):
    folder, rows = few_events
    want, test = expected(rows), rows[rows["event_id"] % 10 >= 8]
    met = np.mean([want[i, 1] == (y > 0) for i, y in zip(test["event_id"], test["y"])])
    off = np.sqrt(np.mean([(want[i, 2] - v) ** 2 for i, v in zip(test["event_id"], test["value"])]))
    got = {r["id"]: (r["data_fitted"], r["score"]) for r in catalog.QUERIES["query_response"](spark, folder).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 2400, 2: 2400}
    assert [got[1][1], got[2][1]] == pytest.approx([met, off], abs=2e-5)


def test_parameter_server_takes_every_round(spark, few_events):
    folder, rows = few_events
    rows = rows.assign(worker=rows["event_id"] // 3 % 4)
    rows["position"] = rows.groupby("worker").cumcount()
    rows = rows[(rows["worker"] != 0) | (rows["position"] % 10 < 8)].copy()
    rows["round"] = rows.groupby("worker").cumcount() // 256
    w, want = np.zeros(3), {}
    for r in range(rows["round"].max() + 1):
        parts = {k: part for k, part in rows[rows["round"] == r].groupby("worker")}
        moved = {k: fold(part, "y", w) - w for k, part in parts.items()}
        want |= {(r, k): [*moved[k], len(parts[k])] for k in parts}
        w = w + sum(moved.values()) / 4
    assert rows["round"].max() == 2
    got = {(r["round"], r["worker"]): [r["d0"], r["d1"], r["d2"], r["fitted"]] for r in catalog.QUERIES["ps_delta"](spark, folder).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6)
    for name in ("ps_average", "ps_all_rounds"):
        last = catalog.QUERIES[name](spark, folder).collect()
        assert [tuple(r)[-1] for r in last] == [len(rows)]
        assert [last[0][c] for c in ("w0", "w1", "b")] == pytest.approx(w.tolist(), abs=2e-6)


def test_rounds_cost_no_jobs_of_their_own(spark):
    """120 rounds of two pipelines in the jobs of one, whatever the batches; also after fewer rounds and without what can't be learned from."""
    rng = np.random.default_rng(5)
    rows = [(k, int(i) // 12, int(i) % 3, int(i), rng.normal(size=2).tolist(), float(rng.choice([-1, 0, 1]))) for k in (None, 7) for i in range(1440)]
    odd = [(7, 0, 0, -1, [1.0], 1.0), (7, 0, 0, -2, None, 1.0), (7, 0, 0, -3, [1.0, None], 1.0), (7, 0, 0, -4, [1.0, 1.0], 5.0), (7, 0, 0, -5, [1.0, 1.0], None)]
    points = spark.createDataFrame(rows + odd, "pipeline long, round int, worker int, id long, x array<double>, y double").repartition(3).cache()
    frame = pd.DataFrame(rows, columns=["pipeline", "round", "worker", "id", "x", "y"])
    frame["y"] = frame["y"].replace(0.0, -1.0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n_rounds, size in ((120, "7"), (3, "10000")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.sparkContext.setJobGroup("rounds", "rounds")
        try:
            got = server.train_rounds(points, ["pipeline"], "id", 2, 3, n_rounds).collect()
            jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < len(jobs) <= 6
        assert {r["pipeline"]: r["fitted"] for r in got} == {k: n_rounds * 12 for k in (None, 7)}
        for r in got:
            w = np.zeros(3)
            own = frame[frame["pipeline"].isna() if r["pipeline"] is None else frame["pipeline"] == r["pipeline"]]
            for n in range(n_rounds):
                w = w + sum(fold(part, "y", w) - w for _, part in own[own["round"] == n].groupby("worker")) / 3
            assert r["v"] == pytest.approx(w.tolist(), abs=1e-9)


@pytest.mark.parametrize("kind", ["PA", "regressorPA"])
def test_narrow_and_wide_rows_fold_alike(kind, monkeypatch):
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(size=(300, 4)), rng.choice([-1.0, 1.0], 300), rng.normal(size=5)
    narrow = learners.fold_rows(kind, x, y, w, 0.01, 0.1)
    monkeypatch.setattr(learners, "NARROW", 0)
    assert learners.fold_rows(kind, x, y, w, 0.01, 0.1) == pytest.approx(narrow, abs=1e-12)
