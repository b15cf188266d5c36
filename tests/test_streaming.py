import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom import __main__ as cli
from tideloom.operators import online, serve
from tideloom.plans.catalog import e_texts
from tideloom.plans.pipeline import Pipeline
from tideloom.sources import records
from tideloom.sources.storage import fresh
from tideloom.streaming import catalog
from tideloom.streaming.job import Job, Parameters

SMALL = {"training_configuration": {"mini_batch_size": 4, "mini_batches": 2}}
CREATE = {"id": 1, "request": "Create", "learner": {"name": "PA"}} | SMALL


def texts(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def point(i, x, y=None, operation="training"):
    return {"id": i, "operation": operation, "numericFeatures": x, "target": y}


def some_points(n, seed=1, width=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return [(i, x[i].tolist(), None if i % 11 == 5 else float(x[i, 0] > 0.1)) for i in range(n)]


class Naive:
    """The job's rules for one pipeline, point by point, without NumPy vectors or tables."""

    def __init__(self, request, workers, refresh=6, capacity=500):
        self.made, self.p, self.refresh, self.capacity = Pipeline.from_request(request), workers, refresh, capacity
        self.kind, self.g, self.served, self.tests = self.made.learner.name, None, None, []
        self.local, self.base = [None] * workers, [None] * workers
        self.seen, self.taken, self.learned, self.pushes0, self.fitted = [0] * workers, [0] * workers, [0] * workers, 0, 0
        self.count, self.sums, self.squares = 0, None, None

    def features(self, x, learn):
        for part in self.made.preprocessors:
            if type(part).__name__ == "PolynomialFeatures":
                held = list(x)
                for _ in range(part.degree - 1):
                    held = held + [a * b for a in held for b in x]
                x = held
            else:
                if learn:
                    self.count += 1
                    self.sums = [0.0] * len(x) if self.sums is None else self.sums
                    self.squares = [0.0] * len(x) if self.squares is None else self.squares
                    self.sums = [a + b for a, b in zip(self.sums, x)]
                    self.squares = [a + b * b for a, b in zip(self.squares, x)]
                if self.count > 1:
                    mean = [a / self.count for a in self.sums]
                    var = [max(0.0, q / self.count - m * m) for q, m in zip(self.squares, mean)]
                    x = [(v - m) / s**0.5 if s > 1e-12 else 0.0 for v, m, s in zip(x, mean, var)]
        return [*x, 1.0]

    def point(self, i, x, y):
        k = i % self.p
        place = self.seen[k]
        self.seen[k] += 1
        if k == 0 and place % 10 >= 8:
            self.tests.append((online.mixed(i), i, x, y))
            if len(self.tests) <= self.capacity:
                return
            out = max(self.tests)
            self.tests.remove(out)
            _, _, x, y = out
        x = self.features(x, True)
        n = len(x)
        if self.local[k] is None:
            self.base[k] = self.local[k] = self.g or [0.0] * (n * n + n if self.kind == "ORR" else n)
        self.taken[k] += 1
        if y is not None and self.kind == "ORR":
            self.local[k] = [v + d for v, d in zip(self.local[k], [a * b for a in x for b in x] + [y * a for a in x])]
            self.learned[k] += 1
        elif y is not None:
            m = sum(a * b for a, b in zip(self.local[k], x))
            if self.kind == "PA":
                y = -1.0 if y == 0 else y
                sign, loss = y, 1 - y * m
            else:
                sign, loss = (1.0 if y >= m else -1.0), abs(y - m)
            t = max(0.0, loss) / (sum(a * a for a in x) + 50) * sign
            self.local[k] = [a + t * b for a, b in zip(self.local[k], x)]
            self.learned[k] += 1
        if self.made.config.protocol == "Synchronous":
            if sum(self.taken) == self.made.config.batch * self.p:
                for j in range(self.p):
                    self.push(j)
                self.base, self.local = [self.g] * self.p, [self.g] * self.p
        elif self.taken[k] == self.made.config.batch:
            self.push(k)
            self.base[k] = self.local[k] = self.g

    def push(self, k):
        start = self.base[k] if self.g is None else self.g
        self.g = [a + (b - c) / self.p for a, b, c in zip(start, self.local[k], self.base[k])]
        self.fitted += self.learned[k]
        self.taken[k] = self.learned[k] = 0
        if k == 0:
            self.pushes0 += 1
            if self.pushes0 % self.refresh == 0:
                self.served = self.g


REQUESTS = [
    CREATE,
    CREATE | {"preprocessors": [{"name": "PolynomialFeatures", "hyperparameters": {"degree": 3}}], "learner": {"name": "regressorPA"}},
    CREATE | {"preprocessors": [{"name": "StandardScaler"}, {"name": "PolynomialFeatures"}], "learner": {"name": "ORR"}},
    CREATE | {"protocol": "Synchronous"},
]


@pytest.mark.parametrize("request_of, cuts", [(REQUESTS[0], (1, 7, 130, 131)), *[(r, (170,)) for r in REQUESTS[1:]]])
def test_a_stream_in_any_batches_is_the_naive_loop(spark, request_of, cuts):
    rows = some_points(300)
    naive = Naive(request_of, 3, refresh=2, capacity=5)
    for i, x, y in rows:
        naive.point(i, x, y)
    job = Job(spark, fresh(spark, "job"), Parameters(parallelism=3, refresh=2, test_capacity=5))
    job.on_requests(texts(spark, [request_of]), 0)
    edges = [0, *[c for c in cuts if c < 300], 300]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        job.on_records(texts(spark, [point(*r) for r in rows[low:high]]), n)
    state = job.states().first()
    assert state["model"] == pytest.approx(naive.g, abs=1e-9) and state["fitted"] == naive.fitted and state["served"] == pytest.approx(naive.served, abs=1e-9)
    assert sorted(t["ord"] for t in state["tests"]) == sorted(t[1] for t in naive.tests) and len(naive.tests) == 5
    assert list(state["learned"]) == naive.learned and state["local"][1] == pytest.approx(naive.local[1], abs=1e-9)
    sent = job.written("messages").orderBy(F.desc("number")).first()
    assert sent["params"] == pytest.approx(naive.g, abs=1e-9) and sent["op"] == 1


def test_repeated_batch_changes_nothing(spark, sf_dir):
    job = Job(spark, fresh(spark, "job"), Parameters(parallelism=2))
    job.on_requests(texts(spark, [CREATE]), 0)
    each = e_texts(spark, sf_dir).select("value")
    seen = []
    for n in (0, 1, 1):
        job.on_records(each, n)
        seen.append((job.states().first(), job.written("predictions").count(), job.written("messages").count()))
    assert seen[1] == seen[2] and seen[0] != seen[1]


def test_requests_make_query_and_delete_pipelines(spark):
    job = Job(spark, fresh(spark, "job"), Parameters(parallelism=2))
    wrong = [CREATE | {"id": 5, "learner": {"name": "NoSuch"}}, CREATE | {"id": 6, "learner": {"name": "PA", "hyperparameters": {"C": "x"}}}, CREATE | {"id": 7, "preprocessors": [{"name": "Other"}]}]
    job.on_requests(texts(spark, [CREATE, *wrong, "{broken", CREATE | {"id": 2, "preprocessors": [{"name": "StandardScaler"}]}]), 0)
    assert sorted(r["id"] for r in job.registry().collect()) == [1, 2] and job.written("rejected").count() == 4
    rows = [point(i, [float((-1) ** i * 2), 1.0], float((-1) ** i)) for i in range(160)]
    job.on_records(texts(spark, rows), 0)
    ask = lambda i, number, verb="Query": {"id": i, "request": verb, "requestId": number}
    job.on_requests(texts(spark, [ask(1, 10), ask(2, 11), ask(3, 12), CREATE | {"request": "Update"}]), 1)
    got = {r["responseId"]: r for r in job.written("responses").collect()}
    assert set(got) == {10, 11} and got[10]["score"] == 1.0 and got[10]["dataFitted"] > 50
    told = json.loads(got[11]["value"])
    assert told["protocol"] == "Asynchronous" and told["preprocessors"][0]["parameters"]["count"] > 100 and len(told["learner"]["parameters"]["a"]) == 2
    # a Delete has no requestId; the same id made again starts from nothing
    job.on_requests(texts(spark, [{"id": 1, "request": "Delete"}, ask(1, 13)]), 2)
    assert [r["id"] for r in job.registry().collect()] == [2] and job.written("responses").where("responseId = 13").count() == 0
    job.on_records(texts(spark, [point(500, [1.0, 1.0], 1.0)]), 1)
    assert [r["pipeline"] for r in job.states().collect()] == [2]
    job.on_requests(texts(spark, [{"id": 2, "request": "Delete"}, CREATE | {"id": 2}, ask(2, 14)]), 3)
    assert json.loads(job.written("responses").where("responseId = 14").first()["value"])["dataFitted"] == 0
    job.on_records(texts(spark, [point(501, [1.0, 1.0], 1.0)]), 2)
    assert [(r["pipeline"], sum(r["seen"])) for r in job.states().collect()] == [(2, 1)]


def test_records_wait_for_a_pipeline_and_forecasts_for_a_model(spark):
    job = Job(spark, fresh(spark, "job"), Parameters(parallelism=1, refresh=1))
    rows = [point(i, [float((-1) ** i), 1.0], float((-1) ** i)) for i in range(4)]
    job.on_records(texts(spark, [*rows, point(100, [1.0, 1.0], operation="forecasting")]), 0)
    assert job.states() is None and job.written("parked").count() == 5
    job.on_requests(texts(spark, [CREATE]), 0)
    job.on_records(texts(spark, [point(101, [-1.0, 1.0], operation="forecasting")]), 1)
    assert job.written("predictions").count() == 0 and sum(job.states().first()["seen"]) == 4
    more = [point(i, [float((-1) ** i), 1.0], float((-1) ** i)) for i in range(4, 30)]
    job.on_records(texts(spark, more), 2)
    told = [json.loads(r["value"]) for r in job.written("predictions").select("value").collect()]
    assert sorted((t["dataPoint"]["id"], t["mlPipeline"], t["prediction"]) for t in told) == [(100, 1, 1.0), (101, 1, 0.0)]
    job.on_records(texts(spark, [point(102, [1.0], operation="forecasting")]), 3)
    last = json.loads(job.written("predictions").where("version = 3").first()["value"])
    assert last.get("prediction") is None


def test_newest_of_the_cache_stay(spark):
    job = Job(spark, fresh(spark, "job"), Parameters(cache=3))
    job.on_records(texts(spark, [point(i, [1.0], 1.0) for i in range(9)]), 0)
    assert sorted(r["record"]["id"] for r in job.written("parked").collect()) == [6, 7, 8]


def test_sentinels(spark):
    job = Job(spark, fresh(spark, "job"), Parameters(parallelism=1, refresh=1, sentinel=True))
    job.on_requests(texts(spark, [CREATE, {"id": 1, "request": "Query", "requestId": 3}]), 0)
    assert job.written("responses").first()["score"] == serve.NO_SCORE
    rows = [point(i, [float((-1) ** i), 1.0], float((-1) ** i)) for i in range(30)]
    job.on_records(texts(spark, [*rows, point(99, [1.0], operation="forecasting")]), 0)
    assert json.loads(job.written("predictions").first()["value"])["prediction"] == serve.NO_PREDICTION


def test_predictions_by_key_are_those_by_broadcast(spark):
    job = Job(spark, fresh(spark, "job"), Parameters(parallelism=2, refresh=1))
    job.on_requests(texts(spark, [r | {"id": i} for i, r in enumerate(REQUESTS, 1)]), 0)
    job.on_records(texts(spark, [point(*r) for r in some_points(200)]), 0)
    data = spark.createDataFrame([(i, x) for i, x, _ in some_points(50, seed=2)] + [(90, [1.0]), (91, None)], "i long, x array<double>")
    one = online.predict(data, job.states()).select("i", "pipeline", F.round("prediction", 9).alias("p")).collect()
    two = online.predict(data, job.states(), largest=0, rows_each=9).select("i", "pipeline", F.round("prediction", 9).alias("p")).collect()
    assert len(one) == 52 * 4 and sorted(map(repr, one)) == sorted(map(repr, two))


def test_standing_pipelines_clear_and_merge():
    spec = json.dumps(CREATE)
    one, two = (online.Standing(1, "0-1", spec, p) for p in (2, 3))
    for i, x, y in some_points(100):
        one.learn(i, x, y)
        two.learn(i, x, y)
    both = one.merge(two)
    assert both.fitted == one.fitted + two.fitted and both.workers == 3 and both.model is two.model and both.local == [None] * 3
    both.learn(1000, [0.1, 0.2], 1.0)
    assert both.base[1000 % 3] is two.model and one.clear().seen == [0, 0]
    row = online.Standing.of(one.row(), 2).row()
    assert json.dumps(row) == json.dumps(one.row())


def test_command_line(spark, tmp_path):
    rows = [point(*r) for r in some_points(120)]
    asked = [point(500 + i, [0.5, 0.5], operation="forecasting") for i in range(5)]
    for name, each in (("training", rows), ("forecasting", asked), ("requests", [{"requests": [CREATE, CREATE | {"id": 2}]}])):
        texts(spark, each).coalesce(1).write.text(str(tmp_path / name))
    given = cli.parse(["--trainingData", str(tmp_path / "training"), "--forecastingData", str(tmp_path / "forecasting"), "--requests", str(tmp_path / "requests"),
                       "--root", str(tmp_path / "job"), "--parallelism", "2", "--refresh", "1"])
    job = cli.run(spark, given)
    assert job.written("predictions").count() == 10 and job.set.parallelism == 2
    for bad in (["--root"], ["--nothing", "1"], ["root", "x"], [], ["--root", "x", "--parallelism", "many"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)


def test_order_of_requests_in_files(spark, tmp_path):
    many = [{"id": 1, "request": v, "learner": {"name": "PA"}} for v in ["Create", "Delete"] * 40 + ["Create"]]
    texts(spark, many).coalesce(1).write.text(str(tmp_path / "requests"))
    placed = records.placed(records.text_static(spark, str(tmp_path / "requests")))
    got = records.requests(placed, keep=["place"]).orderBy("place").select("request").collect()
    assert [r["request"] for r in got] == [m["request"] for m in many]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_against_sql(spark, sf_dir, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name])
