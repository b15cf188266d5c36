"""Streaming queries over ``events`` rendered as JSON texts, with their results in SQL as folds over ordered lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.plans.catalog import EREC, R, e_texts, r6, r_requests
from tideloom.sources import records
from tideloom.sources.storage import fresh

from .job import Job, Parameters

WORKERS, BATCH = 4, 256
PLAIN = {"id": 2, "request": "Create", "learner": {"name": "PA", "hyperparameters": {"C": 0.01}}, "protocol": "Asynchronous"}
OFTEN = PLAIN | {"training_configuration": {"mini_batch_size": 64, "mini_batches": 1}}
SQUARES = PLAIN | {"id": 1, "preprocessors": [{"name": "PolynomialFeatures", "hyperparameters": {"degree": 2}}]}


def _ask(spark: SparkSession, job: Job, *requests: dict) -> None:
    path = fresh(spark, "requests")
    spark.createDataFrame([(json.dumps({"requests": list(requests)}),)], "value string").write.text(path)
    # a folder of its own, so that the checkpoint of another request stream doesn't hold it back
    job.on_requests(records.text_static(spark, path), len(job.versions_of("registry")))


def _halves(spark: SparkSession, sf_dir: str, root: str, *requests: dict) -> Job:
    """A job that takes the first half of the records, is stopped, and goes on with the second half from its checkpoint."""
    texts, path = e_texts(spark, sf_dir), fresh(spark, "records")
    last = texts.agg(F.max("id")).first()[0]
    late = F.col("id") * 2 >= (last or 0) + 1
    for half in (~late, late):
        texts.where(half).select("value").write.mode("append").text(path)
        job = Job(spark, root, Parameters(parallelism=WORKERS))
        if requests:
            _ask(spark, job, *requests)
            requests = ()
        job.run_available("text", path)
    return job


def stream_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of both halves: forecasts that came before the first model was served have waited for it."""
    job = _halves(spark, sf_dir, fresh(spark, "job"), OFTEN)
    parsed = job.written("predictions").withColumn("p", F.from_json("value", records.PREDICTION))
    return parsed.select(F.col("p.mlPipeline").alias("pipeline"), F.col("p.dataPoint.id").alias("id"), F.col("p.prediction").alias("prediction"))


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global model of a job that was stopped half way and started again on the same checkpoint."""
    states = _halves(spark, sf_dir, fresh(spark, "job"), PLAIN).states()
    each = states.where("model IS NOT NULL").select("fitted", F.posexplode("model").alias("pos", "x"))
    return each.withColumn("x", r6(F.col("x")))


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parameter server sent: the global model after each push."""
    sent = _halves(spark, sf_dir, fresh(spark, "job"), PLAIN).written("messages")
    return sent.select("worker", "op", "number", "fitted", *[r6(F.get("params", F.lit(i))).alias(f"w{i}") for i in range(3)])


def stream_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipelines made by requests, one of them with squares, and what each answers to a query after all records."""
    job = _halves(spark, sf_dir, fresh(spark, "job"), SQUARES, PLAIN)
    _ask(spark, job, *[{"id": i, "request": "Query", "requestId": 10 + i} for i in (1, 2, 3)])
    out = job.written("responses")
    part = lambda path: F.get_json_object("value", f"$.{path}")
    return out.select(
        "responseId", "id", "protocol", "dataFitted", F.round("score", 5).alias("score"), part("learner.name").alias("learner"),
        F.coalesce(part("preprocessors[0].name"), F.lit("")).alias("preprocessor"), r6(part("learner.parameters.b").cast("double")).alias("b"),
    )


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON in two files, one to a micro-batch: which pipelines stand, and how many queries of each were answered."""
    text = F.concat(
        F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "request": "'), "request", F.lit('", '),
        F.when(F.col("request") == "Query", F.concat(F.lit('"requestId": '), F.col("seq").cast("string"), F.lit(", "))).otherwise(""),
        F.lit('"learner": {"name": "'), F.when(F.col("seq") % 9 == 4, "Oracle").otherwise("PA"), F.lit('"}}'),
    )
    rows, path = r_requests(spark, sf_dir).withColumn("value", text), fresh(spark, "requests")
    last, job = rows.agg(F.max("seq")).first()[0] or 0, Job(spark, fresh(spark, "job"))
    for half in (F.col("seq") * 2 <= last, F.col("seq") * 2 > last):
        # lines keep their order within a file
        rows.where(half).coalesce(1).sortWithinPartitions("seq").select("value").write.mode("append").text(path)
        job.run_available("text", path, what="requests")
    answered = job.written("responses").groupBy("id").agg(F.count(F.lit(1)).alias("answered"))
    both = job.registry().select("id", F.lit(True).alias("standing")).join(answered, "id", "full")
    return both.select("id", F.coalesce("standing", F.lit(False)).alias("standing"), F.coalesce("answered", F.lit(0)).alias("answered"))


# --- the same in SQL ----------------------------------------------------------------------------------------------


def fold_sql(name: str, features: str, width: int, batch: int = BATCH) -> str:
    """CTEs: ``{name}_p``, the training points; ``{name}``, one row with the state after all of them (held-out ones apart).

    State: g global model; b, l each worker's start and local model; n points and m learned points in its mini-batch; f points
    of the global model; a those of it that worker 0 started from; u pushes of worker 0; s the model that predictors have;
    q the same after the first half; z all pushes.  It holds while no more points are held out than the reservoir takes.
    """
    zero = "[" + ", ".join(["0::DOUBLE"] * (width + 1)) + "]"
    each, none = "[" + ", ".join([zero] * WORKERS) + "]", "[" + ", ".join(["0::BIGINT"] * WORKERS) + "]"
    fresh_state = f"g: {zero}, b: {each}, l: {each}, n: {none}, m: {none}, f: 0::BIGINT, a: 0::BIGINT, u: 0, s: NULL::DOUBLE[], q: NULL::DOUBLE[], z: []::STRUCT(worker INT, fitted BIGINT, w DOUBLE[])[]"
    mine = "i = p.k + 1"
    moved = "list_transform(p.x, lambda v, i: s.l[p.k + 1][i] + v * coalesce(greatest(1 - p.y * list_dot_product(s.l[p.k + 1], p.x), 0) / (list_dot_product(p.x, p.x) + 50) * p.y, 0))"
    pushed = f"CASE WHEN s.n[p.k + 1] = {batch - 1} THEN list_transform(s.g, lambda v, i: v + (w[i] - s.b[p.k + 1][i]) / {WORKERS}) END"
    served = "CASE WHEN g IS NOT NULL AND p.k = 0 AND (s.u + 1) % 6 = 0 THEN g ELSE s.s END"
    count = "s.f + CASE WHEN g IS NULL THEN 0 ELSE s.m[p.k + 1] + CASE WHEN p.y IS NULL THEN 0 ELSE 1 END END"
    return f"""{name}_o AS (SELECT id, (id % {WORKERS})::INT AS k, {features} AS x, target AS y, id * 2 >= (SELECT max(event_id) + 1 FROM events) AS late,
  row_number() OVER (PARTITION BY id % {WORKERS} ORDER BY id) - 1 AS place FROM r WHERE operation = 'training' AND NOT discrete),
{name}_p AS (SELECT *, k = 0 AND place % 10 >= 8 AS held FROM {name}_o),
{name}_l AS (SELECT list_prepend({{k: 0, x: {zero}, y: NULL::DOUBLE, late: false, {fresh_state}}},
  coalesce(list({{k: k, x: x, y: y, late: late, {fresh_state}}} ORDER BY id), [])) AS ps FROM {name}_p WHERE NOT held),
{name} AS (SELECT unnest(list_reduce(ps, lambda s, p: list_transform([{moved}], lambda w: list_transform([{pushed}], lambda g: {{
  k: p.k, x: p.x, y: p.y, late: p.late, g: coalesce(g, s.g),
  b: list_transform(s.b, lambda v, i: CASE WHEN {mine} THEN coalesce(g, v) ELSE v END),
  l: list_transform(s.l, lambda v, i: CASE WHEN {mine} THEN coalesce(g, w) ELSE v END),
  n: list_transform(s.n, lambda v, i: CASE WHEN {mine} THEN CASE WHEN g IS NULL THEN v + 1 ELSE 0 END ELSE v END),
  m: list_transform(s.m, lambda v, i: CASE WHEN {mine} THEN CASE WHEN g IS NULL THEN v + CASE WHEN p.y IS NULL THEN 0 ELSE 1 END ELSE 0 END ELSE v END),
  f: {count}, a: CASE WHEN g IS NOT NULL AND p.k = 0 THEN {count} ELSE s.a END, u: s.u + CASE WHEN g IS NOT NULL AND p.k = 0 THEN 1 ELSE 0 END,
  s: {served}, q: CASE WHEN p.late THEN s.q ELSE {served} END,
  z: CASE WHEN g IS NULL THEN s.z ELSE list_append(s.z, {{worker: p.k, fitted: {count}, w: g}}) END}})[1])[1])) FROM {name}_l)"""


X2, X6 = "[x0, x1, 1]", "[x0, x1, x0 * x0, x0 * x1, x1 * x0, x1 * x1, 1]"
_PLAIN = f"WITH {EREC}, {fold_sql('st', X2, 2)}"


def _answer_sql(name: str, pipeline: int, preprocessor: str) -> str:
    return f"""SELECT {10 + pipeline}::BIGINT AS "responseId", {pipeline} AS id, 'Asynchronous' AS protocol, any_value(a + m[1])::BIGINT AS "dataFitted",
  round(avg(CASE WHEN (list_dot_product(l[1], p.x) >= 0) = (p.y > 0) THEN 1.0::DOUBLE ELSE 0 END), 5) AS score, 'PA' AS learner, '{preprocessor}' AS preprocessor,
  round(any_value(l[1][-1]), 6) + 0.0::DOUBLE AS b FROM {name}, (SELECT x, y FROM {name}_p WHERE held AND y IS NOT NULL) p"""


SQL = {
    "stream_train_predict": f"""WITH {EREC}, {fold_sql('st', X2, 2, 64)}, t AS (SELECT id, {X2} AS x, id * 2 >= (SELECT max(event_id) + 1 FROM events) AS late FROM r WHERE operation = 'forecasting'),
w AS (SELECT id, x, CASE WHEN late THEN s ELSE coalesce(q, s) END AS v FROM t, (SELECT s, q FROM st))
SELECT 2 AS pipeline, id, CASE WHEN list_dot_product(v, x) >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM w WHERE v IS NOT NULL""",
    "stream_restart": f"{_PLAIN} SELECT f AS fitted, unnest(range(3))::INT AS pos, round(unnest(g), 6) + 0.0::DOUBLE AS x FROM st WHERE f > 0",
    "stream_messages": f"""{_PLAIN}, e AS (SELECT unnest(z) AS e, unnest(range(1, len(z) + 1)) AS number FROM st)
SELECT e.worker, 1 AS op, number, e.fitted, {', '.join(f'round(e.w[{i + 1}], 6) + 0.0::DOUBLE AS w{i}' for i in range(3))} FROM e""",
    "stream_pipelines": f"""{_PLAIN}, {fold_sql('sx', X6, 6)}
{_answer_sql('sx', 1, 'PolynomialFeatures')} UNION ALL {_answer_sql('st', 2, '')}""",
    "stream_requests": f"""WITH {R.replace('FROM events)', 'FROM events WHERE event_id % 9 <> 4)', 1)}
SELECT id, coalesce(arg_max(request, seq) FILTER (request IN ('Create', 'Delete')) = 'Create', false) AS standing, count(*) FILTER (request = 'Query')::BIGINT AS answered
FROM f WHERE effective GROUP BY id HAVING standing OR answered > 0""",
}

QUERIES = {f.__name__: f for f in (stream_train_predict, stream_restart, stream_messages, stream_pipelines, stream_requests)}
