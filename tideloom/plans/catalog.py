"""Queries over the fixture tables, one per operator, with the same results in DuckDB SQL.

Fixtures: E, records from ``events`` (x = value / 100 and event_id mod 7 over 7; y = 1 for a purchase, else -1;
eight of ten are training records); L, regression rows from ``lineitem``; V, vectors from ``embeddings``; R, requests
from ``events`` (the event type names the verb).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.functions import linalg as la
from tideloom.functions import params as pa
from tideloom.functions.ordered import with_position
from tideloom.operators import control, learners, preprocess, serve, server, workers
from tideloom.plans.pipeline import Pipeline
from tideloom.sources import records
from tideloom.sources.storage import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
P = 4


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- fixtures ---------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


def e_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, x, y, value, operation)."""
    x = F.array(F.col("value") / 100.0, F.col("event_id") % 7 / 7.0)
    y = F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0)
    operation = F.when(F.col("event_id") % 10 < 8, "training").otherwise("forecasting")
    return events(spark, sf_dir).select("event_id", "user_id", x.alias("x"), y.alias("y"), "value", operation.alias("operation"))


E = """e AS (SELECT event_id, user_id, event_type, value, value / 100.0::DOUBLE AS x0, (event_id % 7) / 7.0::DOUBLE AS x1,
     CASE WHEN event_type = 'purchase' THEN 1.0 ELSE -1.0 END::DOUBLE AS y,
     CASE WHEN event_id % 10 < 8 THEN 'training' ELSE 'forecasting' END AS operation FROM events)"""


def e_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data records of E: views with an id that 5 divides have a discrete feature, sign-ups no target."""
    training = F.col("event_id") % 10 < 8
    y = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") != "signup", -1.0)
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.array(F.col("value") / 100.0, F.col("event_id") % 7 / 7.0).alias("numericFeatures"),
        F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), F.array(F.lit("view"))).alias("discreteFeatures"),
        F.when(training, y).alias("target"),
        F.when(training, "training").otherwise("forecasting").alias("operation"),
    )


EREC = """r AS (SELECT event_id AS id, value / 100.0::DOUBLE AS x0, (event_id % 7) / 7.0::DOUBLE AS x1,
     event_type = 'view' AND event_id % 5 = 0 AS discrete,
     CASE WHEN event_id % 10 < 8 THEN CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type <> 'signup' THEN -1.0 END END::DOUBLE AS target,
     CASE WHEN event_id % 10 < 8 THEN 'training' ELSE 'forecasting' END AS operation FROM events)"""


def e_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_records(spark, sf_dir).select("id", F.to_json(F.struct(*records.RECORD.names)).alias("value"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", la.as_doubles("embedding").alias("v"))


V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def r_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, request): twenty pipelines; purchases and sign-ups create."""
    verb = (
        F.when(F.col("event_type").isin("signup", "purchase"), "Create")
        .when(F.col("event_type") == "view", "Update")
        .when(F.col("event_type") == "click", "Query")
        .otherwise("Delete")
    )
    return events(spark, sf_dir).select((F.col("user_id") % 20).cast("int").alias("id"), F.col("event_id").alias("seq"), verb.alias("request"))


R = """q AS (SELECT (user_id % 20)::INT AS id, event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'Create'
     WHEN event_type = 'view' THEN 'Update' WHEN event_type = 'click' THEN 'Query' ELSE 'Delete' END AS request FROM events),
l AS (SELECT *, coalesce(last_value(CASE WHEN request IN ('Create', 'Delete') THEN request END IGNORE NULLS)
       OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'Create', false) AS registered FROM q),
f AS (SELECT id, seq, request, CASE WHEN request = 'Create' THEN NOT registered ELSE registered END AS effective FROM l)"""


# --- records ----------------------------------------------------------------------------------------------------


@query(f"""WITH {EREC} SELECT id, operation, target, round(x0, 6) AS x0, round(x1, 6) AS x1,
       CASE WHEN discrete THEN 1 ELSE 0 END::INT AS n_discrete FROM r""")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts to valid data records."""
    out = records.records(e_texts(spark, sf_dir))
    n = F.coalesce(F.size("discreteFeatures"), F.lit(0))
    return out.select("id", "operation", "target", r6(la.at("numericFeatures", 0)).alias("x0"), r6(la.at("numericFeatures", 1)).alias("x1"), n.alias("n_discrete"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 13 = 1 THEN 'invalid' ELSE 'valid' END AS fate FROM events""")
def parse_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut texts and unknown operations are told apart; extra fields don't hurt."""
    cut = F.when(F.col("id") % 13 == 0, F.substring("value", 1, 10)).when(
        F.col("id") % 13 == 1, F.regexp_replace("value", "training|forecasting", "sleeping")
    )
    extra = F.regexp_replace("value", r"^\{", '{"more": {"a": [1]}, ')
    parsed = records.parse(e_texts(spark, sf_dir).withColumn("value", F.coalesce(cut, extra)), records.RECORD)
    fate = F.when(records.record_valid(F.col("record")), "valid").when(F.col("record.operation").isNull(), "malformed").otherwise("invalid")
    return parsed.select("id", fate.alias("fate"))


@query(f"WITH {EREC} SELECT id, round(x0, 6) AS x0, round(x1, 6) AS x1, target AS y FROM r WHERE operation = 'training' AND NOT discrete")
def to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.points(e_records(spark, sf_dir))
    return out.select("id", r6(la.at("x", 0)).alias("x0"), r6(la.at("x", 1)).alias("x1"), "y")


@query("""SELECT p_partkey, (unnest(range(3)))::INT AS pos, unnest([p_size::DOUBLE, p_retailprice, p_partkey::DOUBLE]) AS x FROM part""")
def csv_to_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat_ws(",", "p_size", "p_retailprice", "p_partkey")
    return part.select("p_partkey", F.posexplode(records.csv_to_doubles(text)).alias("pos", "x"))


@query("""SELECT event_id AS id, event_id % 4 <> 3 AND event_id % 5 <> 4 AND NOT (event_id % 4 = 1 AND event_id % 3 = 0) AS valid FROM events""")
def record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation training, forecasting, none or unknown by id mod 4; no features if id mod 5 is 4; targets if 3 divides."""
    i = F.col("event_id")
    rec = F.struct(
        F.when(i % 5 != 4, F.array("value")).alias("numericFeatures"),
        F.lit(None).cast("array<string>").alias("discreteFeatures"),
        F.when(i % 3 == 0, F.lit(1.0)).alias("target"),
        F.element_at(F.array(*[F.lit(x) for x in ("training", "forecasting", "training", "resting")]), (i % 4 + 1).cast("int")).alias("operation"),
    )
    return events(spark, sf_dir).select(i.alias("id"), records.record_valid(rec).alias("valid"))


@query(f"""WITH {EREC} SELECT id, id % 13 <> 0 AND id % 11 <> 0 AS valid, 'trainingData' AS topic, (id % 36)::INT AS partition, id + 5 AS key, id * 2 AS position, 1700000000000 + id AS at,
       CASE WHEN id % 13 <> 0 AND id % 11 <> 0 THEN round(x0, 6) END AS x0 FROM r""")
def deserialize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a topic as bytes, with its metadata: records that are cut or of no known operation are null."""
    i = F.col("id")
    text = F.when(i % 13 == 0, F.substring("value", 1, 12)).when(i % 11 == 0, F.regexp_replace("value", "training|forecasting", "resting")).otherwise(F.col("value"))
    sent = e_texts(spark, sf_dir).select(
        "id", text.cast("binary").alias("value"), F.lit("trainingData").alias("topic"), (i % 36).cast("int").alias("partition"),
        F.unhex(F.lpad(F.hex(i + 5), 16, "0")).alias("key"), (i * 2).alias("offset"), F.timestamp_millis(F.lit(1700000000000) + i).alias("timestamp"),
    )
    got = records.deserialized(sent)
    return got.select(
        "id", F.col("record").isNotNull().alias("valid"), "metadata.topic", "metadata.partition", "metadata.key", F.col("metadata.offset").alias("position"),
        F.col("metadata.timestamp").alias("at"), r6(F.get("record.numericFeatures", F.lit(0))).alias("x0"),
    )


@query(f"""WITH {EREC} SELECT id, (id % 5)::INT AS pipeline, round(x0, 6) AS prediction, operation FROM r""")
def serialize_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as the bytes of messages, read back."""
    made = e_records(spark, sf_dir).select(
        records.as_bytes((F.col("id") % 5).cast("int").alias("mlPipeline"), F.struct(*records.RECORD.names).alias("dataPoint"), F.get("numericFeatures", F.lit(0)).alias("prediction")).alias("value")
    )
    back = made.select(F.from_json(F.col("value").cast("string"), records.PREDICTION).alias("p"))
    return back.select(F.col("p.dataPoint.id").alias("id"), F.col("p.mlPipeline").alias("pipeline"), r6(F.col("p.prediction")).alias("prediction"), "p.dataPoint.operation")


_CONFIGS = ["{}", '{"protocol": "Asynchronous"}', '{"protocol": "Gossip"}', '{"mini_batch_size": 64}', '{"mini_batch_size": 0}', '{"mini_batch_size": "x"}', '{"mini_batch_size": 2.0}']


@query(f"""WITH {R}, c AS (SELECT seq, request, seq % 7 AS k, seq % 3 = 0 AS learner, seq % 11 = 0 AS nameless, seq % 2 = 0 AS asked FROM q)
SELECT seq, (request <> 'Create' OR learner) AND (request <> 'Update' OR learner) AND NOT (learner AND nameless)
       AND k NOT IN (2, 4, 5) AND (request <> 'Query' OR asked) AND seq % 17 <> 0 AS valid FROM c""")
def request_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON with and without learner, name, requestId and sound configuration; id -1 if 17 divides."""
    i = F.col("seq")
    learner = F.when(i % 3 == 0, F.when(i % 11 == 0, F.lit('{"hyperparameters": {}}')).otherwise(F.lit('{"name": "PA", "hyperparameters": {"C": 1}}')))
    text = F.concat(
        F.lit('{"id": '), F.when(i % 17 == 0, F.lit("-1")).otherwise(F.col("id").cast("string")), F.lit(', "request": "'), "request", F.lit('"'),
        F.coalesce(F.concat(F.lit(', "learner": '), learner), F.lit("")),
        F.when(i % 2 == 0, F.concat(F.lit(', "requestId": '), i.cast("string"))).otherwise(""),
        F.lit(', "training_configuration": '), F.element_at(F.array(*[F.lit(c) for c in _CONFIGS]), (i % 7 + 1).cast("int")), F.lit("}"),
    )
    parsed = records.parse(r_requests(spark, sf_dir).withColumn("value", text), records.REQUEST)
    return parsed.select("seq", records.request_valid(F.col("record")).alias("valid"))


# --- control plane ----------------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT id, seq, request, effective FROM f")
def request_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.lifecycle(r_requests(spark, sf_dir))


@query(f"""WITH {R}, c AS (SELECT id, seq, request FROM f WHERE effective AND request IN ('Create', 'Delete'))
SELECT id, max(seq) AS created FROM c GROUP BY id HAVING arg_max(request, seq) = 'Create'""")
def request_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.registry(r_requests(spark, sf_dir))


_FAN = f"{R}, m AS (SELECT id, seq, request, unnest(range(CASE WHEN request = 'Query' THEN 1 ELSE {P} END))::INT AS worker FROM f WHERE effective)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fan_out(control.lifecycle(r_requests(spark, sf_dir)).where("effective").drop("effective"), P)


@query(f"WITH {_FAN} SELECT id, seq, request, worker FROM m")
def control_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir)


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter-server messages from events: pipeline by user, worker by id; every third is a pull."""
    i = F.col("event_id")
    return events(spark, sf_dir).select(
        (F.col("user_id") % 20).cast("int").alias("id"), i.alias("seq"), (F.floor(i / 3) % P).cast("int").alias("worker"), F.when(i % 3 == 0, 0).otherwise(1).alias("op")
    )


_UPD = f"""u AS (SELECT (user_id % 20)::INT AS id, event_id AS seq, (event_id // 3 % {P})::INT AS worker,
     CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END::INT AS op FROM events)"""
_SAMPLED = f"""s AS (SELECT id, seq, op, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM u WHERE worker = 0 AND op = 1),
k AS (SELECT id, seq, op, unnest(range({P}))::INT AS worker FROM s WHERE n % 6 = 0)"""


@query(f"WITH {_FAN}, {_UPD} SELECT id, seq, request, worker, -1 AS op FROM m UNION ALL SELECT id, seq, NULL, worker, op FROM u")
def control_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = control.control_union(_messages(spark, sf_dir), _updates(spark, sf_dir))
    return out.withColumn("op", F.coalesce("op", F.lit(-1)))


@query(f"WITH {_UPD}, {_SAMPLED} SELECT id, seq, op, worker FROM k")
def update_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.sampled_updates(_updates(spark, sf_dir), P, pipeline="id")


@query(f"WITH {_FAN}, {_UPD}, {_SAMPLED} SELECT id, seq, request, worker, -1 AS op FROM m WHERE request <> 'Query' UNION ALL SELECT id, seq, NULL, worker, op FROM k")
def predictor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = control.predictor_feed(_messages(spark, sf_dir), control.sampled_updates(_updates(spark, sf_dir), P, pipeline="id"))
    return out.withColumn("op", F.coalesce("op", F.lit(-1)))


# --- preprocessors ----------------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT event_id, unnest(range(6))::INT AS pos,
       unnest([round(x0, 6), round(x1, 6), round(x0 * x0, 6), round(x0 * x1, 6), round(x1 * x0, 6), round(x1 * x1, 6)]) AS value FROM e""")
def poly_degree2(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = e_points(spark, sf_dir).select("event_id", F.posexplode(preprocess.polynomial(F.col("x"), 2)).alias("pos", "value"))
    return wide.withColumn("value", r6(F.col("value")))


@query("""WITH f AS (SELECT [l_quantity / 10, l_discount] AS f FROM lineitem),
a AS (SELECT f, list_concat(f, flatten(list_transform(f, lambda s: list_transform(f, lambda t: s * t)))) AS d2 FROM f),
b AS (SELECT list_concat(d2, flatten(list_transform(d2, lambda s: list_transform(f, lambda t: s * t)))) AS d3 FROM a),
c AS (SELECT unnest(range(len(d3)))::INT AS pos, unnest(d3) AS x FROM b)
SELECT pos, count(*)::BIGINT AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS largest FROM c GROUP BY pos""")
def poly_degree3(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(F.col("l_quantity") / 10, F.col("l_discount"))
    wide = lineitem(spark, sf_dir).select(F.posexplode(preprocess.polynomial(x, 3)).alias("pos", "x"))
    return wide.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"), r6(F.max("x")).alias("largest"))


_L = ["l_quantity", "l_discount", "l_tax"]


@query("""SELECT count(*)::BIGINT AS n, """ + ", ".join(f"round(avg({f}), 6) AS mean_{f}, round(var_pop({f}), 6) AS var_{f}" for f in _L) + " FROM lineitem")
def scaler_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preprocess.moments(lineitem(spark, sf_dir), [], _L)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in out.columns if c != "n"])


@query(f"WITH {E}, s AS (SELECT avg(x0) AS m, stddev_pop(x0) AS d FROM e) SELECT event_id, round((x0 - m) / d, 5) + 0.0::DOUBLE AS z FROM e, s")
def scaler_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = e_points(spark, sf_dir).select("event_id", la.at("x", 0).alias("x0"))
    return preprocess.scale_batch(flat, ["x0"]).select("event_id", (F.round("z_x0", 5) + 0.0).alias("z"))


@query(f"""WITH {E}, s AS (SELECT event_id, user_id, x0, count(*) OVER w AS n, avg(x0) OVER w AS m, var_pop(x0) OVER w AS v FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n = 1 THEN x0 WHEN v > 1e-13 THEN (x0 - m) / sqrt(v) ELSE 0 END, 4) + 0.0::DOUBLE AS z FROM s""")
def scaler_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = e_points(spark, sf_dir).select("event_id", "user_id", la.at("x", 0).alias("x0"))
    return preprocess.scale_running(flat, ["user_id"], "event_id", ["x0"]).select("event_id", (F.round("z_x0", 4) + 0.0).alias("z"))


@query(f"""WITH {E}, a AS (SELECT user_id, avg(x0) AS m, var_pop(x0) AS v, count(*) AS n FROM e GROUP BY user_id)
SELECT user_id, n::BIGINT AS n, round(m, 6) AS mean, round(v, 6) AS variance FROM a""")
def scaler_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of training and forecasting records, merged: as if fitted on all."""
    flat = e_points(spark, sf_dir).select("user_id", "operation", la.at("x", 0).alias("x0"))
    state = lambda o: preprocess.moments(flat.where(F.col("operation") == o), ["user_id"], ["x0"])
    part = lambda df, n: df.select("user_id", F.struct("n", "mean_x0", "var_x0").alias(n))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean_x0"), F.lit(0.0).alias("var_x0"))
    both = part(state("training"), "a").join(part(state("forecasting"), "b"), "user_id", "full")
    both = both.select("user_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    out = both.select("user_id", *preprocess.merged(["x0"]))
    return out.select("user_id", "n", r6(F.col("mean_x0")).alias("mean"), r6(F.col("var_x0")).alias("variance"))


# --- workers ----------------------------------------------------------------------------------------------------


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.assigned(e_points(spark, sf_dir), P, F.floor(F.col("event_id") / 3))


_W = f"{E}, a AS (SELECT *, (event_id // 3 % {P})::INT AS worker FROM e)"


@query(f"WITH {_W} SELECT worker, count(*)::BIGINT AS n, min(event_id) AS first, max(event_id) AS last FROM a GROUP BY worker")
def worker_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


_H = f"{_W}, h AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY event_id) - 1 AS position FROM a), g AS (SELECT *, worker = 0 AND position % 10 >= 8 AS held FROM h)"


@query(f"WITH {_H} SELECT event_id, worker, position, held FROM g")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.holdout(_assigned(spark, sf_dir), "event_id").select("event_id", "worker", "position", "held")


_RND = f"{_H}, t AS (SELECT *, ((row_number() OVER (PARTITION BY worker ORDER BY event_id) - 1) // 256)::INT AS round FROM g WHERE NOT held)"


@query(f"WITH {_RND} SELECT event_id, worker, round FROM t")
def minibatch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = workers.holdout(_assigned(spark, sf_dir), "event_id").where("NOT held")
    return workers.rounds(training, "event_id").select("event_id", "worker", "round")


@query(f"""WITH {_H}, m AS (SELECT event_id, ((event_id % 2147483648) * 1103515245 + 12345) % 2147483648 AS hsh FROM g WHERE held)
SELECT event_id, row_number() OVER (ORDER BY hsh) <= 500 AS kept FROM m""")
def test_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = workers.holdout(_assigned(spark, sf_dir), "event_id").where("held").select("event_id")
    return workers.reservoir(held, "event_id")


@query(f"""WITH {_W}, n AS (SELECT event_id, worker, row_number() OVER (PARTITION BY worker ORDER BY event_id DESC) AS k FROM a)
SELECT event_id, worker FROM n WHERE k <= 300""")
def buffer_oldest_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.oldest_out(_assigned(spark, sf_dir).select("event_id", "worker"), ["worker"], "event_id", 300)


@query(f"""WITH {_W}, n AS (SELECT event_id, worker, row_number() OVER (PARTITION BY worker ORDER BY (event_id % 2147483648 * 1103515245 + 12345) % 2147483648 DESC) AS k FROM a)
SELECT event_id, worker FROM n WHERE k <= 300""")
def buffer_random_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.random_out(_assigned(spark, sf_dir).select("event_id", "worker"), ["worker"], "event_id", 300)


@query(f"""WITH {_W}, n AS (SELECT event_id, user_id, worker, row_number() OVER (PARTITION BY user_id, worker ORDER BY event_id) AS k FROM a)
SELECT event_id, user_id, worker, row_number() OVER (PARTITION BY user_id ORDER BY k, worker) - 1 AS place FROM n""")
def buffers_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workers' buffers of each user, merged turn by turn."""
    return workers.interleaved(_assigned(spark, sf_dir).select("event_id", "user_id", "worker"), ["user_id"], "worker", "event_id")


# --- learners ---------------------------------------------------------------------------------------------------


def _fold_sql(kind: str, source: str, key: str, order: str, target: str, name: str = "m", start: str | None = None) -> str:
    """CTEs: ordered rows, then the fold as a recursion; ``name`` holds (key, rn, w0, w1, b) after each row."""
    if kind == "PA":
        tau = "greatest(1 - y * (w0 * x0 + w1 * x1 + b), 0) / (x0 * x0 + x1 * x1 + 51) * y"
    else:
        tau = "greatest(abs(y - (w0 * x0 + w1 * x1 + b)), 0) / (x0 * x0 + x1 * x1 + 51) * CASE WHEN y - (w0 * x0 + w1 * x1 + b) >= 0 THEN 1 ELSE -1 END"
    zero = start or f"SELECT DISTINCT {key}, 0::BIGINT AS rn, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS b FROM {name}_o"
    return f"""{name}_o AS (SELECT {key}, x0, x1, {target} AS y, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
{name} AS ({zero} UNION ALL SELECT {key}, rn, w0 + t * x0, w1 + t * x1, b + t FROM (
  SELECT o.{key.replace(', ', ', o.')}, o.rn, w0, w1, b, x0, x1, {tau} AS t FROM {name} m JOIN {name}_o o USING ({key}) WHERE o.rn = m.rn + 1)),
{name}_last AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY rn DESC) = 1)"""


_TRAIN = f"{E}, tr AS (SELECT * FROM e WHERE operation = 'training'), te AS (SELECT * FROM e WHERE operation = 'forecasting')"


def _fitted(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    e = e_points(spark, sf_dir)
    e = e.withColumn("y", F.col("value")) if kind == "regressorPA" else e
    return learners.fit_in_order(e.where("operation = 'training'"), ["user_id"], "event_id", kind), e.where("operation = 'forecasting'")


def _weights(models: DataFrame) -> DataFrame:
    return models.select("user_id", r6(la.at("w", 0)).alias("w0"), r6(la.at("w", 1)).alias("w1"), r6(F.col("b")).alias("b"), "fitted")


def _fit_sql(kind: str, target: str) -> str:
    return f"""WITH RECURSIVE {_TRAIN}, {_fold_sql(kind, 'tr', 'user_id', 'event_id', target)}
SELECT user_id, round(w0, 6) + 0.0::DOUBLE AS w0, round(w1, 6) + 0.0::DOUBLE AS w1, round(b, 6) + 0.0::DOUBLE AS b, rn AS fitted FROM m_last"""


@query(_fit_sql("PA", "y"))
def pa_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_fitted(spark, sf_dir, "PA")[0])


@query(f"""WITH RECURSIVE {_TRAIN}, {_fold_sql('PA', 'tr', 'user_id', 'event_id', 'y')}
SELECT event_id, CASE WHEN w0 * x0 + w1 * x1 + b >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM te JOIN m_last USING (user_id)""")
def pa_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, test = _fitted(spark, sf_dir, "PA")
    m = learners.margin(F.col("x"), F.col("w"), F.col("b"))
    return test.join(models, "user_id").select("event_id", learners.classify(m).alias("prediction"))


@query(f"""WITH RECURSIVE {_TRAIN}, {_fold_sql('PA', 'tr', 'user_id', 'event_id', 'y')}
SELECT user_id, round(avg(CASE WHEN (w0 * x0 + w1 * x1 + b >= 0) = (te.y > 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS score
FROM te JOIN m_last USING (user_id) GROUP BY user_id""")
def pa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, test = _fitted(spark, sf_dir, "PA")
    m = learners.margin(F.col("x"), F.col("w"), F.col("b"))
    return test.join(models, "user_id").groupBy("user_id").agg(r6(learners.accuracy(F.col("y"), m)).alias("score"))


@query(_fit_sql("regressorPA", "value"))
def par_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_fitted(spark, sf_dir, "regressorPA")[0])


@query(f"""WITH RECURSIVE {_TRAIN}, {_fold_sql('regressorPA', 'tr', 'user_id', 'event_id', 'value')}
SELECT event_id, round(w0 * x0 + w1 * x1 + b, 6) + 0.0::DOUBLE AS prediction FROM te JOIN m_last USING (user_id)""")
def par_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, test = _fitted(spark, sf_dir, "regressorPA")
    return test.join(models, "user_id").select("event_id", r6(learners.margin(F.col("x"), F.col("w"), F.col("b"))).alias("prediction"))


@query(f"""WITH RECURSIVE {_TRAIN}, {_fold_sql('regressorPA', 'tr', 'user_id', 'event_id', 'value')}
SELECT user_id, round(sqrt(avg((value - (w0 * x0 + w1 * x1 + b)) ** 2)), 6) AS score FROM te JOIN m_last USING (user_id) GROUP BY user_id""")
def par_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, test = _fitted(spark, sf_dir, "regressorPA")
    m = learners.margin(F.col("x"), F.col("w"), F.col("b"))
    return test.join(models, "user_id").groupBy("user_id").agg(r6(learners.rmse(F.col("y"), m)).alias("score"))


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity * l_quantity), 2) AS a_0_0, round(sum(l_quantity * l_discount), 2) AS a_0_1,
       round(sum(l_quantity), 2) AS a_0_2, round(sum(l_discount * l_discount), 2) AS a_1_1, round(sum(l_discount), 2) AS a_1_2,
       round(count(*)::DOUBLE, 2) AS a_2_2, round(sum(l_extendedprice / 1000 * l_quantity), 2) AS b_0,
       round(sum(l_extendedprice / 1000 * l_discount), 2) AS b_1, round(sum(l_extendedprice / 1000), 2) AS b_2 FROM lineitem GROUP BY l_returnflag""")
def ridge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000)
    sums = learners.ridge_sums(rows, ["l_returnflag"], ["l_quantity", "l_discount"], "y")
    return sums.select("l_returnflag", "n", *[F.round(c, 2).alias(c) for c in sums.columns if c[:2] in ("a_", "b_")])


def _ridge(rows: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    state = learners.ridge_state(learners.ridge_sums(rows, keys, features, target), len(features))
    return state.withColumn("w", learners.ridge_solution(0.0)(F.col("A"), F.col("b")))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept
FROM lineitem GROUP BY l_returnflag""")
def ridge_fit1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ridge(lineitem(spark, sf_dir), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    return out.select("l_returnflag", F.round(la.at("w", 0), 3).alias("slope"), F.round(la.at("w", 1), 2).alias("intercept"))


_CRAMER = """m AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my, var_pop(l_quantity) AS xx,
     var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy,
     covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem GROUP BY l_returnflag),
c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS p, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS q FROM m)"""


@query(f"WITH {_CRAMER} SELECT l_returnflag, round(p, 3) AS w0, round(q, 2) AS w1, round(my - p * mx - q * mz, 2) AS b FROM c")
def ridge_fit2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ridge(lineitem(spark, sf_dir), ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice")
    return out.select("l_returnflag", F.round(la.at("w", 0), 3).alias("w0"), F.round(la.at("w", 1), 2).alias("w1"), F.round(la.at("w", 2), 2).alias("b"))


@query(f"""WITH {_CRAMER} SELECT l_returnflag, round(sqrt(avg((l_extendedprice - (my + p * (l_quantity - mx) + q * (l_discount - mz))) ** 2)), 3) AS score
FROM lineitem JOIN c USING (l_returnflag) GROUP BY l_returnflag""")
def ridge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir)
    models = _ridge(rows, ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice").select("l_returnflag", "w")
    m = learners.ridge_predict(F.array("l_quantity", "l_discount"), F.col("w"))
    return rows.join(models, "l_returnflag").groupBy("l_returnflag").agg(F.round(learners.rmse(F.col("l_extendedprice"), m), 3).alias("score"))


_START = {"name": "PA", "hyperparameters": {"C": 0.01}, "parameters": {"a": [0.5, -0.25], "b": 0.125}}


@query(f"""WITH {_TRAIN}, ls AS (SELECT user_id, count(*)::BIGINT AS fitted, list({{x: [x0, x1, 1], y: y::DOUBLE, w: []::DOUBLE[]}} ORDER BY event_id) AS ps FROM tr GROUP BY user_id),
m AS (SELECT user_id, fitted, list_reduce(list_prepend({{x: []::DOUBLE[], y: 0::DOUBLE, w: [0.5::DOUBLE, -0.25, 0.125]}}, ps), lambda s, p: list_transform(
  [greatest(1 - p.y * list_dot_product(s.w, p.x), 0) / (list_dot_product(p.x, p.x) + 50) * p.y],
  lambda t: {{x: p.x, y: p.y, w: list_transform(s.w, lambda v, i: v + t * p.x[i])}})[1]).w AS w FROM ls)
SELECT user_id, round(w[1], 6) + 0.0::DOUBLE AS w0, round(w[2], 6) + 0.0::DOUBLE AS w1, round(w[3], 6) + 0.0::DOUBLE AS b, fitted FROM m""")
def pa_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline whose request gives weights and intercept to go on from."""
    training = e_points(spark, sf_dir).where("operation = 'training'")
    return _weights(Pipeline.from_request({"learner": _START}).fit(training, ["user_id"], "event_id", 2))


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity * l_quantity) + 500 AS a, sum(l_quantity) AS b, count(*) + 500 AS d, sum(l_quantity * l_extendedprice) AS p,
       sum(l_extendedprice) AS q FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round((p * d - q * b) / (a * d - b * b), 3) AS w, round((q * a - p * b) / (a * d - b * b), 2) AS b FROM s""")
def ridge_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge with lambda 500, as a request names it."""
    points = lineitem(spark, sf_dir).select("l_returnflag", F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = Pipeline.from_request({"learner": {"name": "ORR", "hyperparameters": {"lambda": 500}}}).fit(points, ["l_returnflag"], "y", 1)
    return out.select("l_returnflag", F.round(la.at("w", 0), 3).alias("w"), F.round("b", 2).alias("b"))


# --- parameter server -------------------------------------------------------------------------------------------


def _round_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records with worker and round, at the production batch."""
    training = workers.holdout(_assigned(spark, sf_dir), "event_id").where("NOT held")
    return workers.rounds(training, "event_id").withColumn("pipeline", F.lit(1))


def _list_fold(points: str, start: str, kind: str = "PA") -> str:
    """The weights (intercept last) after a list of structs (x with a last 1, y), from ``start``."""
    m = "list_dot_product(s.w, p.x)"
    if kind == "PA":
        tau = f"greatest(1 - p.y * {m}, 0) / (list_dot_product(p.x, p.x) + 50) * p.y"
    else:
        tau = f"greatest(abs(p.y - {m}), 0) / (list_dot_product(p.x, p.x) + 50) * CASE WHEN p.y - {m} >= 0 THEN 1 ELSE -1 END"
    first = f"{{x: []::DOUBLE[], y: 0::DOUBLE, w: {start}}}"
    step = f"list_transform([{tau}], lambda t: {{x: p.x, y: p.y, w: list_transform(s.w, lambda v, i: v + t * p.x[i])}})[1]"
    return f"list_reduce(list_prepend({first}, {points}), lambda s, p: {step}).w"


def _as_list(y: str, order: str = "event_id") -> str:
    return f"list({{x: [x0, x1, 1], y: {y}::DOUBLE, w: []::DOUBLE[]}} ORDER BY {order})"


_PS = f"""{_RND}, mini AS (SELECT worker, round, count(*)::BIGINT AS n, {_as_list('y')} AS rows FROM t GROUP BY worker, round),
ps AS (SELECT 0 AS round, [0::DOUBLE, 0, 0] AS v, 0::BIGINT AS fitted
  UNION ALL SELECT round + 1, [{', '.join(f'v[{i}] + sum(w[{i}] - v[{i}]) / {P}' for i in (1, 2, 3))}], (fitted + sum(n))::BIGINT
  FROM (SELECT s.round, s.v, s.fitted, n, {_list_fold('rows', 's.v')} AS w FROM ps s JOIN mini USING (round)) GROUP BY round, v, fitted)"""
_AT = lambda v, names: ", ".join(f"round({v}[{i + 1}], 6) + 0.0::DOUBLE AS {n}" for i, n in enumerate(names))


@query(f"""WITH RECURSIVE {_PS}, d AS (SELECT round, worker, n, s.v, {_list_fold('rows', 's.v')} AS w FROM ps s JOIN mini USING (round)),
k AS (SELECT round, worker, n AS fitted, list_transform(w, lambda x, i: x - v[i]) AS d FROM d)
SELECT round, worker, {_AT('d', ('d0', 'd1', 'd2'))}, fitted FROM k""")
def ps_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every worker's delta of every round."""
    out = server.round_deltas(_round_points(spark, sf_dir), ["pipeline"], "event_id", 2, P)
    return out.select("round", "worker", *[r6(la.at("delta", i)).alias(f"d{i}") for i in range(3)], "fitted")


def _global(models: DataFrame) -> DataFrame:
    return models.select(*[r6(la.at("v", i)).alias(n) for i, n in enumerate(("w0", "w1", "b"))], "fitted")


@query(f"WITH RECURSIVE {_PS} SELECT {_AT('v', ('w0', 'w1', 'b'))}, fitted FROM ps WHERE fitted > 0 QUALIFY row_number() OVER (ORDER BY round DESC) = 1")
def ps_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global model after all rounds, from the deltas of all of them."""
    deltas = server.round_deltas(_round_points(spark, sf_dir), ["pipeline"], "event_id", 2, P)
    return _global(server.averaged(deltas, None, ["pipeline"], P))


@query(f"WITH RECURSIVE {_PS} SELECT {_AT('v', ('w0', 'w1', 'b'))}, fitted FROM ps WHERE fitted > 0 QUALIFY row_number() OVER (ORDER BY round DESC) = 1")
def ps_all_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by training alone: rounds are streamed in order, and only the model after the last one comes out."""
    return _global(server.train_rounds(_round_points(spark, sf_dir), ["pipeline"], "event_id", 2, P))


# --- linear algebra ---------------------------------------------------------------------------------------------


def _spread(df: DataFrame, key: str, vector: Column) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("pos", "x")).withColumn("x", r6(F.col("x")))


def _spread_sql(expression: str, source: str = "v") -> str:
    return f"""WITH {V}, s AS (SELECT vec_id, {expression} AS o FROM {source})
SELECT vec_id, unnest(range(len(o)))::INT AS pos, round(unnest(o), 6) + 0.0::DOUBLE AS x FROM s"""


@query(f"WITH {V} SELECT vec_id, round(list_inner_product(v, list_reverse(v)), 6) + 0.0::DOUBLE AS dot FROM v")
def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", r6(la.dot("v", F.reverse("v"))).alias("dot"))


@query(f"WITH {V} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM v")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", r6(la.magnitude("v")).alias("norm"))


_PRODUCTS = f"""{V}, o AS (SELECT vec_id, label, v, unnest(range(len(v)))::INT AS i FROM v),
p AS (SELECT label, i, unnest(range(len(v)))::INT AS j, v[i + 1] AS a, unnest(v) AS b, unnest(list_reverse(v)) AS c FROM o)"""


def _cells(rows: DataFrame, matrix: Column) -> DataFrame:
    """Sums of matrices by label, as (label, i, j, x)."""
    each = rows.select("label", F.posexplode(matrix).alias("i", "row")).select("label", "i", F.posexplode("row").alias("j", "x"))
    return each.groupBy("label", "i", "j").agg((F.round(F.sum("x"), 5) + F.lit(0.0)).alias("x"))


@query(f"WITH {_PRODUCTS} SELECT label, i, j, round(sum(a * c), 5) + 0.0::DOUBLE AS x FROM p GROUP BY label, i, j")
def vec_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer products of whole vectors with their reverses, summed by label."""
    return _cells(vectors(spark, sf_dir), la.outer("v", F.reverse("v")))


@query(_spread_sql("list_transform(v, lambda x, i: x + 0.5 * v[len(v) + 1 - i])"))
def vec_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(vectors(spark, sf_dir), "vec_id", la.axpy(0.5, F.reverse("v"), "v"))


@query(_spread_sql("list_transform(v, lambda x: x * 2.5)"))
def vec_scal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(vectors(spark, sf_dir), "vec_id", la.scal(2.5, "v"))


@query(f"WITH {V}, s AS (SELECT label, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM v) SELECT label, pos, round(sum(x), 5) + 0.0::DOUBLE AS total FROM s GROUP BY label, pos")
def vec_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return la.vector_sum(vectors(spark, sf_dir), ["label"], "v").withColumn("total", F.round("total", 5) + 0.0)


def _thin() -> Column:
    return F.transform("v", lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))


_THIN = f"{V}, t AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0.0::DOUBLE END) AS t FROM v)"


@query(f"WITH {_THIN} SELECT vec_id, len(list_filter(t, lambda x: x <> 0))::INT AS nnz, unnest(range(len(t)))::INT AS pos, round(unnest(t), 6) + 0.0::DOUBLE AS x FROM t")
def sparse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors(spark, sf_dir).select("vec_id", la.to_sparse(_thin()).alias("s"))
    back = s.select("vec_id", F.size("s.indices").alias("nnz"), F.posexplode(la.to_dense("s")).alias("pos", "x"))
    return back.withColumn("x", r6(F.col("x")))


@query(f"""WITH {_THIN} SELECT vec_id, round(list_inner_product(t, v), 6) + 0.0::DOUBLE AS with_dense,
       round(list_inner_product(t, list_reverse(t)), 6) + 0.0::DOUBLE AS with_sparse FROM t""")
def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors(spark, sf_dir).select("vec_id", "v", la.to_sparse(_thin()).alias("s"), la.to_sparse(F.reverse(_thin())).alias("r"))
    return s.select("vec_id", r6(la.sparse_dot_dense("s", "v")).alias("with_dense"), r6(la.sparse_dot("s", "r")).alias("with_sparse"))


@query("""WITH k AS (SELECT DISTINCT l_suppkey FROM lineitem), g AS (SELECT l_suppkey, unnest(range(8))::INT AS pos FROM k),
s AS (SELECT l_suppkey, l_linenumber::INT AS pos, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)
SELECT l_suppkey, pos, round(coalesce(x, 0), 6) AS x FROM g LEFT JOIN s USING (l_suppkey, pos)""")
def coo_to_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = lineitem(spark, sf_dir).select("l_suppkey", F.col("l_linenumber").cast("int").alias("i"), F.col("l_quantity").alias("v"))
    sparse = la.from_coo(entries, ["l_suppkey"], 8)
    return _spread(sparse, "l_suppkey", la.to_dense("vector"))


@query("SELECT l_returnflag AS k, l_linenumber::INT AS i, (l_suppkey % 5)::INT AS j, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL")
def matrix_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = lineitem(spark, sf_dir).select(
        F.col("l_returnflag").alias("k"), F.col("l_linenumber").cast("int").alias("i"), (F.col("l_suppkey") % 5).cast("int").alias("j"), F.col("l_quantity").alias("v")
    )
    return la.matrix_from_coo(entries, ["k"]).withColumn("v", F.round("v", 2))


@query(f"WITH {_PRODUCTS} SELECT label, i, j, round(sum(CASE WHEN i = j THEN 1 ELSE 0 END + 0.5 * a * b), 5) + 0.0::DOUBLE AS x FROM p GROUP BY label, i, j")
def syr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity plus half of x xT for whole vectors, summed by label."""
    rows = vectors(spark, sf_dir)
    eye = F.transform("v", lambda _, i: F.transform("v", lambda _, j: F.when(i == j, 1.0).otherwise(0.0)))
    return _cells(rows.withColumn("eye", eye), la.syr(0.5, "v", "eye"))


_SET = "list_transform(t, lambda x, i: CASE WHEN i = vec_id % 64 + 1 THEN 9.0::DOUBLE ELSE x END)"


@query(f"WITH {_THIN}, u AS (SELECT vec_id, {_SET} AS u FROM t) SELECT vec_id, unnest(range(64))::INT AS pos, round(unnest(u), 6) + 0.0::DOUBLE AS x FROM u")
def sparse_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place of each sparse vector is set, stored before or not."""
    changed = la.sparse_updated(la.to_sparse(_thin()), (F.col("vec_id") % 64).cast("int"), F.lit(9.0))
    return _spread(vectors(spark, sf_dir), "vec_id", la.to_dense(changed))


@query(f"""WITH {_THIN}, o AS (SELECT label, t.vec_id, t, unnest(range(len(t)))::INT AS i FROM t JOIN embeddings USING (vec_id)),
p AS (SELECT label, i, unnest(range(len(t)))::INT AS j, t[i + 1] * unnest(list_reverse(t)) AS x FROM o)
SELECT label, i, j, round(sum(x), 5) + 0.0::DOUBLE AS x, count(*)::BIGINT AS n FROM p WHERE x <> 0 GROUP BY label, i, j""")
def sparse_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of sparse vectors with their reverses, summed by label; zeros are never made."""
    each = vectors(spark, sf_dir).select("label", F.explode(la.sparse_outer(la.to_sparse(_thin()), la.to_sparse(F.reverse(_thin())))).alias("p"))
    return each.groupBy("label", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg((F.round(F.sum("p.v"), 5) + F.lit(0.0)).alias("x"), F.count(F.lit(1)).alias("n"))


def _square(v: Column) -> Column:
    """64 components as an 8 x 8 matrix."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, 8))


@query(f"""WITH {_THIN}, u AS (SELECT vec_id, {_SET} AS u FROM t)
SELECT vec_id, len(list_filter(u, lambda x: x <> 0))::INT AS nnz, u[vec_id % 64 + 1] AS cell, unnest(range(64))::INT AS pos, round(unnest(u), 6) + 0.0::DOUBLE AS x FROM u""")
def sparse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 matrices, made sparse by columns, a cell set and read, and made dense again."""
    i, j = (F.floor(F.col("vec_id") % 64 / 8)).cast("int"), (F.col("vec_id") % 8).cast("int")
    m = vectors(spark, sf_dir).select("vec_id", la.sparse_matrix_updated(la.matrix_to_sparse(_square(_thin())), i, j, F.lit(9.0)).alias("m"))
    m = m.select("vec_id", F.size("m.entries").alias("nnz"), la.sparse_matrix_at("m", i, j).alias("cell"), F.posexplode(F.flatten(la.matrix_to_dense("m"))).alias("pos", "x"))
    return m.withColumn("x", r6(F.col("x")))


@query(f"""WITH {V}, u AS (SELECT vec_id, v[vec_id % 64 + 1] AS before, list_transform(v, lambda x, i: CASE WHEN i = vec_id % 64 + 1 THEN 9.0::DOUBLE ELSE x END) AS u FROM v)
SELECT vec_id, round(before, 6) + 0.0::DOUBLE AS before, before = 9 AS same, unnest(range(64))::INT AS pos, round(unnest(u), 6) + 0.0::DOUBLE AS x FROM u""")
def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell of each 8 x 8 matrix is read and set; is the matrix still equal to the one before?"""
    i, j = (F.floor(F.col("vec_id") % 64 / 8)).cast("int"), (F.col("vec_id") % 8).cast("int")
    m = vectors(spark, sf_dir).select("vec_id", _square(F.col("v")).alias("m")).withColumn("n", la.matrix_updated("m", i, j, F.lit(9.0)))
    out = m.select("vec_id", r6(la.matrix_at("m", i, j)).alias("before"), la.equal_matrix("m", "n").alias("same"), F.posexplode(F.flatten("n")).alias("pos", "x"))
    return out.withColumn("x", r6(F.col("x")))


@query(f"WITH {V} SELECT vec_id, v = list_reverse(v) AS palindrome, true AS kept, unnest(range(len(v)))::INT AS pos, round(unnest(v), 6) + 0.0::DOUBLE AS x FROM v")
def ml_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To vectors of Spark's machine-learning library and back."""
    back = la.from_ml(la.to_ml("v"))
    out = vectors(spark, sf_dir).select("vec_id", la.equal("v", F.reverse("v")).alias("palindrome"), la.equal("v", back).alias("kept"), F.posexplode(back).alias("pos", "x"))
    return out.withColumn("x", r6(F.col("x")))


@query("""SELECT l_suppkey, l_linenumber::INT AS i, round(sum(l_quantity), 4) AS x FROM lineitem GROUP BY ALL""")
def sparse_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors from entries in one array, of which several may name a place."""
    entries = F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x")))
    built = lineitem(spark, sf_dir).groupBy("l_suppkey").agg(entries.alias("e")).select("l_suppkey", la.sparse(8, "e").alias("s"))
    each = built.select("l_suppkey", F.explode(F.arrays_zip(F.col("s.indices").alias("i"), F.col("s.values").alias("x"))).alias("p"))
    return each.select("l_suppkey", F.col("p.i").alias("i"), F.round("p.x", 4).alias("x"))


# --- parameters -------------------------------------------------------------------------------------------------


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two linear models a vector: its first and its second half, each with its last component as intercept."""
    half = F.floor(F.size("v") / 2).cast("int")
    part = lambda low: pa.linear(F.slice("v", low + 1, half - 1), F.get("v", low + half - 1))
    return vectors(spark, sf_dir).select("vec_id", "v", part(F.lit(0)).alias("p"), part(half).alias("q"), pa.unflatten("v").alias("whole"))


@query(_spread_sql("list_transform(v[1:len(v) // 2], lambda x, i: x + v[i + len(v) // 2])"))
def param_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_models(spark, sf_dir), "vec_id", pa.flatten(pa.plus("p", "q")))


@query(_spread_sql("list_transform(v[1:len(v) // 2], lambda x, i: x - v[i + len(v) // 2])"))
def param_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_models(spark, sf_dir), "vec_id", pa.flatten(pa.minus("p", "q")))


@query(_spread_sql("list_transform(v, lambda x: x * 3)"))
def param_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_models(spark, sf_dir), "vec_id", pa.flatten(pa.times("whole", 3)))


@query(_spread_sql("list_transform(v, lambda x: x * 0.25)"))
def param_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_models(spark, sf_dir), "vec_id", pa.flatten(pa.over("whole", 4)))


@query(_spread_sql("v"))
def param_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_models(spark, sf_dir), "vec_id", pa.flatten(pa.unflatten(pa.flatten("whole"))))


@query(_spread_sql("list_concat(v, v[1:8])"))
def matrix_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vector as an 8 x 8 matrix and eight numbers, flattened, rebuilt and flattened again: the shape survives."""
    m = vectors(spark, sf_dir).select("vec_id", pa.unflatten_matrix(F.concat("v", F.slice("v", 1, 8)), 8).alias("m"))
    return _spread(m, "vec_id", pa.flatten_matrix("m"))


@query(_spread_sql("v[vec_id % 4 + 1 : vec_id % 4 + 3]"))
def bucket_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("vec_id") % 4
    return _spread(vectors(spark, sf_dir), "vec_id", pa.bucket_slice("v", start, start + 2))


@query(f"""WITH {V} SELECT vec_id, (len(v) - 1)::INT AS weights, 1 AS intercepts, 0::BIGINT AS first, (len(v) - 1)::BIGINT AS last, label::BIGINT AS fitted,
       round(list_sum(v), 5) + 0.0::DOUBLE AS total FROM v""")
def param_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models packed for sending: sizes, flat parameters, bucket, points fitted."""
    d = _models(spark, sf_dir).join(vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").select("vec_id", pa.descriptor("whole", "label").alias("d"))
    return d.select(
        "vec_id", F.get("d.sizes", F.lit(0)).alias("weights"), F.get("d.sizes", F.lit(1)).alias("intercepts"), F.col("d.bucket.start").alias("first"),
        F.col("d.bucket.end").alias("last"), F.col("d.fitted").alias("fitted"), (F.round(la.total("d.params"), 5) + 0.0).alias("total"),
    )


@query(f"""WITH {V}, u AS (SELECT vec_id, [v[1:40], v[41:63], v[64:64]] AS u FROM v), p AS (SELECT vec_id, unnest(range(3))::INT AS part, unnest(u) AS w FROM u)
SELECT vec_id, part, len(w)::INT AS n, round(list_sum(w), 5) + 0.0::DOUBLE AS total FROM p""")
def param_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat parameters cut into parts of 40, 23 and 1."""
    parts = vectors(spark, sf_dir).select("vec_id", F.posexplode(pa.unwrap("v", [40, 23, 1])).alias("part", "w"))
    return parts.select("vec_id", "part", F.size("w").alias("n"), (F.round(la.total("w"), 5) + 0.0).alias("total"))


# --- serving and pipelines --------------------------------------------------------------------------------------


def _two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pipelines trained on all training records of E: a classifier on labels, a regressor on values."""
    e = e_points(spark, sf_dir).where("operation = 'training'")
    one = learners.fit_in_order(e.withColumn("pipeline", F.lit(1)), ["pipeline"], "event_id", "PA").withColumn("kind", F.lit("PA"))
    two = e.withColumns({"pipeline": F.lit(2), "y": F.col("value")})
    return one.unionByName(learners.fit_in_order(two, ["pipeline"], "event_id", "regressorPA").withColumn("kind", F.lit("regressorPA")))


_TWO = f"""{_TRAIN}, ls AS (SELECT count(*)::BIGINT AS n, {_as_list('y')} AS ys, {_as_list('value')} AS vs FROM tr),
ms AS (SELECT n, {_list_fold('ys', '[0::DOUBLE, 0, 0]')} AS w, {_list_fold('vs', '[0::DOUBLE, 0, 0]', 'regressorPA')} AS u FROM ls),
pr AS (SELECT te.*, n, list_dot_product(w, [x0, x1, 1]) AS m1, list_dot_product(u, [x0, x1, 1]) AS m2 FROM te, ms)"""


@query(f"""WITH {_TWO} SELECT event_id, 1 AS pipeline, CASE WHEN m1 >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM pr
UNION ALL SELECT event_id, 2, round(m2, 5) + 0.0::DOUBLE FROM pr""")
def predict_all_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = e_points(spark, sf_dir).where("operation = 'forecasting'").select("event_id", "x")
    out = serve.predict_all(test, _two_models(spark, sf_dir))
    return out.select("event_id", "pipeline", (F.round("prediction", 5) + 0.0).alias("prediction"))


@query(f"""WITH {_TWO} SELECT 11::BIGINT AS response_id, 1 AS id, 'PA' AS learner, any_value(n) AS data_fitted,
       round(avg(CASE WHEN (m1 >= 0) = (y > 0) THEN 1.0::DOUBLE ELSE 0 END), 5) AS score FROM pr
UNION ALL SELECT 12, 2, 'regressorPA', any_value(n), round(sqrt(avg((value - m2) ** 2)), 5) FROM pr""")
def query_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, models = e_points(spark, sf_dir).where("operation = 'forecasting'"), durable(_two_models(spark, sf_dir), "models")
    test = test.withColumn("pipeline", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("y", F.when(F.col("pipeline") == 1, F.col("y")).otherwise(F.col("value")))
    asked = spark.createDataFrame([(11, 1), (12, 2)], "requestId long, pipeline int")
    out = serve.responses(asked, models, serve.scores(test, models))
    return out.select(
        F.col("responseId").alias("response_id"), "id", F.col("learner.name").alias("learner"), F.col("dataFitted").alias("data_fitted"), F.round("score", 5).alias("score")
    )


def prediction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as the JSON texts that go to a topic."""
    test = e_records(spark, sf_dir).where("operation = 'forecasting'").withColumn("x", F.col("numericFeatures"))
    out = serve.predict_all(test, _two_models(spark, sf_dir))
    return out.select(records.as_json(F.col("pipeline").alias("mlPipeline"), F.struct(*records.RECORD.names).alias("dataPoint"), "prediction").alias("value"))


@query(f"""WITH {EREC}, {_TWO}, b AS (SELECT event_id, 1 AS pipeline, CASE WHEN m1 >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM pr UNION ALL SELECT event_id, 2, m2 FROM pr)
SELECT id, pipeline, round(p, 5) + 0.0::DOUBLE AS prediction, r.operation, round(r.x0, 6) AS x0, CASE WHEN discrete THEN 1 ELSE 0 END::INT AS n_discrete, true AS untargeted
FROM b JOIN r ON event_id = id""")
def prediction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of predictions, read back."""
    back = prediction_texts(spark, sf_dir).select(F.from_json("value", records.PREDICTION).alias("p")).select("p.*")
    return back.select(
        F.col("dataPoint.id").alias("id"), F.col("mlPipeline").alias("pipeline"), (F.round("prediction", 5) + 0.0).alias("prediction"), "dataPoint.operation",
        r6(F.get("dataPoint.numericFeatures", F.lit(0))).alias("x0"), F.coalesce(F.size("dataPoint.discreteFeatures"), F.lit(0)).alias("n_discrete"),
        F.col("dataPoint.target").isNull().alias("untargeted"),
    )


_POLY = {
    "id": 1, "request": "Create", "preprocessors": [{"name": "PolynomialFeatures", "hyperparameters": {"degree": 2}}],
    "learner": {"name": "PA", "hyperparameters": {"C": 0.01}}, "protocol": "Asynchronous",
}
_RIDGE = {"id": 2, "request": "Create", "preprocessors": [{"name": "StandardScaler"}], "learner": {"name": "ORR", "hyperparameters": {"lambda": 0.0}}}


def _wide_fold_sql() -> str:
    names = [f"p{i}" for i in range(6)]
    dot = " + ".join(f"w{i} * {n}" for i, n in enumerate(names))
    square = " + ".join(f"{n} * {n}" for n in names)
    ws = ", ".join(f"w{i}" for i in range(6))
    return f"""o AS (SELECT user_id, x0 AS p0, x1 AS p1, x0 * x0 AS p2, x0 * x1 AS p3, x1 * x0 AS p4, x1 * x1 AS p5, y,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM tr),
m AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, {', '.join(f'0::DOUBLE AS w{i}' for i in range(6))}, 0::DOUBLE AS b FROM o
  UNION ALL SELECT user_id, rn, {', '.join(f'w{i} + t * {n}' for i, n in enumerate(names))}, b + t FROM (
    SELECT o.user_id, o.rn, {ws}, b, {', '.join(names)}, greatest(1 - y * ({dot} + b), 0) / ({square} + 51) * y AS t FROM m JOIN o USING (user_id) WHERE o.rn = m.rn + 1)),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)"""


@query(f"""WITH RECURSIVE {_TRAIN}, {_wide_fold_sql()}
SELECT user_id, rn AS fitted, round(b, 6) + 0.0::DOUBLE AS b, {', '.join(f'round(w{i}, 6) + 0.0::DOUBLE AS w{i}' for i in range(6))} FROM l""")
def pipeline_poly_pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline built from a request: degree-2 features, then PA, per user."""
    out = Pipeline.from_request(_POLY).fit(e_points(spark, sf_dir).where("operation = 'training'"), ["user_id"], "event_id", 2)
    return out.select("user_id", "fitted", r6(F.col("b")).alias("b"), *[r6(la.at("w", i)).alias(f"w{i}") for i in range(6)])


@query("""WITH z AS (SELECT l_extendedprice AS y, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS z0 FROM lineitem)
SELECT round(regr_slope(y, z0), 2) AS w0, round(regr_intercept(y, z0), 2) AS b, count(*)::BIGINT AS fitted FROM z""")
def pipeline_scale_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lineitem(spark, sf_dir).select(F.lit(1).alias("pipeline"), F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = Pipeline.from_request(_RIDGE).fit(points, ["pipeline"], "y", 1)
    return out.select(F.round(la.at("w", 0), 2).alias("w0"), F.round("b", 2).alias("b"), "fitted")


__all__ = ["QUERIES", "SQL", "with_position"]
