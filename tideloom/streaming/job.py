"""The streaming job: requests create, query and delete pipelines; records train them and are predicted by them.

Every micro-batch is handled by the same functions as static tables, inside ``foreachBatch``.  What carries over is
written as versions of tables under the job's root, one folder a micro-batch (``<table>/version=<batch>``).  A batch
reads the version before its own and overwrites its own, so one that is repeated after a failure gives the same result.

* ``registry``: standing pipelines (id, created, spec).  ``created`` tells a pipeline from a later one of the same id.
* ``folded``: state rows and push messages (see ``operators.online``).  The feedback loop of the parameter server is the
  state that the next batch starts from; ``messages`` keeps what it pushed (pipeline, worker, op, number, fitted, params).
* ``parked``: records that came before a pipeline or before its first model.  They wait without a limit, or the newest
  ``cache`` of them do, and go through the first pipeline or model there is.
* ``predictions``, ``responses``, ``rejected``: texts that leave the job.

Requests keep the order of the source (offsets, or file time, path and line).  They are few and pass one task, as the
registry is one; records never do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideloom.operators import control, online, serve, workers
from tideloom.plans.pipeline import ConfigError, Pipeline
from tideloom.sources import records
from tideloom.sources.storage import drop_versions, versions


@dataclass
class Parameters:
    """Of a job; ``parallelism`` is the number of logical workers a pipeline."""

    job_name: str = "online-learning"
    parallelism: int = 16
    refresh: int = online.REFRESH
    test_capacity: int = workers.RESERVOIR
    drop_first: bool = False
    cache: int | None = None
    sentinel: bool = False
    messages: bool = True
    keep_versions: int = 3


@F.pandas_udf(T.StringType())
def _fault(spec: pd.Series) -> pd.Series:
    """What is wrong with a Create's request; null if nothing."""

    def check(text: str | None) -> str | None:
        try:
            Pipeline.from_request(json.loads(text))
        except (ConfigError, KeyError, TypeError, ValueError) as e:
            return str(e) or type(e).__name__
        return None

    return pd.Series([check(t) for t in spec], dtype=object)


class Job:
    """``topics``: topic names for ``predictions`` and ``responses``, which then go to a message bus as well."""

    def __init__(self, spark: SparkSession, root: str, parameters: Parameters | None = None, topics: dict[str, str] | None = None, brokers: str = "localhost:9092"):
        self.spark, self.root, self.set = spark, root.rstrip("/"), parameters or Parameters()
        self.topics, self.brokers = topics or {}, brokers

    # --- versions ---

    def _before(self, name: str, version: int) -> DataFrame | None:
        there = [v for v in versions(self.spark, f"{self.root}/{name}") if v < version]
        return self.spark.read.parquet(f"{self.root}/{name}/version={there[-1]}") if there else None

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.root}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _publish(self, df: DataFrame, name: str, version: int) -> None:
        """A table of texts that leave the job, and its topic if there is one."""
        written = self._write(df, name, version)
        if name in self.topics:
            records.sink(written.select("value"), "kafka", self.topics[name], **{"kafka.bootstrap.servers": self.brokers})

    def _forget(self, name: str, version: int) -> None:
        """Versions that no repeated batch reads again."""
        drop_versions(self.spark, f"{self.root}/{name}", version, self.set.keep_versions)

    def versions_of(self, name: str) -> list[int]:
        return versions(self.spark, f"{self.root}/{name}")

    def states(self, version: int = 1 << 30) -> DataFrame | None:
        folded = self._before("folded", version)
        return None if folded is None else folded.where("state IS NOT NULL").select("state.*")

    def registry(self, version: int = 1 << 30) -> DataFrame | None:
        return self._before("registry", version)

    def written(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    # --- requests ---

    def on_requests(self, texts: DataFrame, version: int) -> None:
        """Requests in order after the pipelines that stand; names are checked before verbs."""
        placed = records.placed(texts)
        parsed = records.requests(placed, keep=["place"])
        order = Window.orderBy("place")  # the registry is one and requests are few
        new = parsed.withColumn("seq", F.row_number().over(order).cast("long")).withColumn("spec", records.spec_of())
        known = control.known(F.col("learner.name"), F.transform("preprocessors", lambda p: p["name"]))
        fault = F.when(~F.coalesce(known, F.lit(False)), "unknown name").when(F.col("request") == "Create", _fault("spec"))
        judged = new.withColumn("fault", fault).select("id", "seq", "request", "requestId", "spec", "fault").persist()
        try:
            unfit = judged.where("fault IS NOT NULL").select(F.col("spec").alias("value"), "fault")
            malformed = records.rejects(placed, records.REQUEST).select("value", F.lit("not a valid request").alias("fault"))
            self._write(unfit.unionByName(malformed), "rejected", version)
            old = self.registry(version)
            made = F.concat_ws("-", F.lit(version), F.col("seq"))
            sound = judged.where("fault IS NULL").withColumn("created", F.when(F.col("request") == "Create", made)).drop("fault")
            if old is not None:
                stand = {"seq": F.lit(0).cast("long"), "request": F.lit("Create"), "requestId": F.lit(None).cast("long")}
                sound = old.withColumns(stand).select(*sound.columns).unionByName(sound)
            done = control.lifecycle(sound)
            # what each request meets: the last Create of its id that had an effect
            upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
            effect = F.col("effective") & (F.col("request") == "Create")
            for c in ("created", "spec"):
                done = done.withColumn(f"own_{c}", F.last(F.when(effect, F.col(c)), ignorenulls=True).over(upto))
            done = done.persist()
            last = control.registry(done).select("id", F.col("created").alias("seq"))
            standing = done.join(last, ["id", "seq"], "left_semi").select("id", "created", "spec")
            self._write(standing, "registry", version)
            asked = done.where((F.col("request") == "Query") & F.col("effective"))
            asked = asked.select("requestId", F.col("id").alias("pipeline"), F.col("own_created").alias("created"), F.col("own_spec").alias("spec"))
            states = self.states()
            states = online.new_states(standing.limit(0)) if states is None else states
            out = online.describe(states, asked)
            self._publish(out.withColumn("score", F.coalesce("score", F.lit(serve.NO_SCORE))) if self.set.sentinel else out, "responses", version)
            done.unpersist()
        finally:
            judged.unpersist()
        self._forget("registry", version)

    # --- records ---

    def on_records(self, texts: DataFrame, version: int) -> None:
        """Trains the standing pipelines on the batch, then predicts its forecasting records."""
        valid = records.records(texts).persist()
        try:
            registry, parked = self.registry(), self._before("parked", version)
            ids = [] if registry is None else [r["id"] for r in registry.select("id").collect()]  # the registry is small by design
            waiting = valid.select(F.lit(None).cast("int").alias("pipeline"), F.struct(*records.RECORD.names).alias("record"))
            waiting = waiting if parked is None else parked.unionByName(waiting)
            if not ids:
                self._write(self._newest(waiting), "parked", version)
                return
            folded = self._train(registry, waiting, ids, version)
            if self.set.messages:
                self._write(folded.where("message IS NOT NULL").select("pipeline", "message.*"), "messages", version)
            states = folded.where("state IS NOT NULL").select("state.*")
            self._predict(states, waiting, ids, version)
        finally:
            valid.unpersist()
        for name in ("folded", "parked"):
            self._forget(name, version)

    def _newest(self, waiting: DataFrame) -> DataFrame:
        if self.set.cache is None:
            return waiting
        return waiting.orderBy(F.col("record.id").desc_nulls_last()).limit(self.set.cache)

    def _train(self, registry: DataFrame, waiting: DataFrame, ids: list[int], version: int) -> DataFrame:
        points = records.points(waiting.select("pipeline", "record.*"), keep=["pipeline"])
        each = points.withColumn("pipeline", F.explode(F.lit(ids).cast("array<int>"))).select("pipeline", F.coalesce("id", F.lit(0)).alias("ord"), "x", "y")
        old, fresh = self.states(version), online.new_states(registry)
        if old is not None:
            same = (F.col("pipeline") == F.col("id")) & (F.col("created") == F.col("_created"))
            stay = old.join(registry.select("id", F.col("created").alias("_created")), same, "left_semi")
            fresh = stay.unionByName(fresh.join(stay.select("pipeline"), "pipeline", "left_anti").select(*stay.columns))
        options = {"refresh": self.set.refresh, "capacity": self.set.test_capacity, "drop_first": self.set.drop_first}
        return self._write(online.fold(fresh, each, self.set.parallelism, len(ids), **options), "folded", version)

    def _predict(self, states: DataFrame, waiting: DataFrame, ids: list[int], version: int) -> None:
        """Forecasts by the pipelines that have a model; the rest waits, by pipeline."""
        asked = waiting.where("record.operation = 'forecasting'")
        due = F.when(F.col("pipeline").isNull(), F.lit(ids).cast("array<int>")).otherwise(F.array("pipeline"))
        each = asked.withColumn("due", F.array_intersect(due, F.lit(ids).cast("array<int>")))
        sizes = online.serving(states)
        serving = F.lit(sorted(sizes)).cast("array<int>")
        ready = F.array_intersect("due", serving)
        later = each.select(F.explode(F.array_except("due", serving)).alias("pipeline"), "record")
        now = each.select("record", ready.alias("due"), F.col("record.numericFeatures").alias("x")).where(F.size("due") > 0)
        out = online.predict(now, states, sizes=sizes).where(F.array_contains("due", F.col("pipeline")))
        value = F.coalesce("prediction", F.lit(serve.NO_PREDICTION)) if self.set.sentinel else F.col("prediction")
        text = records.as_json(F.col("pipeline").alias("mlPipeline"), F.col("record").alias("dataPoint"), value.alias("prediction"))
        self._publish(out.select(text.alias("value")), "predictions", version)
        self._write(self._newest(later), "parked", version)

    # --- running ---

    def start(self, source: DataFrame, what: str = "records", **trigger):
        """Starts a stream of texts; ``what``: records or requests."""
        handle = self.on_records if what == "records" else self.on_requests
        stream = source.writeStream.foreachBatch(handle).queryName(f"{self.set.job_name}-{what}").option("checkpointLocation", f"{self.root}/checkpoint-{what}")
        return stream.trigger(**(trigger or {"availableNow": True})).start()

    def run_available(self, kind: str, where: str | list[str], what: str = "records", per_trigger: int | None = None, **options) -> None:
        """Takes everything that is there and stops; goes on from the checkpoint when called again."""
        options |= {"maxFilesPerTrigger": per_trigger} if per_trigger else {}
        texts = records.text_source(self.spark, kind, where, **options)
        self.start(texts, what).awaitTermination()
