"""Control plane: request lifecycle, fan-out to workers, predictor feed, and the update sampler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideloom.functions.ordered import with_position

LEARNERS = ("PA", "regressorPA", "ORR")
PREPROCESSORS = ("PolynomialFeatures", "StandardScaler")


def known(learner: Column, preprocessors: Column) -> Column:
    """Only registered names."""
    names = F.forall(F.coalesce(preprocessors, F.array().cast("array<string>")), lambda p: p.isin(*PREPROCESSORS))
    return (learner.isNull() | learner.isin(*LEARNERS)) & names


def lifecycle(requests: DataFrame, pipeline: str = "id", order: str = "seq", verb: str = "request") -> DataFrame:
    """Adds ``effective``: a Create of an id that isn't registered, any other verb of one that is.

    An id is registered while its last Create or Delete is a Create, whether that one had an effect or not.
    """
    before = Window.partitionBy(pipeline).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turning = F.when(F.col(verb).isin("Create", "Delete"), F.col(verb))
    registered = F.coalesce(F.last(turning, ignorenulls=True).over(before) == "Create", F.lit(False))
    return requests.withColumn("effective", F.when(F.col(verb) == "Create", ~registered).otherwise(registered))


def registry(requests: DataFrame, pipeline: str = "id", order: str = "seq", verb: str = "request") -> DataFrame:
    """Registered ids after all requests, with the place of the Create that stands."""
    own = lifecycle(requests, pipeline, order, verb).where(F.col("effective") & F.col(verb).isin("Create", "Delete"))
    last = own.groupBy(pipeline).agg(F.max(F.struct(order, verb)).alias("_l"))
    return last.where(F.col("_l")[verb] == "Create").select(pipeline, F.col("_l")[order].alias("created"))


def fan_out(effective: DataFrame, workers: int, verb: str = "request") -> DataFrame:
    """A message per worker; a Query goes to worker 0 alone."""
    last = F.when(F.col(verb) == "Query", F.lit(0)).otherwise(F.lit(workers - 1))
    return effective.withColumn("worker", F.explode(F.sequence(F.lit(0), last)))


def control_union(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """Requests and parameter-server updates as one stream; columns one side lacks are null."""
    return messages.unionByName(updates, allowMissingColumns=True)


def sampled_updates(updates: DataFrame, workers: int, every: int = 6, pipeline: str = "pipeline", order: str = "seq") -> DataFrame:
    """Every sixth update that worker 0 gets, per pipeline, for all predictors."""
    own = updates.where((F.col("worker") == 0) & (F.col("op") == 1)).drop("worker")
    picked = with_position(own, [pipeline], order, "_n").where((F.col("_n") + 1) % every == 0).drop("_n")
    return picked.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def predictor_feed(messages: DataFrame, sampled: DataFrame, verb: str = "request") -> DataFrame:
    """What predictors listen to: requests other than Query, and sampled updates."""
    return control_union(messages.where(F.col(verb) != "Query"), sampled)
