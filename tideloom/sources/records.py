"""Records on the wire: schemas, JSON parsing and rendering, validity rules, points, and stream sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = ("training", "forecasting")
VERBS = ("Create", "Update", "Delete", "Query")
PROTOCOLS = ("Asynchronous", "Synchronous", "DynamicAveraging", "FGM")


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RECORD = _schema(
    id=T.LongType(),
    numericFeatures=T.ArrayType(T.DoubleType()),
    discreteFeatures=T.ArrayType(T.StringType()),
    target=T.DoubleType(),
    operation=T.StringType(),
)
_PART = _schema(name=T.StringType(), hyperparameters=T.VariantType(), parameters=T.VariantType())
REQUEST = _schema(
    id=T.IntegerType(),
    request=T.StringType(),
    requestId=T.LongType(),
    preprocessors=T.ArrayType(_PART),
    learner=_PART,
    training_configuration=T.VariantType(),
    protocol=T.StringType(),
)
PREDICTION = _schema(mlPipeline=T.IntegerType(), dataPoint=RECORD, prediction=T.DoubleType())

#: Partitions of the topics, for jobs that read from a message bus.
TOPICS = {"trainingData": 36, "forecastingData": 36, "requests": 1, "predictions": 36, "responses": 1, "psMessages": 36}


def parse(df: DataFrame, schema: T.StructType, text: str = "value", fail_fast: bool = False) -> DataFrame:
    """Adds ``record`` from JSON text.  Malformed text gives a null key field; ``fail_fast`` raises instead."""
    options = {"mode": "FAILFAST" if fail_fast else "PERMISSIVE"}
    return df.withColumn("record", F.from_json(F.col(text), schema, options))


def record_valid(r: Column) -> Column:
    """A known operation, some feature, and no target on a forecasting record."""
    some = (F.coalesce(F.size(r["numericFeatures"]), F.lit(0)) > 0) | (F.coalesce(F.size(r["discreteFeatures"]), F.lit(0)) > 0)
    right_target = (r["operation"] != "forecasting") | r["target"].isNull()
    return F.coalesce(r["operation"].isin(*OPERATIONS) & some & right_target, F.lit(False))


def request_valid(r: Column) -> Column:
    verb, config = r["request"], r["training_configuration"]
    protocol = F.try_variant_get(config, "$.protocol", "string")
    has_batch = F.try_variant_get(config, "$.mini_batch_size", "string").isNotNull()
    batch = F.try_variant_get(config, "$.mini_batch_size", "double")
    text_batch = F.schema_of_variant(F.try_variant_get(config, "$.mini_batch_size", "variant")) == "STRING"
    batch_ok = F.coalesce((batch > 0) & (batch == F.floor(batch)) & ~text_batch, F.lit(False))
    named = F.forall(F.coalesce(r["preprocessors"], F.array().cast(REQUEST["preprocessors"].dataType)), lambda p: p["name"].isNotNull())
    rules = (
        (r["id"] >= 0)
        & verb.isin(*VERBS)
        & ((verb != "Create") | r["learner"].isNotNull())
        & ((verb != "Update") | r["preprocessors"].isNotNull() | r["learner"].isNotNull())
        & (r["learner"].isNull() | r["learner"]["name"].isNotNull())
        & named
        & (protocol.isNull() | protocol.isin(*PROTOCOLS))
        & (r["protocol"].isNull() | r["protocol"].isin(*PROTOCOLS))
        & (~has_batch | batch_ok)
        & ((verb != "Query") | r["requestId"].isNotNull())
    )
    return F.coalesce(rules, F.lit(False))


def records(df: DataFrame, text: str = "value") -> DataFrame:
    """Valid data records of a column of JSON texts; others are left out (see ``rejects``)."""
    return parse(df, RECORD, text).where(record_valid(F.col("record"))).select("record.*")


def rejects(df: DataFrame, schema: T.StructType = RECORD, text: str = "value") -> DataFrame:
    """Texts that ``records`` or ``requests`` leaves out, for a dead-letter sink."""
    ok = record_valid if schema is RECORD else request_valid
    return parse(df, schema, text).where(~ok(F.col("record"))).select(text)


def requests(df: DataFrame, text: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Valid requests; a text may hold one request or a list under ``requests``, where ``protocol`` may stand beside.

    ``keep`` names columns to carry; of them an array ``place`` gets the request's place in its list appended.
    """
    kept = list(keep or [])
    single = F.get_json_object(F.col(text), "$.requests").isNull()
    listed = F.from_json(F.get_json_object(F.col(text), "$.requests"), "array<variant>")
    each = F.when(single, F.array(F.col(text))).otherwise(F.transform(listed, lambda v: F.to_json(v)))
    rows = df.select(*kept, F.posexplode(each).alias("_at", "_text"))
    if "place" in kept:
        rows = rows.withColumn("place", F.concat("place", F.array(F.lpad(F.col("_at").cast("string"), 20, "0"))))
    found = parse(rows, REQUEST, "_text").where(request_valid(F.col("record")))
    return found.select("record.*", *kept)


def spec_of() -> Column:
    """What a request says about its pipeline, as JSON text."""
    return F.to_json(F.struct("preprocessors", "learner", "training_configuration", "protocol"))


def placed(df: DataFrame) -> DataFrame:
    """``value`` with ``place``, an array of sortable texts: partition and offset of a topic, or time, path and line of a file."""
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    if "offset" in df.columns:
        return df.select("value", F.array(number(F.unix_micros("timestamp")), number(F.col("partition")), number(F.col("offset"))).alias("place"))
    line = number(F.monotonically_increasing_id())
    if "file_path" in df.columns:
        return df.select("value", F.array(number(F.unix_micros("file_time")), F.col("file_path"), number(F.col("file_block")), line).alias("place"))
    return df.select("value", F.array(line).alias("place"))


def points(valid: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Training points (``keep``, id, x, y): numeric features only, without discrete ones; a null target stays unlabelled."""
    usable = F.col("numericFeatures").isNotNull() & F.col("discreteFeatures").isNull() & (F.col("operation") == "training")
    return valid.where(usable).select(*(keep or []), "id", F.col("numericFeatures").alias("x"), F.col("target").alias("y"))


def csv_to_doubles(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))


def as_json(*columns, pretty: bool = False) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"} if pretty else {})


def as_bytes(*columns) -> Column:
    """Compact JSON as the bytes of a message."""
    return as_json(*columns).cast("binary")


def text_source(spark: SparkSession, kind: str, where: str | list[str], group: str | None = None, **options) -> DataFrame:
    """A stream of texts in ``value`` with the columns that ``placed`` orders by.  ``where``: topic or folder, or several."""
    if isinstance(where, list):
        each = [text_source(spark, kind, w, group, **options) for w in where]
        out = each[0]
        for other in each[1:]:
            out = out.unionByName(other)
        return out
    if kind == "kafka":
        return source(spark, kind, where, **({"kafka.group.id": group} if group else {}) | options)
    got = source(spark, kind, where, **options)
    meta = {"file_time": "file_modification_time", "file_path": "file_path", "file_block": "file_block_start"}
    return got.select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()])


def text_static(spark: SparkSession, where: str) -> DataFrame:
    """The texts of a folder as they are now, with the columns of ``text_source``."""
    meta = {"file_time": "file_modification_time", "file_path": "file_path", "file_block": "file_block_start"}
    return spark.read.text(where).select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()])


def source(spark: SparkSession, kind: str, where: str, schema: T.StructType | None = None, streaming: bool = True, **options) -> DataFrame:
    """Texts (``value``) or rows of a topic or folder.  kind: kafka (where: topic), text, json, parquet, csv, orc, rate.

    Data and request topics are read from the earliest offset unless ``startingOffsets`` says otherwise.
    """
    reader = spark.readStream if streaming else spark.read
    if kind == "kafka":
        own = {"kafka.bootstrap.servers": "localhost:9092", "startingOffsets": "earliest"} | options
        got = reader.format("kafka").options(**own).option("subscribe", where).load()
        return got.select(F.col("value").cast("string").alias("value"), "key", "topic", "partition", "offset", "timestamp")
    reader = reader.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load() if kind == "rate" else reader.load(where)


def with_metadata(df: DataFrame) -> DataFrame:
    """Kafka columns as the record's metadata struct; the key is an 8-byte number."""
    key = F.conv(F.hex(F.col("key")), 16, 10).cast("long")
    return df.withColumn("metadata", F.struct("topic", "partition", key.alias("key"), "offset", F.unix_millis("timestamp").alias("timestamp")))


def deserialized(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Messages as ``record`` (null where bytes don't give a valid one) and ``metadata``."""
    ok = record_valid if schema is RECORD else request_valid
    parsed = parse(with_metadata(df).withColumn("_text", F.col("value").cast("string")), schema, "_text").drop("_text")
    return parsed.withColumn("record", F.when(ok(F.col("record")), F.col("record")))


def sink(df: DataFrame, kind: str, where: str, **options) -> None:
    """Writes a batch: kafka needs a ``value`` column; others take any rows."""
    writer = df.write.format(kind).options(**options)
    if kind == "kafka":
        writer.option("topic", where).save()
    else:
        writer.mode(options.get("mode", "append")).save(where)
