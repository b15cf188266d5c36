"""``python -m tideloom --trainingData F --forecastingData F --requests F --root F [--key value ...]`` runs the streaming job.

Sources are folders of JSON texts, or topics with ``--kind kafka --brokerList host:port``.  Everything that is there is
taken and the job stops; ``--interval SECONDS`` keeps it running in micro-batches.  Results go to folders under the root
(predictions, responses, rejected, messages), and to topics too where ``--predictionsTopic`` or ``--responsesTopic`` name them.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tideloom.sources import records
from tideloom.streaming.job import Job, Parameters

#: Names of parameters, what they are read as, and their defaults (None: not set).
ARGUMENTS: dict[str, tuple] = {
    "trainingData": (str, None),
    "forecastingData": (str, None),
    "requests": (str, None),
    "root": (str, None),
    "kind": (str, "text"),
    "brokerList": (str, "localhost:9092"),
    "groupId": (str, "tideloom"),
    "predictionsTopic": (str, None),
    "responsesTopic": (str, None),
    "interval": (float, None),
    "filesPerTrigger": (int, None),
    "jobName": (str, Parameters.job_name),
    "parallelism": (int, Parameters.parallelism),
    "refresh": (int, Parameters.refresh),
    "testSetSize": (int, Parameters.test_capacity),
    "cache": (int, None),
    "dropFirst": (lambda text: text.lower() == "true", False),
    "sentinel": (lambda text: text.lower() == "true", False),
}


def parse(argv: list[str]) -> dict:
    """``--key value`` pairs; an unknown key, a missing value or a value of the wrong kind is an error."""
    out = {name: default for name, (_, default) in ARGUMENTS.items()}
    if len(argv) % 2:
        raise SystemExit(f"{argv[-1]} has no value")
    for key, value in zip(argv[::2], argv[1::2]):
        name = key.removeprefix("--")
        if not key.startswith("--") or name not in ARGUMENTS:
            raise SystemExit(f"unknown parameter {key}; known: {', '.join('--' + n for n in ARGUMENTS)}")
        try:
            out[name] = ARGUMENTS[name][0](value)
        except ValueError as e:
            raise SystemExit(f"{key}: {e}") from e
    for name in ("root",):
        if not out[name]:
            raise SystemExit(f"--{name} is needed")
    return out


def job_of(spark: SparkSession, given: dict) -> Job:
    chosen = Parameters(given["jobName"], given["parallelism"], given["refresh"], given["testSetSize"], given["dropFirst"], given["cache"], given["sentinel"])
    topics = {n: given[f"{n}Topic"] for n in ("predictions", "responses") if given[f"{n}Topic"]}
    return Job(spark, given["root"], chosen, topics, given["brokerList"])


def run(spark: SparkSession, given: dict) -> Job:
    """Requests first, so that a finite run's pipelines stand when its records come; records of both topics as one stream."""
    job, kind = job_of(spark, given), given["kind"]
    options = {"kafka.bootstrap.servers": given["brokerList"]} if kind == "kafka" else {}
    if kind != "kafka" and given["filesPerTrigger"]:
        options["maxFilesPerTrigger"] = given["filesPerTrigger"]
    trigger = {"processingTime": f"{given['interval']} seconds"} if given["interval"] else {"availableNow": True}
    group, handles = given["groupId"] if kind == "kafka" else None, []
    data = [given[n] for n in ("trainingData", "forecastingData") if given[n]]
    for what, where in (("requests", given["requests"]), ("records", data)):
        if where:
            handles.append(job.start(records.text_source(spark, kind, where, group, **options), what, **trigger))
            if not given["interval"]:
                handles[-1].awaitTermination()
    for handle in handles:
        handle.awaitTermination()
    return job


def main(argv: list[str] | None = None) -> None:
    given = parse(sys.argv[1:] if argv is None else argv)
    run(SparkSession.builder.appName(given["jobName"]).getOrCreate(), given)


if __name__ == "__main__":
    main()
