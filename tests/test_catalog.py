"""Every query of the engine against its SQL twin, on the smallest tables."""

import pytest

from tideloom.operators import server
from tideloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name])


def test_prediction_json_names_its_fields(spark, sf_dir):
    import json

    row = json.loads(catalog.prediction_texts(spark, sf_dir).first()["value"])
    assert set(row) == {"mlPipeline", "dataPoint", "prediction"}


@pytest.mark.parametrize("name", ["poly_degree2", "vec_dot", "record_validity", "request_lifecycle", "holdout_split", "minibatch_rounds", "syr"])
def test_stays_in_the_jvm(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mini_batches_of_a_round_are_folded_in_the_jvm(spark, sf_dir):
    mini = server.batches(catalog._round_points(spark, sf_dir).where("round = 0"), ["pipeline"], "event_id")
    plan = server.deltas(mini, None, ["pipeline"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_scans_prune_columns(spark, sf_dir):
    plan = catalog.QUERIES["worker_assignment"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan
