"""What is exploded is not broadcast by an estimate that does not know of it."""

from tests.compare import ROOT
from wayframe.checks.registry import QUERIES
from wayframe.runtime import tune


def test_exploded_roads_are_not_broadcast(spark):
    # 150,000 orders, read as less than 1 MB, stand for 750,000 vertices and several times as many cells.
    plan = QUERIES["G14_coincident_share"](spark, f"{ROOT}/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_other_jobs_keep_the_limits_of_the_session(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    own = tune(spark).conf.get(key)
    assert tune(spark, explodes=True).conf.get(key) == "256KB"
    assert tune(spark).conf.get(key) == own != "256KB"
