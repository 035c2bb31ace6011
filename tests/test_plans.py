"""Plan checks: pushdown and pruning reach the scan, scoring stays JVM-side, no
accidental Cartesian products, shared tables are read once."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from onramp import params as P
from onramp import schema as S
from onramp.operators import features as FT
from onramp.plans import catalog as C
from onramp.plans.fixtures import Fixture


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_install_filter_and_pruning_reach_scan(spark):
    fx = Fixture(spark, SF_SMALL, materialized=False)
    p = plan_text(FT.installs(fx.events))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in p
    # only the four columns the install step needs are read
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_request_filter_pushed(spark):
    fx = Fixture(spark, SF_SMALL, materialized=False)
    assert "EqualTo(event_type,click)" in plan_text(fx.requests)


def test_scoring_has_no_python_and_no_cartesian(spark):
    df = C.QUERIES["score_users"](spark, SF_SMALL)
    p = plan_text(df)
    for bad in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct"):
        assert bad not in p, bad


def test_user_table_is_one_journey_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fx = Fixture(spark, SF_SMALL, materialized=False)
        t = FT.user_table(fx.events, 86400, P.FIXTURE_PURCHASE_H_S, P.FIXTURE_CHURN_FROM_S,
                          P.FIXTURE_CHURN_TO_S, P.FIXTURE_LTV_H_S)
        p = t._jdf.queryExecution().executedPlan().toString()
        # no nested-loop join except the 1-row maturity scalar, never a Cartesian product
        assert "CartesianProduct" not in p
        assert p.count("BroadcastNestedLoopJoin") <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_materialised_tables_are_read_not_recomputed(spark):
    C.reset_fixtures()
    fx = C.fixture(spark, SF_SMALL)
    p = plan_text(fx.features.join(fx.labels, S.KEY))
    # both sides come from the written user table, the event table is not in the plan
    i = p.find("events.parquet")
    assert i < 0, p[max(0, i - 300):i + 50]
    assert "FileScan parquet" in p or "Scan parquet" in p


def test_trigger_grid_is_broadcast_nested_loop(spark):
    from onramp.operators.policy import users_x_triggers
    fx = Fixture(spark, SF_SMALL, materialized=False)
    p = plan_text(users_x_triggers(fx.installs.select("app_id", F.col("user_id").alias("airbridge_uuid"))))
    assert "BroadcastNestedLoopJoin" in p and "CartesianProduct" not in p
