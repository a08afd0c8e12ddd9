"""Tables dealt to tasks of a bounded number of rows."""

from nightgrid.operators import raw
from nightgrid.plans import raw_queries
from nightgrid.plans.registry import Tables
from nightgrid.session import spread


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_more_rows_more_tasks(spark):
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (3_000, 30_000):
            parts = spread(spark.range(n), "id", rows=500).rdd.glom().map(len).collect()
            assert len(parts) == n // 500 and sum(parts) == n and max(parts) < 1_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_channels_are_dealt_once_and_grouped_in_place(spark, data_dir):
    """Rows of a file meet before they are grouped, in tasks whose number follows the table."""
    rows = raw_queries.channel_rows(Tables(spark, data_dir))
    for df in (rows, raw.long_channels(rows)):
        plan = plan_of(df)
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
