from ravelin.plans import catalogue


def test_rows_are_dealt_out_before_they_are_counted(spark):
    """Else a task's table of counts holds whatever a file split holds, and few equal steps gather all rows."""
    plan = catalogue.QUERIES["expression_eval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
    assert plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM") and "ENSURE_REQUIREMENTS" not in plan[: plan.index("REPARTITION_BY_NUM")]
