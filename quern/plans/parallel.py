"""Spreading small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out if a plain scan gives fewer partitions than there are cores; a large table stays as it is.

    One row group is one task, however many cores wait. Plans with exchanges of their own are left to adaptive
    execution: asking for their partitions would run them.
    """
    plan = rows._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if plan.execute().getNumPartitions() < cores else rows
