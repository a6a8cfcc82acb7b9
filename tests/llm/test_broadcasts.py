"""Joins of frames that Spark takes for smaller than they are: neither side goes through the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from usagelake.llm import simhash


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_fuzzy_keys_are_not_broadcast(spark):
    """A fingerprint has some sixty keys, which Spark takes to be one."""
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    row, _, _ = simhash.fuzzy_keys(np.array([r["fp"] for r in prints.collect()], dtype=np.int64).view(np.uint64))
    assert len(row) > 50 * 1000
    assert "Broadcast" not in plan_of(simhash.links(prints))


def test_near_copies_are_not_broadcast(spark, monkeypatch):
    """Sides that grow with the corpus are merged: candidates, exact join and components."""
    from tests.llm import data
    from usagelake.llm import common, components, similar

    plans = []

    def stage(df, **options):
        plans.append(plan_of(df))
        return common.stage(df, **options)

    for module in (simhash, similar, components):
        monkeypatch.setattr(module, "stage", stage)
    plans.append(plan_of(simhash.near_duplicates(data.frame(spark))))
    assert len(plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p]
