"""Session settings and scratch folders."""

from __future__ import annotations

import os
from types import SimpleNamespace

from panelwise import session
from panelwise.session import clear_scratch, scratch_dir, shuffle_partitions


def of(cores, **conf):
    named = {k.replace("_", "."): v for k, v in conf.items()}
    context = SimpleNamespace(defaultParallelism=cores, master="yarn")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: named.get(k, d)))


def test_partitions_follow_the_cores_there_may_be():
    assert shuffle_partitions(of(8)) == 32
    assert shuffle_partitions(of(4000)) == 16000
    grows = {"spark.dynamicAllocation.maxExecutors": "1000", "spark.executor.cores": "4"}
    stub = of(8)
    stub.conf = SimpleNamespace(get=lambda k, d=None: {**grows, "spark.dynamicAllocation.enabled": "true"}.get(k, d))
    assert shuffle_partitions(stub) == 16000
    stub.conf = SimpleNamespace(get=lambda k, d=None: grows.get(k, d))
    assert shuffle_partitions(stub) == 32


def test_a_local_and_a_cluster_session_follow_one_rule(spark):
    assert shuffle_partitions(spark) == shuffle_partitions(of(spark.sparkContext.defaultParallelism))


def test_scratch_is_cleared_with_its_tables(spark, monkeypatch):
    monkeypatch.setattr(session, "SCRATCH", [])
    path, other = scratch_dir(spark, "gone"), scratch_dir(spark, "gone-too")
    spark.range(4).write.option("path", path).saveAsTable("scratch_table")
    spark.range(4).write.parquet(other)
    spark.range(4).write.saveAsTable("kept_table")
    assert clear_scratch(spark) == 2
    assert not os.path.exists(path) and not os.path.exists(other)
    assert not spark.catalog.tableExists("scratch_table") and spark.table("kept_table").count() == 4
    spark.sql("DROP TABLE kept_table")
    assert clear_scratch(spark) == 0
