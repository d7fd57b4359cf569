"""What keeps the work of queries in proportion to their tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import scoring
from chronoweave.plans import base


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_scores_cross_no_exchange_and_equal_those_joined_by_term(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i % 5} all") for i in range(40)], "id int, text string")
    asked = spark.createDataFrame([(1, "w1 w1 all"), (2, "w4 none")], "q int, question string")
    near = scoring.bm25(asked, docs, "q", "question", "id", "text")
    assert not [line for line in _plan(near).splitlines() if "Exchange hashpartitioning(query_id" in line and "id#" in line.split("query_id", 1)[1].split(",")[1]]
    monkeypatch.setattr(scoring, "BROADCAST_TERMS", 0)
    far = {(r["query_id"], r["id"]): r["score"] for r in scoring.bm25(asked, docs, "q", "question", "id", "text").collect()}
    assert {(r["query_id"], r["id"]): r["score"] for r in near.collect()} == pytest.approx(far) and len(far) == 48


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 10)
    rows = spark.range(1000).withColumn("k", F.col("id") % 300)
    assert base.in_parts(10, (rows, "k"))[0] is rows
    few, many = (base.in_parts(n, (rows, "k"))[0].rdd.getNumPartitions() for n in (500, 5_000))
    assert few == max(50, spark.sparkContext.defaultParallelism) and many == 500
