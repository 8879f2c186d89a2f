"""Operators over whole texts ask for small Arrow batches, so that a Python worker holds the same whatever the input."""

import pytest

from ledgerlark.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["packed_chunks", "planned_round_robin", "retrieval_metrics_at_k"])
def test_batches(spark, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES[name](spark, SF)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
