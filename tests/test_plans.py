"""Plans stay inside code generation, prune columns and push filters down."""

import re

import pytest
from pyspark.sql import functions as F

from complyspark.operators import retrieval as R
from complyspark.plans import registry

PYTHON_QUERIES = {"restore_spelling", "grounded_merge", "respell_guard", "dossier_flow", "dossier_checks", "indexed_topk", "logged_runs"}
# Queries that hold all rows against one row: a maximum, a count, a day asked for.
ONE_ROW = {"active_jobs", "in_force_interval_join", "relaxed_fallback", "prune_orphans", "guaranteed_topk_cap", "field_ranks", "coverage_at_k"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON_QUERIES))
def test_no_python(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert not re.search("Python|Pandas|InArrow", text)
    assert "CartesianProduct" not in text
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in text


def test_pruned_and_pushed(spark, sf_dir):
    text = plan(registry.QUERIES["scope_filter"](spark, sf_dir))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "In(o_orderstatus" in text
    assert "o_totalprice" not in text
    assert "html" not in plan(registry.QUERIES["chunk_sources"](spark, sf_dir))
    assert "text" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan(registry.QUERIES["chunk_sources"](spark, sf_dir)))[0]


def test_flow_joins_on_keys(spark, sf_dir):
    """Passages meet the one row of all fields' vectors, days meet passages on spans."""
    from complyspark.plans import flow

    docs, chunks = flow._forms(spark, sf_dir)
    fields = spark.createDataFrame([(1, "wage", "Tiền lương", "5")], "doc_id long, field_key string, label string, value string")
    near = plan(flow.nearness(fields, chunks, flow.CHECK))
    assert near.count("BroadcastNestedLoopJoin") <= 1 and "collect_list" in near and "CartesianProduct" not in near
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(50).select(day.alias("day"))
    table = spark.range(500).select((F.col("id") % 3).cast("string").alias("field_key"), F.col("id").cast("string").alias("chunk_id"), F.rand(1).alias("distance"), day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    text = plan(R.valid_top_k(days, table, 3, by=("field_key",)))
    # the one left gives days without a passage in force the k nearest of each field: its rows are the result's
    assert "CartesianProduct" not in text and text.count("BroadcastNestedLoopJoin") <= 1
    scoped = plan(R.valid_top_k(days.withColumn("s", F.col("day").cast("string")), table.withColumn("s", F.col("chunk_id")), 3, ("s",), ("field_key",)))
    assert "BroadcastNestedLoopJoin" not in scoped
