"""The physical plans keep what makes the operators scale."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caselens.operators import hunts, retrieve, scan
from caselens.plans.registry import events, one_source

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(retrieve.apply_filters(
        events(spark, FOLDER), fields="", field_filters={"event_type": "error"},
        ts_from="2024-01-02").select("line_no"))
    assert "EqualTo(event_type,error)" in text and "GreaterThanOrEqual(ts" in text
    assert "props" not in text.split("ReadSchema")[1]


def test_limits_per_group_are_taken_before_the_shuffle(spark):
    ranked = [retrieve.top_values(events(spark, FOLDER), "user"),
              hunts.size_outlier(one_source(spark, FOLDER), ["event_type"], "value", 20, 3.0),
              scan.apply_budget(events(spark, FOLDER).select(
                  "source_id", "line_no", F.col("event_type").alias("rule_id")), {"error": 500})]
    for df in ranked:
        text = plan(df)
        assert text.index("WindowGroupLimit") < text.rindex("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["rate_spike", "size_outlier", "sequence", "periodicity",
                                  "cross_key_same_value", "signature_scan", "chain_checks",
                                  "window_excerpts", "corroborating_events", "merge_windows",
                                  "validate_notes", "entity_linkage", "cross_source_entities"])
def test_no_product_of_rows(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text or name == "window_excerpts"


def test_signature_scan_does_not_shuffle(spark):
    from caselens.operators.signatures import signature_scan
    rule = {"id": "r", "severity": "low", "target": "any", "match": {"raw": ["x"]}}
    ev = events(spark, FOLDER).withColumn("log_type", F.lit("web"))
    assert "Exchange" not in plan(signature_scan(ev, None, [rule]))


def test_iis_lines_are_not_moved(spark):
    from caselens.sources.iis_logs import parse_iis_w3c
    lines = spark.range(100).select(F.lit("s").alias("source_id"), F.col("id").alias("line_no"), F.when(
        F.col("id") % 40 == 0, "#Fields: date time c-ip").otherwise("2024-01-01 00:00:00 1.2.3.4").alias("raw"))
    text = plan(parse_iis_w3c(lines))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
