"""What the plans must not contain, and what must reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studylake.operators import mastery as M
from studylake.sources.tables import view
from tests.conftest import SF

QUERIES = entry.queries()
# Queries that run jobs while they are built (streams, checkpoints) are checked through their operators.
EAGER = {n for n in QUERIES if re.match(r"s\d\d_stream|s05|op\d|pipeline", n)}


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(M.period_stats(view(spark, sf, "answers").filter(F.col("learner_id") == 7), "2024-01-30"))
    physical = text.split("== Physical Plan ==")[1]
    assert "EqualTo(user_id,7)" in physical
    assert "GreaterThanOrEqual(ts,2024-01-23" in physical
    read = re.search(r"ReadSchema: struct<([^>]*)>", physical)[1]
    assert "value" not in read and "event_id" not in read


def test_counts_are_combined_before_the_shuffle(spark, sf):
    physical = plan(M.mastery(view(spark, sf, "answers"))).split("== Physical Plan ==")[1]
    assert physical.count("HashAggregate") == 2 and physical.count("Exchange hashpartitioning") == 1


def test_last_n_is_cut_before_the_shuffle(spark, sf):
    physical = plan(QUERIES["w07_wrong_book"](spark, sf)).split("== Physical Plan ==")[1]
    assert "WindowGroupLimit" in physical


@pytest.mark.parametrize("name, most", [("g07_parent_report", 2), ("h24_report_text_weekly", 3), ("c10_prerequisite_chain", 4)])
def test_scans_of_the_facts(spark, sf, name, most):
    physical = plan(QUERIES[name](spark, sf)).split("== Physical Plan ==")[1]
    assert len(re.findall(r"FileScan parquet", physical)) <= most
