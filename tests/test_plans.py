"""The physical plans that keep the work cheap at scale."""

from __future__ import annotations

import re

import pytest

from queries import QUERIES
from rowferry.operators.conflict import ignore, upsert
from rowferry.sources.staging import stage

# these write files or run several jobs; the frame they give is only the last read
WRITING = {"csv_scan", "csv_options", "csv_columns", "csv_files", "csv_types", "join_cross_source"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITING and not n.startswith(
    ("run_", "migration", "chunked", "chunk_metrics", "stream", "batch_", "structure", "table_", "stage", "execution", "load_unprocessed"))])
def test_no_nested_loops_windows_or_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "Python", "ArrowEval", "Coalesce 1"):
        assert bad not in text, bad


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["pre_filter"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThanOrEqual(o_orderdate" in text
    read = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert "o_orderpriority" not in read and "o_custkey" not in read


def test_a_step_reads_only_what_it_maps(spark, sf):
    text = plan(QUERIES["run_blueprint"](spark, sf))
    reads = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert len(reads) == 2 and not any("c_mktsegment" in r for r in reads)
    assert "GreaterThan(c_acctbal,0.0)" in text and "LessThan(n_regionkey,4)" in text
    assert text.count("Exchange") == 1 and "BroadcastExchange" in text


def test_chunk_range_is_pushed(spark, sf):
    text = plan(QUERIES["chunk_filter"](spark, sf))
    assert "GreaterThan(o_orderkey," in text and "LessThanOrEqual(o_orderkey," in text


def test_policies_shuffle_keys_of_the_target_only(spark, sf):
    """IGNORE reads target rows once for the result and key columns alone for the match."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["load_upsert"](spark, sf))
        # target once, key columns of the batch once, whole batch once
        assert text.count("Exchange hashpartitioning") == 3 and "partial_max" in text
        assert "SortMergeJoin" in text and "LeftAnti" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_small_batch_leaves_the_target_unshuffled(spark, sf):
    """With a staged batch Spark knows its size: the few keys are broadcast to the target's scan."""
    target = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    batch = stage(spark, target.limit(3), "small_batch")
    keys = ["l_orderkey", "l_linenumber"]
    for df in (ignore(target, batch, keys).append, upsert(target, batch, keys).new_target):
        df.collect()
        final = plan(df).split("== Initial Plan ==")[0]
        scans = [final[:m.start()].splitlines()[-8:] for m in re.finditer(r"FileScan[^\n]*lineitem", final)]
        assert scans and not any("Exchange hashpartitioning" in line for above in scans for line in above[-3:])
        assert "BroadcastHashJoin" in final


def test_checksums_and_checks_combine_before_the_shuffle(spark, sf):
    for name in ("recon_checksum", "recon_diff", "key_check", "null_check"):
        assert "partial_" in plan(QUERIES[name](spark, sf)), name
