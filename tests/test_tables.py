from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.sinks.audit import audit_layout, audit_rows, unprocessed_layout
from rowferry.sinks.tables import StaleTable, TableExists, TableMissing, TableStore
from rowferry.sources.staging import stage
from rowferry.spec import Target
from rowferry.workspace import fresh_folder


@pytest.fixture
def store(spark):
    return TableStore(spark, fresh_folder(spark, "tables"))


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_versions(spark, store):
    assert not store.exists("s", "t")
    with pytest.raises(TableMissing):
        store.read("s", "t")
    assert store.publish("s", "t", spark.range(3)) == 3
    assert store.publish("s", "t", spark.range(3, 5), mode="add") == 2
    old = store.read("s", "t")
    assert ids(old) == [0, 1, 2, 3, 4]
    assert store.publish("s", "t", old.filter("id > 2")) == 2  # a table may be rewritten from itself
    assert ids(store.read("s", "t")) == [3, 4]
    assert ids(old) == [0, 1, 2, 3, 4]  # a reader of the old state is not disturbed
    assert [v.mode for v in store.versions("s", "t")] == ["full", "add", "full"]
    assert store.drop_old_versions("s", "t") == 2
    assert ids(store.read("s", "t")) == [3, 4]


def test_empty_load_counts_zero(spark, store):
    assert store.publish("s", "t", spark.range(5).filter("id > 9")) == 0
    assert store.read("s", "t").count() == 0
    assert store.publish("s", "t", spark.range(2).join(spark.range(0), "id"), mode="add") == 0


def test_a_tag_is_applied_once(spark, store):
    assert store.publish("s", "t", spark.range(3), mode="add", tag="run-1") == 3
    assert store.publish("s", "t", spark.range(9), mode="add", tag="run-1") == 3  # what is there
    assert store.has_tag("s", "t", "run-1") and not store.has_tag("s", "t", "run-2")
    assert ids(store.read("s", "t")) == [0, 1, 2]


def test_a_dead_load_leaves_nothing_behind(spark, store):
    store.publish("s", "t", spark.range(2))
    lost = F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id"))
    with pytest.raises(Exception, match="lost"):
        store.publish("s", "t", spark.range(5).select(lost.alias("id")), tag="x")
    os.makedirs(f"{store.folder('s', 't')}/000007.full")  # a folder without _SUCCESS
    assert ids(store.read("s", "t")) == [0, 1]
    store.publish("s", "t", spark.range(4), tag="x")
    assert ids(store.read("s", "t")) == [0, 1, 2, 3]


def test_create_copy_ensure(spark, store):
    layout = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("d", T.DecimalType(12, 4))])
    assert store.ensure("s", "a", layout) == {"created": True, "skipped_existing": False}
    assert store.ensure("s", "a", layout) == {"created": False, "skipped_existing": True}
    with pytest.raises(TableExists):
        store.create("s", "a", layout)
    store.copy_structure("s", "a", "s", "b")
    got = store.read("s", "b")
    assert [(f.name, f.dataType) for f in got.schema] == [("id", T.LongType()), ("d", T.DecimalType(12, 4))]
    assert got.count() == 0
    with pytest.raises(TableExists):
        store.copy_structure("s", "a", "s", "b")
    with pytest.raises(TableMissing):
        store.copy_structure("s", "none", "s", "c")


def test_compact(spark, store):
    for i in range(3):
        store.publish("s", "t", spark.range(i, i + 1), mode="add")
    assert store.compact("s", "t") == 3
    assert ids(store.read("s", "t")) == [0, 1, 2]


def test_stage_replaces(spark, store):
    stage(spark, spark.range(9), "x", store)
    assert ids(stage(spark, spark.range(2), "x", store)) == [0, 1]


def test_audit_layout():
    target = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("email", T.StringType())])
    layout = audit_layout(target, ["id", "tenant"])
    assert layout.names == ["id", "email", "rejected_at", "logged_at", "migration_id", "blueprint_sequence",
                            "target_schema", "target_table", "tenant", "source_snapshot", "reject_reason", "raw_row"]
    assert layout["tenant"].dataType == T.StringType() and layout["id"].dataType == T.LongType()
    assert unprocessed_layout(target).names == ["id", "email", "rejected_at"]


def test_audit_rows(spark):
    import datetime as dt
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rejects = spark.createDataFrame([(7, None, "DUPLICATE_KEY")], "id bigint, email string, reject_reason string")
    row = audit_rows(rejects, ["id", "email"], "m", 3, Target("core", "users", ("id",), "IGNORE_AND_LOG"), at).first()
    assert row.rejected_at == row.logged_at == at
    assert (row.migration_id, row.blueprint_sequence, row.target_schema, row.target_table) == ("m", 3, "core", "users")
    assert row.source_snapshot == '{"id":7}' and row.raw_row == '{"id":7,"email":null}'
    assert row.reject_reason == "DUPLICATE_KEY"


def test_a_load_from_an_older_state_is_withdrawn(spark, store):
    store.publish("s", "t", spark.range(3))
    base = store.newest("s", "t")
    store.publish("s", "t", spark.range(3, 5), mode="add")
    with pytest.raises(StaleTable):
        store.publish("s", "t", spark.range(1), base=base)
    assert ids(store.read("s", "t")) == [0, 1, 2, 3, 4]
    assert store.publish("s", "t", spark.range(1), base=store.newest("s", "t")) == 1


def test_private_and_replaced_copies(spark, store):
    one, two = stage(spark, spark.range(2), "x"), stage(spark, spark.range(3), "x")
    assert (one.count(), two.count()) == (2, 3)
    stage(spark, spark.range(2), "x", store), stage(spark, spark.range(3), "x", store)
    assert [v.number for v in store.versions("staging", "x")] == [2]
