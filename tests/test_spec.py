from __future__ import annotations

import copy

import pytest

from queries.runs import document
from rowferry.spec import (
    Chunking, ColumnMap, Connection, Join, Source, SpecError, Step, Target, connection_from, migration_from)

DOC = document("/data", "s3://bucket/archive")


def test_document():
    m = migration_from({"$schema": "x", "output_format": "SQL", **DOC})
    assert [s.order for s in m.steps] == [1, 2, 3]
    two = m.steps[1]
    assert two.chunking == Chunking("ln.l_orderkey", 2500)
    assert [j.how for j in two.joins] == ["INNER", "LEFT"] and two.joins[0].conditions[0].operator == "="
    assert two.target == Target("shipping", "lines", ("order_key", "line_no"), "UPSERT", connection="lake")
    assert two.columns[5] == ColumnMap("origin", "CONSTANT", "'LIVE'", "VARCHAR(8)", False)
    assert m.steps[0].chunking is None and m.steps[2].root == Source("it", "archive", "items.csv")
    assert m.connections["archive"] == Connection("CSV_S3_BUCKET", "s3://bucket/archive/", {"aws_region": "us-west-2"})


def changed(path, value):
    doc = copy.deepcopy(DOC)
    at = doc
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return doc


@pytest.mark.parametrize("path,value", [
    (("blueprints", 2, "sequence_order"), 5),
    (("blueprints", 1, "sequence_order"), 1),
    (("blueprints", 0, "target", "on_conflict"), "MERGE"),
    (("blueprints", 0, "target", "on_conflict"), "IGNORE_AND_INSERT_UNPROCESSED"),
    (("blueprints", 0, "target", "primary_keys"), []),
    (("blueprints", 0, "target", "primary_keys"), ["nothing"]),
    (("blueprints", 0, "surprise"), 1),
    (("blueprints", 0, "mappings"), []),
    (("blueprints", 0, "mappings", 0, "cast_to"), "BLOB"),
    (("blueprints", 0, "mappings", 0, "source_value"), " "),
    (("blueprints", 0, "mappings", 0, "target_column"), "label"),
    (("blueprints", 0, "sources", "joins", 0, "join_type"), "CROSS"),
    (("blueprints", 0, "sources", "joins", 0, "conditions"), []),
    (("blueprints", 0, "sources", "joins", 0, "alias"), "cu"),
    (("blueprints", 0, "sources", "root_table", "connection_ref"), "nowhere"),
    (("blueprints", 0, "sources", "root_table", "alias"), "derivations"),
    (("blueprints", 1, "mappings", 3, "source_value"), "net"),
    (("blueprints", 1, "chunking_strategy", "chunk_size"), 0),
    (("connections", "lake", "type"), "ORACLE"),
])
def test_what_is_refused(path, value):
    with pytest.raises(SpecError):
        migration_from(changed(path, value))


def test_keys_are_optional_where_nothing_compares_them():
    for policy in ("FAIL", "IGNORE"):
        Target("s", "t", (), policy)
    for policy in ("UPSERT", "IGNORE_AND_LOG"):
        with pytest.raises(SpecError):
            Target("s", "t", (), policy)


def test_audit_table_and_local_csv_are_accepted():
    doc = changed(("blueprints", 0, "target", "audit_table"), {"schema": "core", "table_name": "log"})
    assert migration_from(doc).steps[0].target.audit_table == "core.log"
    assert migration_from(changed(("blueprints", 0, "target", "audit_table"), "log")).steps[0].target.audit_table == "log"
    c = connection_from({"type": "LOCAL_CSV", "file_path": "/x.csv", "parse_options": {"delimiter": ";"}})
    assert c.options["parse_options"] == {"delimiter": ";"}


def test_no_password_in_print():
    c = connection_from({"type": "MYSQL", "connection_string": "mysql://u:secret@h/d", "secret_access_key": "hidden"})
    assert "secret" not in repr(c) and "hidden" not in repr(c)


def test_step_needs_columns():
    with pytest.raises(SpecError):
        Step(1, Target("s", "t", ()), Source("a", "c", "t"), ())
    with pytest.raises(SpecError):
        Join(Source("a", "c", "t"), ())
