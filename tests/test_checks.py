from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowferry.operators.checks import (
    checksum_tree, compare_checksums, different_leaves, key_check, null_check, recon_checksum, recon_counts, recon_diff, recon_tree,
    row_text, tree_leaf)
from rowferry.operators.chunks import chunk_bounds, chunk_filter, chunk_plan, load_ranges
from rowferry.operators.ledger import LEDGER_SCHEMA, METRICS_SCHEMA, empty, execution_report, row_errors, stop_on_errors
from rowferry.operators.shape import align, evaluate
from rowferry.spec import ColumnMap

DDL = "k int, a string, v int"


def make(spark, *rows, ddl=DDL):
    return spark.createDataFrame(list(rows), ddl)


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_key_check(spark):
    df = make(spark, (1, "x", 0), (1, "x", 1), (2, None, 0), (None, None, 0), (3, "y", 0))
    assert bag(key_check(df, ["k", "a"])) == sorted([
        (1, "x", 2, "DUPLICATE_KEY"), (2, None, 1, "NULL_KEY"), (None, None, 1, "NULL_KEY")], key=repr)


def test_null_check(spark):
    df = make(spark, (1, "x", None), (None, "", None))
    assert bag(null_check(df, ["k", "a", "v"])) == [("a", 0, 2), ("k", 1, 2), ("v", 2, 2)]
    assert bag(null_check(df.filter("k = 5"), ["k"])) == [("k", 0, 0)]


def test_counts(spark):
    assert recon_counts(spark.range(10), spark.range(7), spark.range(2)).first() == (10, 7, 2, 1, False)


def test_checksum_sees_every_change(spark):
    base = [(1, "x", 1), (1, "x", 1), (2, None, 2), (3, "", 3)]
    same = recon_checksum(make(spark, *base).repartition(3), ["k", "a", "v"]).first()
    assert recon_checksum(make(spark, *reversed(base)), ["k", "a", "v"]).first() == same
    for other in ([(1, "x", 1), (2, None, 2), (3, "", 3)], [*base[:2], (2, "", 2), base[3]], [*base[:3], (3, "", 4)],
                  [(1, "x", 1), (2, None, 2), (2, None, 2), (3, "", 3)]):
        assert recon_checksum(make(spark, *other), ["k", "a", "v"]).first() != same
    moved = make(spark, ("a", "bc"), ddl="p string, q string"), make(spark, ("ab", "c"), ddl="p string, q string")
    assert len({recon_checksum(m, ["p", "q"]).first().checksum for m in moved}) == 2


def test_compare_checksums(spark):
    by_key = lambda *rows: recon_checksum(make(spark, *rows), ["k", "a", "v"], F.col("k"))
    got = compare_checksums(by_key((1, "x", 1), (2, "x", 1), (3, "x", 1)), by_key((1, "x", 1), (2, "y", 1), (4, "x", 1)))
    assert sorted(r.bucket for r in got.collect()) == [2, 3, 4]


def test_diff(spark):
    source = make(spark, (1, "x", 1), (2, "x", 1), (3, None, 1), (4, "m", 1), (4, "m", 2), (None, "n", 1))
    target = make(spark, (1, "x", 1), (2, "y", None), (3, None, 1), (4, "m", 2), (4, "m", 1), (4, "m", 1), (9, "e", 1), (None, "n", 2))
    got = {(r.k): (r.status, r.source_rows, r.target_rows, r.columns) for r in recon_diff(source, target, ["k"], ["a", "v"]).collect()}
    assert got == {2: ("DIFFERENT", 1, 1, "a,v"), 4: ("DIFFERENT", 2, 3, "a,v"), 9: ("EXTRA", 0, 1, None),
                   None: ("DIFFERENT", 1, 1, "v")}
    crossed = make(spark, (1, "p", 1), (1, "q", 2)), make(spark, (1, "p", 2), (1, "q", 1))
    assert bag(recon_diff(*crossed, ["k"], ["a", "v"])) == [(1, "DIFFERENT", 2, 2, "")]
    swapped = make(spark, (1, None, 42), ddl="k int, a int, v int"), make(spark, (1, 42, None), ddl="k int, a int, v int")
    assert bag(recon_diff(*swapped, ["k"], ["a", "v"])) == [(1, "DIFFERENT", 1, 1, "a,v")]
    assert recon_diff(source, source.repartition(4), ["k"], ["a", "v"]).count() == 0


def test_chunks(spark):
    df = make(spark, *[(k, "", 0) for k in (-5, 0, 1, 4, 5, 6, 30)], (None, "", 0))
    assert chunk_bounds(df, "k").first() == (-6, 30) and chunk_bounds(df, "k", 0).first() == (0, 30)
    assert chunk_bounds(df.filter("k > 99"), "k").first() == (0, 0)
    assert bag(chunk_filter(df, "k", 0, 5).select("k")) == [(1,), (4,), (5,)]
    assert bag(chunk_plan(df, "k", 5, 0)) == [(1, 1, 5, 3), (2, 6, 6, 1), (6, 30, 30, 1)]
    assert chunk_plan(df, "k", 5).agg(F.sum("rows")).first()[0] == 8
    plan = chunk_filter(df, "k", 0, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan


@pytest.mark.parametrize("lo,hi,size,commits", [(0, 100, 7, 4), (-6, 30, 5, 100), (0, 1, 10, 3), (5, 5, 1, 2), (0, 10 ** 12, 25000, 8)])
def test_load_ranges(lo, hi, size, commits):
    got = load_ranges(lo, hi, size, commits)
    assert len(got) <= commits and [a for a, _ in got[1:]] == [b for _, b in got[:-1]]
    assert not got or (got[0][0] == lo and got[-1][1] == hi)
    assert all((b - a) % size == 0 for a, b in got[:-1])


def test_ledger_and_report(spark):
    columns = [ColumnMap("id", "DIRECT", "k", "INT"), ColumnMap("u", "DIRECT", "a", "UUID"), ColumnMap("n", "DIRECT", "v", "INT", False)]
    rows = evaluate(make(spark, (1, "abc", None), (2, " ", 5), (3, None, 5)), columns, ["id"], check_null=True)
    got = bag(row_errors(rows, 1, 3).drop("raw_value"))
    assert got == [(1, 3, {"id": "1"}, "CAST_FAILED", "Invalid UUID", "u"),
                   (1, 3, {"id": "1"}, "NULL_VALUE", "No value for a NOT NULL column", "n")]
    with pytest.raises(Exception, match="CAST_FAILED|NULL_VALUE"):
        stop_on_errors(row_errors(rows, 1))
    metrics = spark.createDataFrame([(1, 0, 3, 5.0), (1, 1, 4, 6.0), (2, 0, 1, 1.0)], METRICS_SCHEMA)
    row = execution_report("m", metrics, row_errors(rows, 1), steps=2).first()
    assert (row.success, row.blueprints_completed, row.rows_processed, row.batches_processed, row.row_error_count) == (True, 2, 8, 3, 2)
    assert [tuple(e) for e in row.error_counts] == [(1, "CAST_FAILED", 1), (1, "NULL_VALUE", 1)]
    none = execution_report("m", empty(spark, METRICS_SCHEMA), empty(spark, LEDGER_SCHEMA), steps=1).first()
    assert (none.success, none.rows_processed, none.row_error_count) == (False, 0, 0)


def test_align(spark):
    target = spark.createDataFrame([], "V bigint, a string, missing date, k decimal(5,1)").schema
    got = align(make(spark, (1, " x ", 7)), target, [ColumnMap("a", "EXPRESSION", "UPPER(a)", "TEXT")])
    assert got.columns == ["V", "a", "missing", "k"] and got.schema["missing"].dataType == target["missing"].dataType
    assert [str(v) for v in got.first()] == ["7", "X", "None", "1.0"]


def test_rows_are_the_same_multiset_after_evaluate(spark):
    df = make(spark, *[(i % 3, "a", i % 2) for i in range(12)])
    columns = [ColumnMap("k", "DIRECT", "k", "INT"), ColumnMap("v", "DIRECT", "v", "INT")]
    got = Counter((r.k, r.v) for r in evaluate(df, columns).collect())
    assert got == Counter((i % 3, i % 2) for i in range(12))


def test_chunk_numbers_near_the_end_of_the_range(spark):
    start = 2 ** 60
    df = spark.createDataFrame([(start + i,) for i in range(40)], "k long")
    assert [r.rows for r in chunk_plan(df, "k", 10).orderBy("chunk").collect()] == [10, 10, 10, 10]


def test_checksums_tell_null_from_its_mark_and_fields_apart(spark):
    one = spark.createDataFrame([(None, "a"), ("x\x1fy", "z")], "p string, q string")
    two = spark.createDataFrame([("\\N", "a"), ("x", "y\x1fz")], "p string, q string")
    texts = [[r[0] for r in df.select(row_text(["p", "q"])).collect()] for df in (one, two)]
    assert not set(texts[0]) & set(texts[1])


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_what_the_whole_comparison_finds(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, None]) if i % 50 == 0 else i, rng.choice("xy"), rng.randrange(5)) for i in range(400)]
    other = [r for r in rows if rng.random() > 0.02]
    other = [(a, b, 9 if rng.random() < 0.02 else v) for a, b, v in other] + [(900, "z", 1), rows[0]]
    s, t = (spark.createDataFrame(x, "a int, b string, v int") for x in (rows, other))
    wanted = Counter(map(tuple, recon_diff(s, t, ["a", "b"], ["v"]).collect()))
    for levels, fanout in ((1, 2), (2, 8), (3, 32)):
        assert Counter(map(tuple, recon_tree(s, t, ["a", "b"], ["v"], levels=levels, fanout=fanout).collect())) == wanted
    assert recon_tree(s, s, ["a", "b"], ["v"]).count() == 0 and recon_tree(s.limit(0), t.limit(0), ["a"], ["v"]).count() == 0


def test_tree_compares_few_rows_when_few_differ(spark):
    s = spark.range(20_000).selectExpr("id", "id % 7 AS v")
    t = s.filter("id <> 77").selectExpr("id", "IF(id = 5, -1, v) AS v")
    trees = [checksum_tree(df, ["id"], ["v"]).persist() for df in (s, t)]
    assert trees[0].filter("level = 0").first()["rows"] == 20_000
    leaves = different_leaves(*trees)
    assert len(leaves) == 2 and s.filter(tree_leaf(["id"]).isin(leaves)).count() < 20
    found = recon_tree(s, t, ["id"], ["v"], source_tree=trees[0], target_tree=trees[1])
    assert sorted((r.id, r.status) for r in found.collect()) == [(5, "DIFFERENT"), (77, "MISSING")]
