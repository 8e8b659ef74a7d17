"""Steps and migrations end to end: policies, failures, resuming, streams."""

from __future__ import annotations

import datetime as dt

import pytest

from rowferry.operators import conflict
from rowferry.operators.conflict import KeyConflict, ignore_and_capture, key_flags
from rowferry.operators.ledger import RowErrors
from rowferry.plans.blueprint import load_step, run_blueprint, stage_step
from rowferry.plans.migration import run_migration
from rowferry.sinks.tables import Buckets, TableStore
from rowferry.spec import Chunking, ColumnMap, Condition, Connection, Join, Migration, Source, SpecError, Step, Target
from rowferry.streaming.batches import file_stream, row_stream, run_stream, stage_row_batches, stream_metrics
from rowferry.workspace import fresh_folder

COLUMNS = (ColumnMap("id", "DIRECT", "s.id", "BIGINT"), ColumnMap("amount", "DIRECT", "s.amount", "DECIMAL(8,2)"))


def step(policy="UPSERT", order=1, table="t", **parts):
    target = parts.pop("target", Target("core", table, ("id",), policy))
    return Step(order, target, Source("s", "c", "s"), parts.pop("columns", COLUMNS), **parts)


def migration(*steps):
    return Migration("m", "client", "1", {"c": Connection("PARQUET", "/nowhere")}, steps)


@pytest.fixture
def store(spark):
    return TableStore(spark, fresh_folder(spark, "tables"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, amount string")


def bag(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def amounts(store, table="t"):
    return {r.id: None if r.amount is None else str(r.amount) for r in store.read("core", table).collect()}


def test_names_stay_valid_to_the_end(spark):
    """Aliases, bare names and ``derivations.`` names in every place that may use them."""
    s = Step(1, Target("x", "y", ()), Source("cm", "c", "a"), (
        ColumnMap("id", "DIRECT", "cm.id", "BIGINT"), ColumnMap("other", "DIRECT", "g.id", "TEXT"),
        ColumnMap("name", "DERIVED", "derivations.name", "TEXT"), ColumnMap("own", "DIRECT", "cm.name", "TEXT"),
        ColumnMap("twice", "EXPRESSION", "derivations.double_id * 2 + double_id", "BIGINT")),
        joins=(Join(Source("g", "c", "b"), (Condition("g.id", "=", "cm.id"),), "LEFT"),),
        pre_filters=("cm.id > 0", "id < 100"), derivations={"name": "UPPER(cm.name)", "double_id": "cm.id * 2"},
        post_filters=("double_id < 10", "derivations.name IS NOT NULL", "cm.name <> 'z'"))
    cm = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "z"), (4, "d"), (50, "e")], "id bigint, name string")
    g = spark.createDataFrame([("1", "x"), ("4x", "y")], "id string, name string")
    got = run_blueprint(s, {"cm": cm, "g": g})
    assert got.columns == ["id", "other", "name", "own", "twice"]
    assert bag(got, *got.columns) == [(1, "1", "B", "b", 6), (4, None, "D", "d", 24)]


def test_a_derivation_cannot_use_another(spark):
    s = step(derivations={"a": "s.id", "b": "a"})
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        run_blueprint(s, {"s": rows(spark, ("1", "1"))})


def test_a_pre_filter_sees_the_root_only(spark):
    s = step(joins=(Join(Source("g", "c", "b"), (Condition("g.id", "=", "s.id"),)),), pre_filters=("g.id = '1'",))
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        run_blueprint(s, {"s": rows(spark, ("1", "1")), "g": rows(spark, ("1", "1"))})


def run(spark, store, s, df, **options):
    name = f"st{len(store.versions('staging', 'x'))}-{s.order}-{id(df)}"
    staged, _ = stage_step(spark, s, {"s": df}, store, name)
    return load_step(spark, s, staged, store, **options)


def test_bad_values_become_null_and_are_listed(spark, store):
    result = run(spark, store, step(), rows(spark, ("1", "x"), ("2", ""), ("3", "4.5"), ("bad", "1")))
    assert amounts(store) == {1: None, 2: None, 3: "4.50"}
    got = bag(store.read("migration_admin", "row_errors"), "row_identity", "error_code", "target_column", "raw_value")
    assert got == sorted([({"id": "1"}, "CAST_FAILED", "amount", "x"), ({"id": "bad"}, "CAST_FAILED", "id", "bad"),
                          ({"id": "bad"}, "NULL_KEY", "id", None)], key=repr)
    assert result.errors == 3 and result.rows_loaded == 3


def test_bad_rows_can_be_left_out(spark, store):
    run(spark, store, step(), rows(spark, ("1", "x"), ("3", "4.5")), reject_bad_rows=True)
    assert amounts(store) == {3: "4.50"}
    with pytest.raises(RowErrors):
        run(spark, store, step("FAIL", table="f"), rows(spark, ("1", "x")), reject_bad_rows=True)
    assert not store.exists("core", "f")


def test_fail_keeps_nothing_of_the_step(spark, store):
    run(spark, store, step("FAIL"), rows(spark, ("1", "1"), ("2", "2")))
    for bad in [("2", "9")], [("5", "1"), ("5", "2")], [(None, "1")]:
        with pytest.raises(KeyConflict):
            run(spark, store, step("FAIL"), rows(spark, ("8", "8"), *bad))
    assert amounts(store) == {1: "1.00", 2: "2.00"}


def test_upsert_adds_without_a_rewrite_when_keys_are_new(spark, store):
    run(spark, store, step(), rows(spark, ("1", "1"), ("2", "2")))
    run(spark, store, step(), rows(spark, ("3", "3")))
    assert [v.mode for v in store.versions("core", "t")] == ["full", "add"]
    run(spark, store, step(), rows(spark, ("1", "7"), ("4", "4")))
    assert [v.mode for v in store.versions("core", "t")] == ["full", "add", "full"]
    assert amounts(store) == {1: "7.00", 2: "2.00", 3: "3.00", 4: "4.00"}


def test_ignore_and_log(spark, store):
    at = dt.datetime(2024, 5, 6)
    s = step(target=Target("core", "t", ("id",), "IGNORE_AND_LOG"))
    run(spark, store, s, rows(spark, ("1", "1")), at=at, migration_id="m1")
    run(spark, store, s, rows(spark, (" 01", "9"), ("2", "2"), ("1", "8"), (None, "3")), at=at, migration_id="m1")
    assert amounts(store) == {1: "1.00", 2: "2.00"}
    log = store.read("core", "migration_conflict_log")
    assert bag(log, "id", "source_snapshot", "reject_reason", "blueprint_sequence", "rejected_at") == sorted([
        (1, '{"id":" 01"}', "DUPLICATE_KEY", 1, at), (1, '{"id":"1"}', "DUPLICATE_KEY", 1, at),
        (None, '{"id":null}', "NULL_KEY", 1, at)], key=repr)


def test_named_audit_and_unprocessed_tables(spark, store):
    first = rows(spark, ("1", "1"))
    for target, where in (
            (Target("core", "a", ("id",), "IGNORE_AND_LOG", audit_table="logs.mine"), ("logs", "mine")),
            (Target("core", "b", ("id",), "IGNORE_AND_INSERT_UNPROCESSED", "later"), ("core", "later"))):
        s = step(target=target)
        run(spark, store, s, first)
        run(spark, store, s, rows(spark, ("1", "2")))
        got = store.read(*where)
        assert bag(got, "id") == [(1,)] and "rejected_at" in got.columns
        assert got.first().rejected_at is not None


def test_target_columns_that_are_not_mapped(spark, store):
    store.publish("core", "t", spark.createDataFrame([(1, "keep", None)], "id bigint, note string, amount decimal(8,2)"))
    run(spark, store, step(), rows(spark, ("1", "5"), ("2", "6")))
    assert bag(store.read("core", "t"), "id", "note", "amount")[0][:2] == (1, "keep")
    assert amounts(store) == {1: "5.00", 2: "6.00"}
    run(spark, store, step("IGNORE"), rows(spark, ("2", "9"), ("3", "9")))
    assert amounts(store) == {1: "5.00", 2: "6.00", 3: "9.00"}


def sources(spark, *frames):
    return lambda s: {"s": frames[s.order - 1]}


def test_a_failing_step_keeps_the_ones_before(spark, store):
    m = migration(step(), step("FAIL", 2, "u"), step(order=3))
    good, twice = rows(spark, ("1", "1")), rows(spark, ("1", "1"), ("1", "2"))
    done = run_migration(spark, m, store, run_id="r", sources=sources(spark, good, twice, good), raise_on_failure=False)
    assert isinstance(done.failure, KeyConflict) and amounts(store) == {1: "1.00"} and not store.exists("core", "u")
    report = done.report.first()
    assert (report.success, report.blueprints_completed, report.message.split(":")[0]) == (False, 1, "KeyConflict")
    # the same run goes on after its source is mended; step 1 is not loaded again
    again = run_migration(spark, m, store, run_id="r", sources=sources(spark, good, good, rows(spark, ("1", "3"))))
    assert [r.skipped for r in again.results] == [True, False, False]
    assert amounts(store) == {1: "3.00"} and amounts(store, "u") == {1: "1.00"}
    report = again.report.first()
    assert (report.success, report.blueprints_completed, report.rows_processed) == (True, 3, 3)


def test_rerun_changes_nothing(spark, store):
    m = migration(step(), step("IGNORE", 2, "u"))
    frames = rows(spark, ("1", "1"), ("1", "4"), ("2", "2")), rows(spark, ("1", "1"), ("1", "4"), ("2", "2"))
    for _ in range(2):
        run_migration(spark, m, store, sources=sources(spark, *frames))
        assert amounts(store) == {1: "4.00", 2: "2.00"} and amounts(store, "u") == {1: "1.00", 2: "2.00"}
    with pytest.raises(KeyConflict):
        run_migration(spark, migration(step("FAIL")), store, sources=sources(spark, frames[0]))


def test_chunks(spark, store):
    df = spark.createDataFrame([(i, str(i)) for i in (-3, 0, 1, 9, 10, 11, 25, None)], "id int, amount string")
    s = step("IGNORE", chunking=Chunking("s.id", 10))
    staged, batches = stage_step(spark, s, {"s": df}, store, "one")
    assert [b[:2] for b in batches] == [(0, 8)]
    wanted = [(-3, 1), (0, 1), (1, 1), (9, 2), (10, 2), (11, 2), (25, 3), (None, 0)]
    assert bag(staged, "id", "_batch") == sorted(wanted, key=repr)
    staged, batches = stage_step(spark, s, {"s": df}, store, "three", commits=3, tag="r-")
    assert [b[:2] for b in batches] == [(1, 3), (2, 3), (3, 1), (0, 1)]
    assert bag(staged, "id", "_batch") == sorted(wanted, key=repr)
    _, batches = stage_step(spark, s, {"s": df}, store, "three", commits=3, tag="r-")
    assert [b[1] for b in batches] == [3, 3, 1, 1]  # all there already
    assert staged.count() == store.read("staging", "three").count() == 8
    staged, _ = stage_step(spark, s, {"s": df}, store, "above0", lower=0)
    assert bag(staged, "id", "_batch") == [(1, 1), (10, 1), (11, 2), (25, 3), (9, 1)]


def test_unmatched_right_rows_come_once_in_a_chunked_step(spark, store):
    s = step("IGNORE", chunking=Chunking("s.id", 1), joins=(Join(Source("g", "c", "g"), (Condition("g.id", "=", "s.id"),), "FULL"),),
             columns=(ColumnMap("id", "EXPRESSION", "COALESCE(s.id, g.id)", "BIGINT"),))
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([(3,), (7,)], "id int")
    staged, _ = stage_step(spark, s, {"s": left, "g": right}, store, "x", commits=3)
    assert bag(staged, "id") == [(1,), (2,), (3,), (7,)]


def test_a_source_may_be_the_target_itself(spark, store):
    run(spark, store, step(), rows(spark, ("1", "1"), ("2", "2")))
    s = step(columns=(COLUMNS[0], ColumnMap("amount", "EXPRESSION", "s.amount * 2", "DECIMAL(8,2)")))
    run(spark, store, s, store.read("core", "t"))
    assert amounts(store) == {1: "2.00", 2: "4.00"}


def test_stream(spark, store):
    folder = fresh_folder(spark, "in")
    for i in range(3):
        rows(spark, ("1", str(i)), (str(10 + i), "5")).coalesce(1).write.mode("append").parquet(folder)
    schema = rows(spark, ("1", "1")).schema
    stream = lambda: file_stream(spark, folder, schema, files_per_batch=1)
    place = fresh_folder(spark, "checkpoint")
    run_stream(spark, stream(), step(), store, "in", place)
    assert amounts(store) == {1: "2.00", 10: "5.00", 11: "5.00", 12: "5.00"}
    metrics = stream_metrics(spark, store, "in").collect()
    assert sorted((m.batch_number, m.rows_processed) for m in metrics) == [(0, 2), (1, 2), (2, 2)]
    versions = len(store.versions("core", "t"))
    run_stream(spark, stream(), step(), store, "in", place)  # nothing new
    assert len(store.versions("core", "t")) == versions
    rows(spark, ("1", "x"), ("13", "5")).coalesce(1).write.mode("append").parquet(folder)
    run_stream(spark, stream(), step(), store, "in", place)
    assert amounts(store) == {1: None, 10: "5.00", 11: "5.00", 12: "5.00", 13: "5.00"}


def test_a_lost_checkpoint_loads_again_and_changes_nothing(spark, store):
    folder = fresh_folder(spark, "in")
    rows(spark, ("1", "1")).coalesce(1).write.parquet(folder)
    schema = rows(spark, ("1", "1")).schema
    for i in range(2):
        run_stream(spark, file_stream(spark, folder, schema), step("IGNORE"), store, "in", fresh_folder(spark, f"c{i}"))
    assert amounts(store) == {1: "1.00"} and store.read("core", "t").count() == 1


def test_a_batch_handed_over_twice_is_taken_once(spark, store):
    """The commit of a batch is lost after the batch was staged and loaded."""
    import os
    folder, place = fresh_folder(spark, "in"), fresh_folder(spark, "checkpoint")
    rows(spark, ("1", "1")).coalesce(1).write.parquet(folder)
    schema = rows(spark, ("1", "1")).schema
    s = step("FAIL")
    run_stream(spark, file_stream(spark, folder, schema), s, store, "in", place)
    for name in ("commits/0", "commits/.0.crc"):
        os.remove(f"{place}/{name}")
    again = run_stream(spark, file_stream(spark, folder, schema), s, store, "in", place)
    assert again.skipped and store.read("staging", "in").count() == 1 and amounts(store) == {1: "1.00"}


def test_a_resumed_run_goes_on_with_its_staged_ranges(spark, store):
    """A run that died between staging and loading reads its source only for the ranges it lacks."""
    s = step(chunking=Chunking("s.id", 10))
    df = spark.createDataFrame([(i, "1") for i in range(30)], "id int, amount string")
    stage_step(spark, s, {"s": df}, store, "r_step1", commits=3, tag="r-step1-")
    done = run_migration(spark, migration(s), store, run_id="r", sources=sources(spark, df), commits=3)
    assert done.results[0].rows_read == 30 and done.results[0].rows_loaded == 30
    assert not store.exists("staging", "r_step1")


def test_a_mapped_column_the_target_lacks_is_an_error(spark, store):
    store.publish("core", "t", spark.createDataFrame([(1,)], "id bigint"))
    with pytest.raises(SpecError, match="amount"):
        run(spark, store, step(), rows(spark, ("1", "1")))


def test_lower_bound_of_a_migration(spark, store):
    df = spark.createDataFrame([(i, "1") for i in (-1, 0, 1, 2)], "id int, amount string")
    s = step("IGNORE", chunking=Chunking("s.id", 10))
    run_migration(spark, migration(s), store, sources=sources(spark, df), lower=0)
    assert sorted(amounts(store)) == [1, 2]


def test_values_take_the_type_of_the_target(spark, store):
    store.create("core", "t", spark.createDataFrame([], "id bigint, amount int").schema)
    for amount in ("5000000000", "7"):
        s = step(columns=(COLUMNS[0], ColumnMap("amount", "DIRECT", "s.amount", "BIGINT")))
        result = run(spark, store, s, rows(spark, ("1", amount), ("2", "6")))
        assert result.errors == (amount != "7") and result.rows_loaded == 2
    assert (result.rows_inserted, result.rows_updated) == (0, 2)
    assert dict(store.read("core", "t").dtypes)["amount"] == "int"
    assert amounts(store) == {1: "7", 2: "6"}
    entry = store.read("migration_admin", "row_errors").first()
    assert (entry.error_code, entry.raw_value, entry.row_identity) == ("CAST_FAILED", "5000000000", {"id": "1"})


def test_reports_hold_their_own_run_and_fail_stops_on_errors(spark, store):
    m = migration(step("IGNORE"))
    for run_id in ("r-2", "r"):
        done = run_migration(spark, m, store, run_id=run_id, sources=sources(spark, rows(spark, ("1", "x"), (run_id, "1"))))
        report = done.report.first()
        assert (report.rows_processed, report.batches_processed) == (2, 1)
    with pytest.raises(RowErrors):
        run(spark, store, step("FAIL", table="f"), rows(spark, ("1", "x")))


def test_order_and_checks_of_a_migration(spark, store):
    columns = (COLUMNS[0], ColumnMap("a", "EXPRESSION", "NULLIF(s.amount, '9')", "VARCHAR(2)", False),
               ColumnMap("z", "EXPRESSION", "0 - s.amount", "BIGINT"))
    s = step(columns=columns, target=Target("core", "t", ("id",), "UPSERT", order_by=("z",)))
    done = run_migration(spark, migration(s), store, check_null=True, check_length=True, sources=sources(
        spark, rows(spark, ("1", "3"), ("1", "2"), ("2", "9"), ("3", "444"))))
    assert bag(store.read("core", "t"), "id", "z") == [(1, -2), (2, -9), (3, -444)]
    assert [tuple(e) for e in done.report.first().error_counts] == [(1, "NULL_VALUE", 1), (1, "TOO_LONG", 1)]


BUCKETED = Target("core", "t", ("id",), "UPSERT", buckets=16)


def folders(store, number):
    import os
    (version,) = [v for v in store.versions("core", "t") if v.number == number]
    return {f for f in os.listdir(version.path) if f.startswith("_part=")}


def test_an_update_reads_and_writes_the_buckets_it_meets(spark, store, monkeypatch):
    s = step(target=BUCKETED)
    run(spark, store, s, spark.range(500).selectExpr("id", "'1' AS amount"))
    assert [v.layout for v in store.versions("core", "t")] == [store.layout("core", "t")] and len(folders(store, 1)) == 16
    taken = []
    read = store.read
    monkeypatch.setattr(store, "read", lambda *a, buckets=None, **k: (taken.append(buckets), read(*a, buckets=buckets, **k))[1])
    result = run(spark, store, s, rows(spark, ("7", "2"), ("8", "3"), ("9001", "4"), ("9002", "5")))
    assert (result.rows_updated, result.rows_inserted) == (2, 2)
    batch = Buckets(16, ("id",)).of(spark.createDataFrame([(7,), (8,), (9001,), (9002,)], "id bigint"))
    met = Buckets(16, ("id",)).of(spark.createDataFrame([(7,), (8,)], "id bigint"))
    assert [b for b in taken if b is not None] == [batch, met]
    assert folders(store, 2) == {f"_part=new-{b}" for b in met} | {f"_part=add-{b}" for b in batch if b not in met}
    monkeypatch.undo()
    pruned = store.read("core", "t", buckets=met).inputFiles()
    assert pruned and all(any(f"_part=new-{b}/" in f for b in met) and "000002" in f for f in pruned)
    run(spark, store, s, rows(spark, ("9003", "6")))  # a new key adds to its bucket
    assert {f.split("-")[0] for f in folders(store, 3)} == {"_part=add"}
    now = amounts(store)
    assert len(now) == 503 and {k: now[k] for k in (6, 7, 8, 9001, 9003)} == {6: "1.00", 7: "2.00", 8: "3.00", 9001: "4.00", 9003: "6.00"}
    assert store.read("core", "t").columns == ["id", "amount"] and store.drop_old_versions("core", "t") == 0
    store.compact("core", "t")
    assert store.layout("core", "t") is None and store.drop_old_versions("core", "t") == 3 and amounts(store) == now


@pytest.mark.parametrize("policy", ["FAIL", "IGNORE", "UPSERT", "IGNORE_AND_LOG"])
def test_policies_on_a_table_in_buckets(spark, store, policy):
    """A table without buckets gets them with the first load that asks for them; then loads agree with plain ones."""
    for buckets, table in ((None, "t"), (4, "u")):
        run(spark, store, step("IGNORE", table=table), rows(spark, *[(str(i), "1") for i in range(0, 40, 2)]))
        for batch in ([(str(i), "2") for i in range(1, 20, 2)], [(str(i), "3") for i in range(41, 60)] + ([("4", "5"), ("4", "6")] if policy != "FAIL" else [])):
            run(spark, store, step(target=Target("core", table, ("id",), policy, buckets=buckets)), rows(spark, *batch))
    assert amounts(store, "u") == amounts(store, "t")
    assert store.layout("core", "u").startswith("4k")
    if policy == "IGNORE_AND_LOG":
        assert store.read("core", "migration_conflict_log").groupBy("target_table").count().collect()[0]["count"] == 2


def test_a_resumed_run_loses_no_late_row(spark, store):
    """Key 5 comes after its range is staged and the run died; a changed column counts if it is watched."""
    s = step(chunking=Chunking("s.id", 10))
    make = lambda ids, amount="1": spark.createDataFrame([(i, amount) for i in ids], "id int, amount string")
    stage_step(spark, s, {"s": make([i for i in range(30) if i != 5])}, store, "r_step1", commits=3, tag="r-step1-")
    done = run_migration(spark, migration(s), store, run_id="r", sources=sources(spark, make(range(30))), commits=3)
    assert done.results[0].rows_read == done.results[0].rows_loaded == 30 and sorted(amounts(store)) == list(range(30))
    for watch, amount in (((), "1.00"), (("s.amount",), "2.00")):
        name = f"w{len(watch)}"
        stage_step(spark, s, {"s": make(range(30))}, store, name, commits=3, tag=f"{name}-", watch=watch)
        staged, _ = stage_step(spark, s, {"s": make(range(30), "2")}, store, name, commits=3, tag=f"{name}-", watch=watch)
        assert {str(r.amount) for r in staged.collect()} == {amount}
    staged, batches = stage_step(spark, s, {"s": make(range(0))}, store, "w0", commits=3, tag="w0-")
    assert staged.count() == 0 and [b[1] for b in batches] == [0, 0, 0, 0]


def test_a_source_that_never_stands_still_is_an_error(spark, store, monkeypatch):
    from rowferry.plans import blueprint
    counter = iter(range(100))
    monkeypatch.setattr(blueprint, "fingerprints", lambda *a: {1: f"1-{next(counter)}"})
    with pytest.raises(blueprint.SourceChanged):
        stage_step(spark, step(chunking=Chunking("s.id", 10)), {"s": rows(spark, ("1", "1"))}, store, "x", commits=1, tag="x-")


def test_a_load_that_died_before_its_target_is_logged_anew(spark, store, monkeypatch):
    """Refused rows and errors are out, the run dies, another load adds a key, the run is called again."""
    s = step(target=Target("core", "t", ("id",), "IGNORE_AND_LOG"))
    batch = rows(spark, ("1", "7"), ("2", "x"), ("3", "9"))
    run(spark, store, step("IGNORE"), rows(spark, ("2", "1")))
    publish = store.publish

    def dies(schema, table, *a, **k):
        if (schema, table) == ("core", "t"):
            raise RuntimeError("gone")
        return publish(schema, table, *a, **k)

    monkeypatch.setattr(store, "publish", dies)
    with pytest.raises(RuntimeError):
        run_migration(spark, migration(s), store, run_id="r", sources=sources(spark, batch))
    monkeypatch.undo()
    run(spark, store, step("IGNORE"), rows(spark, ("1", "1")))
    run_migration(spark, migration(s), store, run_id="r", sources=sources(spark, batch))
    assert bag(store.read("core", "migration_conflict_log"), "id") == [(1,), (2,)]
    assert bag(store.read("migration_admin", "row_errors"), "raw_value") == [("x",)]
    assert amounts(store) == {1: "1.00", 2: "1.00", 3: "9.00"}
    again = run_migration(spark, migration(s), store, run_id="r", sources=sources(spark, batch))
    assert again.results[0].skipped and store.read("core", "migration_conflict_log").count() == 2


def test_capture_reads_the_batch_twice_and_the_targets_keys_once(spark, store):
    folder = fresh_folder(spark, "files")
    spark.range(100).selectExpr("id", "id % 7 AS v").write.parquet(f"{folder}/batch")
    spark.range(50).selectExpr("id * 3 AS id", "-1L AS v", "'x' AS w").write.parquet(f"{folder}/target")
    batch, target = (spark.read.parquet(f"{folder}/{n}") for n in ("batch", "target"))
    flags = key_flags(target, batch, ["id"])
    scans = lambda df, name: sum(f"{name}]" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    flags.write.partitionBy("flag").parquet(f"{folder}/flags")
    assert (scans(flags, "batch"), scans(flags, "target")) == (1, 1)
    kept = spark.read.schema(flags.schema).parquet(f"{folder}/flags")
    load = ignore_and_capture(target, batch, ["id"], flags=kept)
    assert (scans(load.rejects, "batch") - 1, scans(load.rejects, "target"), scans(load.append, "batch")) == (1, 0, 0)  # NULL keys
    assert load.append.count() == 66 and load.rejects.count() == 34


def test_batches_of_rows(spark, store):
    """Dense keys, and a second lot that comes after a stop."""
    folder, place = fresh_folder(spark, "in"), fresh_folder(spark, "checkpoint")
    first = spark.createDataFrame([("5", "1")] * 25 + [(str(i), "2") for i in range(17)], "id string, amount string")
    stage_row_batches(first, folder, 10, "id")
    s = step("IGNORE", target=Target("core", "t", (), "IGNORE"))
    result = run_stream(spark, row_stream(spark, folder, first.schema), s, store, "in", place)
    assert result.rows_loaded == 42 and store.read("core", "t").count() == 42
    stage_row_batches(rows(spark, ("77", "3")), folder, 10)
    assert run_stream(spark, row_stream(spark, folder, first.schema), s, store, "in", place).rows_loaded == 1
    sizes = [r.rows_processed for r in stream_metrics(spark, store, "in").collect()]
    assert max(sizes) <= 10 and sum(sizes) == 43 and len(sizes) >= 6
    with pytest.raises(ValueError):
        stage_row_batches(first, folder, 0)


@pytest.mark.parametrize("policy", ["UPSERT", "IGNORE"])
@pytest.mark.parametrize("few", [0, 100])
def test_keys_are_broadcast_by_their_number(spark, store, monkeypatch, policy, few):
    """The sizes of pruned files tell Spark little: what a batch has is counted."""
    monkeypatch.setattr(conflict, "FEW_KEYS", few, raising=False)
    run(spark, store, step(policy), rows(spark, ("1", "1"), ("2", "2")))
    plans, publish = [], TableStore.publish

    def watched(self, schema, table, out, **options):
        if (schema, table) == ("core", "t"):
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return publish(self, schema, table, out, **options)

    monkeypatch.setattr(TableStore, "publish", watched)
    run(spark, store, step(policy), rows(spark, ("1", "7"), ("4", "4")))
    assert len(plans) == 1 and ("BroadcastHashJoin" in plans[0]) == (few > 0)
    assert amounts(store) == {1: "7.00" if policy == "UPSERT" else "1.00", 2: "2.00", 4: "4.00"}


def matched(monkeypatch):
    """The targets that loads look for keys in, by a job of its own."""
    from rowferry.plans import blueprint
    seen, match = [], blueprint.met_keys
    monkeypatch.setattr(blueprint, "met_keys", lambda target, *a: (seen.append(target), match(target, *a))[1])
    return seen


@pytest.mark.parametrize("few", [0, 3, 100])
def test_an_update_matches_only_rows_in_reach_of_its_keys(spark, store, monkeypatch, few):
    monkeypatch.setattr(conflict, "FEW_KEYS", few)
    seen = matched(monkeypatch)
    store.publish("core", "t", spark.createDataFrame([(i, None) for i in (None, 1, 5, 5, 7, 7, 90)], "id bigint, amount decimal(8,2)"))
    result = run(spark, store, step(), rows(spark, ("91", "1"), ("95", "1"), (None, "1")))  # out of reach
    assert (result.rows_updated, result.rows_inserted, seen) == (0, 2, [])
    assert [v.mode for v in store.versions("core", "t")] == ["full", "add"]
    result = run(spark, store, step(), rows(spark, ("6", "2"), ("7", "2"), ("7", "3"), ("8", "2")))
    # each row of a repeated key counts, and is replaced by one
    assert (result.rows_updated, result.rows_inserted) == (2, 1)
    assert bag(store.read("core", "t").selectExpr("id", "cast(amount AS string) AS amount"), "id", "amount") == sorted(
        [(i, None) for i in (None, 1, 5, 5, 90)] + [(6, "2.00"), (7, "3.00"), (8, "2.00"), (91, "1.00"), (95, "1.00")], key=repr)
    assert [bag(t, "id") for t in seen] == ([[(7,), (7,)]] if few != 3 else [])
    run(spark, store, step(), rows(spark, (None, "1")))  # nothing to load
    assert store.read("core", "t").count() == 10 and store.versions("core", "t")[-1].mode == "add"


def test_a_large_batch_that_meets_a_key_is_matched_by_the_rewrite(spark, store, monkeypatch):
    monkeypatch.setattr(conflict, "FEW_KEYS", 1)
    run(spark, store, step(), spark.range(200).selectExpr("id", "'1' AS amount"))
    seen = matched(monkeypatch)
    result = run(spark, store, step(), spark.range(50, 300).selectExpr("id", "'2' AS amount"))
    assert (result.rows_updated, result.rows_inserted, result.rows_loaded, seen) == (150, 100, 250, [])
    now = amounts(store)
    assert len(now) == 300 and all(now[i] == ("1.00" if i < 50 else "2.00") for i in range(300))
    # one whose keys lie between those of the target, and meets none of them
    run(spark, store, step(table="u"), spark.range(100).selectExpr("id * 2 AS id", "'1' AS amount"))
    result = run(spark, store, step(table="u"), spark.range(50).selectExpr("id * 2 + 1 AS id", "'2' AS amount"))
    assert (result.rows_updated, result.rows_inserted, len(seen)) == (0, 50, 1)
    assert [v.mode for v in store.versions("core", "u")] == ["full", "add"]
