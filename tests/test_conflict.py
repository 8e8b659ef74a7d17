"""Policies against plain Python, on small random batches with repeated, missing and hot keys."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from rowferry.operators import conflict

COLUMNS = "a int, b string, v int, w string"
KEYS = ["a", "b"]


def random_rows(seed, n, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.choice([1, 2, 3, 4, None]), rng.choice(["x", "y", None])
        if hot and i % 3 == 0:
            a, b = 1, "x"
        rows.append((a, b, rng.choice([None, 1, 2, 3]), rng.choice([None, "p", "q"])))
    return rows


def target_rows(seed):
    rng = random.Random(seed)
    return [(a, b, 100, "old") for a in (1, 2, 3) for b in "xyz" if rng.random() < 0.5]


def rank(row):
    return tuple((v is not None, v) for v in row)


def bag(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def by_key(rows):
    groups = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups.setdefault(r[:2], []).append(r)
    return groups


@pytest.fixture(params=[1, 2, 3])
def case(spark, request):
    batch, target = random_rows(request.param, 40, hot=True), target_rows(request.param)
    make = lambda rows: spark.createDataFrame(rows, COLUMNS)
    return batch, target, make(batch), make(target)


ALL = ["a", "b", "v", "w"]


def test_ignore(case):
    batch, target, b, t = case
    old = {r[:2] for r in target}
    wanted = Counter(target) + Counter(min(g, key=rank) for k, g in by_key(batch).items() if k not in old)
    load = conflict.ignore(t, b, KEYS)
    assert bag(load.new_target, *ALL) == wanted
    assert bag(load.rejects, *ALL) == Counter(r for r in batch if None in r[:2])
    assert {r.reject_reason for r in load.rejects.collect()} <= {"NULL_KEY"}


def test_upsert(case):
    batch, target, b, t = case
    groups = by_key(batch)
    wanted = Counter(r for r in target if r[:2] not in groups) + Counter(max(g, key=rank) for g in groups.values())
    once = conflict.upsert(t, b, KEYS).new_target
    assert bag(once, *ALL) == wanted
    assert bag(conflict.upsert(once, b, KEYS).new_target, *ALL) == wanted  # a second run changes nothing


def test_upsert_order(case):
    """``order_by`` decides first: here the greatest w, then v."""
    batch, target, b, t = case
    groups = by_key(batch)
    best = {k: max(g, key=lambda r: rank((r[3], r[2]))) for k, g in groups.items()}
    wanted = Counter(r for r in target if r[:2] not in groups) + Counter(best.values())
    assert bag(conflict.upsert(t, b, KEYS, ["w"]).new_target, *ALL) == wanted


def test_upsert_partial(case):
    batch, target, b, t = case
    groups, old = by_key([(a, k, None, w) for a, k, _, w in batch]), {r[:2]: r for r in target}
    wanted = Counter(r for r in target if r[:2] not in groups)
    for k, g in groups.items():
        w = max(g, key=lambda r: rank(r[3:]))[3]
        wanted[(*k, old[k][2] if k in old else None, w)] += 1
    assert bag(conflict.upsert(t, b.drop("v"), KEYS).new_target, *ALL) == wanted


@pytest.mark.parametrize("hot_rows", [3, 10 ** 6])
def test_capture(case, hot_rows):
    batch, target, b, t = case
    old = {r[:2] for r in target}
    load = conflict.ignore_and_capture(t, b, KEYS, hot_rows=hot_rows)
    wanted = Counter((*r, "DUPLICATE_KEY") for r in batch if r[:2] in old)
    wanted += Counter((*r, "NULL_KEY") for r in batch if None in r[:2])
    assert bag(load.rejects, *ALL, "reject_reason") == wanted
    assert bag(load.new_target, *ALL) == bag(conflict.ignore(t, b, KEYS).new_target, *ALL)


def test_every_batch_row_is_accounted_for(case):
    """Loaded, met an old key, lost to another row, or without a key: each copy once."""
    batch, target, b, t = case
    load = conflict.ignore_and_capture(t, b, KEYS, log_batch_duplicates=True)
    told = bag(load.append, *ALL)
    for r in load.rejects.collect():
        told[(r.a, r.b, r.v, r.w)] += r.copies
    assert told == Counter(batch)


def test_fail(case, spark):
    batch, target, b, t = case
    old, groups = {r[:2] for r in target}, Counter(r[:2] for r in batch)
    load = conflict.fail(t, b, KEYS)
    got = {(r.a, r.b): (r.batch_rows, r.in_target, r.reject_reason) for r in load.conflicts.collect()}
    wanted = {k: (n, k in old, "NULL_KEY" if None in k else "DUPLICATE_KEY" if k in old else "DUPLICATE_IN_BATCH")
              for k, n in groups.items() if None in k or k in old or n > 1}
    assert got == wanted
    with pytest.raises(conflict.KeyConflict):
        conflict.require_no_conflicts(load)
    clean = spark.createDataFrame([(9, "x", 1, "p"), (9, "y", 1, "p")], COLUMNS)
    load = conflict.fail(t, clean, KEYS)
    conflict.require_no_conflicts(load)
    assert load.new_target.count() == len(target) + 2


def test_without_keys_rows_are_added(case):
    batch, target, b, t = case
    for policy in (conflict.fail, conflict.ignore):
        load = policy(t, b, [])
        conflict.require_no_conflicts(load)
        assert bag(load.new_target, *ALL) == Counter(batch) + Counter(target)
    for policy in (conflict.upsert, conflict.ignore_and_capture):
        with pytest.raises(ValueError):
            policy(t, b, [])


def test_append_sources_is_upserts_in_turn(spark):
    frames = [spark.createDataFrame([r for r in random_rows(s, 15) if None not in r[:2]], COLUMNS) for s in (4, 5, 6)]
    target = spark.createDataFrame([], COLUMNS)
    for f in frames:
        target = conflict.upsert(target, f, KEYS).new_target
    assert bag(conflict.append_sources(frames, KEYS), *ALL) == bag(target, *ALL)


def test_one_task_never_gets_all_rows_of_a_key(spark):
    """The pick per key is combined before the shuffle."""
    rows = spark.createDataFrame(random_rows(1, 30), COLUMNS)
    plan = conflict.one_per_key(rows, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_keys_compared_without_case(spark):
    target = spark.createDataFrame([("ab", 1, "kept"), (None, 0, "none"), ("c", 5, "old")], "name string, v int, note string")
    rows = [("AB", 7, "x"), ("aB", 8, "y"), ("D", 1, "z"), ("d", 1, "z"), (None, 3, "q")]
    batch = spark.createDataFrame(rows, "name string, v int, note string")
    keys, (before, new) = conflict.keys_compared_as("UTF8_LCASE", ["name"], target, batch)
    names = ["name", "v", "note"]
    shown = lambda df: sorted((tuple(r) for r in df.select(names).collect()), key=str)
    done = conflict.upsert(before, new, keys, ["v"], stays=["name"])
    assert shown(done.new_target) == sorted([("ab", 8, "y"), ("c", 5, "old"), ("d", 1, "z"), (None, 0, "none")], key=str)
    assert shown(done.rejects) == [(None, 3, "q")]
    assert shown(conflict.ignore(before, new, keys, ["v"]).append) == [("D", 1, "z")]
    load = conflict.ignore_and_capture(before, new, keys, ["v"], log_batch_duplicates=True)
    assert shown(load.append) == [("D", 1, "z")]
    assert sorted((r.name or "", r.reject_reason) for r in load.rejects.collect()) == [
        ("", "NULL_KEY"), ("AB", "DUPLICATE_KEY"), ("aB", "DUPLICATE_KEY"), ("d", "DUPLICATE_IN_BATCH")]
    reasons = {r.reject_reason for r in conflict.fail(before, new, keys).conflicts.collect()}
    assert reasons == {"DUPLICATE_KEY", "DUPLICATE_IN_BATCH", "NULL_KEY"}
    assert conflict.upsert(target, batch, ["name"], ["v"]).new_target.count() == 7  # by their bytes, all but NULL are others


def test_fail_counts_keys_in_one_aggregate(spark):
    """No join: its sides would be sorted beside the counts, or one of them broadcast by a guess of its size."""
    target = spark.createDataFrame([(1, "x", 1, "p"), (2, "y", 1, "p"), (None, "z", 1, "p")], COLUMNS)
    batch = spark.createDataFrame([(2, "y", 1, "p"), (3, "x", 1, "p"), (None, "z", 1, "p"), (4, "x", 1, "p"), (4, "x", 2, "p")], COLUMNS)
    conflicts = conflict.fail(target, batch, KEYS).conflicts
    text = conflicts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    assert bag(conflicts, "a", "b", "batch_rows", "in_target", "reject_reason") == bag(spark.createDataFrame(
        [(2, "y", 1, True, "DUPLICATE_KEY"), (None, "z", 1, False, "NULL_KEY"), (4, "x", 2, False, "DUPLICATE_IN_BATCH")],
        "a int, b string, batch_rows bigint, in_target boolean, reject_reason string"), "a", "b", "batch_rows", "in_target", "reject_reason")
