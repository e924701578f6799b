from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from skein import runtime, tables, versions
from skein.operators import change_feed

DDL = "change_no long, target_table string, ref string, change_type string, source_cursor string, changed_at timestamp, deleted_at timestamp, fingerprint string, row_json string, seq string, present int"
T0 = datetime(2024, 1, 1)


def state(spark, rows, store=None, ddl=DDL):
    store = store or runtime.new_path(spark, "feed")
    df = change_feed.apply_changes(spark, spark.createDataFrame(rows, ddl), store)
    return {(r.target_table, r.ref): r.fingerprint for r in change_feed.present_rows(df).collect()}, store


def row(no, ref, cursor, kind="upsert", fp=None, at=None, table="t"):
    tomb = kind.strip().lower() == "tombstone"
    return (no, table, ref, kind, cursor, None if tomb else at, at if tomb else None, fp, None, "clash", 7)


def test_order_repeats_and_return(spark):
    rows = [row(1, "a", "offset:2", fp="2"), row(2, "a", "offset:1", fp="1"), row(3, "a", " Offset:0002 ", "UPSERT ", fp="2"), row(4, "b", "offset:3", fp="x"), row(5, "b", "offset:4", "Tombstone"),
            row(6, "c", "offset:5", "tombstone"), row(7, "c", "offset:5", fp="new"), row(8, "d", "offset:9", "tombstone")]
    assert state(spark, rows)[0] == {("t", "a"): "2", ("t", "c"): "new"}


def test_time_stands_for_cursor(spark):
    rows = [row(1, "a", "offset:1", fp="1", at=T0), row(2, "b", "offset:2", fp="9", at=T0 + timedelta(1)), row(3, "a", None, fp="2", at=T0 + timedelta(1))]
    assert state(spark, rows)[0] == {("t", "a"): "2", ("t", "b"): "9"}


def test_nulls_and_unknown_are_left_out(spark):
    rows = [row(1, None, "offset:1", fp="1"), row(2, "a", None, fp="1"), row(3, "a", "offset:1", "replace", fp="1"), (None,) * 11, row(4, "", "offset:1", fp="e" * 100_000)]
    assert state(spark, rows)[0] == {("t", ""): "e" * 100_000}


def test_two_writers_from_one_version(spark):
    _, store = state(spark, [row(1, "a", "offset:1", fp="1")])
    number, manifest = versions.current(spark, store)
    change_feed.apply_changes(spark, spark.createDataFrame([row(2, "a", "offset:2", fp="2")], DDL), store)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, store, number, manifest)
    assert {r.fingerprint for r in change_feed.published(spark, store).collect()} == {"2"}


def test_cursor_known_from_an_earlier_or_later_delivery(spark):
    _, store = state(spark, [row(1, "b", "offset:2", fp="b", at=T0), row(2, "c", None, fp="waits", at=T0 + timedelta(9)), row(3, "d", None, fp="no time")])
    assert {(r.ref, r.fingerprint) for r in change_feed.waiting(spark, store).collect()} == {("c", "waits"), ("d", "no time")}
    got, _ = state(spark, [row(4, "a", None, fp="a", at=T0)], store)
    assert got == {("t", "b"): "b", ("t", "a"): "a"}
    got, _ = state(spark, [row(5, "e", "offset:9", fp="e", at=T0 + timedelta(9))], store)
    assert got == {("t", "b"): "b", ("t", "a"): "a", ("t", "c"): "waits", ("t", "e"): "e"}
    assert [r.ref for r in change_feed.waiting(spark, store).collect()] == ["d"]


def test_only_touched_buckets_are_rewritten(spark):
    store = runtime.new_path(spark, "feed")
    change_feed.apply_changes(spark, spark.createDataFrame([row(i, f"r{i}", f"offset:{i}", fp=str(i)) for i in range(200)], DDL), store, buckets=20)
    before = versions.current(spark, store)[1]["state"]["folders"]
    change_feed.apply_changes(spark, spark.createDataFrame([row(900, "r7", "offset:900", fp="new")], DDL), store)
    after = versions.current(spark, store)[1]["state"]["folders"]
    assert len(before) == len(after) and sum(before[b] != after[b] for b in before) == 1
    got = {r.ref: r.fingerprint for r in change_feed.present_rows(change_feed.published(spark, store)).collect()}
    assert got == {f"r{i}": str(i) for i in range(200)} | {"r7": "new"}


def test_store_rewrites_buckets_and_refuses_old_readers(spark):
    store = tables.Store(spark, runtime.new_path(spark, "store"))
    rows = lambda *names: spark.createDataFrame([(n, 1) for n in names], "name string, value long")
    store.merge("stats", rows(*"abcdefgh"))
    read = store.number("stats")
    for i in range(6):
        store.save_stats({"a": i})
    assert store.load_stats() == dict.fromkeys("bcdefgh", 1) | {"a": 5}
    with pytest.raises(versions.Conflict):
        store.overwrite("stats", rows("z"), read)
    store.remove("stats", rows("b"))
    assert store.append_new("stats", rows("a", "x")).count() == 8 and store.load_stats()["a"] == 5


def test_empty(spark):
    assert state(spark, [])[0] == {}


def test_later_delivery_and_replay(spark):
    first = [row(1, "a", "offset:5", "tombstone"), row(2, "b", "offset:1", fp="1")]
    got, store = state(spark, first)
    assert got == {("t", "b"): "1"}
    late = [row(3, "a", "offset:4", fp="late"), row(4, "b", "offset:2", fp="2")]
    assert state(spark, late, store)[0] == {("t", "b"): "2"}  # the tombstone of a still holds
    assert state(spark, first + late, store)[0] == {("t", "b"): "2"}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    log = [(c, r.choice("ab"), f"r{r.randrange(20)}", r.random() < 0.3) for c in range(200)]
    for c, table, ref, dead in log:
        want[table, ref] = None if dead else f"f{c}"
        rows += [row(0, ref, f"offset:{c}", "tombstone" if dead else "upsert", None if dead else f"f{c}", T0 + timedelta(minutes=c), table)] * r.randrange(1, 3)
    r.shuffle(rows)
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    assert state(spark, rows)[0] == {k: v for k, v in want.items() if v}
