"""Keyed state with timers and expiry, and the merged snapshot table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.streaming import keyed, live

EVENTS = "run_id long, ts timestamp_ntz, type string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r, default=str) for r in rows) + "\n")


def at(second):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)).isoformat()


def state(spark, checkpoint):
    return spark.read.format("statestore").option("path", f"file://{checkpoint}")


def test_a_silent_run_is_halted_by_a_timer(spark, tmp_path):
    sink = live.SnapshotSink(spark, f"file://{tmp_path}/out", ["run_id", "status"], keep="first")

    def go():
        stream = live.event_stream(spark, f"file://{tmp_path}/log", EVENTS, 1)
        found = keyed.deadline_stream(stream, 100_000, F.col("type") == "end", "1 second", 50_000)
        live.run_available(found, sink, f"file://{tmp_path}/cursor")
        return {(r.run_id, r.status): r for r in sink.current().collect()}

    put(tmp_path / "log", "a.json", [{"run_id": 1, "ts": at(0), "type": "x"}, {"run_id": 2, "ts": at(1), "type": "x"}, {"run_id": 3, "ts": at(2), "type": "x"}])
    put(tmp_path / "log", "b.json", [{"run_id": 2, "ts": at(50), "type": "end"}, {"run_id": 4, "ts": at(60), "type": "x"}])
    with pytest.raises(FileNotFoundError):
        sink.current()
    assert set(go()) == {(2, "finished")}
    # Run 1 says nothing more; only another run moves the watermark. The late end of run 3 comes after its deadline.
    put(tmp_path / "log", "c.json", [{"run_id": 4, "ts": at(101.5), "type": "x"}, {"run_id": 2, "ts": at(101), "type": "late"}])
    rows = go()
    assert set(rows) == {(2, "finished"), (1, "halted")}
    assert rows[1, "halted"].deadline_at == dt.datetime(2024, 1, 1, 0, 1, 40) and rows[1, "halted"].n_events == 1
    put(tmp_path / "log", "d.json", [{"run_id": 3, "ts": at(130), "type": "end"}, {"run_id": 1, "ts": at(131), "type": "x"}])
    assert set(go()) == {(2, "finished"), (1, "halted"), (3, "halted")}
    put(tmp_path / "log", "e.json", [{"run_id": 9, "ts": at(400), "type": "x"}])
    assert set(go()) == {(2, "finished"), (1, "halted"), (3, "halted"), (4, "halted")}
    put(tmp_path / "log", "f.json", [{"run_id": 9, "ts": at(450), "type": "end"}, {"run_id": 8, "ts": at(460), "type": "x"}])
    go()
    held = state(spark, tmp_path / "cursor").option("stateVarName", "run").load()
    assert {r.key.run_id for r in held.collect()} <= {8, 9}, "finished and halted runs have left the state"


MESSAGES = "comm_id long, run_id long, action string, at long, model string, tokens long"


def test_closed_records_leave_the_state_and_are_exported_once(spark, tmp_path):
    sink = live.SnapshotSink(spark, f"file://{tmp_path}/out", ["comm_id"])
    exported = live.SnapshotSink(spark, f"file://{tmp_path}/closed", ["comm_id", "at_batch"], keep="first")

    def go():
        stream = live.event_stream(spark, f"file://{tmp_path}/log", MESSAGES, 1)
        changes = keyed.registry_stream(stream, 3_600_000)
        closed = changes.withColumn("at_batch", F.col("closed_at"))
        live.run_available(closed, sink, f"file://{tmp_path}/cursor", {"status = 'closed'": exported}, by_clock=True)
        return {r.comm_id: r for r in sink.current().collect()}

    def message(comm, action, when, run=7, model=None, tokens=None):
        return {"comm_id": comm, "run_id": run, "action": action, "at": when, "model": model, "tokens": tokens}

    put(tmp_path / "log", "a.json", [message(1, "open", 1), message(2, "open", 2), message(1, "enrich", 3, model="m1"), message(3, "open", 4, 8)])
    assert {k: r.status for k, r in go().items()} == {1: "open", 2: "open", 3: "open"}
    put(tmp_path / "log", "b.json", [message(1, "close", 6, tokens=5), message(1, "enrich", 5, model="m2"), message(4, "close", 7, None, "direct", 9)])
    rows = go()
    assert tuple(rows[1])[:7] == (1, 7, 1, "m2", 5, 6, "closed") and tuple(rows[4])[:7] == (4, None, None, "direct", 9, 7, "closed")
    put(tmp_path / "log", "c.json", [message(1, "enrich", 8, model="late"), message(1, "close", 9), message(2, "enrich", 10, tokens=1)])
    rows = go()
    assert rows[1].model == "m2" and rows[2].tokens == 1 and rows[2].status == "open"
    assert sorted(r.comm_id for r in exported.current().collect()) == [1, 4]
    held = state(spark, tmp_path / "cursor").option("stateVarName", "open").load()
    assert {r.key.comm_id for r in held.collect()} == {2, 3}
    view = {r.run_id: r for r in keyed.communications_view(sink.current()).collect()}
    assert (view[7].in_flight, view[7].n_in_flight, view[7].last_comm, view[7].last_tokens) == (2, 1, 2, 1) and view[8].in_flight == 3


@pytest.mark.parametrize("keep", ["last", "first"])
def test_reading_snapshots_does_not_grow_with_batches(spark, tmp_path, monkeypatch, keep):
    monkeypatch.setattr(live.SnapshotSink, "FAN", 3)
    sink = live.SnapshotSink(spark, f"file://{tmp_path}/out", ["k"], keep)
    expected = {}
    for number in range(32):
        rows = [(k, number * 10 + k) for k in {number % 5, number % 7, 40 + number // 9}]
        batch = spark.createDataFrame(rows, "k long, v long").coalesce(1)
        sink.write(batch, number)
        if number % 4 == 1:
            sink.write(batch, number)  # repeated after a failure
        for k, v in rows:
            if keep == "last" or k not in expected:
                expected[k] = v
        folders = sink.folders()
        assert len(folders) <= 2 * 4 + 1
        if number in (0, 8, 9, 26, 27, 31):
            assert {r.k: r.v for r in sink.current().collect()} == expected
    assert len(sink.folders()) <= 6


def test_agents_have_caps_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, "b", 50), (2, "a", 1)], "run_id long, agent string, tokens long")
    rows = {(r.run_id, r.agent): (r.spent, r.cap, r.over) for r in live.agent_flags(live.run_spend(df, ("run_id", "agent")), {"a": 11}).collect()}
    assert rows == {(1, "a"): (11, 11, True), (1, "b"): (50, None, False), (2, "a"): (1, 11, False)}
    assert not any(r.over for r in live.agent_flags(live.run_spend(df, ("run_id", "agent")), {}).collect())


@pytest.mark.parametrize("groups", [None, 2])
def test_records_may_share_rows_of_state(spark, tmp_path, groups):
    """The same changes whether a record has a row of state of its own or shares it; whole numbers stay exact beside nulls."""
    big = 2**53 + 1
    sink = live.SnapshotSink(spark, f"file://{tmp_path}/out", ["comm_id"])
    exported = live.SnapshotSink(spark, f"file://{tmp_path}/closed", ["comm_id", "closed_at"], keep="first")

    def go(remember_ms=3_600_000):
        stream = live.event_stream(spark, f"file://{tmp_path}/log", MESSAGES, 1)
        changes = keyed.registry_stream(stream, remember_ms, groups)
        live.run_available(changes, sink, f"file://{tmp_path}/cursor", {"status = 'closed'": exported}, by_clock=True)
        return {r.comm_id: tuple(r)[1:] for r in sink.current().collect()}

    def message(comm, action, when, model=None, tokens=None):
        return {"comm_id": comm, "run_id": comm + 100, "action": action, "at": when, "model": model, "tokens": tokens}

    put(tmp_path / "log", "a.json", [message(c, "open", c, tokens=big if c % 3 else None) for c in range(40)])
    put(tmp_path / "log", "b.json", [message(c, "close", 90 + c) for c in range(0, 40, 2)] + [message(50, "enrich", 61, "late"), message(50, "enrich", 60, "first")])
    put(tmp_path / "log", "c.json", [message(c, "enrich", 200, "m") for c in range(10)])
    rows = go()
    expected = {c: (c + 100, c, "m" if c < 10 and c % 2 else None, big if c % 3 else None, None if c % 2 else 90 + c, "open" if c % 2 else "closed") for c in range(40)}
    assert rows == expected | {50: (150, None, "late", None, None, "open")}
    assert exported.current().groupBy().count().first()[0] == 20
    held = state(spark, tmp_path / "cursor").option("stateVarName", "open").load().collect()
    assert len(held) == (21 if groups is None else groups)
    assert sorted(c for r in held for c in r.value.comm_id) == [*range(1, 40, 2), 50]
    marks = state(spark, tmp_path / "cursor").option("stateVarName", "closed").load()
    assert sorted(c for r in marks.collect() for c in r.value.value.comm_id) == [*range(0, 40, 2)]


@pytest.mark.parametrize("groups", [None, 1])
def test_a_mark_expires(spark, tmp_path, groups):
    sink = live.SnapshotSink(spark, f"file://{tmp_path}/out", ["comm_id"])
    for number, (action, when) in enumerate([("close", 1), ("open", 2), ("close", 3)]):
        put(tmp_path / "log", f"{number}.json", [{"comm_id": 1, "run_id": 2, "action": action, "at": when, "model": None, "tokens": None}])
        live.run_available(keyed.registry_stream(live.event_stream(spark, f"file://{tmp_path}/log", MESSAGES, 1), 1, groups), sink, f"file://{tmp_path}/cursor", by_clock=True)
        row = sink.current().first()
        assert (row.opened_at, row.closed_at) == [(None, 1), (2, None), (2, 3)][number]


def test_records_beside_one_without_id_are_kept(spark, tmp_path):
    sink = live.SnapshotSink(spark, f"file://{tmp_path}/out", ["comm_id"])
    rows = [{"comm_id": c, "run_id": 1, "action": "close" if c in (None, 3) else "open", "at": 5, "model": None, "tokens": None} for c in (None, *range(2**53, 2**53 + 9), 3)]
    put(tmp_path / "log", "a.json", rows)
    live.run_available(keyed.registry_stream(live.event_stream(spark, f"file://{tmp_path}/log", MESSAGES, 1), groups=1), sink, f"file://{tmp_path}/cursor", by_clock=True)
    assert {(r.comm_id, r.status) for r in sink.current().collect()} == {(None, "closed"), (3, "closed"), *((c, "open") for c in range(2**53, 2**53 + 9))}
