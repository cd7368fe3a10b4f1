"""Events: their order, their application as a stream, and the current version."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelake import streaming
from sourcelake.operators import snapshot

STATE = "chunk_id string, relative_path string, content_hash string"


def put(folder, name, *events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(["batch", "seq", "operation", "chunk_id", "relative_path", "content_hash"], e))) + "\n" for e in events))


def test_stream_goes_on_and_keeps_order(spark, tmp_path):
    base = spark.createDataFrame([("a", "p", "1"), ("b", "q", "1")], STATE)
    events, out, check = tmp_path / "events", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    run = lambda: sorted(map(tuple, streaming.apply_stream(spark, str(events), base, out, check).collect()))
    put(events, "1.json", (1, 1, "upsert", "a", "p", "2"), (1, 2, "upsert", "a", "p", "3"), (1, 3, "delete", "b", None, None))
    assert run() == [("a", "p", "3")]
    assert run() == [("a", "p", "3")]  # no new files
    put(events, "2.json", (2, 1, "upsert", "b", "q", "9"))
    assert run() == [("a", "p", "3"), ("b", "q", "9")]
    put(events, "3.json", (3, 1, "rename", "b", "q", "9"))
    with pytest.raises(Exception, match="invalid"):
        run()
    assert streaming.Pointer(spark, f"{out}/current.json").read()["version"] == 2


def test_pointer_compares_and_swaps(spark, tmp_path):
    pointer = streaming.Pointer(spark, f"file://{tmp_path}/current.json")
    assert pointer.swap(None, {"v": 1}) and not pointer.swap(None, {"v": 1}) and pointer.swap({"v": 1}, {"v": 2})
    with pytest.raises(streaming.Conflict):
        pointer.swap({"v": 1}, {"v": 3})


def test_events_are_numbered_as_one_sequence(spark):
    rows = [(f"c{i}", f"dir{i % 7}/f{i % 50}", "upsert" if i % 3 else "delete", "h") for i in range(500)] + [("u", "x", "unchanged", "h")]
    changes = spark.createDataFrame(rows, "chunk_id string, relative_path string, operation string, content_hash string")
    plain = changes.where("operation <> 'unchanged'").withColumn("seq", F.row_number().over(Window.partitionBy("operation").orderBy("relative_path", "chunk_id")).cast("long"))
    assert sorted(map(tuple, snapshot.events(changes).collect())) == sorted(map(tuple, plain.collect()))
    stream = snapshot.event_stream(changes).orderBy("seq").collect()
    assert [r.seq for r in stream] == list(range(502)) and stream[0].event == "start" and (stream[-1].event, stream[-1].upserts, stream[-1].deletes) == ("complete", 333, 167)
    assert snapshot.events(changes.limit(0)).count() == 0


def test_applied_changes_equal_the_target(spark):
    base = spark.createDataFrame([("a", "p", "1"), ("b", "q", "1")], STATE)
    target = spark.createDataFrame([("a", "p", "2"), ("c", "r", "1")], STATE)
    state = snapshot.apply_changes(base, snapshot.delta(base, target), "f" * 40)
    assert snapshot.mismatches(state, target).count() == 0 and state.select("commit_sha").distinct().count() == 1
    assert {r.problem for r in snapshot.mismatches(base, target).collect()} == {"missing", "unexpected"}
