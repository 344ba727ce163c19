"""Merging batches into a bucketed table, and the state of streamed windows."""

import pandas as pd
import pytest

from airwave.operators import filters
from airwave.sources import merge
from airwave.streaming import jobs

ROWS = "stream_id long, message_id string, author string, text string, us long"


def batch(spark, ids, text="t"):
    return spark.createDataFrame([(1, str(i), "a", text, i) for i in ids], ROWS)


def test_a_batch_reads_and_writes_the_buckets_that_it_touches(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["stream_id", filters.identity()]
    assert merge.read(spark, path) is None
    assert merge.merge(batch(spark, range(60)), path, key, filters.upsert_messages, "a", 0, 8)
    first = merge.manifest(spark, path)["versions"]
    seen = []

    def upsert(stored, new):
        seen.append({r[0].rsplit("bucket=", 1)[1].split("/")[0] for r in stored.selectExpr("_metadata.file_path").distinct().collect()})
        return filters.upsert_messages(stored, new)

    assert merge.merge(batch(spark, [3, 100, 100], "new"), path, key, upsert, "a", 1, 8)
    state = merge.manifest(spark, path)
    touched = {b for b, v in state["versions"].items() if v == 2}
    assert 1 <= len(touched) <= 2 and seen == [touched & {*first}] and {b: v for b, v in state["versions"].items() if b not in touched} == {b: 1 for b in first if b not in touched}
    got = {r["message_id"]: r["text"] for r in merge.read(spark, path).collect()}
    assert len(got) == 61 and got["3"] == "t" and got["100"] == "new" and merge.read(spark, path).count() == 61


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["stream_id"]
    streams = lambda title: spark.createDataFrame([(1, title, "u")], "stream_id long, title string, url string")
    assert merge.merge(streams("one"), path, key, filters.upsert_streams, "a", 0)
    before = merge.manifest(spark, path)
    assert not merge.merge(streams("two"), path, key, filters.upsert_streams, "a", 0) and merge.manifest(spark, path) == before
    # the same number of another source is another batch; an empty title leaves the old one
    assert merge.merge(streams("").drop("url"), path, key, filters.upsert_streams, "b", 0)
    assert [tuple(r) for r in merge.read(spark, path).collect()] == [(1, "one", "u")]
    assert not merge.merge(streams("x").limit(0), path, key, filters.upsert_streams, "a", 1)
    assert merge.vacuum(spark, path) > 0 and merge.vacuum(spark, path) == 0
    assert [tuple(r) for r in merge.read(spark, path).collect()] == [(1, "one", "u")]


def test_a_writer_that_comes_second_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.merge(batch(spark, [1]), path, ["stream_id"], filters.upsert_messages, "a", 0)
    with pytest.raises(RuntimeError):
        merge._commit(spark, path, merge.manifest(spark, path))


class Handle:
    """States and timers of one key in memory."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def state(self, name, schema):
        value = self.states.setdefault(name, [])

        class State:
            def exists(self):
                return bool(value)

            def get(self):
                return value[0] if name != "waiting" else iter([*value])

            def update(self, x):
                value[:] = [x]

            def put(self, xs):
                value[:] = xs

            def appendList(self, xs):
                value.extend(xs)

            def clear(self):
                value.clear()

        return State()

    getValueState = getListState = state

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_the_state_of_a_silent_stream_is_dropped():
    handle, w = Handle(), jobs._Windows(2, 60_000_000, 1, 3_600_000)
    w.init(handle)
    rows = lambda *s: iter([pd.DataFrame({"us": [x * 1_000_000 for x in s]})])
    out = pd.concat(w.handleInputRows((7,), rows(3, 1, 2), Clock(0)))
    assert len(out) == 0 and handle.timers == {1001}
    out = pd.concat(w.handleExpiredTimer((7,), Clock(10_000), None))
    assert out.to_dict("list") == {"stream_id": [7], "window_index": [0], "start_us": [1_000_000], "end_us": [2_000_000], "messages": [2]}
    assert handle.timers == {63_001}
    out = pd.concat(w.handleExpiredTimer((7,), Clock(70_000), None))
    assert out["window_index"].tolist() == [1] and handle.timers == {3_603_000}
    assert list(w.handleExpiredTimer((7,), Clock(3_603_001), None)) == []
    assert not any(handle.states.values()) and not handle.timers
