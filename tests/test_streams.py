"""Streams over several batches: timers, merges, bounded batches, dispatch and views, with crashes, replays and restarts."""

import time

import pytest
from compare import agree
from pyspark.sql import functions as F

from millrace.plans import ORACLES, QUERIES, streams
from millrace.sources.sequence import read_sequence, write_sequence
from millrace.streaming import dispatch, merge, timers, views


@pytest.mark.parametrize("name", ["stream_pending", "stream_sweeps", "stream_views", "stream_dispatch"])
def test_many_batches_give_the_same_rows(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(streams, "_EACH", 160)
    agree(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_batches_are_bounded_and_in_order(spark, tmp_path):
    rows = spark.range(1_050).select((1_049 - F.col("id")).alias("k"), F.lit("x").alias("v")).repartition(5)
    folder = write_sequence(rows, ["k"], 100)
    seen = []

    def note(batch, number):
        got = [r.k for r in batch.select("k").collect()]
        seen.append((number, sorted(got)))

    query = read_sequence(spark, folder, rows.schema).writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [(n, list(range(100 * n, min(1_050, 100 * n + 100)))) for n in range(11)]
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [100] * 10 + [50]


def changes(spark, rows):
    return spark.createDataFrame(rows, "k long, seq long, op string, v string, extra int")


def table(spark, folder, **how):
    return merge.MergedTable(spark, f"file://{folder}", ["k"], ["seq"], ["v"], F.col("op") == "D", **how)


def content(t, version=None):
    return sorted(((r.k, r.v) for r in t.read(version).collect()), key=repr)


BATCHES = [
    [(1, 1, "I", "a", 0), (2, 1, "I", "b", 0), (None, 1, "I", "n", 0), (1, 3, "U", "c", 0), (1, 2, "U", "late in its batch", 0)],
    [(2, 4, "D", None, 0), (1, 2, "U", "late", 0), (3, 1, None, None, 0)],
    [(2, 3, "U", "older than its deletion", 0), (4, 1, "D", None, 0)],
    [(2, 5, "I", "again", 0), (1, 3, "U", "c", 0), (None, None, "U", "no order", 0)],
]
CONTENTS = [[(1, "c"), (2, "b"), (None, "n")], [(1, "c"), (3, None), (None, "n")], [(1, "c"), (3, None), (None, "n")], [(1, "c"), (2, "again"), (3, None), (None, "n")]]


@pytest.mark.parametrize("every", [1, 2, 16])
def test_merge_versions_and_replays(spark, tmp_path, every):
    t = table(spark, tmp_path, every=every)
    for n, rows in enumerate(BATCHES):
        t.apply(changes(spark, rows), n)
        t.apply(changes(spark, [(9, 9, "I", "a replay of a batch that is done", 0)]), n)
        assert content(t) == CONTENTS[n]
    assert [content(t, n) for n in t.versions()] == CONTENTS
    t.vacuum(2)
    assert t.versions() == [2, 3] and [content(t, n) for n in (2, 3)] == CONTENTS[2:]
    with pytest.raises(ValueError, match="no version 0"):
        t.read(0)


def test_a_batch_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, every=1)
    t.apply(changes(spark, BATCHES[0]), 0)
    put = t.files.put
    for broken in (1, 2):  # as a delta, and as a snapshot
        monkeypatch.setattr(t.files, "put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.apply(changes(spark, [(7, 7, "I", "half written", 0)]), broken)
        assert content(t) == CONTENTS[broken - 1]
        monkeypatch.setattr(t.files, "put", put)
        t.apply(changes(spark, BATCHES[broken]), broken)
        assert content(t) == CONTENTS[broken]


def test_tombstones_may_be_forgotten(spark, tmp_path):
    t = table(spark, tmp_path, every=1, forget=F.col("seq") < 5)
    for n, rows in enumerate(BATCHES[:2]):
        t.apply(changes(spark, rows), n)
    t.apply(changes(spark, [(2, 3, "U", "comes too late to be told", 0)]), 2)
    assert (2, "comes too late to be told") in content(t)
    with pytest.raises(ValueError, match="nothing was merged"):
        table(spark, tmp_path / "other").read()


def test_a_merge_stream_goes_on_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    for n, rows in enumerate(BATCHES):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        if n in (1, 3):
            stream = spark.readStream.schema(changes(spark, []).schema).parquet(str(source))
            merge.merge_stream(stream, table(spark, tmp_path / "out", every=1))  # an object of its own, as in another process
            assert content(table(spark, tmp_path / "out")) == CONTENTS[n]


def routes():
    return {"a": {"seq": F.col("seq"), "double": F.col("n") * 2}, "b": {"seq": F.col("seq"), "text": F.col("n").cast("string")}, "never": {"seq": F.col("seq")}}


def test_unknown_types_raise_with_the_last_three(spark, tmp_path):
    messages = lambda rows: spark.createDataFrame(rows, "seq long, kind string, n long")
    to = dispatch.Dispatcher(spark, f"file://{tmp_path}", "kind", ["seq"], routes())
    to.apply(messages([(1, "a", 5), (2, "b", 6), (3, "a", None)]), 0)
    for bad in ("x", None):
        with pytest.raises(ValueError, match=f"unknown message type {bad!r} in batch 1; the last types, newest first: {bad!r}, 'a', 'b'"):
            to.apply(messages([(7, "y", 0), (6, bad, 0), (5, "a", 1), (4, "b", 2)]), 1)
    assert to.batches() == [0] and sorted(map(tuple, to.table("a").collect())) == [(1, 10), (3, None)]
    to.apply(messages([(4, "b", 2)]), 1)
    to.apply(messages([(4, "b", 2)]), 1)
    assert sorted(map(tuple, to.table("b").collect())) == [(2, "6"), (4, "2")] and to.table("b").columns == ["seq", "text"]
    assert not to.has("never")
    with pytest.raises(LookupError):
        to.table("never")


def test_a_dispatch_that_breaks_off_is_done_again(spark, sf_dir, tmp_path, monkeypatch):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = lambda: read_sequence(spark, folder, e.schema)
    folder = write_sequence(e, ["event_id", "user_id"], 300)
    columns = {t: {"event_id": F.col("event_id"), f"of_{t}": F.col("value")} for t in ("view", "click", "purchase", "signup", "error")}
    to = lambda: dispatch.Dispatcher(spark, f"file://{tmp_path}/d", "event_type", ["event_id"], columns)
    first = to()
    put = first.files.put
    monkeypatch.setattr(first.files, "put", lambda name, text: put(name, text) if name != "done/2" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        dispatch.dispatch_stream(stream(), first)
    assert first.batches() == [0, 1]
    dispatch.dispatch_stream(stream(), to())
    for t in columns:
        assert sorted(map(tuple, to().table(t).collect())) == sorted(map(tuple, e.where(F.col("event_type") == t).select("event_id", "value").collect()))


def test_folds():
    hold, state = timers.hold_writes(10), {"hold": None}
    rows = [(0, 0, 1, False), (5, 1, 2, True), (6, 2, 3, False), (15, 3, 4, False), (26, 4, 5, False), (30, 5, 6, True), (35, 6, 7, False), (38, 7, 8, True)]
    assert hold(state, rows[:4], 20) == ([(0, 1, "other"), (5, 2, "own")], 26)
    assert state == {"hold": (25, True, 4)}
    assert hold(state, rows[4:], 40) == ([(26, 4, "released"), (26, 5, "other"), (30, 6, "own"), (38, 8, "own")], 49)
    assert hold(state, [], 49) == ([], None) and state == {"hold": None}
    sweep, state = timers.sweep_requests(10), {"open": None}
    assert sweep(state, [(0, 0, 7, True), (3, 1, 8, True), (10, 2, 9, True), (12, 3, 8, False)], 19) == ([], 20)
    assert sweep(state, [(20, 4, 7, False), (25, 5, None, False), (29, 6, 5, True)], 40) == ([(7, 0, 20), (5, 29, 40)], None)
    assert state == {"open": None}


def test_views_refuse_what_cannot_be():
    fold = views.follow_views(own=3)
    new = lambda: {"visible": None, "position": None, "region": None}
    seen = new()
    enter, leave = (0, 1, 3, views.ENTER, 1, 0, 70, 5, views.PLANE), (0, 2, 3, views.LEAVE, 0, 0, 0, 0, None)
    assert fold(seen, [enter], 0) == ([(1, "in", 1, 6, 5)], None)
    assert seen == {"visible": (True,), "position": (1, 6, 5), "region": None}
    with pytest.raises(ValueError, match="own slot 3 never leaves"):
        fold(seen, [leave], 0)
    with pytest.raises(ValueError, match="slot 3 is in view"):
        fold(dict(seen), [enter], 0)
    with pytest.raises(ValueError, match="out of view"):
        fold(new(), [leave], 0)


def test_regions_of_positions_beyond_the_edge():
    fold = views.follow_views()
    left = lambda x, y: fold({"visible": (True,), "position": (2, x, y), "region": None}, [(0, 1, 0, views.LEAVE, 0, 0, 0, 0, None)], 0)[0][0][3:]
    assert left(-1, -63) == (0, 0) and left(-64, -65) == (255, 255) and left(-128, 63) == (254, 0) and left(16_384, 16_447) == (0, 0)


def test_a_slot_that_leaves_view_beyond_the_edge(spark, tmp_path):
    """Slot 0 comes into view at (0, 0), walks to (-4, -4) and leaves view there; slot 1's event moves the watermark on."""
    import datetime

    import duckdb

    ids = [6, 12, 18, 24, 0, 16, 40, 64, 88, 30, 36]  # four stay in region 0, 0 enters at its corner, four walk by (-1, -1), 30 leaves
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=k), 0) for k, i in enumerate(ids)] + [(1, start + datetime.timedelta(hours=3), 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["stream_views"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLES["stream_views"]).fetchall())
    assert [r[2:] for r in got if r[1] in (88, 30)] == [("out", 0, 0, 0), ("at", 0, -4, -4)]


def test_wide_numbers_and_nulls_pass_a_stream_unchanged(spark, tmp_path):
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(1, 1_000, 0, big, True), (1, 2_000, 1, None, True), (1, 900_000, 2, 5, True)], "k long, at long, seq long, value long, own boolean").withColumn("ts", F.timestamp_millis("at"))
    stream = read_sequence(spark, write_sequence(rows, ["at"], 2), rows.schema).withWatermark("ts", "1 second")
    out = timers.folded(stream, "k", ["at", "seq", "value", "own"], "at long, seq long, value long, own boolean", timers.HOLD, "k long, at long, value long, how string", timers.hold_writes(10))
    from millrace.streaming.state import drain

    assert sorted(map(tuple, drain(out, "append").collect())) == [(1, 1_000, big, "own"), (1, 2_000, None, "own")]


def test_rows_without_a_number_come_last():
    import pyarrow as pa

    for by_event_time, times in ((True, [5, 5, 5, 4]), (False, [9] * 4)):
        processor = timers.Folded(None, ["k", "at", "seq", "v"], [], [], "", [], by_event_time)
        table = pa.table({"k": [1, 1, None, 1], "at": [5, 5, 5, 4], "seq": [None, (1 << 60) + 1, 1 << 60, 3], "v": [1, 2, 3, 4]})
        assert processor._by_key(table, 9) == {1: [(times[3], 3, 4), (times[1], (1 << 60) + 1, 2), (times[0], None, 1)], None: [(times[2], 1 << 60, 3)]}


def test_keys_share_buckets(spark, tmp_path):
    """A state store holds few rows and timers, however many keys there are."""
    rows = spark.range(1, 12_001).select((F.col("id") % 3_000).alias("k"), (F.col("id") * 1_000).alias("at"), F.col("id").alias("seq"), F.col("id").alias("value"), F.lit(True).alias("own")).withColumn("ts", F.timestamp_millis("at"))
    stream = read_sequence(spark, write_sequence(rows, ["at"], 4_000), rows.schema).withWatermark("ts", "1 second")
    out = timers.folded(stream, "k", ["at", "seq", "value", "own"], "at long, seq long, value long, own boolean", timers.HOLD, "k long, at long, value long, how string", timers.hold_writes(50_000_000))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["at"], r.k, r.value, r.how) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1_000 * i, i % 3_000, i, "own") for i in range(1, 12_000)]  # the last is not behind the watermark
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert states and 0 < max(states) <= 4 * timers.BUCKETS < 3_000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_keys_of_one_bucket_stay_apart(spark, tmp_path, kind):
    from millrace.streaming.state import drain

    keys = [None, 5, (1 << 60) + 1, 1 << 60, -7]
    given = [(keys[i % 5], 700 * i + i // 40 * 20_000, i, i % 7 == 0, None if i % 4 == 1 else (1 << 60) + i) for i in range(1, 201)]
    rows = spark.createDataFrame(given, "k long, at long, seq long, own boolean, value long").withColumns({"k": F.col("k").cast(kind), "ts": F.timestamp_millis("at")})
    schema, out = "at long, seq long, value long, own boolean", f"k {kind}, at long, value long, how string"
    want, until = [], given[-1][1] - 1_000
    for k in keys:
        mine = [(at, seq, value, own) for key, at, seq, own, value in given if key == k and at <= until]
        want += [(k if k is None or kind == "long" else str(k), *o) for o in timers.hold_writes(5_000)({"hold": None}, mine, until)[0]]
    assert {w[3] for w in want} == {"own", "other", "released"}
    for buckets in (1, 3):
        stream = read_sequence(spark, write_sequence(rows, ["at"], 60), rows.schema).withWatermark("ts", "1 second")
        got = drain(timers.folded(stream, "k", ["at", "seq", "value", "own"], schema, timers.HOLD, out, timers.hold_writes(5_000), buckets=buckets), "append")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="no key"):
        timers.folded(rows.withColumn("k", F.lit(0.5)), "k", ["at", "seq", "value", "own"], schema, timers.HOLD, out, timers.hold_writes(5_000))


def test_a_timer_fires_by_processing_time(spark, tmp_path):
    """Without any row after it."""
    schema = "k long, at long, seq long, value long, own boolean"
    spark.createDataFrame([(1, 0, 0, 7, True), (1, 0, 1, 8, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = timers.folded(stream, "k", ["at", "seq", "value", "own"], "at long, seq long, value long, own boolean", timers.HOLD, "k long, at long, value long, how string", timers.hold_writes(1_500), by_event_time=False)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        got, end = [], time.time() + 60
        while len(got) < 2 and time.time() < end:
            time.sleep(0.5)
            got = sorted((r.how, r.value, r["at"]) for r in spark.read.schema("k long, at long, value long, how string").parquet(str(tmp_path / "out")).collect())
    finally:
        query.stop()
    assert [g[:2] for g in got] == [("own", 7), ("released", 8)] and got[1][2] == got[0][2] + 1_501
