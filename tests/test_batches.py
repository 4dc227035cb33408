"""Triggers don't grow with the rows; ticks of a hundred are told apart within a trigger, whatever batches they come in."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import QUERIES, streams
from millrace.sources.sequence import batch_size
from millrace.streaming import ticks


@pytest.fixture(scope="module")
def larger(spark, sf_dir, tmp_path_factory):
    """Sixty times the events and changes, keys shifted."""
    folder = tmp_path_factory.mktemp("larger")
    k = F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k")
    for name, keys in (("events", {"event_id": 1_000, "user_id": 15}), ("client_changes", {"change_id": 10_000, "client_id": 1_000})):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select("*", k)
        rows.withColumns({c: F.col(c) + F.col("k") * by for c, by in keys.items()}).drop("k").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


class Written(Exception):
    pass


@pytest.mark.parametrize("name", ["stream_bounded", "stream_dispatch", "stream_pending", "stream_sweeps", "stream_views"])
def test_triggers_do_not_grow_with_the_rows(spark, larger, monkeypatch, name):
    def counted(session, folder, schema, *_):
        raise Written(session.read.parquet(folder).groupBy(F.input_file_name()).count().count())

    monkeypatch.setattr(streams, "read_sequence", counted)
    with pytest.raises(Written) as e:
        QUERIES[name](spark, larger)
    assert 1 < e.value.args[0] <= 4


def test_batch_sizes():
    assert batch_size(0, 5, 10, 4) == 5 and batch_size(30, 5, 10, 4) == 8 and batch_size(1_000, 5, 10, 4) == 10
    assert batch_size(30, 5, 10, 4, 3) == 9 and batch_size(0, 0, 10, 4, 100) == 100


def test_ticks_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [(r, "abc"[r * 7 % 3] if r % 11 else None, None if r % 5 == 0 else r * 37 % 101) for r in range(90)]
    frame = lambda some: spark.createDataFrame(some, "rank long, kind string, v long")
    got = []
    for k, size in enumerate((90, 30, 10)):
        new = lambda: ticks.TickTotals(spark, f"file://{tmp_path}/{k}", F.floor(F.col("rank") / 10), "kind", "v")  # noqa: B023, E731
        for n in range(90 // size):
            new().apply(frame(rows[n * size : (n + 1) * size]), n)
            new().apply(frame([(0, "a", 1)]), n)  # a replay
        got.append(sorted(map(tuple, new().read().collect()), key=repr))
    want = []
    for t in range(9):
        for kind in {r[1] for r in rows[10 * t : 10 * t + 10]}:
            so_far = [r[2] for r in rows[: 10 * t + 10] if r[1] == kind]
            want.append((t, kind, len(so_far), max((v for v in so_far if v is not None), default=None)))
    assert got[0] == got[1] == got[2] == sorted(want, key=repr)


def test_a_batch_of_ticks_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch):
    t = ticks.TickTotals(spark, f"file://{tmp_path}", F.col("rank"), "kind", "v")
    frame = lambda *some: spark.createDataFrame(some, "rank long, kind string, v long")
    t.apply(frame((0, "a", 5)), 0)
    put = t.files.put
    monkeypatch.setattr(t.files, "put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.apply(frame((1, "a", 9)), 1)
    monkeypatch.setattr(t.files, "put", put)
    assert [tuple(r) for r in t.read().collect()] == [(0, "a", 1, 5)]
    t.apply(frame((1, "a", 4)), 1)
    assert sorted(map(tuple, t.read().collect())) == [(0, "a", 1, 5), (1, "a", 2, 5)]
