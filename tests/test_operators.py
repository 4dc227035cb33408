"""State, containers and grids on small cases."""

from collections import deque

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import graph, search, state
from millrace.sources.archive import container, open_container, pack_group, unpack_group


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6), st.integers(1, 4), st.sampled_from([0, 1, 2]))
def test_groups_round_trip(files, chunks, kind):
    assert unpack_group(open_container(container(pack_group(files, chunks), kind)), len(files)) == files


def test_dedupe_holds_the_last_accepted(spark):
    ids = [1, 2, 1, 3, 1, 4, 2, 1]
    d = spark.createDataFrame([(0, k, i) for k, i in enumerate(ids)], "k int, at int, i int")
    got = [r.at for r in state.dedupe_recent(d, "k", ["at"], "i", 2).orderBy("at").collect()]
    ring, want = deque(maxlen=2), []
    for k, i in enumerate(ids):
        if i not in ring:
            ring.append(i)
            want.append(k)
    assert got == want


def test_stream_agrees_with_batch(spark, sf_dir):
    from millrace.plans import QUERIES

    key = ["event_type", "event_id", "user_id"]
    batch, stream = (sorted(map(tuple, QUERIES[n](spark, sf_dir).select(key).collect())) for n in ("dedupe_last_100", "stream_dedupe"))
    assert batch == stream


def test_search_over_its_cap_has_no_rows(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"Name {k}") for k in range(5)], "k int, name string")
    assert search.search(d, "name", "NAME", F.lit(True), "k", 4).count() == 0
    assert search.search(d, "name", "NAME", F.lit(True), "k", 5).count() == 5
    monkeypatch.setattr(search, "TOGETHER", 0)
    assert search.search(d, "name", "NAME", F.lit(True), "k", 4).count() == 0
    assert {(r.k, r.place) for r in search.search(d, "name", "NAME", F.lit(True), "k", 5).collect()} == {(k, k) for k in range(5)}
    assert search.search_size(d, "name", "", F.lit(True), 4).first().found == -1


def test_unreachable_target_falls_back(spark):
    cells = spark.createDataFrame([(x, y) for x in range(6) for y in range(6) if x != 3], "x int, y int")
    costs = graph.grid_costs(spark, cells, (0, 0), 10)
    assert tuple(graph.reach_or_near(costs, (2, 2)).first())[:3] == (2, 2, 2)
    assert tuple(graph.reach_or_near(costs, (5, 0)).first())[:2] == (2, 0)


@given(st.lists(st.tuples(st.sampled_from([1, 2, 3]), st.binary(max_size=300)), max_size=8), st.integers(0, 10))
def test_frames_round_trip(messages, cut):
    from millrace.sources.frames import U8, U16, frame, parse

    lengths = {1: U8, 2: U16, 3: 4}
    messages = [(k, b[:255] if k == 1 else b[:4].ljust(4) if k == 3 else b) for k, b in messages]
    raw = b"".join(frame(k, b, lengths) for k, b in messages)
    assert parse(raw, lengths) == (messages, b"")
    some, rest = parse(raw[: max(0, len(raw) - cut)], lengths)
    assert some == messages[: len(some)] and parse(rest + raw[max(0, len(raw) - cut) :], lengths)[0] == messages[len(some) :]


def test_nearest_in_rings_is_exact(spark, monkeypatch):
    import random

    from millrace.operators import lookups

    rnd = random.Random(3)
    places = [(k, rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for k in range(60)]
    elements = [(k, rnd.randrange(-100, 100), rnd.randrange(-100, 100)) for k in range(40)]
    p, e = spark.createDataFrame(places, "k long, x int, y int"), spark.createDataFrame(elements, "e long, x int, y int")
    want = {(k, *min(((x - a) ** 2 + (y - b) ** 2, i) for i, a, b in elements)[::-1]) for k, x, y in places}
    assert {tuple(r) for r in lookups.nearest(p, "k", e, "e").collect()} == want
    monkeypatch.setattr(lookups, "LISTED", 5)
    assert {tuple(r) for r in lookups.nearest(p, "k", e, "e").collect()} == want


def test_places_over_many_partitions(spark):
    from millrace.operators import sorting

    rows = [(k, None if k % 7 == 0 else k * 37 % 11) for k in range(300)]
    d = spark.createDataFrame(rows, "id int, v int").repartition(9)
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1], r[0])), 1)}
    assert {r.id: r.place for r in sorting.place(d, F.col("v").asc_nulls_first(), "id").collect()} == want
    assert sorting.place(d.limit(0), "id").count() == 0


def test_runs_beyond_the_slots_are_an_error(spark):
    d = spark.createDataFrame([(0, 3), (3, 2)], "at int, n int")
    assert [r.slot for r in state.expand_runs(d, "at", "n", 5).orderBy("slot").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="more slots"):
        state.expand_runs(d, "at", "n", 4).collect()


def test_passes_must_be_filled(spark):
    slots = spark.createDataFrame([(1, k, True, False) for k in range(4)], "tick long, slot long, in_view boolean, was_active boolean")
    schema = "tick long, pass int, k int, skip int, value long"
    got = state.skip_passes(slots, spark.createDataFrame([(1, 0, 0, None, 7), (1, 0, 1, 1, None), (1, 0, 2, None, 9)], schema)).orderBy("slot").collect()
    assert [r.value for r in got] == [7, None, None, 9]
    for rows in ([(1, 0, 0, 4, None)], [(1, 0, 0, 2, None)], [(1, 0, 0, 3, None), (1, 2, 0, None, 1)]):
        with pytest.raises(Exception, match="don't fill"):
            state.skip_passes(slots, spark.createDataFrame(rows, schema)).collect()


def test_a_full_list_takes_no_new_names(spark):
    rows = [(k, f"n{k % 5}", k) for k in range(12)]
    got = state.first_members(spark.createDataFrame(rows, "at int, name string, v int").withColumn("l", F.lit(0)), ["l"], "name", ["at"], ["v"], 3).collect()
    assert {(r.name, r.place, r.v) for r in got} == {("n0", 0, 10), ("n1", 1, 11), ("n2", 2, 7)}


def test_urls_keep_malformed_escapes(spark):
    from millrace.functions import text

    cases = {"a%20b+c": "a b c", "%zz%4": "%zz%4", "%00x%81y": "xy", "%80%e9%41": "\u20ac\xe9A", "%2B": "+", "%": "%", "": "", "%%41": "%A", "\n%0a": "\n\n"}
    d = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert [(r.want, r.got) for r in d.withColumn("got", text.decode_url(F.col("s"))).collect() if r.want != r.got] == []


def test_noise_wraps_as_32_bit_arithmetic(spark):
    from millrace.operators import raster

    def noise(x, y):
        wrap = lambda n: (n + 2**31) % 2**32 - 2**31
        n = x + 57 * y
        n = wrap(n ^ wrap(n << 1))
        v = 4096 - (wrap(wrap(wrap(789221 + wrap(15731 * wrap(n * n))) * n) + 1376312589) & 0x7FFFFFFF) // 262144
        return v % 4096 if v >= 0 else -(-v % 4096)

    places = [(x, y) for x in (0, 1, 77, 4095) for y in (0, 5, 1000, 4095)]
    got = spark.createDataFrame(places, "x int, y int").select("x", "y", raster.hash_noise(F.col("x"), F.col("y")).alias("v")).collect()
    assert all(r.v == noise(r.x, r.y) for r in got)


def test_requests_are_dropped_by_the_second_sweep(spark):
    rows = [(1, 10.2, None), (2, 10.2, 11.9), (3, 10.2, 12.5), (4, 10.0, 12.0), (5, 50.0, None)]
    d = spark.createDataFrame(rows, "k int, a double, b double").selectExpr("k", "timestamp_micros(cast(a * 1000000 as long)) AS a", "timestamp_micros(cast(b * 1000000 as long)) AS b")
    got = {r.k: r.dropped for r in state.two_strikes(d, "k", "a", "b", 1, F.timestamp_seconds(F.lit(40))).selectExpr("k", "unix_seconds(dropped) AS dropped").collect()}
    assert got == {1: 12, 2: None, 3: 12, 4: None, 5: None}


def test_ids_that_are_null_are_ids(spark):
    d = spark.createDataFrame([(None, k, i) for k, i in enumerate([1, None, None, 1, 2, None])], "k int, at int, i int")
    assert [r.at for r in state.dedupe_recent(d, "k", ["at"], "i", 2).orderBy("at").collect()] == [0, 1, 4]
