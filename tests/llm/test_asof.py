"""The tolerant as-of join against all orders of each row's client."""

import random

import pytest

from millrace.llm import asof

LEFT, ORDERS = "client_id long, ts_us long, click_id long, size string", "client_id long, ts_us long, sale_id long, priority long, total long, _extra string"
TOLERANCE = 10 * 24 * asof.HOUR


def brute(rows, orders, tolerance):
    """Of the latest time within the tolerance the order of smallest priority, then largest id, then smallest total; nulls lose."""
    out = []
    for client, at, ident, size in rows:
        mine = [o for o in orders if o[0] == client and o[1] is not None and at - tolerance <= o[1] <= at] if client is not None and at is not None else []
        same = [o for o in mine if o[1] == max(x[1] for x in mine)]
        best = min(same, key=lambda o: (o[3] is None, o[3] or 0, o[2] is None, -(o[2] or 0), o[4] is None, o[4] or 0)) if same else (None,) * 6
        out.append((client, at, ident, size, best[2], best[4], len(same) or None, best[1]))
    return sorted(out, key=repr)


def run(spark, rows, orders, tolerance=TOLERANCE, **how):
    left, right = spark.createDataFrame(rows, LEFT).repartition(3), spark.createDataFrame(orders, ORDERS).repartition(3)
    tied = asof.collapse_ties(right, "client_id", "ts_us", ["priority"], ["sale_id"], ["sale_id", "total"])
    return sorted(map(tuple, asof.asof_join(left, tied, "client_id", "ts_us", ["sale_id", "total", "n_tied"], tolerance, **how).collect()), key=repr)


def made(seed, n=600, span=60 * 24):
    """One client has a third of all rows; half of the times are full hours, some of them in one second; nulls and repeated rows."""
    rnd = random.Random(seed)
    client = lambda: rnd.choice([1, 1, 1, *range(2, 7), None])
    time = lambda: rnd.choice([rnd.randrange(-span, span) * asof.HOUR, rnd.randrange(span * asof.HOUR), 5 * asof.HOUR + rnd.randrange(40), None])
    rows = [(client(), time(), rnd.choice([k, None]), "x") for k in range(n)]
    orders = [(client(), time(), rnd.choice([k, k, 7, None]), rnd.choice([1, 2, None]), rnd.choice([5, 6, None]), "y") for k in range(n)]
    return rows + rows[:20], orders + orders[:20]


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 1}, {"chunk_rows": 7, "slots": 3}, {"chunk_rows": 5, "narrower": (3 * asof.HOUR,)}, {"chunk_rows": 3, "narrower": ()}])
def test_against_all_orders(spark, how):
    """Chunks of any width, down to a second, and blocks of the narrowest ones change nothing."""
    rows, orders = made(len(how))
    assert run(spark, rows, orders, **how) == brute(rows, orders, TOLERANCE)


def test_the_tolerance_is_kept_to_the_microsecond(spark):
    rows = [(1, TOLERANCE, 0, ""), (1, TOLERANCE + 1, 1, ""), (1, 0, 2, ""), (1, -1, 3, "")]
    orders = [(1, 0, 10, 1, 1, "")]
    assert [r[2:5:2] for r in run(spark, rows, orders)] == [r[2:5:2] for r in brute(rows, orders, TOLERANCE)]
    found = {r[2]: r[4] for r in run(spark, rows, orders)}
    assert found == {0: 10, 1: None, 2: 10, 3: None}


def test_ids_beyond_a_double_stay(spark):
    big = (1 << 62) + 1
    assert run(spark, [(big, big, big, "")], [(big, big - 1, big, None, big, "")], 1) == [(big, big, big, "", big, big, 1, big - 1)]


def test_empty_tables(spark):
    rows, orders = made(3, 20)
    assert run(spark, [], orders) == []
    assert run(spark, rows, []) == brute(rows, [], TOLERANCE)
    with pytest.raises(ValueError):
        run(spark, rows, orders, 0)


def test_times_without_a_zone_are_utc(spark):
    frame = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.123456' AS a, timestamp_ntz'1969-12-31 23:59:59.999999' AS b, timestamp'2024-03-31 02:30:00.123456Z' AS c, CAST(NULL AS timestamp_ntz) AS d")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert tuple(frame.select(*[asof.micros(frame, c) for c in "abcd"]).first()) == (1711852200123456, -1, 1711852200123456, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
