"""Many grid searches against a search for each request."""

import random
from collections import deque

from millrace.operators.searches import AROUND, grid_searches


def one_search(sx, sy, tx, ty, blocked, steps):
    if None in (sx, sy, tx, ty):
        return None, None, None, False
    cost, queue = {(sx, sy): 0}, deque([(sx, sy)])
    while queue:
        x, y = queue.popleft()
        if cost[x, y] == steps:
            continue
        for dx, dy in AROUND:
            if not {(x + dx, y + dy), (x + dx, y), (x, y + dy)} - {(x, y)} & blocked and (x + dx, y + dy) not in cost:
                cost[x + dx, y + dy] = cost[x, y] + 1
                queue.append((x + dx, y + dy))
    near = [((x - tx) ** 2 + (y - ty) ** 2, c, x, y) for (x, y), c in cost.items() if (x, y) == (tx, ty) or abs(x - tx) <= 10 and abs(y - ty) <= 10 and c < 100]
    d2, c, x, y = min(near, default=(1, None, None, None))
    return x, y, c, d2 == 0


def test_against_a_search_for_each_request(spark):
    rnd = random.Random(6)
    blocked = [(rnd.randrange(14), rnd.randrange(14)) for _ in range(70)] + [(None, 1), (2, None)]
    asked = [(k, rnd.randrange(14), rnd.randrange(14), rnd.randrange(-3, 17), rnd.randrange(-3, 17)) for k in range(60)]
    asked += [(100, 5, 5, 5, 5), (101, None, 0, 1, 1), (102, 0, 0, 60, 0), (103, 3, 3, None, 3), (104, *[b for b in blocked if None not in b][0], 7, 7)]
    requests = spark.createDataFrame([(*a, "clash") for a in asked], "request long, sx int, sy int, tx int, ty int, x string").repartition(3)
    cells = spark.createDataFrame([(*b, 0) for b in blocked + blocked[:5]], "x int, y int, cost int")
    shut = {b for b in blocked if None not in b}
    for steps in (0, 3, 12):
        got = {r.request: (r.x, r.y, r.cost, r.found) for r in grid_searches(requests, cells, steps).collect()}
        assert got == {a[0]: one_search(*a[1:], shut, steps) for a in asked}


def test_nothing_asked_and_nothing_blocked(spark):
    none = spark.createDataFrame([], "request long, sx int, sy int, tx int, ty int")
    cells = spark.createDataFrame([], "x int, y int")
    assert grid_searches(none, cells, 3).collect() == []
    one = spark.createDataFrame([(1, 0, 0, 2, -1)], "request long, sx int, sy int, tx int, ty int")
    assert grid_searches(one, cells, 3).collect() == [(1, 2, -1, 2, True)]
