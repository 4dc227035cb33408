"""Lists folded by codes against a walk through their ticks."""

import random

import pytest

from millrace.operators import lists
from millrace.operators.lists import ADDED, GONE, RAN, SAME, STEPPED, fold_lists

SCHEMA = "g int, tick int, ident int, k int, code int, dx int, dy int, what string"
NAMES = ["same", "changed", "stepped", "ran", "gone", "added"]


def walked(rows):
    """Each list held whole, from tick to tick."""
    out, last = [], max(r[1] for r in rows)
    for g in {r[0] for r in rows}:
        held, at = [], {}
        for t in range(min(r[1] for r in rows if r[0] == g), last + 1):
            sent = {r[2]: r for r in rows if r[:2] == (g, t) and r[4] != ADDED}
            kept, told = [], {}
            for i in held:
                if i not in sent:
                    out.append((g, t, i, "unsent", None, *at[i]))
                    continue
                _, _, _, _, code, dx, dy = sent[i]
                at[i] = (at[i][0] + (dx or 0), at[i][1] + (dy or 0))
                if code == GONE:
                    out.append((g, t, i, "gone", None, *at[i]))
                else:
                    kept.append(i)
                    told[i] = NAMES[code + 1]
            for r in sorted((r for r in rows if r[:2] == (g, t) and r[4] == ADDED), key=lambda r: r[3]):
                at[r[2]] = (r[5] or 0, r[6] or 0)
                kept.append(r[2])
                told[r[2]] = "added"
            out += [(g, t, i, told[i], n, *at[i]) for n, i in enumerate(kept)]
            held = kept
    return sorted(out)


def made(rnd, ticks=30):
    """Codes for lists of up to some dozen entries; tails that aren't sent, ticks that send nothing, entries that go and come at once."""
    rows = []
    for g in range(3):
        held = []
        for t in range(ticks):
            n = 0 if rnd.random() < 0.1 else rnd.randrange(len(held) // 2, len(held) + 1)
            kept, k = [], 0
            gone = []
            for i in held[:n]:
                code = rnd.choice([SAME, SAME, 0, STEPPED, RAN, GONE])
                rows.append((g, t, i, 0, code, rnd.choice([1, -1, None]) if code in (STEPPED, RAN) else None, 2 if code == RAN else None))
                (gone if code == GONE else kept).append(i)
            free = [i for i in range(20) if i not in held] + gone + held[n:]
            for i in rnd.sample(free, min(len(free), rnd.randrange(4))):
                rows.append((g, t, i, k := k + rnd.randrange(1, 3), ADDED, 5, None))
                kept.append(i)
            held = kept
    return rows


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return fold_lists(frame, ["g"], "tick", "ident", "k", "code", "dx", "dy")


@pytest.mark.parametrize("seed", range(4))
def test_against_a_walk(spark, seed):
    rows = made(random.Random(seed))
    got = sorted(map(tuple, run(spark, rows).collect()))
    assert got == walked(rows)
    assert {r[3] for r in got} == {*NAMES, "unsent"}


HELD = [(0, 1, i, i, ADDED, 0, 0) for i in (7, 8, 9)]


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([(0, 2, 7, 0, SAME, 0, 0), (0, 2, 5, 0, SAME, 0, 0)], "isn't in the list at tick 2"),
        ([(0, 3, 7, 0, SAME, 0, 0)], "isn't in the list at tick 3"),
        ([(0, 2, 7, 0, GONE, 0, 0), (0, 3, 7, 0, SAME, 0, 0)], "isn't in the list at tick 3"),
        ([(0, 2, 7, 0, SAME, 0, 0), (0, 2, 8, 0, SAME, 0, 0), (0, 2, 8, 0, ADDED, 0, 0)], "comes that is in the list at tick 2"),
        ([(0, 2, 7, 0, SAME, 0, 0), (0, 2, 9, 0, SAME, 0, 0)], "isn't sent before one that is"),
        ([(0, 2, 7, 0, 5, 0, 0)], "out of range"),
        ([(0, 2, 7, 0, None, 0, 0)], "out of range"),
    ],
)
def test_what_cannot_be_raises(spark, rows, message):
    with pytest.raises(Exception, match=message):
        run(spark, HELD + rows).collect()


def test_no_rows_and_names(spark):
    assert run(spark, HELD[:1]).collect() == [(0, 1, 7, "added", 0, 0, 0)]
    assert fold_lists(spark.createDataFrame([], SCHEMA), ["g"], "tick", "ident", "k", "code", "dx", "dy").collect() == []
    assert [lists._NAMES[c] for c in range(-1, 5)] == NAMES
