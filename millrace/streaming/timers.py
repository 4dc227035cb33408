"""Keyed state that is folded in order of event time, with timers: held-back writes and requests that time out.

A key's rows wait in the state until the watermark has passed them, so that they are folded in their order
whatever batch brought them; what falls due between two rows comes between them. A timer for the next row or due time
wakes the key. Thus results depend on the rows and the watermark only, not on how the batches fall.

Each call to the state store and each key that Spark hands to Python costs about as much as folding hundreds of rows. So the keys are
dealt to buckets, and a bucket, not a key, is what Spark keeps state and timers for: blocks of rows, all its keys' states as one value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch commits what it changed, not a copy of the store.
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

#: Buckets of a stream's keys: many more than tasks, few enough that a batch brings each of them many rows. No more tasks than these work at once.
BUCKETS = 256
#: Begins the names of columns that tell nulls, as pandas has no integers with nulls, and the bucket's (Spark hands no name that starts with "_" to pandas).
_NULL, _BUCKET = "null_of_", "bucket_of_keys"

#: ``fold(state, rows, until)``: what is put out, and when the key falls due next (None: never). ``state`` has the
#: variables by name, each a tuple or None where there is none, and is changed in place.
Fold = Callable[[dict[str, tuple | None], list[tuple], int], tuple[list[tuple], int | None]]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.BufferReader(bytes(p))).read_all() for p in packed], promote_options="permissive")


def _listed(values: pa.ChunkedArray) -> list:
    plain = pa.types.is_integer(values.type) or pa.types.is_floating(values.type) or pa.types.is_boolean(values.type)
    return values.to_numpy().tolist() if plain and not values.null_count else values.to_pylist()


class Folded(StatefulProcessor):
    """Folds the rows ``(at, seq, ...)`` of a bucket's keys; ``at`` is in milliseconds. By processing time rows count as of when they come.

    A bucket holds its rows as blocks with their first time, its keys' states as one value, and one timer, for what is due next of all its keys.
    """

    def __init__(self, fold: Fold, columns: list[str], whole: list[str], names: list[str], kept: str, out: list[str], by_event_time: bool):
        self.fold, self.columns, self.whole, self.names, self.kind, self.out, self.by_event_time = fold, columns, whole, names, kept, out, by_event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("_rows", "first long, rows binary")
        self.kept = handle.getValueState("_kept", self.kind)
        self.timer = handle.getValueState("_timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        if not self.by_event_time:
            return self._folded(pa.concat_tables(map(self._table, rows), promote_options="permissive"), timerValues.getCurrentProcessingTimeInMs())
        first = []
        for frame in rows:
            table = self._table(frame)
            if table[self.columns[1]].null_count:
                raise ValueError(f"{self.columns[1]} is null")
            first.append(int(frame[self.columns[1]].min()))
            self.rows.appendValue((first[-1], _packed(table)))
        self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        if not self.by_event_time:
            return self._folded(None, timerValues.getCurrentProcessingTimeInMs())
        until = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.rows.get()]
        later, due = [r for r in held if r[0] > until], [p for first, p in held if first <= until]
        table = None
        if due:
            table = _unpacked(due)
            at = table[self.columns[1]].to_numpy()
            if (at > until).any():
                later.append((int(at[at > until].min()), _packed(table.filter(at > until))))
                table = table.filter(at <= until)
            self.rows.clear()
            if later:
                self.rows.put(later)
        if later:
            self._wake(min(r[0] for r in later))
        return self._folded(table, until)

    def _table(self, frame: pd.DataFrame) -> pa.Table:
        mask = lambda c: frame[_NULL + c].to_numpy(bool) if c in self.whole else None
        return pa.table({c: pa.array(frame[c], mask=mask(c), from_pandas=True) for c in self.columns})

    def _wake(self, at: int) -> None:
        """Sets the timer to ``at`` unless it is set to an earlier time."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _by_key(self, table: pa.Table, now: int) -> dict:
        """Each key's rows in order."""
        keys, *lists = (_listed(table[c]) for c in self.columns)
        at, seq = (table[c] for c in self.columns[1:3])
        order = np.lexsort([v for c in (seq, at) for v in (c.fill_null(0).to_numpy(), c.is_null().to_numpy())]).tolist()  # nulls last
        if not self.by_event_time:
            lists[0] = [now] * len(keys)
        rows, groups = list(zip(*lists, strict=True)), {}
        for i in order:
            groups.setdefault(keys[i], []).append(rows[i])
        return groups

    def _folded(self, table, until):
        before = self.kept.get()[0] if self.kept.exists() else ()
        kept = {k: ([v and tuple(v) for v in states], due) for k, due, *states in before}
        groups = {} if table is None else self._by_key(table, until)
        for k, (_, due) in kept.items():
            if due is not None and due <= until:
                groups.setdefault(k, [])
        rows = []
        for k, some in groups.items():
            state = dict(zip(self.names, kept[k][0] if k in kept else [None] * len(self.names), strict=True))
            out, due = self.fold(state, some, until)
            rows.extend((k, *o) for o in out)
            if due is None and all(v is None for v in state.values()):
                kept.pop(k, None)
            else:
                kept[k] = [state[n] for n in self.names], due
        if groups:
            self.kept.update(([(k, due, *states) for k, (states, due) in kept.items()],))
        dues = [due for _, due in kept.values() if due is not None]
        if dues:
            self._wake(min(dues))
        if not rows:
            return iter(())
        return iter([pd.DataFrame({n: pd.Series(c, dtype="object") for n, c in zip(self.out, zip(*rows, strict=True), strict=True)})])

    def close(self) -> None:
        return


def folded(stream: DataFrame, key: str, columns: list[str], row: str, states: dict[str, str], out: str, fold: Fold, by_event_time: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """A stream of what ``fold`` puts out for each key; ``columns`` begin with the time in milliseconds and a number that breaks ties.

    ``row``, ``states`` and ``out`` are schemas of the columns, of each variable of the state and of the output, the key first. By event time
    the stream needs a watermark, and rows behind it are dropped. A key may be of any type but float and double. Sets the session's state
    store to the one that keeps timers, its commits to changes.
    """
    kind = stream.schema[key].dataType
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        raise ValueError(f"{key} is of {kind.simpleString()}, which is no key")
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)
    stream.sparkSession.conf.set(_CHANGELOG, "true")
    kinds = {key: kind, **{c: f.dataType for c, f in zip(columns, T.StructType.fromDDL(row), strict=True)}}
    whole = [c for c, t in kinds.items() if isinstance(t, T.IntegralType)]
    nulls = {_NULL + c: F.isnull(c) for c in whole}
    values = {c: F.coalesce(F.col(c), F.lit(0)).cast(kinds[c]) if c in whole else F.col(c).cast(kinds[c]) for c in kinds}
    dealt = stream.withColumns({**nulls, _BUCKET: F.pmod(F.hash(key), F.lit(buckets))}).withColumns(values)
    kept = f"kept array<struct<key {kind.simpleString()}, due long, {', '.join(f'{n} struct<{t}>' for n, t in states.items())}>>"
    processor = Folded(fold, list(kinds), whole, list(states), kept, [f.split()[0] for f in out.split(", ")], by_event_time)
    return dealt.groupBy(_BUCKET).transformWithStateInPandas(processor, out, "Append", "EventTime" if by_event_time else "ProcessingTime")


#: The variables of the folds below.
HOLD = {"hold": "due long, has boolean, value long"}
OPEN = {"open": "idents array<long>, times array<long>"}


def hold_writes(hold_ms: int) -> Fold:
    """Own writes show at once and hold back those of others; rows are ``(at, seq, value, own)``, the state is HOLD.

    An own write holds for ``hold_ms``; each other write that comes meanwhile is kept in the place of the one before and
    holds for as long again, and an own one drops it. Once the time is over, what is kept shows. Without a hold, writes show
    at once. Puts out ``(at, value, how)``: own, other or released.
    """

    def fold(state, rows, until):
        out = []

        def release(now):
            due, has, value = state["hold"] or (now, False, None)
            if due < now:
                if has:
                    out.append((due + 1, value, "released"))
                state["hold"] = None

        for at, _, value, own in rows:
            release(at)
            if own:
                out.append((at, value, "own"))
                state["hold"] = (at + hold_ms, False, None)
            elif state["hold"] is None:
                out.append((at, value, "other"))
            else:
                state["hold"] = (at + hold_ms, True, value)
        release(until)
        return out, state["hold"] and state["hold"][0] + 1

    return fold


def sweep_requests(period_ms: int) -> Fold:
    """Requests that two sweeps in turn find open are dropped; rows are ``(at, seq, ident, opens)``, the state is OPEN.

    Sweeps come at the multiples of ``period_ms``, before the rows of that time. A row that doesn't open closes the request of
    its ident, or all where it has none; one that opens an open request opens it anew. Puts out ``(ident, opened, dropped)``.
    """

    def fold(state, rows, until):
        held, out = dict(zip(*state["open"], strict=True)) if state["open"] else {}, []

        def sweep(now):
            for ident, opened in list(held.items()):
                second = (opened // period_ms + 2) * period_ms
                if second <= now:
                    out.append((ident, opened, second))
                    del held[ident]

        for at, _, ident, opens in rows:
            sweep(at)
            if opens:
                held[ident] = at
            elif ident is None:
                held.clear()
            else:
                held.pop(ident, None)
        sweep(until)
        state["open"] = (list(held), list(held.values())) if held else None
        return out, min(((o // period_ms + 2) * period_ms for o in held.values()), default=None)

    return fold
