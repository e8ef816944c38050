"""Keyed state of streams: ordered folds and delivery audits with ``transformWithStateInPandas``.

State lives in RocksDB on the executor of its key and in the query's checkpoint, so a lost executor or a restart resumes it.
A fold must see a key's rows by event time, but a micro-batch brings them in any order. Rows wait in a map state by time slot;
an event-time timer fires once the watermark passed the slot, and timers of a key fire in order of time. Thus a task
holds the rows of one slot of one key, never a key's micro-batch. Each call into the state store is a round trip to the JVM, so the
rows that one Arrow batch brings for a slot wait in one packed cell, and digests of neighbouring items share one. What a key knows is one typed value state; a key without
rows for longer than ``idle`` forgets it. Rows behind the watermark are dropped by Spark and counted in the query's progress;
:class:`DeliveryAudit` keeps such rows and names what is wrong with them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: One row of a fold: (state or None, row) -> (state, output), all tuples in the order of their schemas.
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which typed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _plain(value):
    """A cell as Python value: NumPy scalars unwrapped, missing ones as None."""
    if isinstance(value, (list, tuple, dict)):
        return value
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


def _cells(column: pd.Series) -> list:
    """A column's cells as :func:`_plain` values."""
    missing, values = column.isna(), column.tolist()
    return [None if m else v for v, m in zip(values, missing.tolist())] if missing.any() else values


class OrderedFold(StatefulProcessor):
    """``step`` over a key's rows in order of ``(time, order)``."""

    def __init__(self, keys: Sequence[str], time: str, row_schema: str, state_schema: str, output: str, step: Step, slot_ms: int, idle_ms: int):
        self.keys, self.time, self.names = list(keys), time, StructType.fromDDL(output).names
        self.row_schema, self.state_schema = StructType.fromDDL(row_schema), StructType.fromDDL(state_schema)          # parsed where a session is
        self.slot_schema, self.place_schema, self.part_schema, self.count_schema = (StructType.fromDDL(x) for x in ("slot long", "slot long, nth int", "rows binary", "n int"))
        self.step, self.slot_ms, self.idle_ms = step, slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.state_schema)
        self.waiting = handle.getMapState("waiting", self.place_schema, self.part_schema)
        self.counts = handle.getMapState("counts", self.slot_schema, self.count_schema)
        self.latest = handle.getValueState("latest", self.slot_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            parts = {}
            micros = frame[self.time].dt.as_unit("us").astype("int64")
            slots = (micros // (1000 * self.slot_ms) + 1) * self.slot_ms
            for slot, row in zip(slots.tolist(), zip(*(_cells(frame[c]) for c in self.row_schema.names))):
                parts.setdefault(slot, []).append(row)
            for slot, part in parts.items():
                n = self.counts.getValue((slot,))
                if n is None:
                    self.handle.registerTimer(slot)
                n = n[0] if n else 0
                self.waiting.updateValue((slot, n), (pickle.dumps(part, 4),))
                self.counts.updateValue((slot,), (n + 1,))
        return iter(())                                     # rows leave by timers only

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs()
        out, parts, latest = [], self.counts.getValue((slot,)), self.latest.get()
        if parts is not None:
            rows = [tuple(row) for k in range(parts[0]) for row in pickle.loads(self.waiting.getValue((slot, k))[0])]
            rows.sort(key=itemgetter(0, 1))
            state = self.known.get()
            state = None if state is None else tuple(state)
            own = tuple(_plain(k) for k in key)
            for row in rows:
                state, emitted = self.step(state, row)
                out.append((*own, *emitted))
            self.known.update(state)
            for k in range(parts[0]):
                self.waiting.removeKey((slot, k))
            self.counts.removeKey((slot,))
            if latest is not None:
                self.handle.deleteTimer(latest[0] + self.idle_ms)
            self.latest.update((slot,))
            self.handle.registerTimer(slot + self.idle_ms)
        elif latest is not None and latest[0] + self.idle_ms == slot:      # no row since
            self.known.clear()
            self.latest.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, keys: Sequence[str], time: str, delay: str, row_schema: str, state_schema: str, output: str, step: Step, *,
                 slot_ms: int = 1, idle_days: int = 3650) -> DataFrame:
    """``step`` over every key's rows in order of ``row_schema``, whose first columns are the time and a tie-breaker.

    ``output`` names the keys first, then what ``step`` emits. ``slot_ms``: how much event time a task folds at once;
    ``idle_days``: a key's state is forgotten after so much event time without a row.
    """
    processor = OrderedFold(keys, time, row_schema, state_schema, output, step, slot_ms, idle_days * 86_400_000)
    keyed = stream.withWatermark(time, delay).groupBy(*keys)
    return keyed.transformWithStateInPandas(processor, StructType.fromDDL(output), "Append", "EventTime")


ACCEPTED, DUPLICATE, CONFLICT, LATE = "ACCEPTED", "DUPLICATE", "CONFLICT", "LATE"


#: Neighbouring items whose digests share a cell of the state.
BLOCK = 1_024


class DeliveryAudit(StatefulProcessor):
    """First content of every item of a key, by digest; later deliveries are judged against it."""

    def __init__(self, item: str, digest: str, monotone: bool, output: str, ttl_ms: int | None):
        self.item, self.digest, self.monotone, self.names, self.ttl_ms = item, digest, monotone, StructType.fromDDL(output).names, ttl_ms
        self.item_schema, self.block_schema, self.digest_schema = (StructType.fromDDL(x) for x in ("item long", "block long", "digests binary"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digests = handle.getMapState("digests", self.block_schema, self.digest_schema, self.ttl_ms)
        self.newest = handle.getValueState("newest", self.item_schema, self.ttl_ms)

    def known(self, block: int, now: int) -> dict[int, tuple[int, int]]:
        """Item -> (digest, time of its first delivery) of a block, without what has expired."""
        cell = self.digests.getValue((block,))
        rows = np.frombuffer(cell[0], np.int64).reshape(-1, 3).tolist() if cell else []
        return {item: (digest, at) for item, digest, at in rows if self.ttl_ms is None or at + self.ttl_ms > now}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get() if self.monotone else None
        before = top = newest[0] if newest is not None else None
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        for frame in rows:
            verdicts, blocks, changed = [], {}, set()
            for item, digest in zip(frame[self.item].tolist(), frame[self.digest].tolist()):
                block = item // BLOCK
                if block not in blocks:
                    blocks[block] = self.known(block, now)
                first = blocks[block].get(item)
                if first is not None:
                    verdicts.append(DUPLICATE if first[0] == digest else CONFLICT)
                elif before is not None and item < before:
                    verdicts.append(LATE)
                else:
                    blocks[block][item] = digest, now
                    changed.add(block)
                    verdicts.append(ACCEPTED)
                    top = item if top is None else max(top, item)
            for block in changed:
                self.digests.updateValue((block,), (np.array([(i, *x) for i, x in blocks[block].items()], np.int64).tobytes(),))
            yield frame.assign(verdict=verdicts)[self.names]
        if self.monotone and top is not None and top != before:
            self.newest.update((top,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([], columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def audit_deliveries(stream: DataFrame, keys: Sequence[str], item: str, content: Sequence[str], *, monotone: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """Every row with its ``verdict``: ACCEPTED is the first delivery of an item, DUPLICATE the same content again, CONFLICT other content.

    ``item`` is a whole number within the key (an id, a day). With ``monotone``, a new item below the newest one
    of earlier micro-batches is LATE. Inside one micro-batch the row that arrives first is the first delivery. ``ttl_ms``
    lets digests expire by processing time. Every key costs a call of its own, so keys of few items are better blocks of ids. Rows are judged, none is lost: the verdicts of all rows sum to the input.
    """
    rows = stream.withColumn("audit_digest", F.xxhash64(*content)).withColumn("audit_item", F.col(item).cast("long"))
    output = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "verdict string"])
    processor = DeliveryAudit("audit_item", "audit_digest", monotone, output, ttl_ms)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, StructType.fromDDL(output), "Append", "ProcessingTime" if ttl_ms else "None").drop("audit_digest", "audit_item")

