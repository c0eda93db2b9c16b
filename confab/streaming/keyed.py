"""Keyed state over streams: rows whose signature changes, and keys seen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

#: The state store that keyed processors need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(t) -> int:
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) if t.tzinfo is None else int(t.timestamp() * 1000)


class _Changes(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, then go by in order; the last signature stays."""

    def __init__(self, schema: StructType, ts: str, order: list[str], signature: str, forget_ms: int | None):
        self.schema, self.ts, self.order, self.signature, self.forget = schema, ts, order, signature, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", "signature string, known boolean, at long")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        new = [tuple(r[c] for c in self.schema.names) for r in rows if r[self.ts] is not None and _ms(r[self.ts]) > passed]
        if new:
            self.waiting.appendList(new)
            at = self.schema.names.index(self.ts)
            self.handle.registerTimer(min(_ms(r[at]) for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, names = timerValues.getCurrentWatermarkInMs(), self.schema.names
        at, sig, order = names.index(self.ts), names.index(self.signature), [names.index(c) for c in self.order]
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if _ms(r[at]) <= passed), key=lambda r: [(r[k] is not None, r[k]) for k in order])
        left = [r for r in rows if _ms(r[at]) > passed]
        value, known, seen = self.last.get() if self.last.exists() else (None, False, 0)
        changed = []
        for r in due:
            if self.forget is not None and known and _ms(r[at]) - seen > self.forget:
                known = False
            if not known or r[sig] != value:
                changed.append(r)
            value, known, seen = r[sig], True, _ms(r[at])
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
            self.last.update((value, known, seen))
            if left:
                self.handle.registerTimer(min(_ms(r[at]) for r in left))
        if self.forget is not None and known:
            if not left and passed > seen + self.forget:
                self.last.clear()  # nothing that still counts could be equal to it
            elif not left:
                self.handle.registerTimer(seen + self.forget + 1)
        return (Row(**dict(zip(names, r))) for r in changed)

    def close(self) -> None:
        pass


def changed_rows_stream(rows: DataFrame, signature: str, by: str, ts: str, order: list[str], late: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """The stream's rows whose (text) ``signature`` differs from that of the row before in ``by``, in the order (``ts``, ``order``).

    As ``metrics.changed_rows`` of the whole table, whatever order rows arrive in, as long as none is more
    than ``late`` behind the latest: each waits until the watermark has passed it.  Later ones are left
    out.  With ``forget_ms`` a signature is forgotten after so long without rows.
    Rows without a time are left out.  State: what waits, and a signature a key.
    """
    marked = rows.withWatermark(ts, late)
    work = _Changes(rows.schema, ts, [ts, *[c for c in order if c != ts]], signature, forget_ms)
    return marked.groupBy(by).transformWithState(work, rows.schema, "Append", "EventTime")


def first_of_keys(rows: DataFrame, key: str, ts: str, within: str = "30 days") -> DataFrame:
    """The first row of each key that a stream brings within that time, over all its micro-batches; null keys all stay.

    A key's state goes when the watermark has passed it by ``within``.
    """
    own = F.coalesce(F.col(key), F.concat(F.lit("null "), F.uuid()))
    return rows.withWatermark(ts, within).withColumn("_key", own).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
