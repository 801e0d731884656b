"""Incremental packing of files as they come: what is known of each label is kept as state, so that no table of the last run is needed.

A delivery of a label (``seen``, ``mtime_ns``, ``source_hash``) says ``reuse`` if time and hash are those of the one before, else ``encode``. A label that isn't
delivered again within ``keep`` is ``removed`` then, by a timer of event time; a delivery after that encodes it anew. What comes out doesn't depend on how
deliveries are cut into batches, as long as those of one label come in order, nor on restarts from the same checkpoint.

Deliveries of one label in one batch count in the order of ``seen``, then of their time and hash. Null labels are one label; a null ``seen`` or one behind the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = "label string, action string, seen timestamp"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Packer(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "mtime_ns long, source_hash binary, seen long")

    def _row(self, key, action: str, seen: int) -> Row:
        return Row(label=key[0], action=action, seen=seen)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r.ms, r.mtime_ns or 0, r.source_hash or b"")):
            if last is not None and r.ms > last[2] + self.keep:
                yield self._row(key, "removed", last[2] + self.keep)
                last = None
            same = last is not None and last[:2] == (r.mtime_ns, r.source_hash)
            yield self._row(key, "reuse" if same else "encode", r.ms)
            last = (r.mtime_ns, r.source_hash, r.ms)
        self.last.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last[2] + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()
        self.last.clear()
        yield self._row(key, "removed", last[2] + self.keep)

    def close(self) -> None:
        pass


def pack_stream(stream: DataFrame, keep_hours: float = 24, late: str = "0 seconds") -> DataFrame:
    """``label, action, seen`` for a stream of deliveries (``label, seen, mtime_ns, source_hash``). State lies in RocksDB, in the query's checkpoint."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own = stream.select("label", "seen", "mtime_ns", "source_hash").filter("seen is not null").withWatermark("seen", late).withColumn("ms", F.unix_millis("seen"))
    found = own.groupBy("label").transformWithState(Packer(int(keep_hours * 3_600_000)), "label string, action string, seen long", "Append", "EventTime")
    return found.withColumn("seen", F.timestamp_millis("seen"))
