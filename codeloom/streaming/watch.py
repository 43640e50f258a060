"""Change events: normalisation, debouncing and the incremental loop, as Structured Streaming."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What the kinds of raw events become, and which of a path's kinds outlasts the others.
KINDS = {"create": "Added", "modify": "Modified", "remove": "Deleted"}
RANK = {"Deleted": 2, "Added": 1, "Modified": 0}
DEBOUNCE = "500 milliseconds"


def normalise(events: DataFrame, ignored: str = ".cache/") -> DataFrame:
    """(ts, path, change): events of files that tell of a change; other kinds, directories and the cache folder drop."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("kind")]
    return events.where(~F.col("is_dir") & ~F.col("path").contains(ignored)).select("ts", "path", kind.alias("change")).where("change is not null")


def merged(change: Column) -> Column:
    """What is left of a path's changes in a session: Deleted, else Added, else Modified. It is a maximum, so the order of
    events in a session does not matter."""
    return _named(F.max(_rank(change)))


def _rank(change: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[change]


def _named(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("Modified"), F.lit("Added"), F.lit("Deleted")), rank + 1)


def _seconds(gap: str) -> float:
    n, unit = re.fullmatch(r"\s*([\d.]+)\s*(\w+?)s?\s*", gap).groups()
    return float(n) * {"millisecond": 1e-3, "second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}[unit]


def debounce(changes: DataFrame, gap: str = DEBOUNCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, path, change, events): changes by session. A session is of all paths together, those of the same
    ``keys``, and ends when ``gap`` passes without an event; of each path one change is left.

    Events a gap apart at most are of one session, so all in a slice of time as wide as the gap are. Slices are aggregated
    where they lie; what is ordered to find the breaks is a row for each slice with events, not the events."""
    width = int(_seconds(gap) * 1_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    sliced = changes.withColumns({"_at": at, "_slice": F.floor(at / width)})
    slices = sliced.groupBy(*keys, "_slice").agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    breaks = slices.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(order) >= width, F.lit(True)))
    starts = breaks.withColumn("_start", F.last(F.when(F.col("opens"), F.col("first")), ignorenulls=True).over(order))
    held = sliced.join(starts.select(*keys, "_slice", "_start"), [*keys, "_slice"])
    rows = held.groupBy(*keys, "_start", "path").agg(merged(F.col("change")).alias("change"), F.count(F.lit(1)).alias("events"))
    return rows.select(*keys, F.timestamp_micros("_start").cast(dict(changes.dtypes)["ts"]).alias("start"), "path", "change", "events")


def sessions(changes: DataFrame, gap: str = DEBOUNCE, watermark: str = "10 seconds") -> DataFrame:
    """(start, found) of a stream: each session once it has ended, with the distinct paths and ranks of its changes."""
    rows = changes.withWatermark("ts", watermark).withColumn("rank", _rank(F.col("change")))
    one = F.pmod(F.hash("path"), F.lit(1)).alias("one")  # streams take no session without a key
    return rows.groupBy(one, F.session_window("ts", gap).alias("session")).agg(F.collect_set(F.struct("path", "rank")).alias("found")).select(F.col("session.start").alias("start"), "found")


def settled(batch: DataFrame) -> DataFrame:
    """(start, path, change) of ended sessions, by path: one change for each path."""
    return batch.select("start", F.inline("found")).groupBy("start", "path").agg(_named(F.max("rank")).alias("change")).orderBy("start", "path")


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = DEBOUNCE, watermark: str = "10 seconds", available_now: bool = True) -> StreamingQuery:
    """Runs ``apply`` on every batch of debounced changes. A stopped query resumes from its checkpoint: a pause loses no
    event, and a batch that failed is applied again, so ``apply`` must be idempotent, as snapshot writes are."""
    writer = sessions(changes, gap, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply(settled(df), n))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=gap)).start()


@dataclass
class Watcher:
    """Keeps a project at the state of its files. ``changed`` takes each batch of changes: it marks the project dirty and,
    unless a scan is under way or the watcher pauses, refreshes it until nothing is left. A pause remembers that changes
    came or may have been missed, and ``resume`` then scans again. ``idle`` pauses after ``idle_seconds`` without changes."""

    refresh: Callable[[], object]
    idle_seconds: float = 300.0
    clock: Callable[[], float] = time.monotonic
    paused: bool = False
    needs_resync: bool = False
    dirty: bool = False
    scanning: bool = False
    scans: int = 0
    last: float = field(default=0.0)

    def __post_init__(self):
        self.last = self.clock()

    def changed(self, batch: DataFrame | None = None, n: int = 0) -> None:
        if batch is not None and batch.isEmpty():
            return
        self.last, self.dirty = self.clock(), True
        if self.paused:
            self.needs_resync = True
        elif not self.scanning:
            self._drain()

    def _drain(self) -> None:
        while self.dirty and not self.paused:
            self.dirty, self.scanning = False, True
            try:
                self.refresh()
                self.scans += 1
            except Exception:
                self.dirty = True  # what was not taken up stays to be done
                raise
            finally:
                self.scanning = False

    def pause(self) -> None:
        self.paused = self.needs_resync = True

    def resume(self) -> None:
        self.paused = False
        self.last = self.clock()
        if self.needs_resync:
            self.needs_resync, self.dirty = False, True
            self._drain()

    def idle(self) -> bool:
        """To be called now and then: pauses if nothing has changed for long; whether it pauses."""
        if not self.paused and self.clock() - self.last >= self.idle_seconds:
            self.pause()
        return self.paused
