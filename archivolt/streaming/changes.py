"""File changes as a stream: the last event of a path, debouncing, and what each change came to.

The event-time watermark only bounds the state that is kept; the census itself has
no notion of late data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.globs import denied_by


def last_events(events: DataFrame, key: str = "path", at: str = "ts", what: str = "event", tie: str = "event_id") -> DataFrame:
    """key, event, ts: the last event of each key; of equal instants the one of the greatest ``tie``."""
    order = F.struct(at, tie)
    return events.groupBy(key).agg(F.max_by(what, order).alias("event"), F.max(at).alias("ts"))


def settled_sessions(events: DataFrame, gap_seconds: int = 3, key: str = "path", at: str = "ts") -> DataFrame:
    """key, first, last, events: bursts of events of a key with no pause longer than ``gap_seconds``; a burst settles that long after its last event."""
    order = Window.partitionBy(key).orderBy(at)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(order)
    rows = events.select(key, at, (F.coalesce(pause, F.lit(1 << 60)) > gap_seconds * 1_000_000).cast("int").alias("__new"))
    rows = rows.withColumn("__burst", F.sum("__new").over(order))
    return rows.groupBy(key, "__burst").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events")).drop("__burst")


def session_bursts(events: DataFrame, gap: str = "3 seconds", key: str = "path", at: str = "ts") -> DataFrame:
    """The same bursts by Spark's session windows, in a batch or on a stream."""
    rows = events.groupBy(key, F.session_window(at, gap)).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events"))
    return rows.drop("session_window")


def _debounce(gap_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, event, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), event, n)], columns=["path", "first", "last", "event", "events"])
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        held = state.get if state.exists else None
        for at, event in zip(rows["ts"], rows["event"]):
            us = int(pd.Timestamp(at).value // 1000)
            if held is not None and us - held[1] > gap_ms * 1000:
                out.append((key[0], pd.Timestamp(held[0], unit="us"), pd.Timestamp(held[1], unit="us"), held[2], held[3]))
                held = None
            held = (us, us, event, 1) if held is None else (held[0], max(us, held[1]), event, held[3] + 1)
        state.update(held)
        state.setTimeoutTimestamp(max(held[1] // 1000 + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "first", "last", "event", "events"])

    return run


def debounced(stream: DataFrame, gap_seconds: int = 3, late: str = "10 seconds") -> DataFrame:
    """path, first, last, event, events of each burst on a stream (path, ts, event), once it has been quiet for the gap."""
    rows = stream.withWatermark("ts", late).groupBy("path")
    return rows.applyInPandasWithState(_debounce(gap_seconds * 1000), "path string, first timestamp, last timestamp, event string, events long", "first long, last long, event string, events long", "append", GroupStateTimeout.EventTimeTimeout)


def moved(events: DataFrame) -> DataFrame:
    """path, event, ts, event_id: a move counts as a deletion of its source and a change of its destination (dest_path)."""
    both = F.array(
        F.struct(F.col("path").alias("path"), F.when(F.col("dest_path").isNotNull(), "deleted").otherwise(F.col("event")).alias("event")),
        F.struct(F.col("dest_path").alias("path"), F.lit("modified").alias("event")),
    )
    return events.select("ts", "event_id", F.explode(both).alias("c")).select("c.path", "c.event", "ts", "event_id").filter("path IS NOT NULL")


def change_outcomes(changes: DataFrame, census: DataFrame, known_hashes: DataFrame, most_bytes: int = 104_857_600) -> DataFrame:
    """path, outcome of each change (path, event, route, size, mtime, hash) against the census (path, size, mtime, hash):
    deleted, ignored, too_large, unreadable, unchanged, known_hash or extract."""
    old = census.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    seen = known_hashes.select("hash", F.lit(True).alias("__known")).dropna().dropDuplicates(["hash"])
    rows = changes.join(old, "path", "left").join(seen, "hash", "left")
    outcome = (
        F.when(F.col("event") == "deleted", "deleted")
        .when(F.col("route") == "skip", "ignored")
        .when(F.col("size") > most_bytes, "too_large")
        .when((F.col("__size") == F.col("size")) & (F.col("__mtime") == F.col("mtime")), "unchanged")
        .when(F.col("hash").isNull(), "unreadable")
        .when(F.col("__known"), "known_hash")
        .otherwise("extract")
    )
    return rows.select("path", outcome.alias("outcome"))


class Watched:
    """What a change job has done: batches, paths handed on, paths kept out by the deny list, and batches that failed with their errors."""

    def __init__(self) -> None:
        self.batches = self.paths = self.denied = 0
        self.failed: list[tuple[int, str]] = []


def watch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, most_paths: int = 5000, seconds: float | None = 1.0, deny: Sequence[str] = (), watched: Watched | None = None):
    """Start the change job: each micro-batch's settled paths that no glob of ``deny`` keeps out go to ``handle(rows,
    part)``, the oldest first, in parts of about ``most_paths`` at a time; none is dropped. A part that fails is
    recorded in ``watched`` and does not stop the job. With ``seconds`` None what is there is processed once."""
    watched = watched or Watched()

    def each(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            kept = rows.filter(denied_by(F.col("path"), deny).isNull()) if deny else rows
            count, all_ = kept.count(), rows.count()
            watched.batches += 1
            watched.denied += all_ - count
            parts = max(1, -(-count // most_paths))
            # parts by time: the bounds are a few quantiles of the paths' last events
            bounds = kept.select(F.unix_micros("last").alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
            at = F.unix_micros("last").cast("double")
            edges = [None, *sorted(set(bounds)), None]
            for low, high in zip(edges[:-1], edges[1:]):
                part = kept if low is None else kept.filter(at > low)
                part = part if high is None else part.filter(at <= high)
                try:
                    handle(part.orderBy("last", "path"), batch)
                    watched.paths += part.count()
                except Exception as e:  # one bad part must not stop the watch
                    watched.failed.append((batch, repr(e)))
        finally:
            rows.unpersist()

    writer = debounced(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
