"""Runs a tracker over detections.

A tracker has step(frame, rows) -> list of output tuples, called once for each frame of a video in order; what it keeps between
calls is its state, which every tracker here bounds. In batch, rows are dealt by video, sorted, and read as a stream of Arrow
batches, so a long video never sits in memory as a whole. In Structured Streaming the same object is kept as the video's state.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Tracker(Protocol):
    def step(self, frame: int, rows: list[Any]) -> list[tuple]: ...


def _step(tracker: Tracker, rows: list[Any]) -> list[tuple]:
    """What the tracker gives for the rows of one frame."""
    frame = int(rows[0].frame)
    return [(frame, *out) for out in tracker.step(frame, rows)]


def _steps(tracker: Tracker, rows: Iterable[Any]) -> Iterator[tuple]:
    for _, group in groupby(rows, key=lambda r: r.frame):
        yield from _step(tracker, list(group))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def track(df: DataFrame, make: Callable[[], Tracker], schema: str, key: str = "video_id") -> DataFrame:
    """key, frame and what the tracker gives (schema) for every frame of every video. df has a row with det null for frames
    without detections, if the tracker is to see those."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "frame", *_names(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, tracker, held = None, None, []
        for batch in batches:
            out = []
            for value, row in zip(batch[key].tolist(), batch.itertuples(index=False), strict=True):
                if held and (value != video or row.frame != held[0].frame):
                    out += [(video, *x) for x in _step(tracker, held)]
                    held = []
                if value != video or tracker is None:
                    video, tracker = value, make()
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(video, *x) for x in _step(tracker, held)], columns=names)

    ordered = df.repartition(key).sortWithinPartitions(key, "frame", "det")
    return ordered.mapInPandas(run, f"{key} {kind}, frame bigint, {schema}")


def track_stream(df: DataFrame, make: Callable[[], Tracker], schema: str, key: str = "video_id", idle: str | None = None) -> DataFrame:
    """The same over a stream whose micro-batches bring each video's frames in order. A frame is whole within one micro-batch.

    idle, such as "30 minutes": the state of a video that brings nothing for so long is dropped, and the video starts anew if it
    comes again. Without it state is kept for ever.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "frame", *_names(schema)]
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else make()
        rows = [row for batch in batches for row in batch.itertuples(index=False)]
        rows.sort(key=lambda r: (r.frame, r.det))
        yield pd.DataFrame([(keys[0], *x) for x in _steps(tracker, rows)], columns=names)
        state.update((pickle.dumps(tracker),))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame bigint, {schema}", "tracker binary", "append", timeout)


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed their frames, and then gives them to the tracker frame by frame."""

    def __init__(self, make: Callable[[], Tracker], names: list[str], columns: list[str], event_time: str, idle: int | None):
        self.make, self.names, self.columns, self.event_time, self.idle = make, names, columns, event_time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "tracker binary, last bigint")
        self.waiting = handle.getMapState("waiting", "frame bigint", "at bigint, rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part[self.event_time].astype("datetime64[ms]").astype("int64")
            for frame, own in part.groupby("frame"):
                frame, new = int(frame), list(own[self.columns].itertuples(index=False, name=None))
                known = self.waiting.containsKey((frame,))
                due, held = self.waiting.getValue((frame,)) if known else (int(at[own.index].max()), pickle.dumps([]))
                self.waiting.updateValue((frame,), (due, pickle.dumps(pickle.loads(held) + new)))
                if not known:
                    self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= passed)
        if due:
            tracker, last = (pickle.loads(self.tracker.get()[0]), self.tracker.get()[1]) if self.tracker.exists() else (self.make(), 0)
            row = namedtuple("Row", self.columns)
            out = []
            for frame, (at, rows) in due:
                self.waiting.removeKey((frame,))
                own = sorted((row(*r) for r in pickle.loads(rows)), key=lambda r: (r.det is None or r.det != r.det, r.det))
                out += [(key[0], *x) for x in _steps(tracker, own)]
                last = max(last, at)
            self.tracker.update((cloudpickle.dumps(tracker), last))
            if self.idle is not None:
                self.handle.registerTimer(last + self.idle)
            if out:
                yield pd.DataFrame(out, columns=self.names)
        elif self.idle is not None and self.tracker.exists() and self.tracker.get()[1] + self.idle <= passed and not any(True for _ in self.waiting.keys()):
            self.tracker.clear()

    def close(self) -> None:
        pass


def track_in_order(
    df: DataFrame, make: Callable[[], Tracker], schema: str, event_time: str, late: str = "2 seconds", key: str = "video_id", idle: str | None = None
) -> DataFrame:
    """The tracks of a stream whose micro-batches may bring frames in any order and in parts.

    event_time: when a frame was taken. Rows wait in the video's state until the watermark, the latest event time less late, has passed
    their frame; then whole frames go to the tracker in order. A row that comes after its frame has gone is late: Spark drops and counts
    it (late_rows). idle, such as "30 minutes" of event time: the tracker of a video that brings nothing for so long is dropped. State
    lies in RocksDB (spark.sql.streaming.stateStore.providerClass), so what waits need not fit in memory.
    """
    names = [key, "frame", *_names(schema)]
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    columns = [c for c in df.columns if c not in (key, event_time)]
    kind = df.schema[key].dataType.simpleString()
    processor = _InOrder(make, names, columns, event_time, milliseconds)
    return df.withWatermark(event_time, late).groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, frame bigint, {schema}", "append", "eventTime")


def late_rows(progress: list[Any]) -> int:
    """Rows that a query's progress reports as dropped because they came too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
