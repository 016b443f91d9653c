"""Streams whose micro-batches bring frames out of order, in parts and too late."""

import random
from datetime import datetime, timedelta

import pytest

from trackwright.operators.tracking.runner import track
from trackwright.streaming.tracks import late_rows, stream_tracks_in_order

SCHEMA = "n bigint, total double, seen bigint"
ROWS = "video_id string, frame bigint, det bigint, x double, at timestamp"
START = datetime(2024, 1, 1)


def summing():
    """A tracker that depends on the order of all frames and on each frame's rows. Made here, as workers can't import tests."""

    class Summing:
        def __init__(self):
            self.total, self.seen = 0.0, 0

        def step(self, frame, rows):
            self.seen += 1
            self.total = 0.5 * self.total + sum((r.det + 1) * r.x for r in rows)
            return [(len(rows), self.total, self.seen)]

    return Summing


def row(video, frame, det):
    return (video, frame, det, float((frame * 7 + det * 3) % 11), START + timedelta(milliseconds=100 * frame))


def run(spark, folder, batches, **settings):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/in/b{i:03}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    out = stream_tracks_in_order(stream, summing(), SCHEMA, "at", **settings)
    query = out.writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return {tuple(r) for r in spark.table("ordered").collect()}, late_rows(query.recentProgress)


@pytest.fixture
def rows():
    return [row(v, f, d) for f in range(40) for v in ("a", "b") for d in range(1 + (f + (v == "b")) % 3)]


def batch_rows(spark, rows):
    frame = spark.createDataFrame(rows, ROWS).drop("at")
    return {tuple(r) for r in track(frame, summing(), SCHEMA).collect()}


def test_shuffled_and_split_frames_give_the_batch_rows(spark, tmp_path, rows):
    rnd = random.Random(4)
    # Rows come up to 1.5 seconds late, so frames mix over micro-batches and come in parts.
    shuffled = sorted(rows, key=lambda r: r[1] * 0.1 + rnd.random() * 1.5)
    cuts = [shuffled[i : i + 25] for i in range(0, len(shuffled), 25)]
    assert any(a[1] > b[1] for part in cuts for a, b in zip(part, part[1:], strict=False))
    end = [[row("end", 10_000, 0)], [row("end", 10_001, 0)]]  # moves the watermark past all frames
    got, late = run(spark, tmp_path, [*cuts, *end], late="2 seconds")
    assert {r for r in got if r[0] != "end"} == batch_rows(spark, rows)
    assert late == 0


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path, rows):
    early, rest = [r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20]
    late = [row("a", 3, 7), row("b", 5, 8), row("b", 5, 9)]
    end = [[row("end", 10_000, 0)], [row("end", 10_001, 0)]]
    got, dropped = run(spark, tmp_path, [early, rest, [row("a", 40, 0)], late, *end], late="1 second")
    assert {r for r in got if r[0] != "end"} == batch_rows(spark, [*rows, row("a", 40, 0)])
    assert dropped == 3


def test_idle_trackers_start_anew(spark, tmp_path):
    first, again = [row("a", f, 0) for f in range(5)], [row("a", f, 0) for f in range(1000, 1005)]
    others = [[row("end", f, 0)] for f in (100, 600, 900)]
    got, _ = run(spark, tmp_path, [first, *others, again, [row("end", 5000, 0)], [row("end", 5001, 0)]], late="1 second", idle="20 seconds")
    seen = {r[1]: r[4] for r in got if r[0] == "a"}
    assert [seen[f] for f in range(5)] == [1, 2, 3, 4, 5]
    assert [seen[f] for f in range(1000, 1005)] == [1, 2, 3, 4, 5]
