"""The committing sink: repeated micro-batches, failing tasks and deliveries that stop half-way."""

import json
import os
import shutil

import pyarrow as pa
import pytest

from trackwright.streaming import outbox as ob

ROWS = "video_id string, frame bigint, x double"


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/in/b{i:03}")
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def finish(query):
    assert query.awaitTermination(200)


def noting(folder, most=None):
    """A receiver that writes down each post, and refuses more than most as long as a file is there. Made here, as workers can't import tests."""

    def post(path, body, key):
        video = json.loads(body)["video_id"]
        os.makedirs(f"{folder}/posts", exist_ok=True)
        if os.path.exists(f"{folder}/refusing") and os.path.exists(f"{folder}/posts/log"):
            with open(f"{folder}/posts/log") as log:
                if len(log.readlines()) >= most:
                    return 503
        with open(f"{folder}/posts/log", "a") as log:
            log.write(json.dumps([video, [r["frame"] for r in json.loads(body)["data"]], key]) + "\n")
        return 200

    return post


def posts(folder):
    with open(f"{folder}/posts/log") as log:
        return sorted(json.loads(line)[:2] for line in log)


BATCHES = [[("a", 0, 1.0), ("b", 0, 2.0), ("a", 1, 3.0)], [("a", 2, 4.0)], [("c", 0, None), ("b", 1, 5.0)]]
WANTED = sorted([["a", [0, 1]], ["b", [0]], ["a", [2]], ["c", [0]], ["b", [1]]])


def give(spark, folder, post):
    return ob.deliver(spark, f"{folder}/out", ROWS, post, "steps", ["frame", "x"], ["frame"])


def test_each_result_is_posted_once(spark, tmp_path):
    finish(ob.write_outbox(stream(spark, tmp_path, BATCHES), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert sum(give(spark, tmp_path, noting(tmp_path)).values()) == 5
    assert give(spark, tmp_path, noting(tmp_path)) == {}
    assert posts(tmp_path) == WANTED


def test_a_repeated_micro_batch_counts_once(spark, tmp_path):
    rows = stream(spark, tmp_path, BATCHES)
    finish(ob.write_outbox(rows, f"{tmp_path}/out", f"{tmp_path}/cp"))
    before = sorted(os.listdir(f"{tmp_path}/out/rows"))
    # As if the stream had died before it noted that its last micro-batches were through.
    for name in os.listdir(f"{tmp_path}/cp/commits"):
        if name.strip(".").split(".")[0] in {"1", "2"}:
            os.remove(f"{tmp_path}/cp/commits/{name}")
    finish(ob.write_outbox(rows, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert sorted(os.listdir(f"{tmp_path}/out/rows")) == before
    give(spark, tmp_path, noting(tmp_path))
    assert posts(tmp_path) == WANTED


def test_a_delivery_that_stops_half_way_goes_on(spark, tmp_path):
    many = [(f"v{i}", 0, 1.0) for i in range(9)]
    finish(ob.write_outbox(stream(spark, tmp_path, [many]), f"{tmp_path}/out", f"{tmp_path}/cp"))
    (tmp_path / "refusing").write_text("")
    post = noting(tmp_path, most=2)
    with pytest.raises(Exception, match="503"):
        give(spark, tmp_path, post)
    assert len(posts(tmp_path)) == 2
    (tmp_path / "refusing").unlink()
    assert list(give(spark, tmp_path, post).values()) == [7]
    assert posts(tmp_path) == sorted([v, [0]] for v, _, _ in many)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    writer = ob.OutboxWriter(f"{tmp_path}/out")
    batch = pa.RecordBatch.from_pydict({"video_id": ["a"], "frame": [0], "x": [1.0]})
    first, none = writer.write(iter([batch])), writer.write(iter([]))
    assert none is None
    writer.abort([first, none], 0)
    assert os.listdir(f"{tmp_path}/out/rows") == []
    lost = writer.write(iter([batch, batch]))  # of a task whose answer never came
    again = writer.write(iter([batch]))
    writer.commit([again, None], 0)
    assert lost.rows == 2
    assert [tuple(r) for r in ob.committed(spark, f"{tmp_path}/out", ROWS, f"{0:012}").collect()] == [("a", 0, 1.0)]


def test_empty_batches_and_null_videos(spark, tmp_path):
    writer = ob.OutboxWriter(f"{tmp_path}/out")
    writer.commit([None], 0)
    writer.commit([writer.write(iter([pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([4]), pa.array([1.0])], ["video_id", "frame", "x"])]))], 1)
    assert list(give(spark, tmp_path, noting(tmp_path)).values()) == [0, 1]
    assert posts(tmp_path) == [[None, [4]]]
    shutil.rmtree(f"{tmp_path}/out")
    assert give(spark, tmp_path, noting(tmp_path)) == {}
