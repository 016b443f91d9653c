"""A streaming sink that commits: rows of a micro-batch count once, however often it is run, and each result is posted once.

Tasks write their rows to files of their own below the outbox folder. When all have, the driver writes one manifest for the micro-batch, which
names these files; a micro-batch that comes again finds its manifest and its new files go. deliver() then posts what the manifests name, from
tasks, and leaves a mark for each payload that was taken, so that a delivery that failed half-way goes on where it stopped.

A task that dies between the answer and its mark posts again; each post carries a key that stays the same, by which the receiver can tell.
Files of tasks that failed are named by no manifest and are never read. The folder is one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..sources.detections import SendError, payloads


def _folder(where: str):
    """A file system and a path in it. A folder without a scheme is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(where if "://" in where else f"file://{where}")


def _exists(where: str) -> bool:
    system, path = _folder(where)
    return system.get_file_info(path).type.name != "NotFound"


def _put(where: str, text: str) -> None:
    """Write a file as a whole: it is written beside and then moved."""
    system, path = _folder(where)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(text.encode())
    system.move(beside, path)


def _get(where: str) -> str:
    system, path = _folder(where)
    with system.open_input_stream(path) as file:
        return file.read().decode()


def _names(where: str) -> list[str]:
    from pyarrow import fs

    system, path = _folder(where)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if "." not in f.base_name)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class OutboxWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged | None:
        import pyarrow.parquet as pq

        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        system, path = _folder(f"{self.folder}/rows/{name}")
        for batch in iterator:
            if out is None:
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = pq.ParquetWriter(path, batch.schema, filesystem=system, compression="zstd")
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return None
        out.close()
        return Staged(name, rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        files = [m for m in messages if m is not None]
        manifest = f"{self.folder}/batches/{batchId:012}"
        if _exists(manifest):
            named = set(json.loads(_get(manifest))["files"])
            self._remove([m for m in files if m.file not in named])
        else:
            _put(manifest, json.dumps({"files": [m.file for m in files], "rows": sum(m.rows for m in files)}))

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._remove([m for m in messages if m is not None])

    def _remove(self, files: list[Staged]) -> None:
        for m in files:
            system, path = _folder(f"{self.folder}/rows/{m.file}")
            if system.get_file_info(path).type.name != "NotFound":
                system.delete_file(path)


class Outbox(DataSource):
    """Format "outbox" of writeStream; option folder."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> OutboxWriter:  # noqa: N802
        return OutboxWriter(self.options["folder"].rstrip("/"))


def write_outbox(rows: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write a stream to the outbox; every, such as "10 seconds", sets how often there is a micro-batch."""
    rows.sparkSession.dataSource.register(Outbox)
    writer = rows.writeStream.format("outbox").option("folder", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def committed(spark: SparkSession, folder: str, schema: T.StructType | str, batch: str) -> DataFrame:
    """The rows of one committed micro-batch."""
    files = json.loads(_get(f"{folder}/batches/{batch}"))["files"]
    paths = [f"{folder if '://' in folder else f'file://{folder}'}/rows/{name}" for name in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def deliver(
    spark: SparkSession, folder: str, schema: T.StructType | str, post: Callable[[str, str, str], int], path: str, columns: list[str], order: list[str]
) -> dict[str, int]:
    """Post each video's rows of each committed micro-batch that has not been delivered, oldest first: post(path, body, key) gives the HTTP
    status. Returns how many payloads of each were posted now. A status but 200 fails; call again to go on. One deliverer at a time."""
    folder = folder.rstrip("/")
    done, counts = set(_names(f"{folder}/delivered")), {}

    def of(batch: str) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for part in batches:
                new = 0
                for video_id, _, body in part.itertuples(index=False):
                    name = video_id if isinstance(video_id, str) else None if pd.isna(video_id) else int(video_id)
                    key = hashlib.sha256(json.dumps([path, batch, name]).encode()).hexdigest()
                    mark = f"{folder}/posted/{batch}/{key}"
                    if _exists(mark):
                        continue
                    status = post(path, json.dumps({"video_id": name, "data": json.loads(body)}), key)
                    if status != 200:
                        raise SendError(f"{path}: status {status}")
                    _put(mark, "")
                    new += 1
                yield pd.DataFrame({"new": [new]})

        return run

    for batch in _names(f"{folder}/batches"):  # one for each micro-batch since the outbox was begun
        if batch not in done:
            ready = payloads(committed(spark, folder, schema, batch), columns, order)
            counts[batch] = ready.mapInPandas(of(batch), "new long").groupBy().sum("new").collect()[0][0] or 0
            _put(f"{folder}/delivered/{batch}", "")
    return counts
