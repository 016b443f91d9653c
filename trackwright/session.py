"""Session and path helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths given out inside passing_scratch; each thread or task has its own list.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="trackwright-")
    return "file://" + os.path.abspath(_own[app])


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trackwright-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder in the shared folder."""
    path = f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch paths given out inside, by this thread, go at the end, also if a step fails. Results must be complete by then and lie
    elsewhere, as in a table written to a path that was asked for before: a frame that is still to be computed may read scratch."""
    token = _passing.set([])
    try:
        yield
    finally:
        own = _passing.get() or []
        _passing.reset(token)
        for path in own:
            _delete(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch of this application. For the end of a session, or between queries whose results have been read."""
    _delete(spark, _scratch_root(spark))


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df below the shared folder and read it again: work done once, lineage cut, safe if executors go."""
    path = scratch(df.sparkSession, name)
    return written(df, path, **options)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """df written to path and read again."""
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """Like materialise, in as many buckets by a column as a shuffle has partitions: a join or grouping on it needs no shuffle of this side."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    own = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(compression="zstd", path=path).bucketBy(buckets, by).format("parquet").saveAsTable(own)
    return spark.table(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it. Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "trackwright"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
