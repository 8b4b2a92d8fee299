"""Tables and files that a computation writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What this process has written to the shared folder and not deleted yet.
_written: set[str] = set()


def filesystem(uri: str):
    """The file system of a place, and the place in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes it
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one serves a local session; a cluster must name one."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(have)
    return have


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is written there is deleted when the process ends, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def make_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder."""
    path = work_path(spark, name)
    system, place = filesystem(path)
    system.create_dir(place, recursive=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: computed once, and lineage ends there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(paths: set[str]) -> None:
    """Deletes written tables and folders that nothing reads any more."""
    for path in sorted(paths & _written):
        _written.discard(path)
        try:
            system, place = filesystem(path)
            system.delete_dir(place)
        except OSError:  # never written, or gone already
            pass


@contextmanager
def scratch() -> Iterator[None]:
    """All that is written inside is deleted at the end: the results must have been written elsewhere by then."""
    before = set(_written)
    try:
        yield
    finally:
        discard(_written - before)


@atexit.register
def _clean() -> None:
    discard(set(_written))
