"""Files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder URI below spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="corpusflow-")
            spark.sparkContext.setCheckpointDir(base)
    if base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/corpusflow-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside takes its shuffle files with it when it ends; else they stay until the driver happens to collect its garbage. The session's setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """df as a Parquet table in a fresh shared folder, read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of tables that df reads: of a written one that nothing reads any more."""
    remove({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def remove(folders: Iterable[str]) -> None:
    """Remove folders of files that nothing reads any more."""
    for uri in folders:
        store, path = fs.FileSystem.from_uri(uri)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def write_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write parts as they come under a private name, then rename, so that a repeated or killed task leaves whole files only."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(private) as out:
        for part in parts:
            out.write(part)
    store.move(private, path)


def appended(uri: str) -> pa.NativeFile:
    """A new file to write to as a task goes on."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def read_file(uri: str) -> memoryview:
    """The file's bytes; a local file is mapped, so that workers of one machine share its pages."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return memoryview(source.read_buffer())
    with store.open_input_file(path) as source:
        return memoryview(source.read_buffer())


def read_range(uri: str, at: int, size: int) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        source.seek(at)
        return source.read(size)
