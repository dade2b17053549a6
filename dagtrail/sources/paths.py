"""Paths: directory checks, file listings, and the shared folder for data written on the way."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def require_directory(spark: SparkSession, path: str) -> str:
    """Return the path; raise if it is not an existing directory."""
    if not is_directory(spark, path):
        raise ValueError(f"not a directory: {path}")
    return path


def count_files(spark: SparkSession, path: str, file_glob: str = "*") -> int:
    """Files below a directory, empty ones too, by the listing that Spark makes for a scan."""
    require_directory(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return len(files.option("pathGlobFilter", file_glob).load(path).inputFiles())


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="dagtrail-")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, unique folder below the shared folder the cluster names.

    Only where `spark.checkpoint.dir` is unset, as in local runs, a folder of our own
    is made; the session's settings are left alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        base = _own_folder()
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for given in _noted:
        given.append(path)
    return path


# Folders given out, for each `removed_afterwards` that is under way.
_noted: list[list[str]] = []


@contextmanager
def removed_afterwards(spark: SparkSession) -> Iterator[None]:
    """Remove the shared folders given out meanwhile, also if the work on them fails."""
    given: list[str] = []
    _noted.append(given)
    try:
        yield
    finally:
        _noted.remove(given)
        for path in given:
            remove_folder(spark, path)


@contextmanager
def replaced_folder(spark: SparkSession, path: str) -> Iterator[str]:
    """Give a new folder beside `path` to write to, which takes its place once it is complete.

    If the work fails, the new folder goes and what lay at `path` stays as it was.
    """
    parent, slash, name = path.rstrip("/").rpartition("/")
    # scans pass over names with an underscore
    written, earlier = (f"{parent}{slash}_{name}-{uuid.uuid4().hex}" for _ in range(2))
    try:
        yield written
    except BaseException:
        remove_folder(spark, written)
        raise
    fs, target = _file_system(spark, path)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    replaces = fs.exists(target)
    if replaces and not fs.rename(target, to_path(earlier)):
        raise OSError(f"cannot move {path} away; the new report is at {written}")
    if not fs.rename(to_path(written), target):
        if replaces:
            fs.rename(to_path(earlier), target)
        raise OSError(f"cannot move {written} to {path}")
    remove_folder(spark, earlier)


def store_rows(df: DataFrame, label: str) -> DataFrame:
    """Write rows to a new table in the shared folder and go on from that table."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that `shared_folder` gave, if it is there."""
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)
