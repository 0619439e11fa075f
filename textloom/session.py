"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "textloom", cores: str = "8") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a session on one
    machine (tests, benches) gets a folder of its own, which goes when the process ends; any other session
    is refused, as its executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textloom.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset, and master {master} has no other folder that all executors share")
        made = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = "file://" + made
        spark.conf.set("textloom.shared.dir", found)
    return found.rstrip("/")


#: Paths handed out, in order, until they are removed.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within it leaves no shuffle files; else they stay until the driver happens to collect
    its garbage, and a long query holds all that it ever moved. Spark before 4.1 does not know the setting."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, keep: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back. Survives the loss
    of any executor, as nothing is kept on one, and what was shuffled for it goes. The path is put on
    ``keep``, for what outlives a scratch."""
    path = fresh_path(df.sparkSession, label)
    if keep is not None:
        keep.append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        if path in _MADE:
            _MADE.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end every intermediate made within it, but for the paths put on the list it gives.
    What is lazy must have been written by then."""
    before, keep = len(_MADE), []
    try:
        yield keep
    finally:
        remove(spark, [p for p in _MADE[before:] if p not in keep])


def clean(spark: SparkSession) -> None:
    """Removes all that this process has left in the shared folder; for when the results are consumed."""
    remove(spark, list(_MADE))
