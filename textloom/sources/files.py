"""Readers and writers beside Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line, by an explicit schema; a broken line fails instead of becoming nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without blanks and comments (#); column ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where(~F.col("value").rlike(r"^\s*(#|$)"))


def read_first_words(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each such line, as lists of ids to leave out are kept."""
    return read_lines(spark, path).select(F.split("value", r"\s+")[0].alias("value"))


def layout(spark: SparkSession, path: str) -> DataFrame:
    """File, rows and bytes of a Parquet folder; reads no column."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    return files.groupBy("file_path", "file_size").agg(F.count("*").alias("n_rows"))


def write_parquet(df: DataFrame, path: str, files: int) -> None:
    """K1: a fixed number of files, dealt round robin."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def write_sorted(df: DataFrame, path: str, key: str, files: int) -> None:
    """K8: range-partitioned and sorted by ``key``, so that a lookup reads the few row groups whose
    minimum and maximum admit it."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """K3: UTF-8 without ASCII escapes; committed task by task, nulls left out."""
    df.write.mode("overwrite").json(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Appends only the rows whose key the Parquet folder lacks, and returns their number; run
    again after a crash it goes on where it stopped. Rows that repeat a key within ``df`` count once."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    before = 0
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        have = spark.read.schema(df.schema).parquet(path).select(key)
        before, fresh = have.count(), fresh.join(have, key, "left_anti").select(*df.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path).count() - before


def differing_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """K9: keys whose rows are not the same on both sides, all columns compared, nulls equal."""
    right = right.select(*left.columns)
    return left.exceptAll(right).unionByName(right.exceptAll(left)).select(key).distinct()
