"""Containers as they arrive: members of new files, in append mode.  Rows are independent, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.containers import members

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_members(spark: SparkSession, path: str, files_per_trigger: int = 1000, **options) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return members(stream.select("path", "content"), **options)
