"""Containers in SQL: table functions over binary columns.

    SELECT m.* FROM files, LATERAL container_members(path, content) m
    SELECT r.content FROM files, LATERAL container_read(content, 3) r
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.containers import read_container

LISTED = "idx bigint, name binary, type string, size bigint, mtime_seconds bigint, mode bigint, link_target binary, data_status string"


@udtf(returnType=LISTED)
class ContainerMembers:
    """A row a member, without its data."""

    def eval(self, path: str, content: bytes):
        for m in read_container(path or "", content or b"", {}, with_content=False):
            yield tuple(m[c.split()[0]] for c in LISTED.split(", "))


@udtf(returnType="name binary, content binary, data_status string")
class ContainerRead:
    """The data of one member, by ordinal."""

    def eval(self, content: bytes, idx: int):
        for m in read_container("", content or b"", {}, only=idx):
            if m["idx"] == idx:
                yield m["name"], m["content"], m["data_status"]
                return


def register(spark: SparkSession) -> None:
    spark.udtf.register("container_members", ContainerMembers)
    spark.udtf.register("container_read", ContainerRead)
