"""``spark.read.format("container")``: one partition a file of a local or mounted path; and the writing side.

Options: access (random, sequential), codec (auto, none or a name), password, withContent, mode (permissive, failfast), and the
six caps by name.  For object stores use holdfast.operators.containers.files with members, which reads through Spark.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import fields

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.status import ContainerError
from .containers import WRITERS, read_container, write_container
from .member import MEMBER, Limits


def _limits(options) -> Limits:
    return Limits(**{f.name: int(options[f.name]) for f in fields(Limits) if f.name in options})


class ContainerDataSource(DataSource):
    @classmethod
    def name(cls):
        return "container"

    def schema(self):
        return MEMBER

    def reader(self, schema: StructType):
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        return Writer(dict(self.options), schema.names, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        path = self.options["path"].removeprefix("file://")
        found = sorted(p for p in (glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p))
        if not found:
            raise ContainerError("NOT_FOUND", path)
        return [InputPartition(p) for p in found]

    def read(self, partition):
        o, container = self.options, {}
        with open(partition.value, "rb") as f:
            data = f.read()
        for row in read_container(
            partition.value, data, container, _limits(o), o.get("access", "random"), o.get("codec", "auto"), o.get("password"), o.get("withcontent", o.get("withContent", "true")).lower() == "true"
        ):
            row.pop("data_carried", None)
            yield _typed(row)
        if o.get("mode") == "failfast" and container["status"] != "END":
            raise ContainerError(container["status"], partition.value)


ORDER = (
    "path", "idx", "name", "name_encoding", "link_target", "type", "size", "stored_size", "size_unknown", "sparse", "sparse_map", "mtime_seconds", "mtime_ns", "mtime_source", "mode", "uid", "gid", "uname",
    "gname", "device_major", "device_minor", "header_offset", "tar", "zip", "sevenz", "data_status", "content",
)


def _typed(row: dict) -> tuple:
    return tuple(row[c] for c in ORDER)


#: Options of the writing side.
WRITE_OPTIONS = {"path", "container", "codec", "method", "variant"}


class Writer(DataSourceWriter):
    """Each task's rows become one container, named by the job and its partition; a temporary file is renamed at commit.

    append leaves earlier files alone; overwrite removes, at commit, the containers that were there before.
    """

    def __init__(self, options, names, overwrite: bool = False):
        if unknown := set(options) - WRITE_OPTIONS:
            raise ContainerError("INVALID", f"unknown options {sorted(unknown)}")
        if options.get("container", "tar") not in WRITERS:
            raise ContainerError("UNSUPPORTED", options["container"])
        if "name" not in names:
            raise ContainerError("INVALID", "rows need a name")
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        self.path, self.kind = options["path"].removeprefix("file://"), options.get("container", "tar")

    def write(self, iterator):
        from pyspark import TaskContext

        o, count = self.options, 0

        def rows():
            nonlocal count
            for r in iterator:
                m = r.asDict()
                count += 1
                yield m, bytes(m.pop("content", None) or b"")

        os.makedirs(self.path, exist_ok=True)
        data = write_container(self.kind, rows(), o.get("codec"), **{k: o[k] for k in ("method", "variant") if k in o})
        task = TaskContext.get()
        temporary = os.path.join(self.path, f".part-{self.job}-{task.partitionId():05d}.{task.taskAttemptId()}")
        with open(temporary, "wb") as f:
            f.write(data)
        return Written(temporary, os.path.join(self.path, f"part-{task.partitionId():05d}-{self.job}.{self.kind}"), count)

    def commit(self, messages):
        before = glob.glob(os.path.join(glob.escape(self.path), "part-*")) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)
        for name in before:
            os.remove(name)
        self._tidy()

    def abort(self, messages):
        self._tidy()

    def _tidy(self) -> None:
        """Files of this job's failed or doubled attempts."""
        for name in glob.glob(os.path.join(glob.escape(self.path), f".part-{self.job}-*")):
            os.remove(name)


class Written(WriterCommitMessage):
    def __init__(self, temporary, final, count):
        self.temporary, self.final, self.count = temporary, final, count
