"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.  ``bytes.split()`` splits on exactly these.
#: ALNUM maps A-Z to lower case and every byte outside 0-9, a-z and 0x80-0xFF to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
M64 = (1 << 64) - 1


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of digits, ASCII letters and non-ASCII characters."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return [] if not text else text.encode("utf-8", "surrogatepass").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives a finished task's memory back: workers wait for later tasks, and several may wait beside one another."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows of an Arrow batch on its way to Python, where the session leaves Spark's default: batches of long texts stay small.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to batches of BATCH_ROWS rows.  JVM and Python each hold a batch or two a task."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow over dictionaries of columns.  f gets ``{name: list}`` batches, yields such batches."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def cut():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield b.slice(at, rows).to_pydict()

        for out in f(cut()):
            yield pa.RecordBatch.from_pydict(out, schema=target)
        tidy()

    return small_batches(df).mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.  One of this machine will do only where all tasks run in it."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="holdfast-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    # Shuffle files of finished steps go when the driver's JVM collects what referred to them; many small steps would pile up.
    spark.sparkContext._jvm.System.gc()
    return out


FLAT = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def flat_table(columns: dict, ddl: str) -> pa.Table:
    """An Arrow table of a DDL string with plain types (workers have no session that could parse it)."""
    return pa.Table.from_pydict(columns, schema=pa.schema([(n, FLAT[t]) for n, t in map(str.split, ddl.split(","))]))


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: one narrow aggregate, used only to size partitions."""
    n, b = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return n or 0, b or 0


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))
