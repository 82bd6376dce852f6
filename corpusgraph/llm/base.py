"""What the operators share: reading tables, tables kept between steps, and the split of labels."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's Arrow batches small enough for texts of tens of KB, and of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one in local tests."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(_own[app])
    return _own[app]


def kept_table(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: lost executors cost only the tasks they ran, and steps that use the rows
    several times don't make them again. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusgraph-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            del jvm
        except Exception:  # the session has ended: nothing can be removed any more
            return


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of doc_id as text, mod 5, is the remainder. A null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def release_memory() -> None:
    """Give back to the system what this Python worker has freed. Workers are used again by later stages, and idle ones keep what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, which releases memory at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return run


def free_name(columns: list[str], name: str) -> str:
    """The name, or the first of name_1, name_2 ... that no column has (case aside, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow for columns of any names: work takes and gives the columns by place, in the order of df and of schema."""
    made = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, made.names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(tidied(placed), made).toDF(*schema.names)


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    """A schema with one more column (StructType.add would change the DataFrame's own)."""
    return T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
