"""Shared helpers of the corpus operators: table access, shared scratch space, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch handed to a Python worker; bounds a worker's memory whatever the rows hold.
BATCH_BYTES = 2 << 20
#: Rows that a Parquet reader decodes at once: the texts of all of them lie in one array, which grows by doubling.
BATCH_ROWS = 256
#: Bytes of a frame's rows up to which it is broadcast.
SMALL = 32 << 20
#: Values that a Memo holds at most.
MEMO = 1 << 16


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that very long texts or packed blocks cannot pile up in a worker, and the rows that
    Parquet readers decode at once, so that they ask for no arrays of tens of MB, for which an executor's heap would grow."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset and Spark
    runs in one process (tests). On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage is cut and the rows survive the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small frames of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes as a row in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16).cast("long"), lambda s, x: s + _bytes(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A hint to broadcast the frame where its rows are measured to be small together (in bytes); beyond that it is shuffled."""
    held = df.agg(F.sum(sum((_bytes(F.col(f.name), f.dataType) for f in df.schema), F.lit(16)))).first()[0]
    return F.broadcast(df) if (held or 0) <= most else df


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null counts as the empty text."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def batches(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Memo(dict):
    """A function's values by argument; forgets all of them beyond MEMO, so that it cannot fill a worker's memory."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        self[key] = x = self.function(key)
        return x


def in_fold(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id written as text leaves this remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, so that extra columns cannot clash with internal ones."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


Batches = Iterator[pa.RecordBatch]
