"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does exactly that where every character is one byte, and is much faster than
    ``translate``; other texts take the character map.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset a local session (tests, notebooks) gets a temporary folder, which is removed when the
    process ends; a cluster is refused, since its executors share no temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="repolith-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that nothing reads any more, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_root(df.sparkSession)
    return df.checkpoint()


class Kept:
    """A result that is written to the shared folder as Parquet and can be removed once nothing needs it any more.

    Like a checkpoint it cuts the lineage and outlives executors; it is compressed, and goes when it is told to.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.folder = shared_folder(self.spark, name)
        df.write.parquet(self.folder)
        # with the schema told, as an empty result may leave no file to read it from
        self.frame = self.spark.read.schema(df.schema).parquet(self.folder)

    def remove(self) -> None:
        remove_folder(self.spark, self.folder)


def release_shuffles(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, as executors keep the files of shuffles until the driver has forgotten these."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch that become Python objects at a time.
SLICE_ROWS = 256


def text_slices(batch: pa.RecordBatch, column: int = 1, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of a few hundred rows, each with the texts of a column; null texts come empty."""
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches; what it held is given back once it has ended and let go of it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget:
            forget()
        release_memory()

    return whole


def release_memory() -> None:
    """Gives freed memory back when a task ends: workers are reused, and an idle one keeps what it had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
