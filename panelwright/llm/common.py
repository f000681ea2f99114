"""What several of the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_dir  # noqa: F401  (cut: for the operators)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, smaller than a checkpoint; sweep() deletes such tables, at the latest when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(sweep)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sweep(*keep: DataFrame) -> None:
    """Delete what written() wrote in this process, but for the tables ``keep``; DataFrames over the others can't be read afterwards."""
    kept = [name.rsplit("/", 2)[-2] for df in keep for name in df.inputFiles()]
    for spark, path in list(_WRITTEN):
        if path.rsplit("/", 1)[-1] not in kept:
            _WRITTEN.remove((spark, path))
            if spark.sparkContext._jsc is not None:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(id_col: str, modulus: int, remainder: int):
    """True where crc32 of the id as text has that remainder; null ids count as ''."""
    digest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (digest % F.lit(modulus)) == F.lit(remainder)


#: Rows and bytes of an Arrow batch, on either side of a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BATCH_BYTES)}


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on its session sends texts to Python in batches of bounded size, where the user has set no other."""
    conf = df.sparkSession.conf
    for key, (default, ours) in _BATCHES.items():
        if conf.get(key, default) == default:
            conf.set(key, str(ours))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that Python objects of few texts are alive at a time.

    Spark keeps Python workers for later tasks; at the end what they hold
    without using it goes back to the system.
    """
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept_where(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows whose text (null: empty) the predicate keeps, all columns as they are; make() builds it once per task."""
    place = docs.columns.index(text_col)

    def keep(batches):
        test = make()
        for batch in sliced(batches):
            yield batch.filter(pa.array(test([t or "" for t in batch.column(place).to_pylist()]), pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)
