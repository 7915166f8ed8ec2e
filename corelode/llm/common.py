"""Shared plumbing: shipping the package, the shared scratch folder and written tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, through Spark's file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{root.name}-src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


@functools.lru_cache(maxsize=None)
def _own_folder(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a folder of its own; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(batches: Iterator) -> Iterator:
    """``batches``; at their end the worker, which later stages use again, gives the memory that it has freed back."""
    import ctypes

    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int) -> None:
    """From now on the session's Arrow batches have at most ``rows`` rows, so that neither side holds many whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def byte_texts(column) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow string column; null gives empty bytes."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def gathered(rows: DataFrame, task, size: int, slices: int = 16):
    """Element-wise sum over all tasks of the vectors of ``size`` numbers that ``task`` makes of Arrow batches.

    Tasks tell their vector in slices, which are summed by a shuffle; the driver gets ``size`` numbers.
    """
    import numpy as np

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for k, piece in enumerate(np.array_split(task(batches), slices)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.astype(np.float64).tobytes()])], names=["slice", "sums"])

    def summed(key, table):
        import pyarrow as pa

        total = sum(np.frombuffer(v) for v in table.column("sums").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()])})

    found = rows.mapInArrow(told, "slice int, sums binary").groupBy("slice").applyInArrow(summed, "slice int, sums binary").collect()
    pieces = np.array_split(np.zeros(size), slices)
    for r in found:
        pieces[r[0]] = np.frombuffer(r[1])
    return np.concatenate(pieces)
