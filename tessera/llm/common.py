"""What several operators share: table access, durable cuts of lineage, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; others are neither read nor able to clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all of Spark runs in this process."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not held.isDefined():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, and read by columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no plan still to run reads, and let Spark delete the shuffle files behind them."""
    delete(*tables)
    if tables:
        release(tables[0].sparkSession)


def delete(*tables: DataFrame) -> None:
    """Delete tables of written() that no plan still to run reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more; else they stay until the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def value_sizes(column: pa.Array) -> list[int]:
    """Bytes of each value of a column of any type."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
    return [column.slice(k, 1).nbytes for k in range(len(column))]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        if batch.column(i).nbytes <= limit or batch.num_rows == 1:
            yield batch
            continue
        sizes = value_sizes(batch.column(i))
        start = total = 0
        for k, n in enumerate(sizes):
            if k > start and total + n > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        yield batch.slice(start)


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Let Spark send Python at most ``size`` at a time, where the session still has Spark's own bound of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", None):
        spark.conf.set(key, size)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch of bounded size."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in pieces(batches, column):
            out = f(batch)
            yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, underscored until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text):
    """Number of words of a text column, as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
