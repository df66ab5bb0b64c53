"""Small helpers that several operators use: shared tables, batches of texts, the fold rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a Python worker holds as objects at once.
SLICE_BYTES = 8 << 20
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only for a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='scoreloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/scoreloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, with no lineage to lose."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it (names ignore case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def rows_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of ``batch`` with the values of ``column`` (null: empty), about ``SLICE_BYTES`` each."""
    texts = batch.column(column)
    empty = b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else ""
    step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, texts.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step), [empty if t is None else t for t in texts.slice(at, step).to_pylist()]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches have at most so many rows meanwhile: their buffers are outside of the heap and grow with the texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the fifth of the ids that fitting never sees: crc32(id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))
