"""What the text operators share: shared storage, Arrow streaming, row identity and folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import reachable, shared_folder

#: Bytes of text in one Arrow batch handed to a Python worker.
ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that very long texts don't swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the batches of each partition; what it has freed goes back to the system, for workers live on after a task."""
    reachable(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo: the fold rule of the learned operators."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Stands for a null doc_id where ids are compared: an id below all others.
NO_ID = -(2**63)


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `_cw_id`, `_cw_row` and `_cw_text`: rows that agree in `_cw_id` and `_cw_row` have equal ids and texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_cw_id"), F.xxhash64(whole).alias("_cw_row"), whole.alias("_cw_text"))
