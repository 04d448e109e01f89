"""Content hashes, revision chains and write-once archives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

CONTRACT = "2"
#: Columns that tell how a table was fetched rather than what it says.
VOLATILE = ("tick_lag_seconds", "quote_age_seconds", "received_at_utc", "logged_at_utc", "retrieved_at_utc", "exchange_time_utc", "implied_volatility", "delta", "underlying_price", "open_interest_attempt")
#: A row's hash is added up in so many parts of so many hexadecimal digits, each as a high and a low half of so many bits.
PARTS, DIGITS, HALF = 4, 15, 30


def content_hash(rows: DataFrame, ignore: tuple[str, ...] = (), by: str = "name") -> DataFrame:
    """One hash per name over columns, types and the multiset of rows.

    Where order matters the ordinal is a column like any other, so it is part of each row. Rows' hashes are added up in parts
    that are wide enough not to overflow at 10^17 rows: combined before the shuffle, with no order and no array of hashes.
    Each Arrow batch is added up in whole columns first, so decimals are made for batches rather than rows. Names are atomic values.
    """
    cols = sorted(c for c in rows.columns if c not in (*ignore, by))
    kinds = dict(rows.dtypes)
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else F.lit("{}")
    hashed = rows.select(by, F.unhex(F.sha2(text, 256)).alias("h"))
    halves = [f"{x}{k}" for k in range(PARTS) for x in ("high", "low")]
    added = hashed.mapInArrow(_added, StructType([hashed.schema[by], *(StructField(c, LongType()) for c in ("n", *halves))]))
    sums = added.groupBy(by).agg(F.sum("n").alias("rows"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in halves))
    part = lambda k: F.col(f"high{k}") * F.lit(1 << HALF).cast("decimal(10,0)") + F.col(f"low{k}")
    whole = F.concat_ws("|", F.lit(",".join(f"{c}:{kinds[c]}" for c in cols)), F.col("rows").cast("string"), *(part(k).cast("string") for k in range(PARTS)))
    return sums.select(by, F.sha2(whole, 256).alias("sha256"), "rows")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name and hash of 32 bytes -> for each name of a batch its rows and the sums of both halves of each part, which a bigint holds."""
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(1).cast(pa.binary(32))
        words = np.frombuffer(h.buffers()[1], ">u8", 4 * len(h), 32 * h.offset).astype("u8").reshape(-1, 4)
        parts = []
        for k in range(PARTS):
            i, shift = divmod(4 * DIGITS * k, 64)
            x = words[:, i] << shift | words[:, i + 1] >> 64 - shift if shift else words[:, i]
            x = x >> 64 - 4 * DIGITS
            parts += [(x >> HALF).astype("i8"), (x & (1 << HALF) - 1).astype("i8")]
        columns = [str(j) for j in range(len(parts))]
        sums = pa.table([b.column(0), *parts], names=["name", *columns]).group_by("name", use_threads=False).aggregate([([], "count_all"), *((c, "sum") for c in columns)])
        out = sums.select(["name", "count_all", *(f"{c}_sum" for c in columns)]).rename_columns([b.schema.names[0], "n", *(f"{x}{k}" for k in range(PARTS) for x in ("high", "low"))])
        yield from out.to_batches()


def snapshot_id(tables: DataFrame, session: str, config: str) -> DataFrame:
    """Session and twelve digits of a hash over contract, configuration and the sorted tables' hashes."""
    one = tables.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat_ws(":", x["name"], x["sha256"])), ",").alias("t"))
    return one.select(F.concat(F.lit(f"{session}-"), F.substring(F.sha2(F.concat_ws("|", F.lit(CONTRACT), F.lit(config), "t"), 256), 1, 12)).alias("snapshot_id"))


def latest(manifests: DataFrame) -> DataFrame:
    """The newest revision of each session and view as a whole row, and how many there are."""
    rest = [c for c in manifests.columns if c not in ("session", "view")]
    return manifests.groupBy("session", "view").agg(F.max_by(F.struct(*rest), "revision").alias("x"), F.count(F.lit(1)).alias("revisions")).select("session", "view", "x.*", "revisions")


def changed_tables(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Names whose hash differs, or that only one side has."""
    a = before.select(*keys, F.col("sha256").alias("was"))
    b = after.select(*keys, F.col("sha256").alias("now"))
    return a.join(b, keys, "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(*keys, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def with_revisions(snapshots: DataFrame) -> DataFrame:
    """session, view, created, snapshot_id -> revision numbers and what each supersedes; repeated content is the same revision."""
    first = snapshots.groupBy("session", "view", "snapshot_id").agg(F.min("created").alias("created"))
    w = W.partitionBy("session", "view").orderBy("created", "snapshot_id")
    return first.withColumns({"revision": F.row_number().over(w), "supersedes": F.lag("snapshot_id").over(w)})


def write_once(df: DataFrame, path: str) -> bool:
    """Write where nothing is; the same content again is no change, other content an error.

    The table is written beside its place and renamed into it, so of two writers at once one finds the other's.
    """
    import uuid

    spark: SparkSession = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        df.write.mode("errorifexists").parquet(part.toString())
        if not fs.exists(place) and fs.rename(part, place):
            return True
        fs.delete(part, True)
    old = spark.read.parquet(path)
    if old.exceptAll(df).limit(1).count() or df.exceptAll(old).limit(1).count():
        raise ValueError(f"{path} holds other content")
    return False
