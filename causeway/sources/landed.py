"""Readers of landed provider payloads, as long observations (series, session, value), and rules of precedence.

Fetching is out of process: what lands is read here. Values that don't parse are null and dropped, never guessed.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OBSERVATIONS = "series string, session date, value double"
#: Fixed value: names whose values are secrets in an address.
SECRETS = r"(?i)\b(api_key|apikey|token)=[^&\s\"']*"


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "$1=***")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\W+", "_"), F.lit("_"))


def number(text: Column) -> Column:
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")


def day(text: Column) -> Column:
    return F.to_date(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def read_graph_csv(spark: SparkSession, path: str, series: str, start: str = "0001-01-01") -> DataFrame:
    """First column a date, last a value; a lone dot is a holiday."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(F.lit(series).alias("series"), day(F.col(raw.columns[0])).alias("session"), number(F.col(raw.columns[-1])).alias("value"))
    return out.where(F.col("session").isNotNull() & F.col("value").isNotNull() & (F.col("session") >= F.lit(start).cast("date")))


def read_wide_csv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A date column (its name holds "date") and values; names become slugs with the prefix."""
    import re

    raw = spark.read.option("header", True).csv(path)
    date = next(c for c in raw.columns if "date" in c.lower())
    named = {c: prefix + re.sub(r"\W+", "_", c.lower()).strip("_") for c in raw.columns if c != date}
    wide = raw.select(day(F.col(date)).alias("session"), *(number(F.col(c)).alias(n) for c, n in named.items())).where("session is not null")
    return wide.unpivot(["session"], list(named.values()), "series", "value").where("value is not null").select("series", "session", "value")


def read_observations_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    """{"observations": [{"date", "value"}]}"""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "observations array<struct<date:string,value:string>>")["observations"]).alias("o"))
    return rows.select(F.lit(series).alias("series"), day(F.col("o.date")).alias("session"), number(F.col("o.value")).alias("value")).where("session is not null and value is not null")


def read_chart_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    """Epoch seconds with adjusted closes where there are as many, else closes; the raw series is a second convention."""
    quote, adjusted = "quote:array<struct<close:array<double>>>", "adjclose:array<struct<adjclose:array<double>>>"
    schema = f"chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<{quote},{adjusted}>>>>"
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", schema)["chart"]["result"][0].alias("r"))
    r = r.select(F.col("r.timestamp").alias("t"), F.try_element_at("r.indicators.quote", F.lit(1))["close"].alias("close"), F.try_element_at("r.indicators.adjclose", F.lit(1))["adjclose"].alias("adj"))
    full = F.size("adj") == F.size("t")
    out = None
    for convention, values in (("adjusted", F.when(full, F.col("adj")).otherwise(F.col("close"))), ("raw", F.col("close"))):
        checked = F.when(F.size(values) == F.size("t"), values).otherwise(F.raise_error(F.lit("as many values as timestamps are needed")))
        one = r.select(F.explode(F.arrays_zip(F.col("t"), checked.alias("v"))).alias("z")).select(F.lit(series).alias("series"), F.lit(convention).alias("convention"), F.to_date(F.timestamp_seconds("z.t")).alias("session"), F.col("z.v").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.where("value is not null")


def read_trades_json(spark: SparkSession, path: str, series: str) -> DataFrame:
    """{"data": {"tradesTable": {"rows": [{"date", "close"}]}}} with currency signs and thousands separators."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "data struct<tradesTable:struct<rows:array<struct<date:string,close:string>>>>")["data"]["tradesTable"]["rows"]).alias("o"))
    return rows.select(F.lit(series).alias("series"), day(F.col("o.date")).alias("session"), number(F.col("o.close")).alias("value")).where("session is not null and value is not null")


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name = next(n for n in z.namelist() if n.lower().endswith((".csv", ".txt")))
                lines = z.read(name).decode("cp1252").splitlines()
            yield pd.DataFrame({"path": path, "n": range(len(lines)), "line": lines})


def read_factor_zip(spark: SparkSession, path: str) -> DataFrame:
    """The first contiguous block of lines that begin with eight digits, under the first line that begins with a comma; percents."""
    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_zipped, "path string, n int, line string")
    header = lines.where("line like ',%'").groupBy("path").agg(F.min_by("line", "n").alias("header"))
    rows = first_block(lines, F.col("line").rlike(r"^\s*\d{8}\s*,")).join(header, "path")
    cells = rows.select(F.split("line", ",").alias("c"), F.split("header", ",").alias("h"))
    long = cells.select(day(F.btrim(F.col("c")[0])).alias("session"), F.posexplode(F.slice("h", 2, F.size("h") - 1)).alias("k", "name"), "c")
    return long.select(slug(F.col("name")).alias("series"), "session", (number(F.try_element_at("c", F.col("k") + 2)) / 100).alias("value")).where("value is not null")


def first_block(lines: DataFrame, matches: Column) -> DataFrame:
    """Of each file, matching lines from the first one to the first that doesn't match after it."""
    w = W.partitionBy("path").orderBy("n")
    m = lines.withColumn("ok", F.coalesce(matches, F.lit(False)))
    m = m.withColumn("block", F.sum((F.col("ok") & ~F.coalesce(F.lag("ok").over(w), F.lit(False))).cast("int")).over(w))
    return m.where("ok and block = 1").drop("ok", "block")


def initial_release(rows: DataFrame) -> DataFrame:
    """series, observation_date, available, value -> for each day of availability, the latest observation."""
    return rows.groupBy("series", "available").agg(F.max_by("value", "observation_date").alias("value"), F.max("observation_date").alias("observation_date"))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that arrived last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def combine_first(primary: DataFrame, fallback: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cell by cell: the primary's value, else the fallback's."""
    a = primary.select(*keys, F.col(value).alias("_a"))
    b = fallback.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_a", "_b").alias(value))


def cascade(rows: DataFrame) -> DataFrame:
    """series, session, value, priority -> each series from the first provider that has any of it."""
    best = rows.groupBy("series").agg(F.min("priority").alias("priority"))
    return rows.join(best, ["series", "priority"], "left_semi")


def as_of(rows: DataFrame, cutoff: str, column: str = "session") -> DataFrame:
    return rows.where(F.col(column) <= F.lit(cutoff).cast("date"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the right value last known at its time.

    Both sides go through one window in time order, so a left row never meets all earlier right rows as pairs.
    """
    a = left.withColumns({"_t": F.col(left_time), "_v": F.lit(None).cast(dict(right.dtypes)[value]), "_left": F.lit(True)})
    b = right.select(*keys, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    w = W.partitionBy(*keys).orderBy("_t", "_left").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left").drop("_t", "_v", "_left")


def unavailable_keys(df: DataFrame, forbidden: tuple[str, ...]) -> list[str]:
    """Paths of forbidden field names anywhere in the schema."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path):
        if isinstance(kind, StructType):
            for f in kind.fields:
                here = f"{path}.{f.name}".lstrip(".")
                yield from [here] if f.name.lower() in forbidden else []
                yield from walk(f.dataType, here)
        elif isinstance(kind, ArrayType):
            yield from walk(kind.elementType, path)
        elif isinstance(kind, MapType):
            yield from walk(kind.valueType, path)

    return list(walk(df.schema, ""))
