"""What a run leaves behind: tables, findings, the report in two languages, and JSON for programs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from causeway.plans import report


def flat(df: DataFrame) -> DataFrame:
    """Columns that CSV can hold: structs as one column for each field, arrays and maps as JSON."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StructType):
            out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        elif isinstance(f.dataType, (ArrayType, MapType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_tables(spark: SparkSession, root: str, frames: Mapping[str, DataFrame], csv: Sequence[str] = (), records: Sequence[str] = ()) -> DataFrame:
    """name, format, rows of what was written. An empty table isn't; those in `csv` are written as CSV too, those in `records` as JSON."""
    rows = []
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
        kept = spark.read.schema(df.schema).parquet(f"{root}/{name}.parquet")
        n = kept.count()
        if not n:
            _remove(spark, f"{root}/{name}.parquet")
            continue
        rows.append((name, "parquet", n))
        if name in csv:
            flat(kept).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}.csv")
            rows.append((name, "csv", n))
        if name in records:
            kept.coalesce(1).write.mode("overwrite").json(f"{root}/{name}.json")
            rows.append((name, "json", n))
    return spark.createDataFrame(rows, "name string, format string, rows bigint")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the file system that the path names."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_report(spark: SparkSession, root: str, built: Mapping[str, Any], title: str) -> list[str]:
    """The report as JSON and, in each language, as markdown and HTML."""
    files = {"report.json": json.dumps(built, ensure_ascii=False, indent=2, default=str)}
    for language in report.TITLES:
        files[f"report.{language}.md"] = report.markdown(dict(built), language)
        files[f"report.{language}.html"] = report.page(dict(built), title, language)
    for name, text in files.items():
        write_text(spark, f"{root}/{name}", text)
    return sorted(files)


def run_folder(root: str, session: str, clock: str, offline: bool = False) -> str:
    """A folder of its own for each run; runs on fixtures share one."""
    return f"{root}/offline" if offline else f"{root}/{session}-{clock}"
