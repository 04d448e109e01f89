"""Loading of many series: a cache with a stale fallback, alternatives for each series, and a manifest of what happened.

A failure of one series is a manifest row, never the end of the run. Transport is a function the caller gives, so that the
rules of the cache and of precedence don't depend on a network.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.landed import OBSERVATIONS, redact

MANIFEST = "dataset string, provider string, status string, rows bigint, earliest date, latest date, error string"


def cache_name(url: str, name: str | None = None) -> str:
    return name or hashlib.sha256(url.encode()).hexdigest()[:20] + ".bin"


@dataclass(frozen=True)
class Fetched:
    path: str
    status: str  # cache_fresh, network or cache_stale
    error: str | None = None


def fetch(get: Callable[[str], bytes], url: str, folder: str, name: str | None = None, max_age_seconds: float = 86_400.0, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> Fetched:
    """A landed file of the address: a fresh one as it is, else fetched and put in place at once, else a stale one with the error.

    Driver-side, for landing raw bytes only; what reads them is Spark. OSError is what a transport raises.
    """
    path = os.path.join(folder, cache_name(url, name))
    if os.path.exists(path) and time.time() - os.path.getmtime(path) <= max_age_seconds:
        return Fetched(path, "cache_fresh")
    failure: OSError | None = None
    for k in range(tries):
        try:
            body = get(url)
            break
        except OSError as e:
            failure = e
            wait(2.0**k)
    else:
        if os.path.exists(path):
            return Fetched(path, "cache_stale", str(failure))
        raise failure or OSError(f"nothing fetched from {url}")
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, path)
    return Fetched(path, "network")


Reader = Callable[[], DataFrame]


def load_series(spark: SparkSession, wanted: dict[str, Sequence[tuple[str, Reader]]]) -> tuple[DataFrame, DataFrame]:
    """dataset -> its providers in order of preference -> (observations, manifest).

    The first provider that gives rows wins; the errors of those before it stand in the row of the one that worked, and a
    dataset without any is a failed row. Readers are a configuration of dozens, so they are tried one by one.
    """
    parts: list[DataFrame] = []
    rows: list[tuple] = []
    for dataset, providers in wanted.items():
        errors: list[str] = []
        for provider, read in providers:
            try:
                df = read().select("series", "session", "value").where("value is not null")
                span = df.agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("a"), F.max("session").alias("b")).first()
                if not span["n"]:
                    raise ValueError("no rows")
            except (OSError, ValueError, PySparkException) as e:
                errors.append(f"{provider}: {str(e).splitlines()[0]}")
                continue
            parts.append(df)
            rows.append((dataset, provider, "ok", span["n"], span["a"], span["b"], "; ".join(errors) or None))
            break
        else:
            rows.append((dataset, ",".join(p for p, _ in providers), "failed", 0, None, None, "; ".join(errors) or "no provider"))
    out = spark.createDataFrame([], OBSERVATIONS)
    for p in parts:
        out = out.unionByName(p)
    manifest = spark.createDataFrame(rows, MANIFEST)
    return out, manifest.withColumn("error", redact(F.col("error")))


def combined_factors(files: Sequence[tuple[str, DataFrame]], whole: str = "five_factors") -> DataFrame:
    """Factor files in order: of the one named `whole` all series, of others the first one under the file's name; of a series
    that several files have, the first file's."""
    parts = []
    for rank, (name, df) in enumerate(files):
        if name != whole:
            only = df.agg(F.min("series").alias("series")).first()["series"] if "k" not in df.columns else None
            df = df.where("k = 0") if only is None else df.where(F.col("series") == only)
            df = df.withColumn("series", F.lit(name))
        parts.append(df.select("series", "session", "value").withColumn("rank", F.lit(rank)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("series").agg(F.min("rank").alias("rank"))
    return every.join(best, ["series", "rank"], "left_semi").select("series", "session", "value")


def missing_only(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary and the fallback's series that it hasn't at all."""
    return primary.unionByName(fallback.join(primary.select("series").distinct(), "series", "left_anti").select(*primary.columns))


def cascaded(providers: Sequence[DataFrame]) -> DataFrame:
    """Each provider adds the series that all before it lack; then, cell by cell, later ones fill what is null."""
    out = providers[0].select("series", "session", "value")
    for p in providers[1:]:
        rows = p.select("series", "session", "value")
        out = missing_only(out, rows)
        filled = rows.select("series", "session", F.col("value").alias("other"))
        out = out.join(filled, ["series", "session"], "full_outer").select("series", "session", F.coalesce("value", "other").alias("value"))
    return out


def point_in_time_status(manifest: DataFrame) -> DataFrame:
    """One row: all datasets by their first release, none, or some."""
    g = manifest.agg(F.bool_and(F.col("provider").contains("first_release")).alias("all"), F.bool_or(F.col("provider").contains("first_release")).alias("some"))
    return g.select(F.when(F.col("all"), "point_in_time").when(F.col("some"), "mixed").otherwise("latest_values").alias("status"))


def index_closes(wide: DataFrame, name: str) -> DataFrame:
    """session and the close of an index file: the first column whose name holds "close", else the last; named `name`."""
    values = [c for c in wide.columns if c != "session"]
    close = next((c for c in values if "close" in c.lower()), values[-1])
    return wide.select(F.lit(name).alias("series"), "session", F.col(close).try_cast("double").alias("value")).where("value is not null")


def read_offline(spark: SparkSession, path: str, groups: dict[str, Sequence[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """One wide CSV as long observations by group of columns, and a manifest whose rows are fixtures."""
    raw = spark.read.option("header", True).csv(path)
    date = raw.columns[0]
    out, rows = {}, []
    for group, columns in groups.items():
        have = [c for c in columns if c in raw.columns]
        long = raw.select(F.to_date(date).alias("session"), *(F.col(c).try_cast("double").alias(c) for c in have)).unpivot(["session"], have, "series", "value") if have else spark.createDataFrame([], "session date, series string, value double")
        out[group] = long.where("value is not null and session is not null").select("series", "session", "value")
        span = out[group].agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("a"), F.max("session").alias("b")).first()
        rows.append((group, "offline", "fixture", span["n"], span["a"], span["b"], None))
    return out, spark.createDataFrame(rows, MANIFEST)


def offline_fixture(spark: SparkSession, start: str, end: str, symbols: Sequence[str]) -> DataFrame:
    """symbol, session, p on weekdays: regimes of drift and swing by a fixed rule of day and symbol, the same each time."""
    days = spark.sql(f"select explode(sequence(date '{start}', date '{end}')) as session").where("weekday(session) < 5")
    rows = days.withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("session")
    i = F.row_number().over(w)
    h = F.pmod(F.xxhash64("symbol", "session"), F.lit(2001)) / 1000 - 1  # in [-1, 1]
    calm = F.pmod(F.floor(i / 125), F.lit(4)) < 3
    step = F.when(calm, 0.0005 + 0.008 * h).otherwise(-0.0008 + 0.02 * h)
    return rows.withColumn("step", step).select("symbol", "session", (100 * F.exp(F.sum("step").over(w))).alias("p"))
