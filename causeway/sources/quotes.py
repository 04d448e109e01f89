"""Landed broker payloads: quotes, late open interest, listed strikes, contracts, clock skew and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.timeseries import cleaned
from causeway.settings import MARKET_DATA_TYPES


def data_type_name(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in MARKET_DATA_TYPES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def normalised(raw: DataFrame) -> DataFrame:
    """Ticks to quotes: sentinels to null, open interest and volume of the contract's own right, lag told from age.

    A frozen book carries no time of its own, so it has a lag but no age.
    """
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    some = two | F.col("last").isNotNull() | F.col("close").isNotNull()
    frozen = F.coalesce(F.col("data_type").isin(2, 4), F.lit(False))
    lag = F.unix_micros("received_at") / 1e6 - F.unix_micros("exchange_time") / 1e6
    side = lambda put, call, other: F.when(F.col("right") == "P", F.col(put)).when(F.col("right") == "C", F.col(call)).otherwise(other)
    q = raw.withColumns({c: cleaned(F.col(c)) for c in ("bid", "ask", "last", "close")})
    return q.withColumns(
        {
            "open_interest": cleaned(side("put_open_interest", "call_open_interest", F.col("open_interest"))),
            "option_volume": cleaned(side("put_volume", "call_volume", F.lit(None).cast("double"))),
            "tick_lag_seconds": lag,
            "quote_age_seconds": F.when(~frozen, lag),
            "staleness_basis": F.when(frozen, "frozen_book_has_no_timestamp").when(F.col("exchange_time").isNotNull(), "tick_timestamp").otherwise("unknown"),
            "data_type_name": data_type_name(F.col("data_type")),
            "status": F.when(two, "complete").when(some, "close_only").otherwise("empty"),
            "open_interest_attempt": F.lit(0),
        }
    ).drop("put_open_interest", "call_open_interest", "put_volume", "call_volume")


def with_late_open_interest(quotes: DataFrame, retries: DataFrame) -> DataFrame:
    """Only a missing open interest is filled, with the first attempt that has one; prices are never read again."""
    first = retries.where("open_interest is not null").groupBy("con_id").agg(F.min_by(F.struct(F.col("open_interest").alias("value"), "attempt"), "attempt").alias("late"))
    out = quotes.join(first, "con_id", "left")
    fill = F.col("open_interest").isNull() & F.col("late").isNotNull()
    return out.withColumns({"open_interest_attempt": F.when(fill, F.col("late.attempt")).otherwise(F.col("open_interest_attempt")), "open_interest": F.coalesce("open_interest", "late.value")}).drop("late")


def listed_strikes(contracts: DataFrame) -> DataFrame:
    """Distinct positive strikes by symbol and expiry, in order."""
    return contracts.where("strike > 0").groupBy("symbol", "expiry").agg(F.array_sort(F.collect_set("strike")).alias("strikes"))


def chain_parameters(chains: DataFrame) -> DataFrame:
    return chains.withColumns({"expirations": F.array_sort(F.array_distinct("expirations")), "strikes": F.array_sort(F.array_distinct("strikes"))}).withColumns({"expiry_count": F.size("expirations"), "strike_count": F.size("strikes")})


def qualified(contracts: DataFrame) -> DataFrame:
    return contracts.where("con_id is not null and con_id <> 0")


def clock_skew(samples: DataFrame) -> DataFrame:
    """server - the middle of the local times before and after, in seconds."""
    mid = (F.unix_micros("before") + F.unix_micros("after")) / 2
    return samples.withColumn("skew_seconds", (F.unix_micros("server") - mid) / 1e6)


def request_log(events: DataFrame) -> DataFrame:
    """begin, complete and fail events -> one row per request with its last state; a request without an end is pending."""
    g = events.groupBy("generation", "request_id").agg(F.min(F.when(F.col("event") == "begin", F.col("at"))).alias("requested_at"), F.max(F.when(F.col("event") != "begin", F.col("at"))).alias("completed_at"), F.max_by("event", F.struct("at", F.col("event") != "begin")).alias("last"), F.max_by("error", "at").alias("error"))
    return g.select("generation", "request_id", "requested_at", "completed_at", F.when(F.col("last") == "begin", "pending").when(F.col("last") == "fail", "failed").otherwise(F.col("last")).alias("state"), "error")


def batch(contracts: DataFrame, ticks: DataFrame, started: str, wait_seconds: float = 12.0) -> DataFrame:
    """con_id and the last tick that came within one wait after all were asked; a contract without one keeps its row.

    `ticks`: con_id, received_at and values. Later ticks belong to another batch: prices are never read again.
    """
    start = F.lit(started).cast("timestamp")
    values = [c for c in ticks.columns if c != "con_id"]
    inside = ticks.where((F.col("received_at") >= start) & (F.col("received_at") <= start + F.make_interval(secs=F.lit(wait_seconds))))
    last = inside.groupBy("con_id").agg(F.max_by(F.struct(*values), "received_at").alias("x")).select("con_id", "x.*")
    return contracts.join(last, "con_id", "left")


BARS = "symbol string, session date, open double, high double, low double, close double, volume double"


def historical_bars(spark: SparkSession, path: str, duration: str, what: str = "TRADES", regular_hours: bool = True, allowed: bool = False) -> DataFrame:
    """Landed daily bars with what was asked for beside each row. Asking a broker for history is a decision: without it, an error."""
    if not allowed:
        raise PermissionError("historical bars weren't allowed")
    bars = spark.read.schema(BARS).json(path)
    return bars.withColumns({"duration": F.lit(duration), "what": F.lit(what), "regular_hours": F.lit(regular_hours)})
