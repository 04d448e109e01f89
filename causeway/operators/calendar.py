"""Sessions of the New York exchanges by rule: holidays, their observance, and early closes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Closures that no rule gives.
ONE_OFF = ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def _last(year: int, month: int, weekday: int) -> dt.date:
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * e) // 451
    month, day = divmod(h + e - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def holidays(year: int) -> set[dt.date]:
    def observed(d: dt.date) -> dt.date:
        return d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0))

    days = {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), _last(year, 5, 0), observed(dt.date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), observed(dt.date(year, 12, 25))}
    new_year = dt.date(year, 1, 1)
    if new_year.weekday() != 5:  # on a Saturday it isn't moved into the old year
        days.add(observed(new_year))
    if year >= 2022:
        days.add(observed(dt.date(year, 6, 19)))
    return days | {d for d in map(dt.date.fromisoformat, ONE_OFF) if d.year == year}


def early_closes(year: int) -> set[dt.date]:
    days = {_nth(year, 11, 3, 4) + dt.timedelta(1), dt.date(year, 12, 24), dt.date(year, 7, 3)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """session, open_utc, close_utc. Rules are a handful of rows per year; days are made and joined in Spark."""
    years = range(int(start[:4]), int(end[:4]) + 1)
    closed = spark.createDataFrame([(d,) for y in years for d in sorted(holidays(y))], "session date")
    short = spark.createDataFrame([(d, True) for y in years for d in sorted(early_closes(y))], "session date, early boolean")
    days = spark.sql(f"select explode(sequence(date '{start}', date '{end}')) as session").where("weekday(session) < 5")
    out = days.join(closed, "session", "left_anti").join(short, "session", "left")
    at = lambda clock: F.to_utc_timestamp(F.concat(F.col("session").cast("string"), F.lit(f" {clock}")).cast("timestamp"), "America/New_York")
    return out.select("session", at("09:30:00").alias("open_utc"), F.when(F.col("early"), at("13:00:00")).otherwise(at("16:00:00")).alias("close_utc"))


def last_completed(cal: DataFrame, now: str, buffer_minutes: int = 0) -> DataFrame:
    t = F.lit(now).cast("timestamp") - F.expr(f"interval {buffer_minutes} minutes")
    return cal.where(F.col("close_utc") <= t).agg(F.max("session").alias("session"))


def market_is_open(cal: DataFrame, now: str) -> DataFrame:
    t = F.lit(now).cast("timestamp")
    return cal.agg(F.coalesce(F.bool_or((F.col("open_utc") <= t) & (t < F.col("close_utc"))), F.lit(False)).alias("open"))


def completed_clock(cal: DataFrame, now: str, buffer_minutes: int = 20) -> DataFrame:
    """The last session whose close and buffer are over, with its open, close and cutoff."""
    cutoff = F.col("close_utc") + F.expr(f"interval {buffer_minutes} minutes")
    done = cal.withColumn("cutoff_utc", cutoff).where(F.col("cutoff_utc") <= F.lit(now).cast("timestamp"))
    return done.agg(F.max_by(F.struct("session", "open_utc", "close_utc", "cutoff_utc"), "session").alias("x")).select("x.*")


#: Dates that are worth a broadcast: a thousand years of days.
DATES = 366_000


def session_age(sessions: DataFrame, marks: DataFrame, as_of: str) -> DataFrame:
    """id, latest -> sessions after `latest` up to `as_of`; a future date has age 0, none has no age.

    Ages are found once for each date that occurs, in one window over dates (as many as the calendar has), and looked up by
    date: rows of marks stay where they are.
    """
    from pyspark.sql import Window as W

    day = F.lit(as_of).cast("date")
    dates = sessions.select(F.col("session").alias("date"), F.lit(1).alias("held")).unionByName(marks.select(F.col("latest").alias("date"), F.lit(0).alias("held"))).where("date is not null")
    dates = dates.groupBy("date").agg(F.max("held").alias("held"))
    w = W.partitionBy(F.lit(0)).orderBy("date")
    ages = dates.withColumn("n", F.sum("held").over(w)).withColumn("on_day", F.when(F.col("date") <= day, F.col("n")))
    ages = ages.withColumn("top", F.coalesce(F.max("on_day").over(W.partitionBy(F.lit(0))), F.lit(0)))
    ages = ages.select(F.col("date").alias("latest"), F.greatest(F.lit(0), F.col("top") - F.col("n")).cast("long").alias("age"))
    if dates.limit(DATES + 1).count() <= DATES:
        ages = F.broadcast(ages)
    return marks.join(ages, "latest", "left").select(*marks.columns, "age")
