"""Market-shaped views of the star-schema tables, and the same views as SQL.

`px`: one price path from daily order totals. `px5`: five symbols, one for each order priority, with gaps.
`bars`: daily bars by priority with planted faults. `quotes`, `chain`: option-like rows from lineitem and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYMBOLS = {"1-URGENT": "spy", "2-HIGH": "rsp", "3-MEDIUM": "iwm", "4-NOT SPECIFIED": "hyg", "5-LOW": "lqd"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(daily: DataFrame) -> DataFrame:
    """symbol, session, a -> symbol, session, i, p."""
    w = W.partitionBy("symbol").orderBy("session")
    mean = daily.groupBy("symbol").agg(F.avg("a").alias("m"))
    p = 100 * F.exp(F.sum(0.05 * (F.col("a") / F.col("m") - 1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return daily.join(mean, "symbol").select("symbol", "session", (F.row_number().over(w) - 1).alias("i"), p.alias("p"))


def symbol() -> Column:
    out = F.lit(None).cast("string")
    for k, v in SYMBOLS.items():
        out = F.when(F.col("o_orderpriority") == k, v).otherwise(out)
    return out


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.to_date("o_orderdate").alias("session")).agg(F.avg("o_totalprice").alias("a"))
    return _path(daily.withColumn("symbol", F.lit("px")))


def px5(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("symbol", symbol())
    return _path(o.groupBy("symbol", F.to_date("o_orderdate").alias("session")).agg(F.avg("o_totalprice").alias("a")))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, session, value: credit and implied-volatility series by ship date."""
    li = table(spark, sf_dir, "lineitem")
    daily = li.groupBy(F.to_date("l_shipdate").alias("session")).agg((F.avg("l_tax") * 100).alias("hy_oas"), (F.avg("l_quantity") / 10).alias("baa_spread"), (F.stddev_samp("l_discount") * 100).alias("vix_close"))
    return daily.unpivot(["session"], ["hy_oas", "baa_spread", "vix_close"], "series", "value")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("symbol", symbol()).withColumn("session", F.to_date("o_orderdate"))
    b = o.groupBy("symbol", "session").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.max("o_orderkey").alias("k"),
    )
    hit = lambda n: F.col("k") % n == 0
    return b.select(
        "symbol",
        "session",
        F.when(hit(19), F.lit(None)).otherwise(F.col("open")).alias("open"),
        F.when(hit(23), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(hit(31), F.col("close") * 100).when(hit(37), -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(hit(29), F.lit(None)).when(hit(41), F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
        F.when(hit(43), F.lit(None)).otherwise(F.lit("shares")).alias("volume_unit"),
        F.lit("ETF").alias("sec_type"),
    )


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px seen by another source: tiny differences, sessions without a value, one outlier."""
    x = px(spark, sf_dir)
    close = F.when(F.col("i") == 500, F.col("p") * 0.66).otherwise(F.col("p") * (1 + 1e-6 * ((F.col("i") % 7) - 3)))
    return x.select("symbol", "session", "i", F.when(F.col("i") % 97 != 0, close).alias("p"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    con = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    hit = lambda n: con % n == 0
    return li.select(
        con.alias("con_id"),
        F.when(hit(11), None).when(hit(13), F.lit(0.0)).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bid"),
        F.when(hit(17), None).when(hit(19), F.lit(-1.0)).otherwise(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("ask"),
        F.when(hit(7), F.col("l_extendedprice") * 1.2).otherwise(F.col("l_extendedprice")).alias("last"),
        F.when(hit(5), None).otherwise(F.col("l_quantity") * 10).alias("open_interest"),
        F.when(hit(3), None).otherwise(F.col("l_quantity") * 2).alias("age"),
        F.when(hit(23), F.lit(-1.0)).otherwise(F.col("l_discount") * 5).alias("implied_volatility"),
        (F.col("l_orderkey") % 4 + 1).cast("int").alias("data_type"),
        F.col("l_partkey").alias("part"),
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expiry, strike, put and call mids and half spreads of a parity-like chain."""
    p = table(spark, sf_dir, "part")
    k = (600 + 5 * F.col("p_size")).cast("double")
    days = (20 + 3 * F.substring("p_brand", 7, 2).cast("int")).alias("days")
    put = F.greatest(F.lit(0.5), 0.06 * (k - (774.4 - 90)))
    call = put + F.exp(-0.031 * days / 365) * (774.4 - k) + F.when(F.col("p_partkey") % 11 == 0, F.lit(0.4)).otherwise(F.lit(0.0))
    return p.groupBy("p_brand", F.col("p_size")).agg(F.min("p_partkey").alias("p_partkey")).select(F.col("p_brand").alias("expiry"), days, k.alias("strike"), put.alias("put_mid"), call.alias("call_mid"), F.lit(0.05).alias("half_spread"))


CASES = " ".join(f"when '{k}' then '{v}'" for k, v in SYMBOLS.items())
PX = """d as (select cast(o_orderdate as date) as session, avg(o_totalprice) as a from orders group by 1),
g as (select avg(a) as m from d),
px as (select 'px' as symbol, session, row_number() over (order by session) - 1 as i,
       100 * exp(sum(0.05 * (a / m - 1)) over (order by session)) as p from d cross join g)"""
PX5 = f"""d5 as (select case o_orderpriority {CASES} end as symbol, cast(o_orderdate as date) as session, avg(o_totalprice) as a from orders group by 1, 2),
g5 as (select symbol, avg(a) as m from d5 group by 1),
px5 as (select symbol, session, row_number() over (partition by symbol order by session) - 1 as i,
        100 * exp(sum(0.05 * (a / m - 1)) over (partition by symbol order by session)) as p from d5 join g5 using (symbol))"""
MACRO = """md as (select cast(l_shipdate as date) as session, avg(l_tax) * 100 as hy_oas, avg(l_quantity) / 10 as baa_spread, stddev_samp(l_discount) * 100 as vix_close from lineitem group by 1),
macro as (select session, 'hy_oas' as series, hy_oas as value from md union all select session, 'baa_spread', baa_spread from md union all select session, 'vix_close', vix_close from md)"""
BARS = f"""b0 as (select case o_orderpriority {CASES} end as symbol, cast(o_orderdate as date) as session, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
       arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume, max(o_orderkey) as k from orders group by 1, 2),
bars as (select symbol, session, case when k % 19 = 0 then null else open end as open, case when k % 23 = 0 then low - 1 else high end as high, low,
       case when k % 31 = 0 then close * 100 when k % 37 = 0 then -close else close end as close,
       case when k % 29 = 0 then null when k % 41 = 0 then 0.0 else volume end as volume, case when k % 43 = 0 then null else 'shares' end as volume_unit, 'ETF' as sec_type from b0)"""
SECOND = PX + """,
px2 as (select symbol, session, i, case when i = 500 then p * 0.66 else p * (1 + 1e-6 * ((i % 7) - 3)) end as p from px where i % 97 <> 0)"""
QUOTES = """q0 as (select l_orderkey * 10 + l_linenumber as con_id, * from lineitem),
quotes as (select con_id, case when con_id % 11 = 0 then null when con_id % 13 = 0 then 0.0 else l_extendedprice * (1 - l_discount) end as bid,
       case when con_id % 17 = 0 then null when con_id % 19 = 0 then -1.0 else l_extendedprice * (1 + l_tax) end as ask,
       case when con_id % 7 = 0 then l_extendedprice * 1.2 else l_extendedprice end as last,
       case when con_id % 5 = 0 then null else l_quantity * 10 end as open_interest, case when con_id % 3 = 0 then null else l_quantity * 2 end as age,
       case when con_id % 23 = 0 then -1.0 else l_discount * 5 end as implied_volatility, cast(l_orderkey % 4 + 1 as int) as data_type, l_partkey as part from q0)"""
CHAIN = """c0 as (select p_brand as expiry, 20 + 3 * cast(substr(p_brand, 7, 2) as int) as days, cast(600 + 5 * p_size as double) as strike, min(p_partkey) as k from part group by p_brand, p_size),
c1 as (select *, greatest(0.5, 0.06 * (strike - (774.4 - 90))) as put_mid from c0),
chain as (select expiry, days, strike, put_mid, put_mid + exp(-0.031 * days / 365) * (774.4 - strike) + case when k % 11 = 0 then 0.4 else 0.0 end as call_mid, 0.05 as half_spread from c1)"""
