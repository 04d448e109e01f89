"""Queries of landed payloads: driver tables written in a provider's format and read back, and broker payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.operators import calendar, lineage, quality, research
from causeway.plans.inputs import BARS, PX, PX5, bars, px, px5, table
from causeway.plans.quality_queries import ISSUES, MANIFEST, health
from causeway.plans.registry import query
from causeway.session import shared_folder
from causeway.sources import landed, loading, quotes
from causeway.streaming import events


def landing(spark, name: str) -> str:
    return f"{shared_folder(spark)}/causeway/landed-{name}-{uuid.uuid4().hex}"


DAILY = "dy as (select cast(o_orderdate as date) as session, round(max(o_totalprice), 2) as value, count(*) as n from orders group by 1)"


def daily(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("session")).agg(F.round(F.max("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n"))


@query("graph_csv", f"with {DAILY} select 'daily' as series, session, value from dy where n % 7 > 0 and session >= date '1996-01-01'")
def graph_csv(spark, sf_dir):
    """A lone dot is a day without a value."""
    at = landing(spark, "graph")
    rows = daily(spark, sf_dir).select(F.col("session").cast("string").alias("DATE"), F.when(F.col("n") % 7 == 0, ".").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("VALUE"))
    rows.write.option("header", True).csv(at)
    return landed.read_graph_csv(spark, at, "daily", "1996-01-01")


@query("wide_csv", f"with {DAILY} select 'fsi_' || k as series, session, case k when 'total_price' then value else n::double end as value from dy, (values ('total_price'), ('orders_a_day')) t(k)")
def wide_csv(spark, sf_dir):
    """Headers become slugs under a prefix."""
    at = landing(spark, "wide")
    daily(spark, sf_dir).select(F.date_format("session", "MM/dd/yyyy").alias("Trade Date"), F.col("value").cast("decimal(18,2)").alias("Total-Price"), F.col("n").alias("Orders a Day")).write.option("header", True).csv(at)
    return landed.read_wide_csv(spark, at, "fsi_")


@query("index_closes", f"with {DAILY} select 'vxn' as series, session, value from dy union all select 'vxo', session, n::double from dy")
def index_closes(spark, sf_dir):
    """Of an index file the column named like a close, else its last."""
    d = daily(spark, sf_dir)
    first = loading.index_closes(d.select("session", F.col("value").cast("string").alias("VXN Close"), F.col("n").alias("volume")), "vxn")
    return first.unionByName(loading.index_closes(d.select("session", F.col("value").alias("a"), F.col("n").cast("string").alias("b")), "vxo"))


@query("index_alignment", f"with {DAILY}, a as (select session, case when n % 3 > 0 then value end as value from dy), b as (select session, case when n % 2 = 0 then n end as n from dy) select coalesce(a.session, b.session) as session, value as vix_close, n::double as vxn_close from a full join b on a.session = b.session")
def index_alignment(spark, sf_dir):
    d = daily(spark, sf_dir)
    vix = d.select("session", F.when(F.col("n") % 3 > 0, F.col("value")).alias("vix_close"))
    return vix.join(d.select("session", F.when(F.col("n") % 2 == 0, F.col("n").cast("double")).alias("vxn_close")), "session", "full_outer")


def _whole(spark, rows, name: str) -> str:
    """One JSON document of rows (as many as the calendar has days), written as text."""
    at = landing(spark, name)
    rows.coalesce(1).write.text(at)
    return at


@query("observations_json", f"with {DAILY} select 'daily' as series, session, value from dy where n % 7 > 0")
def observations_json(spark, sf_dir):
    o = daily(spark, sf_dir).select(F.struct(F.col("session").cast("string").alias("date"), F.when(F.col("n") % 7 == 0, ".").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("value")).alias("o"))
    return landed.read_observations_json(spark, _whole(spark, o.agg(F.to_json(F.struct(F.collect_list("o").alias("observations")))), "api"), "daily")


@query("trades_json", f"with {DAILY} select 'daily' as series, session, value from dy")
def trades_json(spark, sf_dir):
    """Currency signs and thousands separators."""
    o = daily(spark, sf_dir).select(F.struct(F.date_format("session", "MM/dd/yyyy").alias("date"), F.concat(F.lit("$"), F.format_number("value", 2)).alias("close")).alias("o"))
    doc = o.agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list("o").alias("rows")).alias("tradesTable")).alias("data"))))
    return landed.read_trades_json(spark, _whole(spark, doc, "trades"), "daily")


@query("chart_json", f"with {DAILY} select 'daily' as series, convention, session, case convention when 'raw' then value else value / 2 end as value from dy, (values ('raw'), ('adjusted')) t(convention)")
def chart_json(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.unix_timestamp(F.col("session").cast("timestamp")).alias("t"), "value")
    arrays = d.agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("x"))
    doc = arrays.select(
        F.to_json(
            F.struct(
                F.struct(
                    F.array(
                        F.struct(
                            F.transform("x", lambda r: r["t"]).alias("timestamp"),
                            F.struct(F.array(F.struct(F.transform("x", lambda r: r["value"]).alias("close"))).alias("quote"), F.array(F.struct(F.transform("x", lambda r: r["value"] / 2).alias("adjclose"))).alias("adjclose")).alias("indicators"),
                        )
                    ).alias("result")
                ).alias("chart")
            )
        )
    )
    return landed.read_chart_json(spark, _whole(spark, doc, "chart"), "daily")


@query("multi_series", f"with {DAILY} select 'a' as series, count(*) as n, round(sum(value), 2) as total from dy union all select 'b', count(*), round(sum(n), 2) from dy")
def multi_series(spark, sf_dir):
    """Series with alternatives: the first of `a` fails, `c` has none that works; neither ends the run."""
    d = daily(spark, sf_dir)
    named = lambda name, value: d.select(F.lit(name).alias("series"), "session", F.col(value).cast("double").alias("value"))

    def broken():
        raise OSError("no route, api_key=abc")

    wanted = {"a": [("api", broken), ("graph", lambda: named("a", "value"))], "b": [("graph", lambda: named("b", "n"))], "c": [("api", broken)]}
    rows, _ = loading.load_series(spark, wanted)
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("multi_series_manifest", f"with {DAILY}, s as (select count(*) as rows, min(session) as earliest, max(session) as latest from dy) select 'a' as dataset, 'graph' as provider, 'ok' as status, rows, earliest, latest, 'api: no route, api_key=***' as error from s union all select 'c', 'api', 'failed', 0, null, null, 'api: no route, api_key=***'")
def multi_series_manifest(spark, sf_dir):
    d = daily(spark, sf_dir)

    def broken():
        raise OSError("no route, api_key=abc")

    read = lambda: d.select(F.lit("a").alias("series"), "session", "value")
    return loading.load_series(spark, {"a": [("api", broken), ("graph", read)], "c": [("api", broken)]})[1]


@query("combined_factors", f"with {DAILY} select 'mkt_rf' as series, session, value from dy union all select 'hml', session, value * 2 from dy union all select 'mom', session, n::double from dy")
def combined_factors(spark, sf_dir):
    """The first file of a series wins; of a file of one factor only its first column is taken."""
    d = daily(spark, sf_dir)
    col = lambda name, value, k: d.select(F.lit(name).alias("series"), "session", value.cast("double").alias("value"), F.lit(k).alias("k"))
    five = col("mkt_rf", F.col("value"), 0).unionByName(col("hml", F.col("value") * 2, 1))
    momentum = col("umd", F.col("n"), 0).unionByName(col("rest", F.col("n") + 1, 1))
    return loading.combined_factors([("five_factors", five), ("mom", momentum), ("hml", col("x", F.col("value") * 9, 0))])


@query("cascade_missing_only", f"with {DAILY} select 'a' as series, session, case when n % 5 > 0 then value else value + 1 end as value from dy union all select 'b', session, n::double from dy")
def cascade_missing_only(spark, sf_dir):
    """A later provider gives the series that earlier ones lack, and fills their empty cells."""
    d = daily(spark, sf_dir)
    one = lambda name, value: d.select(F.lit(name).alias("series"), "session", value.cast("double").alias("value"))
    first = one("a", F.when(F.col("n") % 5 > 0, F.col("value")))
    second = one("a", F.col("value") + 1).unionByName(one("b", F.col("n")))
    return loading.cascaded([first, second])


@query("offline_groups", f"with {DAILY} select 'prices' as grp, 'spy' as series, session, value from dy union all select 'macro', 'hy_oas', session, n::double from dy")
def offline_groups(spark, sf_dir):
    at = landing(spark, "offline")
    daily(spark, sf_dir).select("session", F.col("value").cast("decimal(18,2)").alias("spy"), F.col("n").alias("hy_oas")).write.option("header", True).csv(at)
    groups, _ = loading.read_offline(spark, at, {"prices": ["spy", "rsp"], "macro": ["hy_oas"]})
    out = None
    for name, rows in groups.items():
        rows = rows.withColumn("grp", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("grp", "series", "session", "value")


@query("slugs_and_numbers", "select p_partkey, trim(regexp_replace(lower('Mkt-RF ' || p_name || '!'), '\\W+', '_', 'g'), '_') as slug, round(p_retailprice, 2) as price from part")
def slugs_and_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", landed.slug(F.concat(F.lit("Mkt-RF "), "p_name", F.lit("!"))).alias("slug"), landed.number(F.concat(F.lit("$ "), F.format_number("p_retailprice", 2))).alias("price"))


# Broker payloads

TICKS = """tk as (select l_orderkey * 10 + l_linenumber as con_id, l_orderkey % 4 + 1 as data_type, case l_linenumber % 3 when 0 then 'P' when 1 then 'C' else null end as side,
       case when l_orderkey % 5 = 0 then -1.0 when l_orderkey % 7 = 0 then null else l_extendedprice end as bid, case when l_orderkey % 3 = 0 then null else l_extendedprice * 1.01 end as ask, case when l_orderkey % 2 = 0 then l_extendedprice end as last, l_quantity as put_oi, l_quantity * 2 as call_oi, l_linenumber as lag from lineitem)"""


@query("normalised_quotes", f"""with {TICKS}, c as (select *, case when bid >= 0 then bid end as b from tk)
select con_id, count(*) as rows, max(case side when 'P' then put_oi when 'C' then call_oi end) as open_interest, max(lag::double) as tick_lag_seconds, max(case when data_type not in (2, 4) then lag::double end) as quote_age_seconds,
max(case when data_type in (2, 4) then 'frozen_book_has_no_timestamp' else 'tick_timestamp' end) as staleness_basis, max(case data_type when 1 then 'live' when 2 then 'frozen' when 3 then 'delayed' else 'delayed_frozen' end) as data_type_name,
max(case when b is not null and ask is not null then 'complete' when b is not null and ask is not null or last is not null then 'close_only' else 'empty' end) as status from c group by 1""")
def normalised_quotes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k, n, price = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")
    at = F.lit("2001-06-29 15:00:00").cast("timestamp")
    none = F.lit(None).cast("double")
    raw = li.select(
        (k * 10 + n).alias("con_id"),
        (k % 4 + 1).cast("int").alias("data_type"),
        F.when(n % 3 == 0, "P").when(n % 3 == 1, "C").alias("right"),
        F.when(k % 5 == 0, F.lit(-1.0)).when(k % 7 != 0, price).alias("bid"),
        F.when(k % 3 != 0, price * 1.01).alias("ask"),
        F.when(k % 2 == 0, price).alias("last"),
        none.alias("close"),
        none.alias("open_interest"),
        F.col("l_quantity").cast("double").alias("put_open_interest"),
        (F.col("l_quantity") * 2).cast("double").alias("call_open_interest"),
        none.alias("put_volume"),
        none.alias("call_volume"),
        at.alias("exchange_time"),
        (at + F.make_interval(secs=n)).alias("received_at"),
    )
    q = quotes.normalised(raw)
    return q.groupBy("con_id").agg(F.count(F.lit(1)).alias("rows"), *(F.max(c).alias(c) for c in ("open_interest", "tick_lag_seconds", "quote_age_seconds", "staleness_basis", "data_type_name", "status")))


@query("quote_batch", """with t as (select l_orderkey as con_id, l_linenumber as seconds, max(l_extendedprice) as bid from lineitem group by 1, 2),
r as (select con_id, max(seconds) as seconds, arg_max(bid, seconds) as bid from t where seconds <= 5 group by 1)
select o_orderkey as con_id, bid, bid is not null as answered from orders left join r on con_id = o_orderkey""")
def quote_batch(spark, sf_dir):
    """All are asked, one wait, all are read: the last tick of each within it; a contract without one keeps its row."""
    start = F.lit("2001-06-29 15:00:00").cast("timestamp")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("bid"))
    ticks = li.select(F.col("l_orderkey").alias("con_id"), (start + F.make_interval(secs=F.col("l_linenumber"))).alias("received_at"), "bid")
    contracts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("con_id"))
    return quotes.batch(contracts, ticks, "2001-06-29 15:00:00", 5.0).select("con_id", "bid", F.col("received_at").isNotNull().alias("answered"))


@query("landed_bars", f"with {BARS} select symbol, session, close, 'TRADES' as what, true as regular_hours, '10 Y' as duration from bars where close is not null")
def landed_bars(spark, sf_dir):
    """Historical bars land with what was asked for."""
    at = landing(spark, "bars")
    bars(spark, sf_dir).select("symbol", "session", "open", "high", "low", "close", "volume").write.json(at)
    return quotes.historical_bars(spark, at, "10 Y", "TRADES", True, allowed=True).where("close is not null").select("symbol", "session", "close", "what", "regular_hours", "duration")


CHAINS = "ch as (select p_type as symbol, p_brand as expiry, cast(600 + 5 * p_size as double) as strike, case when p_partkey % 4 = 0 then 0 else p_partkey end as con_id from part)"


@query("listed_strikes", f"with {CHAINS} select symbol, expiry, array_to_string(list_sort(list(distinct cast(strike as int))), ',') as strikes from ch group by 1, 2")
def listed_strikes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_type").alias("symbol"), F.col("p_brand").alias("expiry"), (600 + 5 * F.col("p_size")).cast("double").alias("strike"))
    return quotes.listed_strikes(rows).withColumn("strikes", F.array_join(F.transform("strikes", lambda x: x.cast("int").cast("string")), ","))


@query("chain_parameters", f"with {CHAINS} select symbol, cast(count(distinct expiry) as int) as expiry_count, cast(count(distinct strike) as int) as strike_count, min(expiry) as first_expiry from ch group by 1")
def chain_parameters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.groupBy(F.col("p_type").alias("symbol")).agg(F.collect_list("p_brand").alias("expirations"), F.collect_list((600 + 5 * F.col("p_size")).cast("double")).alias("strikes"))
    return quotes.chain_parameters(rows).select("symbol", "expiry_count", "strike_count", F.col("expirations")[0].alias("first_expiry"))


@query("qualified_contracts", f"with {CHAINS} select symbol, count(*) as n from ch where con_id <> 0 group by 1")
def qualified_contracts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_partkey")).alias("con_id"))
    return quotes.qualified(p).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("clock_skew", "select l_orderkey, l_linenumber, l_linenumber - (2 + l_quantity) / 2.0 as skew_seconds from lineitem")
def clock_skew(spark, sf_dir):
    at = F.lit("2001-06-29 15:00:00").cast("timestamp")
    after = lambda s: at + F.make_interval(secs=s)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", after(F.lit(2)).alias("before"), after(F.col("l_linenumber")).alias("server"), after(F.col("l_quantity")).alias("after"))
    return quotes.clock_skew(rows).select("l_orderkey", "l_linenumber", "skew_seconds")


@query("request_log", "select o_orderkey as request_id, case o_orderkey % 3 when 0 then 'pending' when 1 then 'complete' else 'failed' end as state, case when o_orderkey % 3 = 2 then 'timed out' end as error from orders")
def request_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    at = F.lit("2001-06-29 15:00:00").cast("timestamp")
    begun = o.select(F.lit(1).alias("generation"), k.alias("request_id"), F.lit("begin").alias("event"), at.alias("at"), F.lit(None).cast("string").alias("error"))
    ended = o.select(F.lit(1).alias("generation"), k.alias("request_id"), F.when(k % 3 == 1, "complete").when(k % 3 == 2, "fail").alias("event"), (at + F.expr("interval 3 seconds")).alias("at"), F.when(k % 3 == 2, "timed out").alias("error")).where("event is not null")
    return quotes.request_log(begun.unionByName(ended)).select("request_id", "state", "error")


# Lineage, clocks, gates

ID = "id as (select o_orderstatus as name, sha256(cast(count(*) as varchar)) as sha256 from orders group by 1)"


@query("snapshot_id", f"with {ID} select '2001-06-29-' || sha256('2|cfg|' || string_agg(name || ':' || sha256, ',' order by name))[1:12] as snapshot_id from id")
def snapshot_id(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("sha256"))
    return lineage.snapshot_id(t, "2001-06-29", "cfg")


@query("revision_chain", """with s as (select date_trunc('month', o_orderdate)::date as session, o_orderpriority as view, 'c' || (o_custkey % 7) as snapshot_id, min(o_orderkey) as created from orders group by 1, 2, 3)
select session, view, snapshot_id, cast(row_number() over w as int) as revision, lag(snapshot_id) over w as supersedes from s window w as (partition by session, view order by created, snapshot_id)""")
def revision_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("session"), F.col("o_orderpriority").alias("view"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("snapshot_id"), F.col("o_orderkey").alias("created"))
    return lineage.with_revisions(o).select("session", "view", "snapshot_id", F.col("revision").cast("int").alias("revision"), "supersedes")


CLOCK = "cl as (select distinct cast(o_orderdate as date) as session from orders), ck as (select session, session + interval 14 hours as open_utc, session + interval 21 hours as close_utc from cl)"


def clock(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()
    at = lambda h: F.col("session").cast("timestamp") + F.expr(f"interval {h} hours")
    return s.select("session", at(14).alias("open_utc"), at(21).alias("close_utc"))


NOON = "1997-03-05 21:10:00"


@query("last_completed", f"with {CLOCK} select max(session) as session from ck where close_utc + interval 20 minutes <= timestamp '{NOON}'")
def last_completed(spark, sf_dir):
    return calendar.last_completed(clock(spark, sf_dir), NOON, 20)


@query("market_is_open", f"with {CLOCK} select coalesce(bool_or(open_utc <= timestamp '1997-03-05 15:00:00' and timestamp '1997-03-05 15:00:00' < close_utc), false) as open from ck")
def market_is_open(spark, sf_dir):
    return calendar.market_is_open(clock(spark, sf_dir), "1997-03-05 15:00:00")


@query("completed_clock", f"with {CLOCK} select session, open_utc, close_utc, close_utc + interval 20 minutes as cutoff_utc from ck where close_utc + interval 20 minutes <= timestamp '{NOON}' order by session desc limit 1")
def completed_clock(spark, sf_dir):
    c = calendar.completed_clock(clock(spark, sf_dir), NOON)
    return c.select("session", *(F.col(x).cast("timestamp_ntz").alias(x) for x in ("open_utc", "close_utc", "cutoff_utc")))


@query("last_bar_incomplete", f"with {BARS} select symbol, max(session) as session, 'last_bar_incomplete' as code, 'quarantine' as severity from bars group by 1 having max(session) >= date '1998-08-02'")
def last_bar_incomplete(spark, sf_dir):
    return quality.last_bar_incomplete(bars(spark, sf_dir), F.col("session") < F.lit("1998-08-02").cast("date"))


@query("eligible_series", f"with {MANIFEST}, {PX5}, bad as (select dataset from he group by 1 having not bool_or(health = 'ok')), ds as (select * from (values ('d1', 'spy'), ('d2', 'rsp'), ('d3', 'iwm'), ('d4', 'hyg'), ('d5', 'lqd')) t(dataset, symbol)) select symbol, count(*) as n from px5 where symbol not in (select symbol from ds join bad using (dataset)) group by 1")
def eligible_series(spark, sf_dir):
    from causeway.plans.daily import eligible

    datasets = spark.createDataFrame(list(zip(("d1", "d2", "d3", "d4", "d5"), ("spy", "rsp", "iwm", "hyg", "lqd"), strict=True)), "dataset string, symbol string")
    return eligible(px5(spark, sf_dir), health(spark, sf_dir), datasets).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("diagnostics", f"with {MANIFEST}, {PX5}, fr as (select dataset, bool_or(health = 'ok') as ok from he where required group by 1), cl as (select symbol, count(*) >= 252 as ok from px5 group by 1) select 'required:' || dataset as check_name, case when ok then 'ok' else 'failed' end as status from fr union all select 'closes:' || symbol, case when ok then 'ok' else 'failed' end from cl")
def diagnostics(spark, sf_dir):
    from causeway.plans.diagnostics import data_checks

    return data_checks(health(spark, sf_dir), px5(spark, sf_dir))


@query("exceptional_review", f"with {PX}, m as (select symbol, session, i, abs(p / lag(p) over (partition by symbol order by session) - 1) as move from px) select symbol, session from m where move > 0.03 and i % 3 > 0 and not i % 5 = 0")
def exceptional_review(spark, sf_dir):
    w = ts.series("symbol")
    m = px(spark, sf_dir).withColumn("move", F.abs(ts.pct_change(F.col("p"), w))).where("move > 0.03")
    return events.exceptional_review(m.withColumns({"verified": F.col("i") % 3 > 0, "single_print": F.col("i") % 5 == 0})).select("symbol", "session")


@query("registry_store", """with e as (select 'e' || o_orderkey as name, case o_orderkey % 2 when 0 then 'data_quality' else 'risk_identification' end as capability, row_number() over () as k from orders),
u as (select name, capability from e union all select 'new', 'action_value') select capability, count(*) as experiments from u group by 1""")
def registry_store(spark, sf_dir):
    """Saved as JSON, loaded, merged: a taken name is kept as it was. A store that isn't there is empty."""
    at = landing(spark, "registry")
    empty = research.load(spark, f"{at}/none")
    pick = F.when(F.col("o_orderkey") % 2 == 0, "data_quality").otherwise("risk_identification")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("name"), pick.alias("capability"))
    full = lambda df: empty.unionByName(df, allowMissingColumns=True)
    research.save(full(rows), at)
    more = rows.select("name", F.lit("action_value").alias("capability")).unionByName(spark.createDataFrame([("new", "action_value")], "name string, capability string"))
    return research.merged(research.load(spark, at), full(more)).groupBy("capability").agg(F.count(F.lit(1)).alias("experiments"))


@query("run_artefacts", f"with {ISSUES.replace(BARS, BARS)}, {PX5} select 'prices' as name, 'parquet' as format, (select count(*) from px5) as rows union all select 'issues', 'csv', (select count(*) from iss) union all select 'issues', 'parquet', (select count(*) from iss)")
def run_artefacts(spark, sf_dir):
    """Tables of a run as written: empty ones are left out, arrays in CSV become text."""
    from causeway.plans import artefacts

    at = landing(spark, "run")
    frames = {"prices": px5(spark, sf_dir), "issues": quality.validate_bars(bars(spark, sf_dir)), "nothing": quality.no_issues(spark)}
    return artefacts.write_tables(spark, at, frames, csv=("issues",))
