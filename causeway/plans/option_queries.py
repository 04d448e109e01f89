"""Queries of option candidates. The chain comes from part, quotes and contracts from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import options
from causeway.plans.inputs import CHAIN, QUOTES, chain, quotes, table
from causeway.plans.registry import query

#: Expiries by brand, strikes by brand and size, a spot for each type: what a listing service would land.
LISTED = """ex as (select distinct p_type as symbol, p_brand as expiry, 20 + 3 * cast(substr(p_brand, 7, 2) as int) as days from part),
sk as (select distinct p_type as symbol, p_brand as expiry, case when p_partkey % 3 > 0 then cast(600 + 5 * p_size as double) end as strike from part),
sk2 as (select * from sk where strike is not null and cast(strike as int) % 10 = 0 and expiry <> 'Brand#7'),
sp as (select p_type as symbol, cast(700 + 10 * (length(p_type) % 9) + 0.5 as double) as spot, cast(100000.0 as double) as notional from part group by 1),
bk as (select * from (values ('25-60', 25, 60), ('60-95', 60, 95)) t(bucket, fewest, most)),
se as (select s.symbol, bucket, x.expiry, x.days, case when x.expiry is null then 'no_listed_expiry' else 'proposed' end as status
       from (select distinct symbol from ex) s cross join bk left join lateral (select expiry, days from ex where ex.symbol = s.symbol and days between fewest and most order by days, expiry limit 1) x on true)"""
NEAREST = "left join lateral (select strike from {t} k where k.symbol = g.symbol and k.expiry = g.expiry and k.strike is not null order by abs(strike - target), strike limit 1) k on true"
PLAN = f"""{LISTED}, g as (select se.*, spot, notional, m as moneyness, spot * (1 + m) as target from se join sp using (symbol), (values (-0.02), (-0.05), (-0.10)) t(m)),
pl as (select g.symbol, bucket, expiry, days, spot, notional, moneyness, target, strike, case when status <> 'proposed' then status when strike is null then 'no_listed_strike' when abs(strike / target - 1) > 0.01 then 'strike_far_from_target' else 'proposed' end as status from g {NEAREST.format(t='sk')})"""
RESOLVED = f"""{PLAN}, rs as (select g.symbol, bucket, g.expiry, days, spot, notional, moneyness, target, g.strike as strike_proposed, k.strike, case when status <> 'proposed' then status when e.expiry is null then 'expiry_not_listed' when k.strike is null then 'no_listed_strike' when abs(k.strike / target - 1) > 0.01 then 'strike_far_from_target' else 'ok' end as status
       from pl g left join (select distinct symbol, expiry from sk2) e on e.symbol = g.symbol and e.expiry = g.expiry {NEAREST.format(t='sk2')})"""
CONTRACTS = """ct as (select p_brand as expiry, cast(600 + 5 * p_size as double) as strike, max(case when p_partkey % 4 > 0 then p_partkey end) as con_id from part group by 1, 2)"""
ATTACHED = f"""{RESOLVED}, {CONTRACTS}, ac as (select rs.* replace (case when status = 'ok' and con_id is null then 'not_qualified' else status end as status), case when status = 'ok' then con_id end as con_id from rs left join ct on ct.expiry = rs.expiry and ct.strike = rs.strike)"""
BOOK = """qt as (select l_partkey as part, 1.0 * l_partkey % 50 / 5 + l_discount as bid, 1.0 * l_partkey % 50 / 5 + l_discount + case when l_partkey % 5 = 0 then 4.0 else 0.05 end as ask0, l_quantity * 10 as open_interest, l_quantity * 2 as age0 from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1),
qq as (select case when part % 7 > 0 then part end as con_id, bid, case when part % 9 = 0 then -1.0 when part % 13 = 0 then null else ask0 end as ask, case when part % 6 = 0 then null else open_interest end as open_interest, case when part % 4 = 1 then null else age0 end as age, case part % 3 when 0 then 'frozen' when 1 then 'mixed' else 'live' end as basis from qt)"""
QUOTED = f"""{ATTACHED}, {BOOK}, aq as (select ac.*, bid, ask, open_interest, age, basis, case when status <> 'ok' then status when basis is null then 'no_quote_returned' when not coalesce(ask > 0, false) then 'no_ask' else 'priced' end as st, case when ask > 0 and bid > 0 then (ask + bid) / 2 end as mid, case when ask > 0 and bid > 0 then (ask - bid) / ask end as relative_spread from ac left join qq using (con_id))"""
SCREENED = f"""{QUOTED}, sr as (select *, concat_ws('; ', case when relative_spread > 0.15 then 'wide spread' end, case when open_interest < 100 then 'thin open interest' end) as reasons,
  concat_ws('; ', case when st <> 'priced' then 'not priced: ' || st when basis in ('frozen', 'mixed') then 'frozen at the last close' when age is null then 'no usable time of the quote' when age > 60 then 'quote too old' else 'quote fresh' end, case when relative_spread is null then 'spread unknown' end, case when open_interest is null then 'open interest absent' end) as notes from aq),
sc as (select *, case when st <> 'priced' then 'UNAVAILABLE' when reasons <> '' then 'QUARANTINED' when relative_spread is null or open_interest is null then 'DEGRADED' when basis in ('frozen', 'mixed') then 'VALID' when age is null or age > 60 then 'DEGRADED' else 'VALID' end as qualification from sr)"""


def listed(spark, sf_dir):
    """Every part is a row: where a strike or a contract's id never came, the cell is null."""
    p = table(spark, sf_dir, "part")
    symbol, expiry = F.col("p_type").alias("symbol"), F.col("p_brand").alias("expiry")
    days = (20 + 3 * F.substring("p_brand", 7, 2).cast("int")).alias("days")
    expiries = p.select(symbol, expiry, days).distinct()
    strikes = p.select(symbol, expiry, F.when(F.col("p_partkey") % 3 > 0, (600 + 5 * F.col("p_size")).cast("double")).alias("strike")).distinct()
    spots = p.groupBy(symbol).agg(F.lit(100000.0).alias("notional")).withColumn("spot", 700 + 10 * (F.length("symbol") % 9) + 0.5)
    contracts = p.select(expiry, (600 + 5 * F.col("p_size")).cast("double").alias("strike"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey")).alias("con_id"))
    return expiries, strikes, strikes.where((F.col("strike").cast("int") % 10 == 0) & (F.col("expiry") != "Brand#7")), spots, contracts


def book(spark, sf_dir):
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem")
    one = li.withColumn("k", F.row_number().over(W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))).where("k = 1")
    c = F.col("l_partkey")
    bid = F.lit(1.0) * c % 50 / 5 + F.col("l_discount")
    return one.select(
        F.when(c % 7 > 0, c).alias("con_id"),
        bid.alias("bid"),
        F.when(c % 9 == 0, F.lit(-1.0)).when(c % 13 == 0, None).otherwise(bid + F.when(c % 5 == 0, F.lit(4.0)).otherwise(F.lit(0.05))).alias("ask"),
        F.when(c % 6 != 0, F.col("l_quantity") * 10).alias("open_interest"),
        F.when(c % 4 != 1, F.col("l_quantity") * 2).alias("age"),
        F.when(c % 3 == 0, "frozen").when(c % 3 == 1, "mixed").otherwise("live").alias("basis"),
    )


def stages(spark, sf_dir):
    expiries, strikes, listed_later, spots, contracts = listed(spark, sf_dir)
    planned = options.plan_candidates(options.select_expiries(expiries), strikes, spots)
    resolved = options.resolve_strikes(planned, listed_later)
    attached = options.attach_contracts(resolved, contracts)
    quoted = options.attach_quotes(attached, book(spark, sf_dir))
    return planned, resolved, attached, quoted, options.screen(quoted, market_open=False)


KEYS = ["symbol", "bucket", "moneyness"]


@query("expiry_buckets", f"with {LISTED} select * from se")
def expiry_buckets(spark, sf_dir):
    return options.select_expiries(listed(spark, sf_dir)[0])


@query("select_chain", "with c as (select p_type as symbol, p_brand as trading_class, count(distinct p_size) as strike_count from part group by 1, 2) select * from c qualify row_number() over (partition by symbol order by case when upper(trading_class) = upper(symbol) then 0 else 1 end, strike_count desc, trading_class) = 1")
def select_chain(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return options.select_chain(p.groupBy(F.col("p_type").alias("symbol"), F.col("p_brand").alias("trading_class")).agg(F.count_distinct("p_size").alias("strike_count")))


@query("nearest_strike", f"with {LISTED}, g as (select symbol, expiry, spot as target from ex join sp using (symbol)) select g.symbol, g.expiry, target, strike from g {NEAREST.format(t='sk')}")
def nearest_strike(spark, sf_dir):
    expiries, strikes, _, spots, _ = listed(spark, sf_dir)
    targets = expiries.join(spots, "symbol").select("symbol", "expiry", F.col("spot").alias("target"))
    return options.nearest_strike(targets, strikes, ["symbol", "expiry"]).select("symbol", "expiry", "target", "strike")


@query("plan_candidates", f"with {PLAN} select symbol, bucket, moneyness::double as moneyness, expiry, strike, status, round(target, 4) as target from pl")
def plan_candidates(spark, sf_dir):
    return stages(spark, sf_dir)[0].select(*KEYS, "expiry", "strike", "status", F.round("target", 4).alias("target"))


@query("resolve_strikes", f"with {RESOLVED} select symbol, bucket, moneyness::double as moneyness, strike_proposed, strike, status from rs")
def resolve_strikes(spark, sf_dir):
    return stages(spark, sf_dir)[1].select(*KEYS, "strike_proposed", "strike", "status")


@query("attach_contracts", f"with {ATTACHED} select symbol, bucket, moneyness::double as moneyness, con_id, status from ac")
def attach_contracts(spark, sf_dir):
    return stages(spark, sf_dir)[2].select(*KEYS, "con_id", "status")


@query("attach_quotes", f"with {QUOTED} select symbol, bucket, moneyness::double as moneyness, con_id, st as status, round(mid, 6) as mid, round(relative_spread, 6) as relative_spread from aq")
def attach_quotes(spark, sf_dir):
    return stages(spark, sf_dir)[3].select(*KEYS, "con_id", "status", F.round("mid", 6).alias("mid"), F.round("relative_spread", 6).alias("relative_spread"))


@query("screen_candidates", f"with {SCREENED} select symbol, bucket, moneyness::double as moneyness, qualification, reasons, notes, qualification in ('VALID', 'DEGRADED') and reasons = '' as screened from sc")
def screen_candidates(spark, sf_dir):
    return stages(spark, sf_dir)[4].select(*KEYS, "qualification", "reasons", "notes", "screened")


@query("quotable", f"with {RESOLVED} select symbol, bucket, moneyness::double as moneyness, strike from rs where status = 'ok'")
def quotable(spark, sf_dir):
    return options.quotable(stages(spark, sf_dir)[1]).select(*KEYS, "strike")


@query("put_quotes", f"with {QUOTED} select symbol, expiry, strike, bid::double as bid, ask::double as ask, con_id, age::double as age, 100 as multiplier from aq where st = 'priced'")
def put_quotes(spark, sf_dir):
    return options.put_quotes(stages(spark, sf_dir)[3])


@query("screened", f"with {SCREENED} select symbol, bucket, moneyness::double as moneyness, con_id, qualification from sc where qualification in ('VALID', 'DEGRADED') and reasons = ''")
def screened(spark, sf_dir):
    return options.screened(stages(spark, sf_dir)[4]).select(*KEYS, "con_id", "qualification")


@query("median_horizon", f"with {LISTED} select symbol, coalesce(median(case when bucket = '25-60' then days end), 30) as horizon from se group by 1")
def median_horizon(spark, sf_dir):
    return options.median_horizon(options.select_expiries(listed(spark, sf_dir)[0]), "25-60")


@query("spot_of_book", """with q as (select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'frozen' when 1 then 'mixed' else 'live' end as basis, case when l_orderkey % 5 = 0 then null when l_orderkey % 7 = 0 then -1.0 else l_extendedprice end as close, case when l_orderkey % 3 = 0 then null else l_extendedprice * 1.01 end as last from lineitem)
select l_orderkey, l_linenumber, round(case when basis in ('frozen', 'mixed') then coalesce(case when close > 0 then close end, last) else coalesce(last, case when close > 0 then close end) end, 4) as spot from q""")
def spot_of_book(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k, price = F.col("l_orderkey"), F.col("l_extendedprice")
    n = F.col("l_linenumber") % 3
    q = li.select("l_orderkey", "l_linenumber", F.when(n == 0, "frozen").when(n == 1, "mixed").otherwise("live").alias("basis"), F.when(k % 5 == 0, None).when(k % 7 == 0, F.lit(-1.0)).otherwise(price).alias("close"), F.when(k % 3 != 0, price * 1.01).alias("last"))
    return options.spot_of_book(q).select("l_orderkey", "l_linenumber", F.round("spot", 4).alias("spot"))


@query("parse_expiry", "select p_partkey, case p_partkey % 3 when 0 then date '2026-01-01' + cast(p_size as int) when 1 then date '2026-01-01' + cast(p_size as int) end as expiry from part")
def parse_expiry(spark, sf_dir):
    """Compact, dashed and unreadable dates."""
    p = table(spark, sf_dir, "part")
    d = F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.date_format(d, "yyyyMMdd")).when(F.col("p_partkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    return p.select("p_partkey", options.parse_expiry(text).alias("expiry"))


@query("screen_open_market", f"""with {QUOTES}, w as (select con_id, data_type, case when ask > 0 and bid > 0 then (ask - bid) / ask end as sp, open_interest, age, coalesce(ask > 0, false) as priced from quotes)
select con_id % 100 as grp, case when not priced then 'UNAVAILABLE' when sp > 0.15 or open_interest < 100 then 'QUARANTINED' when sp is null or open_interest is null then 'DEGRADED' when data_type in (2, 4) then 'DEGRADED' when age is null or age > 60 then 'DEGRADED' else 'VALID' end as qualification, count(*) as n from w group by 1, 2""")
def screen_open_market(spark, sf_dir):
    q = quotes(spark, sf_dir)
    both = (F.col("ask") > 0) & (F.col("bid") > 0)
    rows = q.withColumns({"status": F.when(F.coalesce(F.col("ask") > 0, F.lit(False)), "priced").otherwise("no_ask"), "relative_spread": F.when(both, (F.col("ask") - F.col("bid")) / F.col("ask")), "basis": F.when(F.col("data_type").isin(2, 4), "frozen").otherwise("live")})
    return options.screen(rows, market_open=True).groupBy((F.col("con_id") % 100).alias("grp"), "qualification").agg(F.count(F.lit(1)).alias("n"))


SIZED = f"""{SCREENED}, sz as (select *, notional / spot as shares, floor(notional / spot / 100) as contracts from sc where st = 'priced'),
pu as (select *, m as move, contracts * (ask * 100 + 0.65) as outlay, contracts * 100 * greatest(strike - spot * (1 + m), 0.0) as payoff, shares * (spot * (1 + m) - spot) as plain from sz, (values (-0.20), (-0.10), (-0.05), (0.0), (0.05), (0.10)) t(m)),
cs as (select con_id, symbol, bucket, moneyness, any_value(outlay) as cost, any_value(notional) as notional, arg_min(plain, move) as plain_worst, arg_min(plain + payoff - outlay, move) as worst, arg_min(plain + payoff - outlay, abs(move)) as flat, arg_max(plain + payoff - outlay, move) as best from pu group by 1, 2, 3, 4)"""


@query("size_protection", f"with {SIZED} select con_id, round(shares, 4) as shares, cast(contracts as bigint) as contracts, round(shares - contracts * 100, 4) as uncovered from sz")
def size_protection(spark, sf_dir):
    s = options.size_protection(stages(spark, sf_dir)[4].where("status = 'priced'"))
    return s.select("con_id", F.round("shares", 4).alias("shares"), "contracts", F.round("uncovered", 4).alias("uncovered"))


@query("put_scenarios", f"with {SIZED} select con_id, bucket, moneyness::double as moneyness, move::double as move, round(outlay, 4) as outlay, round(payoff, 4) as payoff, round(plain + payoff - outlay, 4) as hedged_pnl from pu")
def put_scenarios(spark, sf_dir):
    s = options.put_scenarios(stages(spark, sf_dir)[4].where("status = 'priced'"))
    return s.select("con_id", "bucket", "moneyness", "move", *(F.round(c, 4).alias(c) for c in ("outlay", "payoff", "hedged_pnl")))


@query("candidate_summary", f"with {SIZED} select symbol, bucket, moneyness::double as moneyness, round(cost, 4) as cost, round(worst, 4) as worst, round(flat, 4) as flat, round(best, 4) as best from cs")
def candidate_summary(spark, sf_dir):
    s = options.put_scenarios(stages(spark, sf_dir)[4].where("status = 'priced'")).withColumn("key", F.struct("symbol", "bucket", "moneyness"))
    return options.candidate_summary(s, "key").select("key.*", *(F.round(c, 4).alias(c) for c in ("cost", "worst", "flat", "best")))


HALF = f"""{SCREENED}, sz as (select *, notional / spot as shares, floor(notional / spot * 0.5 / 100) as contracts from sc where st = 'priced')"""


@query("size_half_protection", f"with {HALF} select con_id, cast(contracts as bigint) as contracts, round(contracts * 100 / shares, 6) as coverage_ratio, round(shares - contracts * 100, 4) as uncovered from sz")
def size_half_protection(spark, sf_dir):
    s = options.size_protection(stages(spark, sf_dir)[4].where("status = 'priced'"), coverage=0.5)
    return s.select("con_id", "contracts", F.round("coverage_ratio", 6).alias("coverage_ratio"), F.round("uncovered", 4).alias("uncovered"))


#: Every seventh candidate is made so dear that it can't be afforded; a null cost can.
SHORT = f"""{SIZED}, cc as (select sz.*, case when con_id % 11 = 0 then null else contracts * (ask * 100 + 0.65) / notional * case when con_id % 7 < 3 then 20 else 0.2 end end as cost_share from sz),
ok as (select *, coalesce(cost_share <= 0.05, true) as fits from cc),
ch as (select *, coalesce(case when bool_or(fits and bucket = '60-95') over (partition by symbol) then '60-95' end, min(case when fits then bucket end) over (partition by symbol)) as chosen from ok),
fi as (select *, fits and bucket = chosen and row_number() over (partition by symbol, fits and bucket = chosen, moneyness order by cost_share nulls first, con_id) = 1 as is_first from ch),
pl2 as (select *, coalesce(is_first, false) and row_number() over (partition by symbol order by coalesce(is_first, false) desc, moneyness desc, con_id) <= 3 as taken from fi)"""


@query("shortlist", f"""with {SHORT} select symbol, bucket, moneyness::double as moneyness, con_id, taken as shortlisted,
case when taken then cast(cast(round(moneyness * 100) as int) as varchar) || '% protection depth in ' || bucket when not fits then 'cost over 5% of the notional' else 'not in the chosen horizon' end as reason from pl2""")
def shortlist(spark, sf_dir):
    s = options.size_protection(stages(spark, sf_dir)[4].where("status = 'priced'"))
    share = F.col("contracts") * (F.col("ask") * 100 + 0.65) / F.col("notional")
    s = s.withColumn("cost_share", F.when(F.col("con_id") % 11 != 0, share * F.when(F.col("con_id") % 7 < 3, 20).otherwise(0.2)))
    return options.shortlist(s, horizon="60-95").select(*KEYS, "con_id", "shortlisted", "reason")


@query("payoff_faults", """with r as (select l_orderkey, l_linenumber, case l_orderkey % 9 when 0 then null when 1 then 0.0 else 500.0 end as spot, case l_orderkey % 8 when 0 then 'nan'::double else 100000.0 end as notional, case l_linenumber when 1 then -5.0 else 475.0 end as strike, case l_linenumber when 2 then 'inf'::double else 8.0 end as ask from lineitem)
select l_orderkey, l_linenumber, case when spot is null or spot <= 0 then 'spot isn''t a positive number' when isnan(notional) then 'notional isn''t a positive number' when strike <= 0 then 'strike isn''t a positive number' when isinf(ask) then 'ask isn''t a positive number' end as fault from r""")
def payoff_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(k % 9 == 0, None).when(k % 9 == 1, F.lit(0.0)).otherwise(F.lit(500.0)).alias("spot"),
        F.when(k % 8 == 0, F.lit(float("nan"))).otherwise(F.lit(100000.0)).alias("notional"),
        F.when(n == 1, F.lit(-5.0)).otherwise(F.lit(475.0)).alias("strike"),
        F.when(n == 2, F.lit(float("inf"))).otherwise(F.lit(8.0)).alias("ask"),
    )
    return rows.select("l_orderkey", "l_linenumber", options.payoff_fault().alias("fault"))


@query("data_status", f"with {QUOTED} select symbol, case when bool_or(st = 'priced') then 'screened_out' else 'data_insufficient' end as data_status from aq group by 1")
def data_status(spark, sf_dir):
    return options.data_status(stages(spark, sf_dir)[3])


MOVES6 = "(values (-0.20), (-0.10), (-0.05), (0.0), (0.05), (0.10)) t(m)"
REDUCED = f"rx as (select symbol, notional, m, notional * 0.2 * 2.0 / 10000 as cost, (notional * 0.2 - notional * 0.2 * 2.0 / 10000) * 0.04 * 30 / 365 as carry from sp, {MOVES6})"


@query("reduced_exposure", f"with {LISTED}, {REDUCED} select symbol, m::double as move, round(cost, 4) as cost, round(carry, 4) as carry, round(notional * 0.8 * m + carry - cost, 4) as pnl from rx")
def reduced_exposure(spark, sf_dir):
    r = options.reduced_exposure(listed(spark, sf_dir)[3], cash_rate=0.04)
    return r.select("symbol", "move", *(F.round(c, 4).alias(c) for c in ("cost", "carry", "pnl")))


CONTROLS = f"""{REDUCED}, cn as (select symbol, 'no new protection' as label, 'unhedged' as structure, 0.0 as cost, notional, arg_min(notional * m, m) as worst, arg_min(notional * m, m) as unhedged_worst, arg_min(notional * m, abs(m)) as flat, arg_max(notional * m, m) as best from sp, {MOVES6} group by symbol, notional
union all select symbol, 'reduce to 80%', 'de-risked', any_value(cost), any_value(notional), arg_min(notional * 0.8 * m + carry - cost, m), arg_min(notional * m, m), arg_min(notional * 0.8 * m + carry - cost, abs(m)), arg_max(notional * 0.8 * m + carry - cost, m) from rx group by symbol)"""


@query("control_summary", f"with {LISTED}, {CONTROLS} select symbol, label, structure, cast(null as double) as strike, 0.0::double as coverage_ratio, round(cost, 4) as cost, round(cost / notional, 8) as cost_share, round(worst, 4) as worst, round(unhedged_worst, 4) as unhedged_worst, round(worst - unhedged_worst, 4) as protection_at_worst, round(flat, 4) as flat, round(best, 4) as best from cn")
def control_summary(spark, sf_dir):
    c = options.controls(listed(spark, sf_dir)[3], cash_rate=0.04)
    return c.select("symbol", "label", "structure", "strike", "coverage_ratio", F.round("cost_share", 8).alias("cost_share"), *(F.round(x, 4).alias(x) for x in ("cost", "worst", "unhedged_worst", "protection_at_worst", "flat", "best")))


@query("protection_table", f"""with {SIZED.replace("from sc where st = 'priced'", "from sc where qualification in ('VALID', 'DEGRADED') and reasons = ''")}, {CONTROLS.replace("0.04", "0.0")},
ca as (select *, cost / notional as cost_share, coalesce(cost / notional <= 0.05, true) as fits from cs),
ch as (select *, min(case when fits then bucket end) over (partition by symbol) as chosen from ca),
fi as (select *, fits and bucket = chosen and row_number() over (partition by symbol, fits and bucket = chosen, moneyness order by cost_share nulls first, con_id) = 1 as is_first from ch),
ta as (select *, coalesce(is_first, false) and row_number() over (partition by symbol order by coalesce(is_first, false) desc, moneyness desc, con_id) <= 3 as taken from fi)
select symbol, 'protective put' as structure, con_id, round(cost, 4) as cost, round(worst, 4) as worst, round(flat, 4) as flat, round(best, 4) as best, round(worst - plain_worst, 4) as protection_at_worst, taken as shortlisted from ta
union all select symbol, structure, null, round(cost, 4), round(worst, 4), round(flat, 4), round(best, 4), round(worst - unhedged_worst, 4), null from cn""")
def protection_table(spark, sf_dir):
    """The whole analysis of every symbol, its controls beside the candidates."""
    expiries, strikes, later, spots, contracts = listed(spark, sf_dir)
    t = options.protection_table(expiries, strikes, later, spots, contracts, book(spark, sf_dir))
    return t.select("symbol", "structure", "con_id", *(F.round(c, 4).alias(c) for c in ("cost", "worst", "flat", "best", "protection_at_worst")), "shortlisted")


@query("no_protection", f"with {LISTED} select symbol, m::double as move, round(notional * m, 4) as pnl from sp, (values (-0.20), (-0.10), (-0.05), (0.0), (0.05), (0.10)) t(m)")
def no_protection(spark, sf_dir):
    return options.no_protection(listed(spark, sf_dir)[3]).select("symbol", "move", F.round("pnl", 4).alias("pnl"))


PARITY = f"""{CHAIN}, y as (select *, call_mid - put_mid as y from chain),
ft as (select expiry, days, regr_slope(y, strike) as slope, regr_intercept(y, strike) as intercept, count(*) as pairs from y group by 1, 2),
rd as (select expiry, days, any_value(slope) as slope, any_value(intercept) as intercept, any_value(pairs) as pairs, max(abs(y - intercept - slope * strike)) as worst, bool_or(abs(y - intercept - slope * strike) > 2 * half_spread) as broken from y join ft using (expiry, days) group by 1, 2),
pa as (select *, case when pairs < 2 then 'too_few_pairs' when not (slope between -1.05 and -0.90) then 'slope_out_of_band' when pairs = 2 then 'slope_only' when broken then 'violated' else 'ok' end as status from rd)"""


@query("put_call_parity", f"with {PARITY} select expiry, days, pairs, round(slope, 6) as slope, round(case when slope < 0 then -intercept / slope end, 4) as forward, round(case when slope < 0 then -ln(-slope) / (days / 365) end, 6) as rate, round(worst, 6) as worst, status from pa")
def put_call_parity(spark, sf_dir):
    p = options.put_call_parity(chain(spark, sf_dir))
    return p.select("expiry", "days", "pairs", F.round("slope", 6).alias("slope"), F.round("forward", 4).alias("forward"), F.round("rate", 6).alias("rate"), F.round("worst", 6).alias("worst"), "status")


@query("parity_verdict", f"with {PARITY} select count(*) as n, case when count(*) = 0 then 'unverified' when bool_and(status = 'ok') then 'ok' when bool_or(status in ('violated', 'slope_out_of_band')) then 'failed' else 'unverified' end as verdict from pa")
def parity_verdict(spark, sf_dir):
    return options.parity_verdict(options.put_call_parity(chain(spark, sf_dir)))


@query("staleness", f"with {QUOTES} select part, array_to_string(list_sort(list(distinct cast(data_type as varchar))), ',') as types, case when bool_and(data_type in (2, 4)) then 'frozen' when bool_or(data_type in (2, 4)) then 'mixed' else 'live' end as basis, case when not bool_and(data_type in (2, 4)) then max(age) end as oldest_age, case when bool_or(data_type in (2, 4)) then date '2001-06-29' end as book_session, case when bool_or(data_type in (2, 4)) then 60.0::double end as book_age_hours from quotes group by 1")
def staleness(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("data_type", F.col("data_type").cast("int"))
    return options.staleness(q, "2001-06-29", "2001-06-29 20:00:00", "2001-07-02 08:00:00")


@query("put_call_pairs", f"with {CHAIN}, l as (select expiry, strike, 'P' as side, put_mid as mid from chain union all select expiry, strike, 'C', call_mid from chain where cast(strike as int) % 3 > 0) select expiry, strike, round(max(mid) filter (where side = 'P'), 6) as put_mid, round(max(mid) filter (where side = 'C'), 6) as call_mid from l group by 1, 2 having count(distinct side) = 2")
def put_call_pairs(spark, sf_dir):
    c = chain(spark, sf_dir)
    long = c.select("expiry", "strike", F.lit("P").alias("side"), F.col("put_mid").alias("mid")).unionByName(c.select("expiry", "strike", F.lit("C").alias("side"), F.when(F.col("strike").cast("int") % 3 > 0, F.col("call_mid")).alias("mid")))
    wide = long.groupBy("expiry", "strike").pivot("side", ["P", "C"]).agg(F.avg("mid"))
    return wide.where("P is not null and C is not null").select("expiry", "strike", F.round("P", 6).alias("put_mid"), F.round("C", 6).alias("call_mid"))
