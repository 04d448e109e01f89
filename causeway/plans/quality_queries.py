"""Queries of findings, source health and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.operators import quality
from causeway.plans.inputs import BARS, PX, PX5, SECOND, SYMBOLS, QUOTES, bars, px, px5, quotes, second_source, table
from causeway.plans.registry import query

V = "over (partition by symbol order by session)"
WHOLE = "open is not null and high is not null and low is not null and close is not null"
SCALE = """rt as (select *, case when lag(close) {V} <> 0 then close / lag(close) {V} end as ratio from bars),
sc as (select *, case when ratio > 0 then round_even(log10(ratio), 0) end as k from rt),
sb as (select *, case when k <> 0 and abs(ratio / pow(10.0, k) - 1) <= 0.02 then pow(10.0, k) end as scale from sc)""".replace("{V}", V)
ISSUES = f"""{BARS}, {SCALE}, iss as (
{' union all '.join(f"select symbol, session, 'price_not_finite' as code, 'quarantine' as severity, '{c}' as detail, 'training,day_end,quotes' as blocks from sb where {c} is null union all select symbol, session, 'price_not_positive', 'quarantine', '{c}', 'training,day_end,quotes' from sb where {c} <= 0" for c in ('open', 'high', 'low', 'close'))}
union all select symbol, session, 'ohlc_inverted', 'quarantine', null, 'training,day_end,quotes' from sb where {WHOLE} and high < low
union all select symbol, session, 'ohlc_bounds_violated', 'quarantine', 'open', 'training,day_end,quotes' from sb where {WHOLE} and (open < low or open > high)
union all select symbol, session, 'ohlc_bounds_violated', 'quarantine', 'close', 'training,day_end,quotes' from sb where {WHOLE} and (close < low or close > high)
union all select symbol, session, 'price_scale_break', 'quarantine', null, 'training,day_end,quotes' from sb where scale is not null
union all select symbol, session, 'large_price_move', 'review', null, '' from sb where scale is null and ratio > 0 and abs(ratio - 1) > 0.20
union all select symbol, session, 'volume_unit_undeclared', 'note', null, '' from sb where volume_unit is null
union all select symbol, session, 'volume_missing', 'note', null, '' from sb where volume is null
union all select symbol, session, 'volume_zero', 'note', null, '' from sb where volume = 0)"""


@query("validate_bars", f"with {ISSUES} select symbol, session, code, severity, detail, blocks from iss")
def validate_bars(spark, sf_dir):
    return quality.validate_bars(bars(spark, sf_dir)).withColumn("blocks", F.array_join("blocks", ","))


@query("scale_break", f"with {BARS}, {SCALE} select symbol, session, scale from sb where scale is not null")
def scale_break(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("ratio", F.try_divide(F.col("close"), F.lag("close").over(ts.series("symbol"))))
    return rows.withColumn("scale", ts.scale_factor(F.col("ratio"))).where("scale is not null").select("symbol", "session", "scale")


@query("volume_checks", f"with {ISSUES} select symbol, code, count(*) as n from iss where code like 'volume%' group by 1, 2")
def volume_checks(spark, sf_dir):
    return quality.validate_bars(bars(spark, sf_dir)).where("code like 'volume%'").groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"))


@query("issue_summary", f"with {ISSUES} select code, severity, count(*) as n, count(distinct symbol) as subjects, case when severity = 'quarantine' then 'day_end,quotes,training' else '' end as blocked from iss group by 1, 2")
def issue_summary(spark, sf_dir):
    return quality.issue_summary(quality.validate_bars(bars(spark, sf_dir)))


@query("issues_by_severity_rollup", f"with {ISSUES} select severity, code, count(*) as n from iss group by rollup (severity, code)")
def issues_rollup(spark, sf_dir):
    return quality.validate_bars(bars(spark, sf_dir)).rollup("severity", "code").agg(F.count(F.lit(1)).alias("n"))


STRUCTURAL = ", ".join(f"'{c}'" for c in quality.STRUCTURAL)


@query("crisis_gate", f"with {ISSUES} select symbol, count(i.code) as structural, count(i.code) = 0 as allowed from (select distinct symbol from bars) b left join iss i using (symbol) where i.code is null or i.code in ({STRUCTURAL}) group by 1")
def crisis_gate(spark, sf_dir):
    b = bars(spark, sf_dir)
    return quality.crisis_gate(quality.validate_bars(b), b.select("symbol").distinct())


@query("drop_quarantined", f"with {ISSUES} select symbol, session, close from bars b where not exists (select 1 from iss i where i.symbol = b.symbol and i.session = b.session and severity = 'quarantine')")
def drop_quarantined(spark, sf_dir):
    b = bars(spark, sf_dir)
    return quality.drop_quarantined(b, quality.validate_bars(b)).select("symbol", "session", "close")


#: Some cells are null, so that rows can differ in where a null stands.
DUPES = "dup as (select l_suppkey as symbol, cast(l_shipdate as date) as session, case when l_linenumber % 3 > 0 then l_linestatus end as close, case when l_linenumber % 3 = 0 then l_linestatus end as flag from lineitem)"


@query("duplicate_rows", f"with {DUPES} select symbol, session, case when count(distinct (coalesce(close, '-'), coalesce(flag, '-'))) = 1 then 'duplicate_row_identical' else 'duplicate_row_conflict' end as code, case when count(distinct (coalesce(close, '-'), coalesce(flag, '-'))) = 1 then 'note' else 'quarantine' end as severity, count(*) as rows from dup group by 1, 2 having count(*) > 1")
def duplicate_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return quality.duplicate_rows(li.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("session"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linestatus")).alias("close"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linestatus")).alias("flag")))


BOOK = "bid is not null and ask is not null"


@query("validate_quotes", f"""with {QUOTES}
select con_id, 'crossed_book' as code, 'review' as severity from quotes where {BOOK} and bid > ask
union all select con_id, 'zero_bid', 'note' from quotes where bid = 0 union all select con_id, 'implied_vol_sentinel', 'note' from quotes where implied_volatility <= 0
union all select con_id, 'last_outside_book', 'note' from quotes where {BOOK} and (last < bid or last > ask)""")
def validate_quotes(spark, sf_dir):
    return quality.validate_quotes(quotes(spark, sf_dir)).select("con_id", "code", "severity")


@query("validate_frozen_quotes", f"""with {QUOTES}, i as (
select 'crossed_book' as code from quotes where {BOOK} and bid > ask union all select 'zero_bid' from quotes where bid = 0 union all select 'implied_vol_sentinel' from quotes where implied_volatility <= 0)
select code, count(*) as n, cast(null as varchar) as detail from i group by 1
union all select 'last_outside_frozen_book', 1, cast(count(*) as varchar) from quotes where {BOOK} and (last < bid or last > ask)""")
def validate_frozen_quotes(spark, sf_dir):
    return quality.validate_quotes(quotes(spark, sf_dir), frozen=True).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("detail").alias("detail"))


@query("stale_series", """with st as (select l_suppkey as symbol, cast(l_shipdate as date) as k, max(l_linestatus) as close from lineitem group by 1, 2),
n as (select *, coalesce(cast(close is distinct from lag(close) over (partition by symbol order by k) as int), 1) as new from st),
r as (select *, sum(new) over (partition by symbol order by k) as run from n),
g as (select symbol, run, count(*) as length, min(k) as starts from r group by 1, 2)
select symbol, length, starts from g qualify row_number() over (partition by symbol order by length desc, run) = 1 and length >= 5""")
def stale_series(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return quality.stale_series(li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("session")).agg(F.max("l_linestatus").alias("close")))


ACTIONS = """act as (select symbol, session as effective_at, session - cast(case when i % 2 = 0 then 10 else -5 end as int) as known_at, case when i % 3 = 0 then 'dividend' else 'split' end as kind,
       case when i % 3 <> 0 then 1 / (1 + move) * case when i % 5 = 0 then 1.5 else 1.0 end end as ratio, i as action_id from mv),
ok as (select * from act where known_at <= date '1999-01-01')"""
MOVES = f"{PX}, mv as (select symbol, session, i, p / lag(p) {V} - 1 as move from px qualify abs(move) > 0.03)"


@query("attribute_moves", f"""with {MOVES}, {ACTIONS},
j as (select m.symbol, m.session, m.move, min(case when kind = 'dividend' or abs((1 + m.move) * ratio - 1) <= 0.02 then action_id end) as action_id from mv m left join ok a on a.symbol = m.symbol and a.effective_at = m.session group by 1, 2, 3)
select symbol, session, round(move, 6) as move, action_id, case when action_id is null then 'large_price_move' else 'move_explained_by_corporate_action' end as code, case when action_id is null then 'review' else 'note' end as severity from j""")
def attribute_moves(spark, sf_dir):
    x = px(spark, sf_dir).withColumn("move", ts.pct_change(F.col("p"), ts.series("symbol"))).where("abs(move) > 0.03")
    dividend = F.col("i") % 3 == 0
    actions = x.select(
        "symbol",
        F.col("session").alias("effective_at"),
        F.date_sub("session", F.when(F.col("i") % 2 == 0, 10).otherwise(-5)).alias("known_at"),
        F.when(dividend, "dividend").otherwise("split").alias("kind"),
        F.when(~dividend, 1 / (1 + F.col("move")) * F.when(F.col("i") % 5 == 0, 1.5).otherwise(1.0)).alias("ratio"),
        F.col("i").cast("long").alias("action_id"),
    )
    return quality.attribute_moves(x.select("symbol", "session", "move"), actions, "1999-01-01")


MANIFEST = """mf as (select 'd' || (l_suppkey % 10) as dataset, 's' || l_suppkey as provider, case when l_suppkey % 9 = 0 then 'failed' when l_suppkey % 8 = 0 then 'fixture' else 'ok' end as status,
       count(distinct cast(l_shipdate as date)) as rows, min(cast(l_shipdate as date)) as earliest, max(cast(l_shipdate as date)) as latest from lineitem group by l_suppkey),
ru as (select 'd' || k as dataset, k % 2 = 0 as required, cast(k * 4 as int) as max_age, k * 0.7 as min_history, cast(k * 100 as int) as min_rows, k * 0.05 as min_density from range(0, 8) t(k)),
wd as (select *, list_sum([case when isodow(d) < 6 then 1 else 0 end for d in generate_series(latest::timestamp, timestamp '2001-11-09', interval 1 day)]) - 1 as age, datediff('day', earliest, date '2001-11-09') / 365.25 as history,
       least(1.0, rows / list_sum([case when isodow(d) < 6 then 1 else 0 end for d in generate_series(earliest::timestamp, latest::timestamp, interval 1 day)])) as density from mf left join ru using (dataset)),
he as (select dataset, provider, coalesce(required, false) as required, cast(age as bigint) as age, round(history, 6) as history, round(density, 6) as density,
       case when status = 'failed' then 'failed' when not coalesce(age <= coalesce(max_age, 5), false) then 'stale'
            when status <> 'fixture' and not (history >= coalesce(min_history, 0) and rows >= coalesce(min_rows, 1) and density >= coalesce(min_density, 0)) then 'truncated' else 'ok' end as health from wd)"""


def health(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    day = F.to_date("l_shipdate")
    m = li.groupBy("l_suppkey").agg(F.count_distinct(day).alias("rows"), F.min(day).alias("earliest"), F.max(day).alias("latest"))
    m = m.select(F.concat(F.lit("d"), (k % 10).cast("string")).alias("dataset"), F.concat(F.lit("s"), k.cast("string")).alias("provider"), F.when(k % 9 == 0, "failed").when(k % 8 == 0, "fixture").otherwise("ok").alias("status"), "rows", "earliest", "latest")
    r = F.col("id")
    rules = spark.range(8).select(F.concat(F.lit("d"), r.cast("string")).alias("dataset"), (r % 2 == 0).alias("required"), (r * 4).cast("int").alias("max_age"), (r * 0.7).alias("min_history"), (r * 100).cast("int").alias("min_rows"), (r * 0.05).alias("min_density"))
    return quality.manifest_health(m, rules, "2001-11-09")


@query("manifest_health", f"with {MANIFEST} select *, health = 'ok' as eligible from he")
def manifest_health(spark, sf_dir):
    return health(spark, sf_dir)


@query("required_failures", f"with {MANIFEST} select dataset from he where required group by 1 having not bool_or(health = 'ok')")
def required_failures(spark, sf_dir):
    return quality.required_failures(health(spark, sf_dir))


@query("observation_density", f"with {MANIFEST} select dataset, round(avg(density), 6) as density, min(age) as age from he group by 1")
def observation_density(spark, sf_dir):
    return health(spark, sf_dir).groupBy("dataset").agg(F.round(F.avg("density"), 6).alias("density"), F.min("age").alias("age"))


TOLERANCE = f"""{SECOND}, jn as (select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.session, b.session) as session, a.p as a, b.p as b from px a full join px2 b on a.symbol = b.symbol and a.session = b.session),
tn as (select symbol, abs(a / b - 1) as x from jn where a is not null and b is not null qualify row_number() over (partition by symbol order by session desc) <= 250),
tm as (select symbol, median(x) as med, count(*) as points from tn group by 1),
tl as (select symbol, points, case when points < 2 then 5e-5 else greatest(med + 6 * mad, 5e-5) end as tolerance from (select symbol, any_value(points) as points, any_value(med) as med, median(abs(x - med)) as mad from tn join tm using (symbol) group by 1)),
rc as (select symbol, session, round(abs(a / b - 1), 6) as difference, case when b is null then 'date_only_in_primary' when a is null then 'date_only_in_secondary' when abs(a / b - 1) > tolerance then 'sources_disagree' else 'agrees' end as code from jn left join tl using (symbol))"""


@query("measured_tolerance", f"with {TOLERANCE} select symbol, points, round(tolerance, 8) as tolerance from tl")
def measured_tolerance(spark, sf_dir):
    t = quality.measured_tolerance(quality.aligned(px(spark, sf_dir), second_source(spark, sf_dir)))
    return t.select("symbol", "points", F.round("tolerance", 8).alias("tolerance"))


@query("reconcile_closes", f"with {TOLERANCE} select *, case code when 'sources_disagree' then 'review' when 'agrees' then null else 'note' end as severity from rc")
def reconcile_closes(spark, sf_dir):
    return quality.reconcile(px(spark, sf_dir), second_source(spark, sf_dir))


@query("source_only_dates", f"with {SECOND} select symbol, session from px a where not exists (select 1 from px2 b where a.symbol = b.symbol and a.session = b.session)")
def source_only_dates(spark, sf_dir):
    return px(spark, sf_dir).join(second_source(spark, sf_dir).where("p is not null"), ["symbol", "session"], "left_anti").select("symbol", "session")


@query("reconciliation_summary", f"with {TOLERANCE} select symbol, count(*) filter (where code in ('agrees', 'sources_disagree')) as common, count(*) filter (where code = 'sources_disagree') as disagreements, max(difference) as worst, first(session order by coalesce(difference, -1) desc, session) as worst_session, bool_or(code = 'agrees') as overlap, coalesce(bool_and(code = 'agrees') filter (where code in ('agrees', 'sources_disagree')), false) as agreed from rc group by 1")
def reconciliation_summary(spark, sf_dir):
    return quality.reconciliation_summary(quality.reconcile(px(spark, sf_dir), second_source(spark, sf_dir)))


CONFIRM = """ra as (select symbol, session, p, p / lag(p) {V} - 1 as r from px), rb as (select symbol, session, p, p / lag(p) {V} - 1 as r from px2),
mv as (select * from ra where abs(r) > 0.02), cm as (select a.symbol, a.session, abs(a.p / b.p - 1) as x from ra a join rb b using (symbol, session)),
nr as (select m.symbol, m.session, x from mv m join cm j on j.symbol = m.symbol and j.session < m.session qualify row_number() over (partition by m.symbol, m.session order by j.session desc) <= 250),
nm as (select symbol, session, median(x) as med from nr group by 1, 2),
nd as (select symbol, session, any_value(med) as med, median(abs(x - med)) as mad, count(*) as points from nr join nm using (symbol, session) group by 1, 2),
cf as (select m.symbol, m.session, m.r as ra, case when b.r is null then 'move_unconfirmable' when abs(m.r - b.r) <= greatest(2 * case when coalesce(points, 0) < 2 then 5e-5 else greatest(med + 6 * mad, 5e-5) end, 0.005) then 'move_confirmed' else 'move_unconfirmed' end as code
       from mv m left join rb b using (symbol, session) left join nd using (symbol, session))""".replace("{V}", V)


@query("confirm_move", f"with {SECOND}, {CONFIRM} select symbol, session, round(ra, 6) as move, code, case when code = 'move_confirmed' then 'note' else 'review' end as severity from cf")
def confirm_move(spark, sf_dir):
    return quality.confirm_moves(px(spark, sf_dir), second_source(spark, sf_dir))


@query("union_issues", f"with {ISSUES}, n as (select symbol, min(session) as session from iss where severity = 'quarantine' group by 1) select symbol, code, severity, count(*) as n from (select symbol, code, severity from iss union all select symbol, 'agreement_does_not_clear_quarantine', 'note' from n) group by 1, 2, 3")
def union_issues(spark, sf_dir):
    """Agreement of another source adds a note where something is quarantined; it never clears it."""
    issues = quality.validate_bars(bars(spark, sf_dir)).select("symbol", "code", "severity")
    return quality.agreement_cannot_clear(issues).groupBy("symbol", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


#: Five symbols seen by a second source: one trades under another convention, one shares no session.
FIVE = f"""{PX5}, s5 as (select symbol, case when symbol = 'lqd' then session + 10000 else session end as session, p * (1 + 1e-6 * ((i % 5) - 2)) * case when symbol = 'iwm' and i % 401 = 7 then 1.1 else 1.0 end as p from px5 where i % 89 <> 3),
j5 as (select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.session, b.session) as session, a.p as a, b.p as b from px5 a full join s5 b on a.symbol = b.symbol and a.session = b.session),
t5 as (select symbol, abs(a / b - 1) as x from j5 where a is not null and b is not null qualify row_number() over (partition by symbol order by session desc) <= 250),
m5 as (select symbol, median(x) as med, count(*) as points from t5 group by 1),
l5 as (select symbol, case when points < 2 then 5e-5 else greatest(med + 6 * mad, 5e-5) end as tolerance from (select symbol, any_value(points) as points, any_value(med) as med, median(abs(x - med)) as mad from t5 join m5 using (symbol) group by 1)),
r5 as (select symbol, session, case when b is null then 'date_only_in_primary' when a is null then 'date_only_in_secondary' when abs(a / b - 1) > tolerance then 'sources_disagree' else 'agrees' end as code from j5 left join l5 using (symbol) where symbol <> 'hyg'
       union all select 'lqd', null, 'no_overlap' union all select 'hyg', null, 'convention_mismatch')"""


def five(spark, sf_dir):
    a = px5(spark, sf_dir)
    i = F.col("i")
    other = F.when((F.col("symbol") == "iwm") & (i % 401 == 7), 1.1).otherwise(1.0)
    b = a.select("symbol", F.when(F.col("symbol") == "lqd", F.date_add("session", 10000)).otherwise(F.col("session")).alias("session"), F.when(i % 89 != 3, F.col("p") * (1 + 1e-6 * ((i % 5) - 2)) * other).alias("p"))
    rows = [(s, source, "adjusted" if s == "hyg" and source == "second" else "raw", "regular", "USD", "shares") for s in SYMBOLS.values() for source in ("first", "second")]
    return a, b, spark.createDataFrame(rows, "symbol string, source string, price string, session_kind string, currency string, volume_unit string")


@query("reconcile_conventions", f"with {FIVE} select symbol, code, count(*) as n, min(session) as first_session from r5 group by 1, 2")
def reconcile_conventions(spark, sf_dir):
    """Symbols under different conventions aren't compared; those without a common session say so."""
    return quality.reconcile(*five(spark, sf_dir)).groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first_session"))


@query("convention_comparable", "select * from (values ('spy', true), ('rsp', true), ('iwm', true), ('hyg', false), ('lqd', true)) t(symbol, comparable)")
def convention_comparable(spark, sf_dir):
    return quality.comparable(five(spark, sf_dir)[2])


@query("cross_source", f"""with {FIVE}, {CONFIRM.replace("from px2", "from s5").replace("from px)", "from px5)")},
d as (select symbol, count(*) filter (where code = 'sources_disagree') as disagreements, count(*) filter (where code in ('agrees', 'sources_disagree')) as common, bool_or(code = 'convention_mismatch') as mismatch from r5 group by 1),
c as (select symbol, count(*) filter (where code = 'move_confirmed') as confirmed, count(*) filter (where code <> 'move_confirmed') as unconfirmed from cf group by 1)
select symbol, case when mismatch then 'convention_mismatch' when common = 0 then 'unverified' when disagreements > 0 then 'disagreed' else 'agreed' end as verdict, disagreements, coalesce(confirmed, 0) as confirmed, coalesce(unconfirmed, 0) as unconfirmed from d left join c using (symbol)""")
def cross_source(spark, sf_dir):
    return quality.cross_source(*five(spark, sf_dir))


@query("unverifiable", "select distinct l_returnflag as symbol, 'no_independent_source' as code, 'note' as severity, 'quotes come from one feed' as detail from lineitem")
def unverifiable(spark, sf_dir):
    return quality.unverifiable(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct(), "quotes come from one feed")


@query("stability_only", "select l_returnflag as symbol, count(l_extendedprice) as reads, round(max(l_extendedprice) / min(l_extendedprice) - 1, 6) as spread, 'same_source_stability' as code, 'note' as severity from lineitem group by 1")
def stability_only(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_extendedprice").alias("value"))
    return quality.stability_only(reads).withColumn("spread", F.round("spread", 6))


@query("substitutions", "select distinct l_returnflag as symbol, cast(l_linenumber as varchar) as replaced_source, l_linestatus as replacement_source, 'feed ended' as substitution_reason, true as must_pass_same_gates from lineitem")
def substitutions(spark, sf_dir):
    swaps = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_linenumber").cast("string").alias("replaced"), F.col("l_linestatus").alias("replacement"), F.lit("feed ended").alias("reason")).distinct()
    return quality.substitutions(swaps)


@query("actions_rejected", """with a as (select o_orderkey as action_id, case o_orderkey % 5 when 0 then 'merger' when 1 then 'dividend' else 'split' end as kind, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then -1.0 else 2.0 end as ratio,
cast(o_orderdate as date) as effective_at, case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) - cast(o_custkey % 500 as int) end as known_at from orders)
select action_id, case when kind not in ('split', 'dividend') then 'unknown kind' when kind = 'split' and not coalesce(ratio > 0, false) then 'split without a ratio' when known_at is null then 'no date' when known_at < effective_at - 365 then 'known more than a year early' end as reason from a where reason is not null""")
def actions_rejected(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    actions = o.select(
        k.alias("action_id"),
        F.when(k % 5 == 0, "merger").when(k % 5 == 1, "dividend").otherwise("split").alias("kind"),
        F.when(k % 7 == 0, None).when(k % 11 == 0, F.lit(-1.0)).otherwise(F.lit(2.0)).alias("ratio"),
        day.alias("effective_at"),
        F.when(k % 13 != 0, F.date_sub(day, (F.col("o_custkey") % 500).cast("int"))).alias("known_at"),
    )
    return quality.actions_rejected(actions).select("action_id", "reason")


@query("reported_move", "select l_orderkey, l_linenumber, (l_linenumber - 4) / 100 as move from (select l_orderkey, l_linenumber from lineitem)")
def reported_move(spark, sf_dir):
    """A move written into a finding's text and read back."""
    li = table(spark, sf_dir, "lineitem")
    percent = (F.col("l_linenumber") - 4).cast("int")
    text = F.concat(F.lit("close moved "), F.when(percent >= 0, F.lit("+")).otherwise(F.lit("")), percent.cast("string"), F.lit(".0% against the bar before"))
    return li.select("l_orderkey", "l_linenumber", quality.reported_move(text).alias("move"))


@query("tolerance_before", f"""with {SECOND}, cm as (select a.symbol, a.session, abs(a.p / b.p - 1) as x from px a join px2 b using (symbol, session)),
ls as (select symbol, session, list(x) over (partition by symbol order by session rows between 250 preceding and 1 preceding) as l from cm),
md as (select symbol, session, l, list_median(l) as med from ls)
select symbol, session, round(case when coalesce(len(l), 0) < 2 then 5e-5 else greatest(med + 6 * list_median(list_transform(l, lambda v: abs(v - med))), 5e-5) end, 8) as band from md""")
def tolerance_before(spark, sf_dir):
    """The band of each common session from those strictly before it."""
    both = quality.aligned(px(spark, sf_dir), second_source(spark, sf_dir)).where("a is not null and b is not null")
    return quality.tolerance_before(both).select("symbol", "session", F.round("band", 8).alias("band"))
