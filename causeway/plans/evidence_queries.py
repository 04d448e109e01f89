"""Queries of indicators and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import evidence
from causeway.plans.inputs import MACRO, PX5, macro, px5
from causeway.plans.registry import query

V = "over (order by session"
FULL = "case when count({c}) over (order by session rows between {k} preceding and current row) = {n} then {f}({c}) over (order by session rows between {k} preceding and current row) end"
roll = lambda f, c, n: FULL.format(f=f, c=c, n=n, k=n - 1)
pair = lambda name, a, b: f"select session, '{name}' as name, x / lag(x, 63) {V}) - 1 as value from (select a.session, a.p / b.p as x from px5 a join px5 b on a.session = b.session and a.symbol = '{a}' and b.symbol = '{b}')"
VALUES = f"""{PX5}, {MACRO},
y0 as (select session, row_number() {V}) - 1 as j, p, p / lag(p) {V}) - 1 as r from px5 where symbol = 'spy'),
y1 as (select *, count(r) over w as n, sum(case when r is not null then pow(0.94, -j) end) over w as s0, sum(pow(0.94, -j) * r) over w as s1, sum(pow(0.94, -j) * r * r) over w as s2,
       sum(case when r is not null then pow(0.94 * 0.94, -j) end) over w as ss, {roll('stddev_samp', 'r', 20)} * sqrt(252) as v20, {roll('stddev_samp', 'r', 60)} * sqrt(252) as v60
       from y0 window w as (order by session rows between unbounded preceding and current row)),
own as (select session, p / {roll('avg', 'p', 200)} - 1 as spy_vs_200d_ma, p / lag(p, 63) {V}) - 1 as spy_return_63d, p / {roll('max', 'p', 252)} - 1 as spy_drawdown_252d,
       v20 * 100 as realised_vol_20d, v60 * 100 as realised_vol_60d, v20 / v60 as vol_ratio_20_over_60,
       case when n >= 60 then sqrt(greatest(0, (s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - ss))) * sqrt(252) * 100 end as ewma_vol_lambda94 from y1),
vals as ({' union all '.join(f"select session, '{c}' as name, {c} as value from own" for c in ('spy_vs_200d_ma', 'spy_return_63d', 'spy_drawdown_252d', 'realised_vol_20d', 'realised_vol_60d', 'vol_ratio_20_over_60', 'ewma_vol_lambda94'))}
       union all {pair('rsp_over_spy', 'rsp', 'spy')} union all {pair('iwm_over_spy', 'iwm', 'spy')} union all {pair('hyg_over_lqd', 'hyg', 'lqd')} union all select session, series, value from macro),
cat as (select * from (values {', '.join(f"('{n}', '{d}', {str(u).lower()}, {repr(o) if o else 'cast(null as varchar)'})" for n, (d, u, o) in evidence.CATALOGUE.items())}) t(name, dimension, riskier, overlap_with)),
vc as (select *, value - lag(value, 1) over w as change_1, value - lag(value, 5) over w as change_5, value - lag(value, 20) over w as change_20, row_number() over (partition by name order by session desc) as k, count(*) over (partition by name) as n from vals where value is not null window w as (partition by name order by session)),
ls as (select * from vc where k = 1),
rk as (select l.name, count(case when v.value < l.value then 1 end) as below, count(*) as earlier from ls l join vc v on v.name = l.name and v.session < l.session group by 1),
cv as (select name, avg(case when value is not null then 1 else 0 end) as coverage from (select * from vals qualify row_number() over (partition by name order by session desc) <= 252) group by 1),
e1 as (select name, dimension, riskier, overlap_with, session as as_of, value, change_1, change_5, change_20, case when n >= 252 then below / earlier end as percentile, coverage from ls left join rk using (name) left join cv using (name) left join cat using (name)),
ev as (select *, case when change_20 is null or abs(change_20) < 1e-12 then 'stable' when (change_20 > 0) = riskier then 'deteriorating' else 'easing' end as direction, case when riskier then percentile else 1 - percentile end as risk_rank from e1)"""
NUMBERS = ("value", "change_1", "change_5", "change_20", "percentile", "coverage", "risk_rank")


def found(spark, sf_dir):
    return evidence.evidence(evidence.indicator_values(px5(spark, sf_dir), macro(spark, sf_dir)))


@query("evidence_table", f"with {VALUES} select name, dimension, riskier, overlap_with, as_of, direction, {', '.join(f'round({c}, 6) as {c}' for c in NUMBERS)} from ev")
def evidence_table(spark, sf_dir):
    return found(spark, sf_dir).select("name", "dimension", "riskier", "overlap_with", "as_of", "direction", *(F.round(c, 6).alias(c) for c in NUMBERS))


@query("peer_ratio", f"with {PX5}, q as (select a.session, a.p / b.p as ratio from px5 a join px5 b on a.session = b.session and a.symbol = 'rsp' and b.symbol = 'spy') select session, round(ratio, 6) as ratio, round(ratio / lag(ratio, 63) {V}) - 1, 6) as change_63 from q")
def peer_ratio(spark, sf_dir):
    r = evidence.peer_ratio(px5(spark, sf_dir), "rsp", "spy")
    return r.select("session", F.round("ratio", 6).alias("ratio"), F.round("change_63", 6).alias("change_63"))


@query("risk_rank_direction", f"with {VALUES} select name, direction, round(risk_rank, 6) as risk_rank from ev")
def risk_rank_direction(spark, sf_dir):
    return found(spark, sf_dir).select("name", "direction", F.round("risk_rank", 6).alias("risk_rank"))


@query("missing_dimensions", f"with {VALUES} select d as dimension, coalesce(bool_or(value is not null), false) as covered from (values ('trend'), ('volatility'), ('participation'), ('credit'), ('implied')) t(d) left join ev on dimension = d group by 1")
def missing_dimensions(spark, sf_dir):
    return evidence.missing_dimensions(found(spark, sf_dir))


STANCE = f"""{VALUES}, st as (select dimension, case when bool_or(direction = 'deteriorating') and bool_or(direction = 'easing') then 'split' when bool_and(direction = 'deteriorating') then 'worsening' when bool_and(direction = 'easing') then 'easing' else 'stable' end as stance
       from ev where overlap_with is null and value is not null group by 1)"""


@query("contradictions", f"with {STANCE} select 'split' as kind, dimension as left_dimension, dimension as right_dimension from st where stance = 'split' union all select 'against', a.dimension, b.dimension from st a, st b where a.stance = 'worsening' and b.stance = 'easing'")
def contradictions(spark, sf_dir):
    return evidence.contradictions(found(spark, sf_dir))


@query("review_triggers", f"with {VALUES} select name, round(least(1.0, percentile + 0.1), 6) as above, round(greatest(0.0, percentile - 0.1), 6) as below from ev where percentile is not null")
def review_triggers(spark, sf_dir):
    return evidence.review_triggers(found(spark, sf_dir))


LABELS = f"""{VALUES}, nb as (select dimension, bool_or(overlap_with is null and direction = 'deteriorating' and risk_rank >= 0.9) as worse, bool_or(overlap_with is null and direction = 'easing' and risk_rank <= 1 - 0.9) as ease from ev group by 1),
nn as (select count(*) filter (where worse) as w, count(*) filter (where worse and dimension in ('participation', 'credit')) as b, count(*) filter (where ease) as e from nb),
lb as (select (select coalesce(bool_or(name = 'spy_vs_200d_ma' and value < 0), false) from ev) as trend_damaged, (select coalesce(bool_or(name = 'vol_ratio_20_over_60' and percentile >= 0.9), false) from ev) as volatility_elevated, w >= 2 and b >= 1 as stress_spreading, e >= 2 and w = 0 as repair_underway from nn)"""


@query("state_labels", f"with {LABELS} select * from lb")
def state_labels(spark, sf_dir):
    return evidence.state_labels(found(spark, sf_dir))


@query("leaning", f"""with {LABELS} select *, case when trend_damaged and (volatility_elevated or stress_spreading) then 'REDUCTION' when repair_underway and (trend_damaged or volatility_elevated or stress_spreading) then 'CONFLICTED'
when volatility_elevated and not trend_damaged and not stress_spreading then 'HEDGE' when trend_damaged or volatility_elevated or stress_spreading or repair_underway then 'WATCH' else 'NO_NEW_DEFENSE' end as rung, 'DATA_INSUFFICIENT' as leaning from lb""")
def leaning(spark, sf_dir):
    return evidence.leaning(evidence.state_labels(found(spark, sf_dir)))


@query("evidence_missing", f"with {VALUES} select c.name, c.dimension, case when value is null then 'no data' when percentile is null then 'too few observations for a rank' end as missing_reason from cat c left join ev using (name)")
def evidence_missing(spark, sf_dir):
    return evidence.with_missing(found(spark, sf_dir)).select("name", "dimension", "missing_reason")


#: Every combination of labels, by the orders' keys.
FLAGS16 = "fl as (select o_orderkey, o_orderkey % 2 = 1 as trend_damaged, (o_orderkey // 2) % 2 = 1 as volatility_elevated, (o_orderkey // 4) % 2 = 1 as stress_spreading, (o_custkey % 2) = 1 as repair_underway, o_custkey % 3 = 0 as tested from orders)"


@query("leaning_ladder", f"""with {FLAGS16}, r as (select *, case when trend_damaged and (volatility_elevated or stress_spreading) then 'REDUCTION' when repair_underway and (trend_damaged or volatility_elevated or stress_spreading) then 'CONFLICTED'
when volatility_elevated and not trend_damaged and not stress_spreading then 'HEDGE' when trend_damaged or volatility_elevated or stress_spreading or repair_underway then 'WATCH' else 'NO_NEW_DEFENSE' end as rung from fl)
select o_orderkey, rung, case when tested then rung else 'DATA_INSUFFICIENT' end as leaning from r""")
def leaning_ladder(spark, sf_dir):
    """Every rung, with and without a grade."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bit = lambda c, k: F.pmod(F.floor(F.col(c) / k), F.lit(2)) == 1
    rows = o.select("o_orderkey", bit("o_orderkey", 1).alias("trend_damaged"), bit("o_orderkey", 2).alias("volatility_elevated"), bit("o_orderkey", 4).alias("stress_spreading"), bit("o_custkey", 1).alias("repair_underway"), F.when(F.col("o_custkey") % 3 == 0, "TESTED").otherwise("UNTESTED").alias("grade"))
    return evidence.leaning(rows, F.col("grade")).select("o_orderkey", "rung", "leaning")
