"""Queries over price paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.operators import ledger
from causeway.plans.inputs import PX, PX5, px, px5
from causeway.plans.registry import query

W_ = "over (partition by symbol order by session"


def _window_query(name: str, column, sql: str, digits: int = 6):
    """One computed column `x` over a price path."""

    @query(name, f"with {PX5}, r as (select *, p / lag(p) {W_}) - 1 as r from px5) select symbol, session, round({sql}, {digits}) as x from r")
    def run(spark, sf_dir):
        w = ts.series("symbol")
        rows = px5(spark, sf_dir).withColumn("r", ts.pct_change(F.col("p"), w))
        return rows.select("symbol", "session", F.round(column(w), digits).alias("x"))

    return run


_window_query("pct_change", lambda w: ts.pct_change(F.col("p"), w, 63), f"p / lag(p, 63) {W_}) - 1")
_window_query("change_20", lambda w: ts.change(F.col("p"), w, 20), f"p - lag(p, 20) {W_})")
_window_query("rolling_mean_200", lambda w: ts.rolling_mean(F.col("p"), w, 200), f"case when count(p) {W_} rows between 199 preceding and current row) = 200 then avg(p) {W_} rows between 199 preceding and current row) end", 4)
_window_query("rolling_vol_20", lambda w: ts.rolling_volatility(F.col("r"), w, 20), f"case when count(r) {W_} rows between 19 preceding and current row) = 20 then stddev_samp(r) {W_} rows between 19 preceding and current row) * sqrt(252) end")
_window_query("rolling_vol_60", lambda w: ts.rolling_volatility(F.col("r"), w, 60), f"case when count(r) {W_} rows between 59 preceding and current row) = 60 then stddev_samp(r) {W_} rows between 59 preceding and current row) * sqrt(252) end")
_window_query("rolling_max_drawdown_252", lambda w: F.col("p") / ts.rolling(F.max, F.col("p"), w, 252) - 1, f"p / case when count(p) {W_} rows between 251 preceding and current row) = 252 then max(p) {W_} rows between 251 preceding and current row) end - 1")
_window_query("expanding_mean", lambda w: ts.expanding_mean(F.col("p"), w, 252), f"case when count(p) {W_} rows between unbounded preceding and current row) >= 252 then avg(p) {W_} rows between unbounded preceding and current row) end", 4)
_window_query("forward_drawdown_event", lambda w: ts.forward_drawdown_event(F.col("p"), w, 20, 0.05).cast("double"), f"case when count(p) {W_} rows between 1 following and 20 following) = 20 then cast(min(p) {W_} rows between 1 following and 20 following) / p - 1 <= -0.05 as int)::double end")
_window_query("forward_fill", lambda w: ts.forward_fill(F.when(F.col("i") % 3 == 0, F.col("p")), w), f"last_value(case when i % 3 = 0 then p end ignore nulls) {W_} rows between unbounded preceding and current row)")
_window_query("back_fill", lambda w: ts.back_fill(F.when(F.col("i") % 3 == 0, F.col("p")), w), f"first_value(case when i % 3 = 0 then p end ignore nulls) {W_} rows between current row and unbounded following)")

EWM = f"""r as (select *, p / lag(p) {W_}) - 1 as r from px),
k as (select *, count(r) over w as n, sum(case when r is not null then pow(0.94, -i) end) over w as s0, sum(pow(0.94, -i) * r) over w as s1,
      sum(pow(0.94, -i) * r * r) over w as s2, sum(case when r is not null then pow(0.94 * 0.94, -i) end) over w as ss
      from r window w as (partition by symbol order by session rows between unbounded preceding and current row)),
e as (select *, case when n >= 20 then sqrt(greatest(0, (s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - ss))) end as ewm from k)"""


@query("ewma_vol", f"with {PX}, {EWM} select symbol, session, round(ewm * sqrt(252), 6) as x from e")
def ewma_vol(spark, sf_dir):
    rows = px(spark, sf_dir).withColumn("r", ts.pct_change(F.col("p"), ts.series("symbol")))
    return ts.ewm_volatility(rows, ["symbol"], "session", "r", "v").select("symbol", "session", F.round(F.col("v") * F.sqrt(F.lit(252.0)), 6).alias("x"))


CAUSAL = """causal as (select a.symbol, a.i, count(b.x) as earlier, count(case when b.x < a.x then 1 end) as below
           from {t} a left join {t} b on a.symbol = b.symbol and b.i < a.i and b.x is not null where a.x is not null group by 1, 2)"""
RANK = "case when earlier + 1 >= 252 and earlier > 0 then below / earlier end"


@query("causal_percentile", f"with {PX}, v as (select symbol, session, i, p as x from px), {CAUSAL.format(t='v')} select symbol, session, round({RANK}, 6) as x from v left join causal using (symbol, i)")
def causal_percentile(spark, sf_dir):
    return ts.causal_percentile(px(spark, sf_dir), ["symbol"], "session", "p", "rank").select("symbol", "session", F.round("rank", 6).alias("x"))


EXPOSURES = f"""{PX}, {EWM},
f as (select *, count(r) {W_} rows between 19 preceding and current row) as n20, stddev_samp(r) {W_} rows between 19 preceding and current row) * sqrt(252) as v20,
      count(p) {W_} rows between 199 preceding and current row) as n200, avg(p) {W_} rows between 199 preceding and current row) as ma from e),
x as (select symbol, session, i, p, r, case when n20 = 20 then v20 end as vol, case when n200 = 200 then ma end as trend, cast(1.0 as double) as no_new_defense, cast(0.6 as double) as fixed_low_exposure,
      lag(case when n20 = 20 and v20 > 0 then least(0.10 / v20, 1.0) end) {W_}) as trailing_or_ewma_volatility_target,
      lag(case when ewm > 0 then least(0.10 / (ewm * sqrt(252)), 1.0) end) {W_}) as ewma_volatility_target,
      lag(case when n200 = 200 and p > ma then 1.0::double else 0.0::double end) {W_}) as fixed_long_term_trend_rule from f)"""
UNION = " union all ".join(f"select symbol, session, i, r, '{s}' as strategy, cast({s} as double) as weight, (r is not null and {' and '.join(f'{t} is not null' for t in ledger.STRATEGIES)}) as common from x" for s in ledger.STRATEGIES)
LEDGER = f"""{EXPOSURES}, u as ({UNION}),
l as (select *, weight * r - coalesce(abs(weight - lag(weight) over (partition by symbol, strategy order by session)), 0) * 2.0 / 10000 as ret from u)"""
DRAWN = LEDGER + """,
q as (select *, exp(sum(ln(1 + ret)) over (partition by symbol, strategy order by session)) as eq from l where common),
z as (select *, eq / max(eq) over (partition by symbol, strategy order by session rows between unbounded preceding and current row) - 1 as dd from q)"""


@query("benchmark_exposures", f"with {EXPOSURES} select symbol, session, {', '.join(f'round({s}, 6) as {s}' for s in ledger.STRATEGIES)} from x")
def benchmark_exposures(spark, sf_dir):
    return ledger.benchmark_exposures(px(spark, sf_dir)).select("symbol", "session", *(F.round(s, 6).alias(s) for s in ledger.STRATEGIES))


@query("ledger_returns", f"with {LEDGER} select symbol, session, strategy, round(weight, 6) as weight, round(ret, 6) as ret from l where ret is not null")
def ledger_returns(spark, sf_dir):
    out = ledger.ledger_returns(ledger.benchmark_exposures(px(spark, sf_dir)))
    return out.where("ret is not null").select("symbol", "session", "strategy", F.round("weight", 6).alias("weight"), F.round("ret", 6).alias("ret"))


@query("ledger_benchmarks", f"with {DRAWN} select symbol, strategy, count(*) as days, round(avg(ret) * 252, 6) as annual_return, round(stddev_samp(ret) * sqrt(252), 6) as annual_volatility, round(min(dd), 6) as max_drawdown, round(avg(weight), 6) as average_exposure from z group by 1, 2")
def ledger_benchmarks(spark, sf_dir):
    return ledger.performance(ledger.ledger_returns(ledger.benchmark_exposures(px(spark, sf_dir))))


@query("max_drawdown", f"with {PX5}, r as (select *, p / lag(p) {W_}) - 1 as r from px5), q as (select *, exp(sum(ln(1 + r)) {W_})) as eq from r where r is not null), z as (select *, eq / max(eq) {W_} rows between unbounded preceding and current row) - 1 as dd from q) select symbol, round(min(dd), 6) as max_drawdown from z group by 1")
def max_drawdown(spark, sf_dir):
    r = px5(spark, sf_dir).withColumn("ret", ts.pct_change(F.col("p"), ts.series("symbol"))).where("ret is not null")
    return ledger.with_drawdown(r, ["symbol"]).groupBy("symbol").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"))


def matched_sql(name: str, strategy: str, target: str = ledger.TARGET) -> str:
    return f"""mr{name} as (select symbol, session, {target} as baseline, case when count({strategy}) {W_}) >= 252 and count({target}) {W_}) >= 252 and avg({target}) {W_}) > 0 then greatest(0, least(2, avg({strategy}) {W_}) / avg({target}) {W_}))) end as ratio from x),
mf{name} as (select symbol, session, baseline * coalesce(last_value(ratio ignore nulls) {W_} rows between unbounded preceding and current row), first_value(ratio ignore nulls) {W_} rows between current row and unbounded following)) as control from mr{name})"""


@query("matched_control", f"with {EXPOSURES}, {matched_sql('', 'fixed_long_term_trend_rule')} select symbol, session, round(control, 6) as control from mf where control is not null")
def matched_control(spark, sf_dir):
    x = ledger.benchmark_exposures(px(spark, sf_dir))
    pairs = x.select("symbol", "session", F.col(ledger.TARGET).alias("baseline"), F.col("fixed_long_term_trend_rule").alias("candidate"))
    return ledger.matched_control(pairs).where("control is not null").select("symbol", "session", F.round("control", 6).alias("control"))


#: Strategies and matched controls as c0, c1, ...: returns, drawn by the same blocks, and the depth of each draw.
SIDES = [*ledger.STRATEGIES, *(f"matched_{n}" for n in ledger.MATCHED)]
PAIRS = [(n, ledger.TARGET) for n in ledger.STRATEGIES if n != ledger.TARGET] + [(n, f"matched_{n}") for n in ledger.MATCHED]
each = lambda f: ", ".join(f.format(k=k) for k in range(len(SIDES)))
BOOT = f"""{LEDGER}, {', '.join(matched_sql(str(k), n) for k, n in enumerate(ledger.MATCHED))},
cm as (select distinct symbol, session from u where common),
{', '.join(f"mc{k} as (select symbol, session, least(greatest(control, 0), 1) as w from mf{k} join cm using (symbol, session)), ml{k} as (select symbol, session, w * r - coalesce(abs(w - lag(w) {W_})), 0) * 2.0 / 10000 as ret from mc{k} join x using (symbol, session))" for k in range(len(ledger.MATCHED)))},
al as (select symbol, session, strategy, ret from l where common {' '.join(f"union all select symbol, session, 'matched_{n}', ret from ml{k}" for k, n in enumerate(ledger.MATCHED))}),
pr as (select symbol, session, row_number() {W_}) - 1 as pos, {', '.join(f"max(ret) filter (where strategy = '{c}') as c{k}" for k, c in enumerate(SIDES))} from al group by symbol, session),
n as (select symbol, count(*) as n from pr group by 1),
ix as (select symbol, draw, b * 60 + k as pos, ((draw * 7919 + b * 104729 + 17) * 31 % n + k) % n as source, n from n, range(0, 1000) t(draw), range(0, cast(ceil(n / 60) as bigint)) u(b), range(0, 60) v(k)),
dr as (select ix.symbol, draw, ix.pos, {each('c{k}')} from ix join pr on pr.symbol = ix.symbol and pr.pos = source where ix.pos < n
       union all select symbol, -1, pos, {each('c{k}')} from pr),
ee as (select symbol, draw, pos, {each('sum(ln(1 + c{k})) over w as c{k}')} from dr window w as (partition by symbol, draw order by pos)),
dd as (select symbol, draw, {each('c{k} - max(c{k}) over w as c{k}')} from ee window w as (partition by symbol, draw order by pos)),
mn as (select symbol, draw, {each('exp(min(c{k})) - 1 as c{k}')} from dd group by 1, 2),
df as ({' union all '.join(f"select symbol, draw, '{a}' as lhs, '{b}' as rhs, c{SIDES.index(a)} - c{SIDES.index(b)} as diff from mn" for a, b in PAIRS)}),
bt as (select symbol, lhs, rhs, count(*) filter (where draw >= 0) as draws, round(max(diff) filter (where draw < 0), 6) as difference, round(quantile_cont(diff, 0.025) filter (where draw >= 0), 6) as low, round(quantile_cont(diff, 0.975) filter (where draw >= 0), 6) as high,
       quantile_cont(diff, 0.025) filter (where draw >= 0) > 0 or quantile_cont(diff, 0.975) filter (where draw >= 0) < 0 as significant from df group by 1, 2, 3)"""


@query("paired_bootstrap", f'with {BOOT} select symbol, lhs as "left", rhs as "right", (select n from n) as observations, draws, difference, low, high, significant from bt')
def paired_bootstrap(spark, sf_dir):
    """All seven comparisons, a thousand draws each."""
    return ledger.paired_bootstrap(ledger.with_matched_returns(ledger.benchmark_exposures(px(spark, sf_dir))), PAIRS)


@query("compare_against_benchmarks", f"""with {BOOT},
q as (select *, exp(sum(ln(1 + ret)) over (partition by symbol, strategy order by session)) as eq from l where common),
z as (select *, eq / max(eq) over (partition by symbol, strategy order by session rows between unbounded preceding and current row) - 1 as depth from q),
pf as (select symbol, strategy, count(*) as days, round(avg(ret) * 252, 6) as annual_return, round(stddev_samp(ret) * sqrt(252), 6) as annual_volatility, round(min(depth), 6) as max_drawdown, round(avg(weight), 6) as average_exposure from z group by 1, 2)
select pf.*, {', '.join(f'{a}.{c} as {p}_{c}' for a, p in (('t', 'target'), ('m', 'matched')) for c in ('difference', 'low', 'high', 'significant'))}
from pf left join bt t on t.lhs = strategy and t.rhs = '{ledger.TARGET}' left join bt m on m.lhs = strategy and m.rhs <> '{ledger.TARGET}'""")
def compare_against_benchmarks(spark, sf_dir):
    return ledger.compare_against_benchmarks(px(spark, sf_dir))


CONDITIONAL = f"""{EXPOSURES}, v as (select symbol, session, i, p, trend, vol as x,
       case when count(p) {W_} rows between 1 following and 20 following) = 20 then cast(min(p) {W_} rows between 1 following and 20 following) / p - 1 <= -0.05 as int) end as event from x),
{CAUSAL.format(t='v')},
c as (select *, {RANK} as rank from v join causal using (symbol, i)),
s as (select *, p < trend as is_low, rank >= 0.9 as wild from c where event is not null and rank is not null and trend is not null),
pd as (select 'whole' as period, * from s union all select 'recent', * from s where session >= date '1998-01-01')"""
MASKS = {"all": "true", "below_trend": "is_low", "high_volatility": "wild", "both": "is_low and wild"}


@query("conditional_frequencies", f"with {CONDITIONAL} select symbol, period, " + ", ".join(f"count(*) filter (where {m}) as {k}_sessions, round(avg(event) filter (where {m}), 6) as {k}_rate" for k, m in MASKS.items()) + " from pd group by 1, 2")
def conditional_frequencies(spark, sf_dir):
    return ledger.conditional_frequencies(px(spark, sf_dir))


FLAGS = f"""{PX}, fl as (select symbol, session, i, p, case when count(p) {W_} rows between 1 following and 20 following) = 20 then cast(min(p) {W_} rows between 1 following and 20 following) / p - 1 <= -0.05 as int) end as event,
       cast(coalesce(p < case when count(p) {W_} rows between 49 preceding and current row) = 50 then avg(p) {W_} rows between 49 preceding and current row) end, false) as int) as below from px),
al as (select *, coalesce(lag(below) {W_}), 0) as alert from fl),
ff as (select *, coalesce(cast(i - lag(i) over (partition by symbol order by i) > 5 as int), 1) as new from al where event = 1),
fe as (select *, sum(new) over (partition by symbol order by i) as episode from ff),
ep as (select symbol, cast(episode as bigint) as episode, min(session) as first_session, max(session) as last_session, min(i) as first_i, max(i) as last_i, max(i) - min(i) + 1 as event_days from fe group by 1, 2)"""


def flagged(spark, sf_dir):
    w = ts.series("symbol")
    rows = px(spark, sf_dir).withColumn("event", ts.forward_drawdown_event(F.col("p"), w, 20, 0.05))
    rows = rows.withColumn("below", F.coalesce(F.col("p") < ts.rolling_mean(F.col("p"), w, 50), F.lit(False)).cast("int"))
    return rows.withColumn("alert", F.coalesce(F.lag("below").over(w), F.lit(0)))


@query("episodes", f"with {FLAGS} select symbol, episode, first_session, last_session, event_days from ep")
def episodes(spark, sf_dir):
    return ledger.episodes(flagged(spark, sf_dir).withColumn("flag", F.col("event"))).select("symbol", "episode", "first_session", "last_session", F.col("event_days").cast("long").alias("event_days"))


@query("replay_metrics", f"""with {FLAGS},
h as (select e.symbol, e.episode, coalesce(bool_or(a.i between e.first_i and e.last_i), false) as hit from ep e left join al a on a.symbol = e.symbol and a.alert = 1 and a.event is not null group by 1, 2),
e2 as (select symbol, count(*) as episodes, count(*) filter (where hit) as detected from h group by 1),
a2 as (select symbol, count(*) as sessions, cast(sum(alert) as bigint) as alerts, count(*) filter (where alert = 1 and event = 1) as hits from al where event is not null group by 1)
select symbol, sessions, coalesce(episodes, 0) as episodes, coalesce(detected, 0) as detected, alerts, round(detected / nullif(episodes, 0), 6) as recall, round(hits / nullif(alerts, 0), 6) as precision,
       round(alerts / sessions * 252, 6) as alerts_per_year, alerts - hits as false_sessions from a2 left join e2 using (symbol)""")
def replay_metrics(spark, sf_dir):
    return ledger.replay_metrics(flagged(spark, sf_dir).where("event is not null"))


@query("signal_rate", f"with {FLAGS}, s as (select symbol, alert - lag(alert) {W_}) = 1 as edge from al) select symbol, round(count(*) filter (where edge) / count(*) * 252, 6) as rate from s group by 1")
def signal_rate(spark, sf_dir):
    return ledger.signal_rate(flagged(spark, sf_dir).withColumn("signal", F.col("alert")))


@query("current_exposures", f"with {EXPOSURES} select symbol, session, {', '.join(f'round({s}, 6) as {s}' for s in ledger.STRATEGIES)}, round(trend, 6) as trend_level, round(vol, 6) as volatility, p > trend as above_trend from x qualify row_number() over (partition by symbol order by session desc) = 1")
def current_exposures(spark, sf_dir):
    return ledger.current_exposures(px(spark, sf_dir))


@query("run_lengths", f"""with {FLAGS}, c as (select symbol, session, below = 1 as present, coalesce(cast((below = 1) is distinct from (lag(below) {W_}) = 1) as int), 1) as new from al),
u as (select *, sum(new) {W_}) as run from c)
select symbol, cast(run as bigint) as run, min(session) as starts, count(*) as length from u where present group by 1, 2""")
def run_lengths(spark, sf_dir):
    return ledger.run_lengths(flagged(spark, sf_dir).select("symbol", "session", (F.col("below") == 1).alias("present")))


@query("threshold_grid_search", f"""with {EXPOSURES}, v as (select symbol, session, i, vol as x from x), {CAUSAL.format(t='v')}, c as (select *, {RANK} as rank from v join causal using (symbol, i)),
t as (select symbol, session, grid, cast(rank >= grid / 100 as int) as signal from c, range(50, 99) g(grid) where rank is not null),
e2 as (select *, signal - lag(signal) over (partition by symbol, grid order by session) = 1 as edge from t),
rt as (select symbol, grid, count(*) filter (where edge) / count(*) * 252 as rate from e2 group by 1, 2)
select symbol, cast(grid as int) as grid, round(rate, 6) as rate from rt qualify row_number() over (partition by symbol order by abs(rate - 6), grid) = 1""")
def threshold_grid_search(spark, sf_dir):
    w = ts.series("symbol")
    rows = px(spark, sf_dir).withColumn("r", ts.pct_change(F.col("p"), w)).withColumn("vol", ts.rolling_volatility(F.col("r"), w, 20))
    return ledger.threshold_search(ts.causal_percentile(rows, ["symbol"], "session", "vol", "rank"), 6.0)
