"""Queries of sources, lineage, calendars, events and time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.operators import calendar, lineage
from causeway.plans.inputs import PX, PX5, SECOND, px, px5, second_source, table
from causeway.plans.registry import query
from causeway.settings import EventRules
from causeway.sources import landed
from causeway.streaming import events as machine

LABELS = f"""{PX5}, lb as (select symbol as label, session, i, coalesce(p < case when count(p) over w = 20 then avg(p) over w end, false) as present from px5 window w as (partition by symbol order by session rows between 19 preceding and current row))"""
MACHINE = f"""with recursive {LABELS},
m as (select label, cast(-1 as bigint) as i, cast(null as date) as first_seen, 0 as seen, 0 as absent, cast(null as date) as confirmed, cast(null as date) as noted, cast(null as varchar) as kind, cast(null as date) as session, cast(null as date) as note_first, 0 as note_seen from (select distinct label from lb)
  union all
  select label, i, case when released then null else first_seen end, case when released then 0 else seen end, case when released then 0 else absent end, case when released then null else confirmed end,
         case when released then null when fires then session else noted end, case when fires then case when released then 'released' else 'opened' end end, session, first_seen, seen
  from (select *, (opening or (released and confirmed is not null)) and (noted is null or session - noted >= 5) as fires from (
    select l.label, l.i, l.session, case when l.present and m.first_seen is null then l.session else m.first_seen end as first_seen,
           case when l.present then case when m.first_seen is null then 1 else m.seen + 1 end else m.seen end as seen, case when l.present or m.first_seen is null then 0 else m.absent + 1 end as absent,
           case when l.present and m.first_seen is null then null when l.present and m.confirmed is null and m.seen + 1 >= 3 then l.session else m.confirmed end as confirmed, case when l.present and m.first_seen is null then null else m.noted end as noted,
           l.present and m.first_seen is not null and m.confirmed is null and m.seen + 1 >= 3 as opening, not l.present and m.first_seen is not null and m.absent + 1 >= 5 as released
    from m join lb l on l.label = m.label and l.i = m.i + 1)))
select label, session, kind, note_first as first_seen, note_seen as seen from m where kind is not null"""


def labels(spark, sf_dir):
    w = ts.series("symbol")
    rows = px5(spark, sf_dir).withColumn("present", F.coalesce(F.col("p") < ts.rolling_mean(F.col("p"), w, 20), F.lit(False)))
    return rows.select(F.col("symbol").alias("label"), "session", "present")


@query("event_machine_batch", MACHINE)
def event_machine_batch(spark, sf_dir):
    return machine.notifications(labels(spark, sf_dir))


#: A confirmed event stands (open) after a session: the machine's state over labels lb(label, i, present), i from 0.
def standing_sql(lb: str, out: str) -> str:
    return f"""{out}m as (select label, cast(-1 as bigint) as i, false as active, 0 as seen, 0 as absent, false as confirmed from (select distinct label from {lb})
  union all select label, i, active and not released, case when released then 0 else seen end, case when released then 0 else absent end, confirmed and not released from (
    select l.label, l.i, l.present or m.active as active, case when l.present then case when m.active then m.seen + 1 else 1 end else m.seen end as seen, case when l.present or not m.active then 0 else m.absent + 1 end as absent,
           m.confirmed or (l.present and m.active and m.seen + 1 >= 3) as confirmed, not l.present and m.active and m.absent + 1 >= 5 as released from {out}m m join {lb} l on l.label = m.label and l.i = m.i + 1)),
{out} as (select label, i, confirmed as open from {out}m where i >= 0)"""


COST = f"""with recursive {LABELS}, {standing_sql('lb', 'st')},
op as (select label, i, lag(i) over (partition by label order by i) as before from (select label, i, open and not coalesce(lag(open) over (partition by label order by i), false) as up from st) where up),
dl as (select o.label, o.i - min(l.i) as delay from op o join lb l on l.label = o.label and l.present and l.i > coalesce(o.before, -1) and l.i <= o.i group by o.label, o.i),
rn as (select label, count(*) as n from (select label, i - row_number() over (partition by label order by i) as island from lb where present) group by label, island)
select label, (select count(*) from rn where rn.label = a.label and n < 3) as flickers, (select count(*) from dl where dl.label = a.label) as opened, (select median(delay)::double from dl where dl.label = a.label) as median_delay, (select max(delay)::double from dl where dl.label = a.label) as worst_delay
from (select distinct label from lb) a"""


@query("confirmation_cost", COST)
def confirmation_cost(spark, sf_dir):
    return machine.confirmation_cost(labels(spark, sf_dir), EventRules())


@query("standing_events", f"with recursive {LABELS}, {standing_sql('lb', 'st')} select label, session, open from st join lb using (label, i)")
def standing_events(spark, sf_dir):
    return machine.standing(labels(spark, sf_dir))


@query("active_events", MACHINE.rsplit("select label, session, kind", 1)[0] + "select label, first_seen, seen, absent, confirmed as confirmed_on from m where first_seen is not null qualify row_number() over (partition by label order by i desc) = 1 and i = (select max(i) from m x where x.label = m.label)")
def active_events(spark, sf_dir):
    return machine.active(labels(spark, sf_dir)).select("label", "first_seen", "seen", "absent", "confirmed_on")


REPLAY = f"""with recursive {PX}, w_ as (select *, p / lag(p) over (order by session) - 1 as r from px),
v_ as (select *, case when count(r) over (order by session rows between 19 preceding and current row) = 20 then stddev_samp(r) over (order by session rows between 19 preceding and current row) * sqrt(252) end as x,
  p <= case when count(p) over (order by session rows between 199 preceding and current row) = 200 then avg(p) over (order by session rows between 199 preceding and current row) end as low,
  case when count(p) over (order by session rows between 1 following and 20 following) = 20 then cast(min(p) over (order by session rows between 1 following and 20 following) / p - 1 <= -0.05 as int) end as event from w_),
ca as (select a.i, count(b.x) as earlier, count(case when b.x < a.x then 1 end) as below from v_ a left join v_ b on b.i < a.i and b.x is not null where a.x is not null group by 1),
rk as (select v_.*, case when earlier + 1 >= 252 and earlier > 0 then below / earlier end as rank from v_ left join ca using (i)),
la as (select 'c' as label, i, coalesce(lag(low) over (order by i), false) as present from rk),
{standing_sql('la', 'sc')},
gr as (select cast(g as varchar) as label, i, coalesce(rank >= g / 100, false) as present from rk, range(50, 99) t(g) where session <= date '1998-06-30'),
{standing_sql('gr', 'sg')},
rt as (select label, count(*) filter (where up) / count(*) * 252 as rate from (select label, open and not lag(open) over (partition by label order by i) as up from sg) group by 1),
tr as (select count(*) filter (where up) / count(*) * 252 as target from (select open and not lag(open) over (order by i) as up from sc join px using (i) where session <= date '1998-06-30')),
mt as (select cast(label as int) as grid, rate from rt, tr order by abs(rate - target), cast(label as int) limit 1),
lv as (select 'v' as label, i, coalesce(lag(rank) over (order by i) >= grid / 100, false) as present from rk, mt),
{standing_sql('lv', 'sv')},
fe as (select i, session, coalesce(cast(i - lag(i) over (order by i) > 5 as int), 1) as new from rk where event = 1),
fs as (select *, sum(new) over (order by i) as episode from fe),
ep as (select episode, min(session) as a, max(session) as b from fs group by 1),
si as (select 'c' as rule, i, open from sc union all select 'v', i, open from sv),
hi as (select rule, count(distinct episode) as detected from si join rk using (i) join ep on session between a and b where open and event is not null and a > date '1998-06-30' group by 1),
rr as (select rule, count(*) filter (where up) / count(*) * 252 as rate from (select rule, open and not lag(open) over (partition by rule order by i) as up from si join px using (i) where session > date '1998-06-30') group by 1),
te as (select count(*) as n from ep where a > date '1998-06-30')
select 'px' as symbol, grid, round(target, 6) as target, round((select rate from rr where rule = 'c'), 6) as candidate_rate, round((select rate from rr where rule = 'v'), 6) as comparator_rate,
round(coalesce((select detected from hi where rule = 'c'), 0) / n, 6) as candidate_recall, round(coalesce((select detected from hi where rule = 'v'), 0) / n, 6) as comparator_recall, n as test_episodes, (select count(*) from ep where b <= date '1998-06-30') as train_episodes from mt, tr, te"""


@query("trend_rule_replay", REPLAY)
def trend_rule_replay(spark, sf_dir):
    from causeway.operators import replay

    m = replay.measure(px(spark, sf_dir), "1998-06-30")
    return m.select("symbol", "grid", *(F.round(c, 6).alias(c) for c in ("target", "candidate_rate", "comparator_rate", "candidate_recall", "comparator_recall")), "test_episodes", "train_episodes")


@query("event_machine_stream", MACHINE)
def event_machine_stream(spark, sf_dir):
    """The streaming operator over landed label files, run until they are read; equal to the batch fold."""
    at = f"{stage(spark)}/labels-{uuid.uuid4().hex}"
    labels(spark, sf_dir).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("label string, session date, present boolean").parquet(f"{at}/in")
    q = machine.stream_notifications(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(machine.NOTES).parquet(f"{at}/out")


def stage(spark) -> str:
    """The folder that driver and executors share; only where none is named, on one machine, a temporary one."""
    from causeway.session import shared_folder

    return shared_folder(spark)


@query("tumbling_window", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("sliding_window", "select time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as start, count(*) as n from events, range(0, 4) t(k) group by 1")
def sliding_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "2 hours", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("session_window", """with g as (select user_id, ts, event_id, coalesce(cast(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 2 hours as int), 1) as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # A gap of exactly two hours still belongs to the session: the built-in window ends before it.
    return e.groupBy(F.session_window("ts", "7200.000001 seconds").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


#: One file is one batch: nothing is late yet, and windows that end by the watermark are given out.
@query("watermark_late_rows", """with e as (select case when event_id % 17 = 0 then ts - interval 2 hours else ts end as ts from events), w as (select time_bucket(interval 1 hour, ts) as start, count(*) as n from e group by 1)
select start, n from w where start + interval 1 hour <= (select max(ts) - interval 30 minutes from e)""")
def watermark_late_rows(spark, sf_dir):
    """A stream in which some rows come two hours late: hourly counts under a watermark of thirty minutes."""
    at = f"{stage(spark)}/late-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    late = stream.withColumn("ts", F.when(F.col("event_id") % 17 == 0, F.col("ts") - F.expr("interval 2 hours")).otherwise(F.col("ts")).cast("timestamp"))
    counts = late.withWatermark("ts", "30 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    q = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start timestamp, n long").parquet(f"{at}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("json_props_extract", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total from events group by 1")
def json_props_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("redact_secrets", "select event_id, regexp_replace('get?api_key=' || props || '&x=1 token=abc', '(?i)\\b(api_key|apikey|token)=[^&\\s\"'']*', '\\1=***', 'g') as clean from events")
def redact_secrets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", landed.redact(F.concat(F.lit("get?api_key="), "props", F.lit("&x=1 token=abc"))).alias("clean"))


@query("zip_lines_block", """with l as (select l_suppkey as path, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) as n, l_returnflag as line from lineitem),
m as (select *, line <> 'R' as ok, line <> 'R' and coalesce(lag(line) over (partition by path order by n) = 'R', true) as new from l),
b as (select *, sum(cast(new as int)) over (partition by path order by n) as block from m)
select path, min(n) as first_line, count(*) as lines from b where ok and block = 1 group by 1""")
def zip_lines_block(spark, sf_dir):
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    lines = li.select(F.col("l_suppkey").alias("path"), n.cast("long").alias("n"), F.col("l_returnflag").alias("line"))
    return landed.first_block(lines, F.col("line") != "R").groupBy("path").agg(F.min("n").alias("first_line"), F.count(F.lit(1)).alias("lines"))


VINTAGE = "vt as (select l_returnflag as series, cast(l_shipdate as date) as observation_date, cast(l_shipdate as date) + cast(l_quantity % 5 as int) as available, max(l_extendedprice) as value from lineitem group by 1, 2, 3)"


@query("initial_release", f"with {VINTAGE} select series, available, arg_max(value, observation_date) as value, max(observation_date) as observation_date from vt group by 1, 2")
def initial_release(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    rows = li.groupBy(F.col("l_returnflag").alias("series"), day.alias("observation_date"), F.date_add(day, (F.col("l_quantity") % 5).cast("int")).alias("available")).agg(F.max("l_extendedprice").alias("value"))
    return landed.initial_release(rows).select("series", "available", "value", "observation_date")


@query("combine_first", f"with {SECOND} select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.session, b.session) as session, round(coalesce(a.p, b.p), 4) as value from (select symbol, session, case when i % 5 > 0 then p end as p from px) a full join px2 b on a.symbol = b.symbol and a.session = b.session")
def combine_first(spark, sf_dir):
    a = px(spark, sf_dir).withColumn("value", F.when(F.col("i") % 5 > 0, F.col("p")))
    b = second_source(spark, sf_dir).withColumnRenamed("p", "value")
    return landed.combine_first(a, b, ["symbol", "session"]).withColumn("value", F.round("value", 4))


CASCADE = "cs as (select 's' || (l_suppkey % 50) as series, cast(l_shipdate as date) as session, l_suppkey % 3 + case when l_suppkey % 50 < 10 then 1 else 0 end as priority, sum(l_quantity) as value from lineitem group by 1, 2, 3)"


@query("source_cascade", f"with {CASCADE} select series, priority, count(*) as sessions, sum(value) as value from cs join (select series, min(priority) as priority from cs group by 1) b using (series, priority) group by 1, 2")
def source_cascade(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    rows = li.groupBy(F.concat(F.lit("s"), (k % 50).cast("string")).alias("series"), F.to_date("l_shipdate").alias("session"), (k % 3 + F.when(k % 50 < 10, 1).otherwise(0)).alias("priority")).agg(F.sum("l_quantity").alias("value"))
    return landed.cascade(rows).groupBy("series", "priority").agg(F.count(F.lit(1)).alias("sessions"), F.sum("value").alias("value"))


@query("dedupe_keep_last", "select o_custkey, cast(o_orderdate as date) as session, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2")
def dedupe_keep_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("session"), "o_orderkey", "o_totalprice")
    return landed.keep_last(o, ["o_custkey", "session"], "o_orderkey")


@query("asof_trim", f"with {PX} select symbol, session, round(p, 4) as p from px where session <= date '1998-06-30'")
def asof_trim(spark, sf_dir):
    return landed.as_of(px(spark, sf_dir), "1998-06-30").select("symbol", "session", F.round("p", 4).alias("p"))


@query("asof_join", """with r as (select l_suppkey as k, cast(l_shipdate as date) as d, max(l_extendedprice) as price from lineitem group by 1, 2)
select o.o_orderkey, r.price from (select o_orderkey, o_custkey % 100 as k, cast(o_orderdate as date) as d from orders) o asof left join r on o.k = r.k and o.d >= r.d""")
def asof_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), F.to_date("o_orderdate").alias("d"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d")).agg(F.max("l_extendedprice").alias("price"))
    return landed.as_of_join(left, right, ["k"], "d", "d", "price").select("o_orderkey", "price")


@query("full_outer_alignment", f"with {PX5} select session, {', '.join(f'''round(max(p) filter (where symbol = '{s}'), 4) as {s}''' for s in ('spy', 'rsp', 'iwm', 'hyg', 'lqd'))} from px5 group by 1")
def full_outer_alignment(spark, sf_dir):
    wide = px5(spark, sf_dir).groupBy("session").pivot("symbol", ["spy", "rsp", "iwm", "hyg", "lqd"]).agg(F.max("p"))
    return wide.select("session", *(F.round(c, 4).alias(c) for c in wide.columns[1:]))


#: The exchange's rules in SQL: holidays by weekday and by observed date, Good Friday, closures of their own, and New York's clock.
CALENDAR = f"""with dy as (select cast(d as date) as session from generate_series(timestamp '2000-01-01', timestamp '2026-12-31', interval 1 day) t(d)),
pt as (select session, year(session) as y, month(session) as m, day(session) as k, isodow(session) as w from dy where isodow(session) < 6),
ey as (select y, y % 19 as a, y // 100 as b, y % 100 as c from range(2000, 2027) t(y)),
eh as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from ey),
el as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from eh),
em as (select *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 as q from el),
gf as (select cast(make_date(y, q // 31, q % 31 + 1) as date) - 2 as session from em),
ho as (select session from pt where (m = 1 and w = 1 and k between 15 and 21) or (m = 2 and w = 1 and k between 15 and 21) or (m = 5 and w = 1 and k >= 25) or (m = 9 and w = 1 and k <= 7) or (m = 11 and w = 4 and k between 22 and 28)
  or (m = 7 and (k = 4 or (k = 3 and w = 5) or (k = 5 and w = 1))) or (m = 12 and (k = 25 or (k = 24 and w = 5) or (k = 26 and w = 1))) or (y >= 2022 and m = 6 and (k = 19 or (k = 18 and w = 5) or (k = 20 and w = 1))) or (m = 1 and (k = 1 or (k = 2 and w = 1)))
  union select session from gf union select cast(x as date) from (values {', '.join(f"('{d}')" for d in calendar.ONE_OFF)}) t(x)),
op as (select *, (m = 11 and w = 5 and k between 23 and 29) or (m = 12 and k = 24) or (m = 7 and k = 3) as early,
  case when y >= 2007 then session > make_date(y, 3, 8) + cast((7 - isodow(make_date(y, 3, 8))) % 7 as int) and session < make_date(y, 11, 1) + cast((7 - isodow(make_date(y, 11, 1))) % 7 as int)
       else session > make_date(y, 4, 1) + cast((7 - isodow(make_date(y, 4, 1))) % 7 as int) and session < make_date(y, 10, 31) - cast(isodow(make_date(y, 10, 31)) % 7 as int) end as summer from pt where session not in (select session from ho))
select session, session + interval 9 hours + interval 30 minutes + case when summer then interval 4 hours else interval 5 hours end as open_utc, session + case when early then interval 13 hours else interval 16 hours end + case when summer then interval 4 hours else interval 5 hours end as close_utc from op"""


@query("calendar_sessions", CALENDAR)
def calendar_sessions(spark, sf_dir):
    c = calendar.calendar(spark, "2000-01-01", "2026-12-31")
    return c.select("session", F.col("open_utc").cast("timestamp_ntz").alias("open_utc"), F.col("close_utc").cast("timestamp_ntz").alias("close_utc"))


@query("session_age", "with s as (select distinct cast(o_orderdate as date) as session from orders), m as (select o_custkey, max(cast(o_orderdate as date)) + 3 as latest from orders group by 1) select o_custkey, latest, greatest(0, (select count(*) from s where session <= date '2001-06-30') - (select count(*) from s where session <= latest)) as age from m")
def session_age(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sessions = o.select(F.to_date("o_orderdate").alias("session"))
    marks = o.groupBy("o_custkey").agg(F.date_add(F.max(F.to_date("o_orderdate")), 3).alias("latest"))
    return calendar.session_age(sessions, marks, "2001-06-30")


MANIFESTS = "mf as (select date_trunc('month', o_orderdate)::date as session, o_orderpriority as view, row_number() over (partition by date_trunc('month', o_orderdate), o_orderpriority order by o_orderkey) as revision, o_orderkey as id, o_totalprice as amount from orders)"


def manifests(spark, sf_dir):
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("session"), F.col("o_orderpriority").alias("view"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return o.withColumn("revision", F.row_number().over(W.partitionBy("session", "view").orderBy("id")).cast("long"))


@query("snapshot_latest", f"with {MANIFESTS} select session, view, max(revision) as revision, arg_max(id, revision) as id, arg_max(amount, revision) as amount, count(*) as revisions from mf group by 1, 2")
def snapshot_latest(spark, sf_dir):
    return lineage.latest(manifests(spark, sf_dir)).select("session", "view", "revision", "id", "amount", "revisions")


HASHES = "hs as (select 't' || (o_custkey % 40) as name, o_orderstatus = 'F' as old, sha256(cast(max(o_orderkey) % 3 as varchar)) as sha256 from orders group by 1, 2)"


@query("snapshot_changed_tables", f"with {HASHES} select coalesce(a.name, b.name) as name, case when a.name is null then 'added' when b.name is null then 'removed' else 'changed' end as change from (select * from hs where old) a full join (select * from hs where not old) b on a.name = b.name where a.sha256 is distinct from b.sha256")
def snapshot_changed_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    h = o.groupBy(F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("name"), (F.col("o_orderstatus") == "F").alias("old")).agg(F.sha2((F.max("o_orderkey") % 3).cast("string"), 256).alias("sha256"))
    return lineage.changed_tables(h.where("old"), h.where("not old"), ["name"])


@query("content_hash", """with r as (select o_orderstatus as name, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}') as h from orders),
g as (select name, count(*) as rows, sum(cast(('0x' || h[1:15]) as bigint)) as s0, sum(cast(('0x' || h[16:30]) as bigint)) as s1, sum(cast(('0x' || h[31:45]) as bigint)) as s2, sum(cast(('0x' || h[46:60]) as bigint)) as s3 from r group by 1)
select name, sha256('o_custkey:bigint,o_orderkey:bigint|' || rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) as sha256, rows from g""")
def content_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"), F.col("o_custkey").cast("bigint").alias("o_custkey"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    return lineage.content_hash(o)


@query("eligibility", """with t as (select o_custkey as name, list_sort(list(distinct case (o_custkey + o_orderkey) % 6 when 0 then 'DEGRADED' when 1 then 'UNAVAILABLE' when 2 then 'QUARANTINED' else 'VALID' end) filter (where o_orderkey % 2 = 0)) as q, o_custkey % 5 as b from orders group by o_custkey),
r as (select name, b, case when b = 1 then 'quarantined by a field-level check' when list_has_any(q, ['DEGRADED', 'UNAVAILABLE']) then 'rows that could not be judged: ' || array_to_string(list_filter(q, lambda x: x in ('DEGRADED', 'UNAVAILABLE')), ', ') when q is null then 'no data' end as reason from t)
select name, reason is null as quotes, b <> 2 as day_end, false as intraday, false as training, reason from r""")
def eligibility(spark, sf_dir):
    from causeway.operators.quality import eligibility as op

    k = (F.col("o_custkey") + F.col("o_orderkey")) % 6
    q = F.when(k == 0, "DEGRADED").when(k == 1, "UNAVAILABLE").when(k == 2, "QUARANTINED").otherwise("VALID")
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, q)).alias("qualifications"))
    b = F.col("name") % 5
    return op(t.withColumn("blocks", F.when(b == 1, F.array(F.lit("quotes"))).when(b == 2, F.array(F.lit("day_end")))))


@query("registry_summary", """with e as (select o_orderkey, case o_orderkey % 3 when 0 then 'data_quality' when 1 then 'risk_identification' else 'other' end as c, case o_custkey % 4 when 0 then 'computed_correctly' when 1 then 'replayed_and_explainable' when 2 then 'frozen_shadow_output' else 'tested_on_new_data' end as grade,
case o_custkey % 5 when 0 then 'passed' else 'insufficient_evidence' end as outcome from orders)
select k as capability, count(o_orderkey) as experiments, coalesce(array_to_string(list_sort(list(distinct grade) filter (where grade is not null)), ','), '') as grades,
coalesce(array_to_string(list_sort(list(distinct 'e' || o_orderkey) filter (where grade = 'tested_on_new_data' and outcome = 'passed')), ','), '') as may_influence
from (values ('data_quality'), ('risk_identification'), ('action_value')) t(k) left join e on c = k group by 1""")
def registry_summary(spark, sf_dir):
    from causeway.operators import research

    o = table(spark, sf_dir, "orders")
    pick = lambda c, n, values: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % n + 1).cast("int"))
    rows = o.select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("name"),
        pick("o_orderkey", 3, ("data_quality", "risk_identification", "other")).alias("capability"),
        pick("o_custkey", 4, research.LADDER).alias("grade"),
        F.when(F.col("o_custkey") % 5 == 0, "passed").otherwise("insufficient_evidence").alias("outcome"),
    )
    return research.summary(rows)


@query("late_open_interest", """with q as (select l_orderkey * 10 + l_linenumber as con_id, max(case when l_orderkey % 3 = 0 then l_quantity end) as oi from lineitem group by 1),
r as (select l_orderkey * 10 + l_linenumber as con_id, l_suppkey % 4 + 1 as attempt, max(case when l_orderkey % 5 < 3 then l_discount end) as oi from lineitem group by 1, 2)
select con_id, coalesce(q.oi, x.oi) as open_interest, cast(case when q.oi is null and x.oi is not null then x.attempt else 0 end as int) as attempt
from q left join (select con_id, min(attempt) as attempt, arg_min(oi, attempt) as oi from r where oi is not null group by 1) x using (con_id)""")
def late_open_interest(spark, sf_dir):
    from causeway.sources import quotes as landed_quotes

    li = table(spark, sf_dir, "lineitem")
    con = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("con_id")
    q = li.groupBy(con).agg(F.max(F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity"))).alias("open_interest")).withColumn("open_interest_attempt", F.lit(0))
    r = li.groupBy(con, (F.col("l_suppkey") % 4 + 1).cast("int").alias("attempt")).agg(F.max(F.when(F.col("l_orderkey") % 5 < 3, F.col("l_discount"))).alias("open_interest"))
    return landed_quotes.with_late_open_interest(q, r).select("con_id", "open_interest", F.col("open_interest_attempt").alias("attempt"))
