"""Queries of validated snapshots, written and read back, and of their histories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causeway.operators import snapshots
from causeway.plans.inputs import table
from causeway.plans.registry import query
from causeway.session import shared_folder


def written(spark, sf_dir):
    """Five runs over the whole of orders and customer: new, the same again, revised prices, another view, and a changed verdict."""
    root = f"{shared_folder(spark)}/causeway/snapshots-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first = {"orders": orders, "customers": customers}
    revised = first | {"orders": orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)}
    for tables, run, verdict in (
        (first, {"horizon": "30-60"}, ("day_end",)),
        (first, {"horizon": "30-60"}, ("day_end",)),
        (revised, {"horizon": "30-60"}, ("day_end", "quotes")),
        (first, {"horizon": "60-90"}, ()),
        (first, {"horizon": "30-60"}, ()),
    ):
        snapshots.write_snapshot(spark, root, "2001-06-29", tables, {"limits": 1}, run, verdict, {} if verdict else {"day_end": "rule changed"})
    return root, snapshots.current(snapshots.records(spark, root))


REVISIONS = """with n as (select (select count(*) from orders) + (select count(*) from customer) as rows)
select * from (values ('30-60', 1, false, cast(null as varchar), cast(null as varchar), 1), ('30-60', 2, true, 'orders', 'day_end,quotes', 0), ('60-90', 1, false, null, null, 0)) t(horizon, revision, supersedes, changed_tables, eligible_for, amendments), n"""


@query("snapshot_revisions", REVISIONS)
def snapshot_revisions(spark, sf_dir):
    """The same content is no second snapshot; a changed verdict is an amendment; another view is no revision."""
    _, m = written(spark, sf_dir)
    listed = snapshots.list_snapshots(m).join(m.select("snapshot_id", F.size("amendments").alias("amendments")), "snapshot_id")
    return listed.select(F.get_json_object("view", "$.horizon").alias("horizon"), "revision", F.col("supersedes").isNotNull().alias("supersedes"), "changed_tables", "eligible_for", "amendments", "rows")


@query("snapshot_latest_sessions", """with n as (select (select count(*) from orders) + (select count(*) from customer) as rows)
select * from (values ('30-60', 2, 2), ('60-90', 1, 1)) t(horizon, revision, revisions), n""")
def snapshot_latest_sessions(spark, sf_dir):
    latest = snapshots.latest_sessions(snapshots.list_snapshots(written(spark, sf_dir)[1]))
    return latest.select(F.get_json_object("view", "$.horizon").alias("horizon"), "revision", F.col("revisions").cast("int").alias("revisions"), "rows")


@query("snapshot_read", "select o_orderkey, o_custkey, round(o_totalprice + 1, 2) as o_totalprice from orders")
def snapshot_read(spark, sf_dir):
    """The revised snapshot read back, after its content was found to be what the manifest says."""
    root, m = written(spark, sf_dir)
    own = m.where("revision = 2").first()["snapshot_id"]
    snapshot = snapshots.read_snapshot(spark, root, own)
    if problems := snapshots.verify_snapshot(snapshot):
        raise ValueError(f"{own}: {problems}")
    snapshot.require("quotes")
    return snapshot.table("orders").withColumn("o_totalprice", F.round("o_totalprice", 2))


#: A history of manifests: one per order, its tables from lineitem.
HISTORY = """mt as (select l_orderkey, l_returnflag as name, count(*) as rows, sum(l_quantity) as q from lineitem group by 1, 2),
mo as (select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as session, o_orderpriority as view from orders),
mr as (select *, cast(row_number() over (partition by session, view order by o_orderkey) as int) as revision from mo)"""


def history(spark, sf_dir):
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("q"))
    tables = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), "rows", F.col("q").cast("string").alias("sha256")))).alias("tables"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc(F.to_date("o_orderdate"), "month").alias("session"), F.col("o_orderpriority").alias("view"), F.col("o_orderstatus").alias("status"))
    w = W.partitionBy("session", "view").orderBy("o_orderkey")
    m = o.join(tables, o["o_orderkey"] == tables["l_orderkey"], "left").withColumns({"revision": F.row_number().over(w).cast("int"), "supersedes": F.lag("o_orderkey").over(w).cast("string")})
    none = F.array().cast("array<string>")
    return m.select(
        F.col("o_orderkey").cast("string").alias("snapshot_id"),
        "session",
        "revision",
        "view",
        "supersedes",
        F.when(F.col("revision") > 1, F.array(F.lit("quotes"))).alias("changed_tables"),
        F.coalesce("tables", F.array().cast(tables.schema["tables"].dataType)).alias("tables"),
        F.lit(0).cast("long").alias("requests"),
        F.lit(0).cast("long").alias("issues"),
        F.when(F.col("status") == "F", F.array(F.lit("day_end"))).otherwise(none).alias("eligible_for"),
    )


@query("snapshot_list", f"""with {HISTORY}, g as (select l_orderkey, count(*) as tables, cast(sum(rows) as bigint) as rows from mt group by 1)
select cast(m.o_orderkey as varchar) as snapshot_id, session, revision, view, cast(lag(m.o_orderkey) over (partition by session, view order by m.o_orderkey) as varchar) as supersedes, case when revision > 1 then 'quotes' end as changed_tables,
cast(coalesce(tables, 0) as int) as tables, coalesce(rows, 0) as rows, case when o_orderstatus = 'F' then 'day_end' end as eligible_for from mr m join orders using (o_orderkey) left join g on l_orderkey = m.o_orderkey""")
def snapshot_list(spark, sf_dir):
    return snapshots.list_snapshots(history(spark, sf_dir)).drop("requests", "issues")


@query("snapshot_session_count", f"with {HISTORY} select count(distinct session) as sessions from mr")
def snapshot_session_count(spark, sf_dir):
    return snapshots.session_count(snapshots.list_snapshots(history(spark, sf_dir)))


@query("snapshot_session_revisions", f"with {HISTORY} select cast(o_orderkey as varchar) as snapshot_id, revision from mr where session = date '1998-01-01' and view = '1-URGENT'")
def snapshot_session_revisions(spark, sf_dir):
    view = history(spark, sf_dir).withColumn("view", F.when(F.col("view") == "1-URGENT", snapshots.canonical({"priority": 1})).otherwise(F.col("view")))
    return snapshots.session_revisions(view, "1998-01-01", {"priority": 1}).select("snapshot_id", "revision")
