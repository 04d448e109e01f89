"""Registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from causeway.plans import evidence_queries, flow_queries, landing_queries, option_queries, quality_queries, registry, series_queries, snapshot_queries  # noqa: F401  importing registers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def register_views(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """The tables and every query as temporary views, so that all of them can be asked in SQL. A view is evaluated when it is read;
    queries that write on the way (streams, snapshots, landed files) do so when their view is made, so name those that are wanted."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    made = sorted(names if names is not None else set(queries()) - WRITING)
    for name in made:
        queries()[name](spark, sf_dir).createOrReplaceTempView(name if name not in TABLES else f"q_{name}")
    return made


#: Queries that write to the shared folder before they return.
WRITING = {"event_machine_stream", "watermark_late_rows", "snapshot_revisions", "snapshot_latest_sessions", "snapshot_read", "graph_csv", "wide_csv", "observations_json", "trades_json", "chart_json", "offline_groups", "landed_bars", "registry_store", "run_artefacts"}
