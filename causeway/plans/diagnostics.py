"""Checks of the installation and of the data a run needs."""

from __future__ import annotations

import importlib.util
import sys
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CLOSES = 252
MODULES = ("pyspark", "pyarrow", "pandas", "numpy")


def environment() -> list[dict[str, Any]]:
    rows = [{"check_name": f"module:{m}", "status": "ok" if importlib.util.find_spec(m) else "failed"} for m in MODULES]
    return [{"check_name": "python", "status": "ok" if sys.version_info >= (3, 10) else "failed"}, *rows]


def data_checks(health: DataFrame, prices: DataFrame, least: int = LEAST_CLOSES) -> DataFrame:
    """check_name, status: each required dataset has an eligible provider, each symbol enough closes."""
    status = lambda ok: F.when(ok, "ok").otherwise("failed").alias("status")
    fresh = health.where("required").groupBy("dataset").agg(F.bool_or("eligible").alias("ok"))
    closes = prices.groupBy("symbol").agg((F.count("p") >= least).alias("ok"))
    return fresh.select(F.concat(F.lit("required:"), "dataset").alias("check_name"), status(F.col("ok"))).unionByName(closes.select(F.concat(F.lit("closes:"), "symbol").alias("check_name"), status(F.col("ok"))))
