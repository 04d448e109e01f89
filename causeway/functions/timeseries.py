"""Causal column builders over a series: nothing here looks at a later row unless its name says forward.

Every builder takes the window of its series (see `series`), so all builders of one select share one exchange and
one sort. A statistic over a frame is null until the frame has its minimum of non-null values.
"""

from __future__ import annotations

from bisect import bisect_left, insort


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(*by: str, order: str = "session") -> WindowSpec:
    return W.partitionBy(*by).orderBy(order)


def known(x: Column) -> Column:
    """x, null where it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def cleaned(x: Column) -> Column:
    """Broker sentinels (negative, NaN) to null; zero stays."""
    return F.when(~F.isnan(x) & (x >= 0), x)


def pct_change(p: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(p, F.lag(p, n).over(w)) - 1


def change(x: Column, w: WindowSpec, n: int) -> Column:
    return x - F.lag(x, n).over(w)


def rolling(agg, x: Column, w: WindowSpec, n: int, minimum: int | None = None) -> Column:
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) >= (minimum or n), agg(x).over(frame))


def rolling_mean(x: Column, w: WindowSpec, n: int) -> Column:
    return rolling(F.avg, x, w, n)


def rolling_volatility(r: Column, w: WindowSpec, n: int, days: int = 252) -> Column:
    return rolling(F.stddev_samp, r, w, n) * F.sqrt(F.lit(float(days)))


def expanding_mean(x: Column, w: WindowSpec, minimum: int) -> Column:
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    return F.when(F.count(x).over(frame) >= minimum, F.avg(x).over(frame))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def back_fill(x: Column, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def forward_drawdown_event(p: Column, w: WindowSpec, horizon: int, depth: float) -> Column:
    """1 if the lowest of the next `horizon` values is `depth` or more below, null unless all of them exist."""
    ahead = w.rowsBetween(1, horizon)
    return F.when(F.count(p).over(ahead) == horizon, (F.min(p).over(ahead) / p - 1 <= -abs(depth)).cast("int"))


def equity(r: Column, w: WindowSpec) -> Column:
    """Cumulative growth; a loss of all or more is null rather than an error."""
    return F.exp(F.sum(F.when(r > -1, F.log1p(r))).over(w.rowsBetween(W.unboundedPreceding, 0)))


def changed(x: Column, w: WindowSpec) -> Column:
    return F.coalesce((~x.eqNullSafe(F.lag(x, 1).over(w))).cast("int"), F.lit(1))


def run_id(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(W.unboundedPreceding, 0))


def scale_factor(ratio: Column, tolerance: float = 0.02) -> Column:
    """10^k if the ratio is within tolerance of a power of ten other than 1."""
    k = F.bround(F.log10(F.when(ratio > 0, ratio)))
    return F.when((k != 0) & (F.abs(ratio / F.pow(F.lit(10.0), k) - 1) <= tolerance), F.pow(F.lit(10.0), k))


def _ewm(values: np.ndarray, alpha: float, minimum: int) -> np.ndarray:
    """Bias-corrected exponentially weighted deviation; gaps decay the weights."""
    q, out = 1 - alpha, np.full(len(values), np.nan)
    s0 = s1 = s2 = ss = 0.0
    n = 0
    for i, x in enumerate(values):
        s0, s1, s2, ss = s0 * q, s1 * q, s2 * q, ss * q * q
        if x == x:
            s0, s1, s2, ss, n = s0 + 1, s1 + x, s2 + x * x, ss + 1, n + 1
        if n >= minimum and n > 1:
            m = s1 / s0
            out[i] = np.sqrt(max(0.0, (s2 / s0 - m * m) * s0 * s0 / (s0 * s0 - ss)))
    return out


def ewm_volatility(df: DataFrame, by: list[str], order: str, value: str, out: str, alpha: float = 0.06, minimum: int = 20) -> DataFrame:
    """A recursion over each series. A series holds one row per session, so its length is that of the calendar."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = _ewm(pdf[value].to_numpy(dtype=float), alpha, minimum)
        return pdf.assign(**{out: [None if x != x else float(x) for x in v]})

    return df.groupBy(*by).applyInPandas(f, f"{_ddl(df)}, {out} double")


def causal_percentile(df: DataFrame, by: list[str], order: str, value: str, out: str, minimum: int = 252) -> DataFrame:
    """Share of earlier values below the current one; null until `minimum` values, the current one included."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen: list[float] = []
        ranks: list[float | None] = []
        for x in pdf[value].to_numpy(dtype=float):
            if x != x:
                ranks.append(None)
                continue
            ranks.append(bisect_left(seen, x) / len(seen) if len(seen) + 1 >= minimum and seen else None)
            insort(seen, x)
        return pdf.assign(**{out: pd.array(ranks, dtype="Float64")})

    return df.groupBy(*by).applyInPandas(f, f"{_ddl(df)}, {out} double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


