"""Indicators, their contradictions, labels and the leaning that the labels allow."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.settings import DIMENSIONS, LabelRules

#: name -> (dimension, whether higher is riskier, the indicator it shares data with).
CATALOGUE = {
    "spy_vs_200d_ma": ("trend", False, None),
    "spy_return_63d": ("trend", False, None),
    "spy_drawdown_252d": ("trend", False, None),
    "realised_vol_20d": ("volatility", True, None),
    "realised_vol_60d": ("volatility", True, None),
    "vol_ratio_20_over_60": ("volatility", True, None),
    "ewma_vol_lambda94": ("volatility", True, None),
    "rsp_over_spy": ("participation", False, None),
    "iwm_over_spy": ("participation", False, None),
    "hy_oas": ("credit", True, None),
    "baa_spread": ("credit", True, None),
    "hyg_over_lqd": ("credit", False, "hy_oas"),
    "vix_close": ("implied", True, None),
}


def indicator_values(prices: DataFrame, macro: DataFrame) -> DataFrame:
    """(name, session, value): every indicator's history, from wide prices by symbol and long macro series."""
    w = ts.series("symbol")
    spy = prices.where("symbol = 'spy'").withColumn("r", ts.pct_change(F.col("p"), w))
    spy = ts.ewm_volatility(spy, ["symbol"], "session", "r", "ewm", minimum=60)
    v20, v60 = (ts.rolling_volatility(F.col("r"), w, n) for n in (20, 60))
    own = spy.select(
        "session",
        (F.try_divide(F.col("p"), ts.rolling_mean(F.col("p"), w, 200)) - 1).alias("spy_vs_200d_ma"),
        ts.pct_change(F.col("p"), w, 63).alias("spy_return_63d"),
        (F.try_divide(F.col("p"), ts.rolling(F.max, F.col("p"), w, 252)) - 1).alias("spy_drawdown_252d"),
        (v20 * 100).alias("realised_vol_20d"),
        (v60 * 100).alias("realised_vol_60d"),
        F.try_divide(v20, v60).alias("vol_ratio_20_over_60"),
        (F.col("ewm") * F.sqrt(F.lit(252.0)) * 100).alias("ewma_vol_lambda94"),
    )
    long = own.unpivot(["session"], own.columns[1:], "name", "value")
    ratios = peer_ratios(prices, {"rsp_over_spy": ("rsp", "spy"), "iwm_over_spy": ("iwm", "spy"), "hyg_over_lqd": ("hyg", "lqd")})
    long = long.unionByName(ratios.select("session", F.col("pair").alias("name"), F.col("change_63").alias("value")))
    return long.unionByName(macro.select("session", F.col("series").alias("name"), "value"))


def peer_ratios(prices: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """pair, session, ratio and its 63-session change, each on the sessions that both have: one pivot for all pairs."""
    symbols = sorted({s for p in pairs.values() for s in p})
    wide = prices.groupBy("session").pivot("symbol", symbols).agg(F.first("p"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("pair"), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.try_divide(F.col(a), F.col(b)).alias("ratio"))).alias("r")) for n, (a, b) in pairs.items()))).alias("x")
    r = wide.select("session", each).where("x.r is not null").select("x.pair", "session", "x.r.ratio")
    return r.withColumn("change_63", ts.pct_change(F.col("ratio"), ts.series("pair"), 63))


def peer_ratio(prices: DataFrame, a: str, b: str) -> DataFrame:
    return peer_ratios(prices, {f"{a}/{b}": (a, b)})


def evidence(values: DataFrame, minimum: int = 252) -> DataFrame:
    """One row per indicator: last value, changes over 1, 5, 20 observations, causal rank of the last, coverage.

    One exchange by name: windows number the observations and carry each indicator's last one to all its rows, and one
    aggregation reads off the rest.
    """
    w, whole, back = ts.series("name"), W.partitionBy("name"), W.partitionBy("name").orderBy(F.col("session").desc())
    v = values.withColumns({"seq": F.count("value").over(w), "n": F.count("value").over(whole), "k": F.row_number().over(back)})
    v = v.withColumn("now", F.max(F.when(F.col("value").isNotNull() & (F.col("seq") == F.col("n")), F.col("value"))).over(whole))
    there = F.col("value").isNotNull()
    ago = lambda d: F.max(F.when(there & (F.col("seq") == F.col("n") - d), F.col("value")))
    earlier = there & (F.col("seq") < F.col("n"))
    out = v.where("n > 0").groupBy("name").agg(
        F.max("n").alias("n"),
        F.max(F.when(there, F.col("session"))).alias("as_of"),
        F.max("now").alias("value"),
        *((F.max("now") - ago(d)).alias(f"change_{d}") for d in (1, 5, 20)),
        F.count(F.when(earlier & (F.col("value") < F.col("now")), 1)).alias("below"),
        F.count(F.when(earlier, 1)).alias("earlier"),
        F.avg(F.when(F.col("k") <= 252, there.cast("int"))).alias("coverage"),
    )
    ranked = F.when(F.col("n") >= minimum, F.try_divide(F.col("below"), F.col("earlier")))
    meta = F.lit(None).cast("struct<dimension:string,riskier:boolean,overlap_with:string>")
    for name, (d, up, over) in CATALOGUE.items():
        meta = F.when(F.col("name") == name, F.struct(F.lit(d).alias("dimension"), F.lit(up).alias("riskier"), F.lit(over).cast("string").alias("overlap_with"))).otherwise(meta)
    return out.withColumn("m", meta).select("name", "m.dimension", "m.riskier", "m.overlap_with", "as_of", "value", "change_1", "change_5", "change_20", ranked.alias("percentile"), "coverage").withColumns({"direction": direction(), "risk_rank": risk_rank()})


def direction() -> Column:
    c = F.col("change_20")
    flat = c.isNull() | ~ts.finite(c) | (F.abs(c) < 1e-12)
    return F.when(flat, "stable").when((c > 0) == F.col("riskier"), "deteriorating").otherwise("easing")


def risk_rank() -> Column:
    return F.when(F.col("riskier"), F.col("percentile")).otherwise(1 - F.col("percentile"))


def missing_dimensions(found: DataFrame) -> DataFrame:
    want = found.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    have = found.groupBy("dimension").agg(F.bool_or(F.col("value").isNotNull()).alias("covered"))
    return want.join(have, "dimension", "left").select("dimension", F.coalesce("covered", F.lit(False)).alias("covered"))


def contradictions(found: DataFrame) -> DataFrame:
    """Dimensions that split within themselves, and worsening ones against easing ones. At most a row per pair of dimensions."""
    votes = found.where("overlap_with is null and value is not null").groupBy("dimension").agg(F.array_sort(F.collect_set("direction")).alias("d"))
    worse, ease = F.array_contains("d", "deteriorating"), F.array_contains("d", "easing")
    stance = F.when(worse & ease, "split").when((F.size("d") == 1) & worse, "worsening").when((F.size("d") == 1) & ease, "easing").otherwise("stable")
    s = votes.select("dimension", stance.alias("stance"))
    split = s.where("stance = 'split'").select(F.lit("split").alias("kind"), F.col("dimension").alias("left_dimension"), F.col("dimension").alias("right_dimension"))
    a = s.where("stance = 'worsening'").select(F.lit(1).alias("j"), F.col("dimension").alias("left_dimension"))
    b = s.where("stance = 'easing'").select(F.lit(1).alias("j"), F.col("dimension").alias("right_dimension"))
    return split.unionByName(a.join(b, "j").select(F.lit("against").alias("kind"), "left_dimension", "right_dimension"))


def review_triggers(found: DataFrame, step: float = 0.10) -> DataFrame:
    p = F.col("percentile")
    return found.where("percentile is not null").select("name", F.round(F.least(F.lit(1.0), p + step), 6).alias("above"), F.round(F.greatest(F.lit(0.0), p - step), 6).alias("below"))


def state_labels(found: DataFrame, rules: LabelRules = LabelRules()) -> DataFrame:
    """One row of labels: damaged trend, high volatility, spreading stress, repair."""
    votes = F.col("overlap_with").isNull()
    notable = votes & (((F.col("direction") == "deteriorating") & (F.col("risk_rank") >= rules.stress_percentile)) | ((F.col("direction") == "easing") & (F.col("risk_rank") <= 1 - rules.stress_percentile)))
    by = found.groupBy("dimension").agg(
        F.coalesce(F.bool_or(notable & (F.col("direction") == "deteriorating")), F.lit(False)).alias("worse"),
        F.coalesce(F.bool_or(notable & (F.col("direction") == "easing")), F.lit(False)).alias("ease"),
    )
    n = by.agg(
        F.count(F.when(F.col("worse"), 1)).alias("worsening"),
        F.count(F.when(F.col("worse") & F.col("dimension").isin("participation", "credit"), 1)).alias("broad"),
        F.count(F.when(F.col("ease"), 1)).alias("easing"),
    )
    own = found.agg(
        F.coalesce(F.bool_or((F.col("name") == "spy_vs_200d_ma") & (F.col("value") < rules.below_average)), F.lit(False)).alias("trend_damaged"),
        F.coalesce(F.bool_or((F.col("name") == "vol_ratio_20_over_60") & (F.col("percentile") >= rules.volatility_percentile)), F.lit(False)).alias("volatility_elevated"),
    )
    return own.join(n).select("trend_damaged", "volatility_elevated", ((F.col("worsening") >= 2) & (F.col("broad") >= 1)).alias("stress_spreading"), ((F.col("easing") >= 2) & (F.col("worsening") == 0)).alias("repair_underway"))


def leaning(labels: DataFrame, grade: Column | None = None) -> DataFrame:
    """The first rung that fits. Without a grade the leaning is withheld: an untested rule can't lean."""
    t, v, s, r = (F.col(c) for c in ("trend_damaged", "volatility_elevated", "stress_spreading", "repair_underway"))
    rung = F.when(t & (v | s), "REDUCTION").when(r & (t | v | s), "CONFLICTED").when(v & ~t & ~s, "HEDGE").when(t | v | s, "WATCH").when(r, "WATCH").otherwise("NO_NEW_DEFENSE")
    out = labels.withColumn("rung", rung)
    g = grade if grade is not None else F.lit(LabelRules().grade)
    return out.withColumn("leaning", F.when(g == "UNTESTED", "DATA_INSUFFICIENT").otherwise(F.col("rung")))


def described(found: DataFrame) -> dict[str, Any]:
    """The evidence for a reader: indicators by dimension, what is missing, and what contradicts. A dozen rows: the catalogue bounds them."""
    rows = [r.asDict() for r in found.orderBy("name").collect()]
    small = found.sparkSession.createDataFrame(rows, found.schema) if rows else found
    by: dict[str, list[dict[str, Any]]] = {}
    for r in rows:
        by.setdefault(r["dimension"], []).append({k: r[k] for k in ("name", "value", "percentile", "direction", "coverage", "as_of")})
    missing = [r["dimension"] for r in missing_dimensions(small).where("not covered").orderBy("dimension").collect()]
    return {"dimensions": by, "missing": missing, "contradictions": [r.asDict() for r in contradictions(small).collect()]}


def with_missing(found: DataFrame) -> DataFrame:
    """All indicators of the catalogue, with the reason where one has no value: no data, or too little for a rank."""
    rows = [(n, d, up, over) for n, (d, up, over) in CATALOGUE.items()]
    every = found.sparkSession.createDataFrame(rows, "name string, dimension string, riskier boolean, overlap_with string")
    out = every.join(found.drop("dimension", "riskier", "overlap_with"), "name", "left")
    return out.withColumn("missing_reason", F.when(F.col("value").isNull(), "no data").when(F.col("percentile").isNull(), "too few observations for a rank"))


def promoted(rules: LabelRules, grade: str, evidence: dict[str, Any]) -> LabelRules:
    """The rules one rung up the ladder, for which evidence must be named."""
    rungs = ("UNTESTED", "REPLAYED", "SHADOWED", "TESTED")
    if grade not in rungs or rungs.index(grade) != rungs.index(rules.grade) + 1:
        raise ValueError(f"{rules.grade} isn't followed by {grade}")
    if not evidence or any(v in (None, "") for v in evidence.values()):
        raise ValueError("a promotion names its evidence")
    return replace(rules, grade=grade)
