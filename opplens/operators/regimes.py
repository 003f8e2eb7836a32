"""Market regimes: thresholds fitted on training rows only, the state of each row with its reasons, and what the assignment looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import exact_quantiles

#: What a source calls the states of a trend.
TREND_NAMES = {"TRENDING": ("TRENDING", "TREND", "BULL", "BULLISH", "BEAR", "BEARISH", "UP", "DOWN"), "MEAN_REVERTING": ("MEAN_REVERTING", "MEAN-REVERTING", "MEAN_REVERSION", "REVERTING"), "NEUTRAL": ("NEUTRAL", "RANGE", "RANGING", "FLAT")}
BIASES = ("d1_bias", "h4_bias", "h1_bias")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def source_trend(text: Column) -> Column:
    t = F.upper(F.trim(text))
    out = F.when(t.isNull(), None)
    for state, names in TREND_NAMES.items():
        out = out.when(t.isin(*names), state)
    return out


def fit_regimes(train: DataFrame, score_threshold: float = 0.5, conflict: str = "feature_status") -> DataFrame:
    """One row of thresholds from the training rows that are not in conflict: thirds of the two volatilities, the 0.95 quantile of the spread
    and the 0.75 quantile of the absolute z-score."""
    rows = train.where(F.upper(F.coalesce(conflict, F.lit(""))) != "CONFLICT")
    z = F.coalesce(finite(F.col("price_abs_z20")), F.abs(finite(F.col("price_z20"))))
    rows = rows.select(*[finite(F.col(c)).alias(c) for c in ("atr_percent", "return_std_20", "spread_r")], z.alias("abs_z"))
    third = {"low": ("linear", 1 / 3), "high": ("linear", 2 / 3)}
    wanted = {"atr": ("atr_percent", third), "std": ("return_std_20", third), "spread": ("spread_r", {"stressed": ("linear", 0.95)}), "z": ("abs_z", {"extreme": ("linear", 0.75)})}
    out = rows.sparkSession.createDataFrame([(score_threshold,)], "score double")
    for name, (column, rules) in wanted.items():
        out = out.join(F.broadcast(exact_quantiles(rows, column, rules).select(*[F.col(k).alias(f"{name}_{k}") for k in rules])))  # one row each
    return out


def assign_regimes(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows with trend, volatility, liquidity, composite, confidence and reason.

    The trend is what the source says; else what the composite score says; else whether the price is far from its mean; else what the
    biases of three timeframes agree on. Volatility is that of the range, else that of the returns, by their own thresholds."""
    x = rows.join(F.broadcast(thresholds))  # one row
    score, z, spread = (finite(F.col(c)) for c in ("composite_regime_score", "price_z20", "spread_r"))
    biases = F.array_distinct(F.array_compact(F.array(*[source_trend(F.col(c)) for c in BIASES])))
    trend = (
        F.when(source_trend(F.col("source_regime")).isNotNull(), source_trend(F.col("source_regime")))
        .when(score.isNotNull() & F.col("score").isNotNull(), F.when(score >= F.col("score"), "TRENDING").when(score <= -F.col("score"), "MEAN_REVERTING").otherwise("NEUTRAL"))
        .when(z.isNotNull() & F.col("z_extreme").isNotNull(), F.when(F.abs(z) >= F.col("z_extreme"), "MEAN_REVERTING").otherwise("NEUTRAL"))
        .when(F.size(biases) == 1, F.get(biases, F.lit(0))).otherwise("UNKNOWN")
    )
    atr = finite(F.col("atr_percent"))
    value = F.coalesce(atr, finite(F.col("return_std_20")))
    low, high = (F.when(atr.isNotNull(), F.col(f"atr_{k}")).otherwise(F.col(f"std_{k}")) for k in ("low", "high"))
    volatility = F.when(value.isNull() | low.isNull() | high.isNull(), "UNKNOWN").when(value < low, "LOW").when(value >= high, "HIGH").otherwise("NORMAL")
    liquidity = F.when(spread.isNull() | F.col("spread_stressed").isNull(), "UNKNOWN").when(spread >= F.col("spread_stressed"), "STRESSED").otherwise("NORMAL")
    x = x.withColumns({"trend": trend, "volatility": volatility, "liquidity": liquidity})
    states = {"insufficient_trend_features": "trend", "insufficient_volatility_features": "volatility", "insufficient_liquidity_features": "liquidity"}
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "UNKNOWN", F.lit(reason)) for reason, c in states.items()]))
    composite = F.when((F.col("trend") == "UNKNOWN") | (F.col("volatility") == "UNKNOWN"), "UNKNOWN").otherwise(F.concat(F.when(F.col("trend") == "TRENDING", "TREND_").otherwise("RANGE_"), "volatility", F.lit("_VOL")))
    confidence = F.when(F.size(missing) == 0, "HIGH").when(F.size(missing) == 1, "MEDIUM").otherwise("LOW")
    reason = F.when(F.size(missing) == 0, "all_regime_dimensions_available").otherwise(F.array_join(missing, ";"))
    return x.select(*rows.columns, "trend", "volatility", "liquidity", composite.alias("composite"), confidence.alias("confidence"), reason.alias("reason"))


def regime_report(assigned: DataFrame) -> DataFrame:
    """(kind, key, composite, n): the distribution, the confusion of what the source says with what was assigned, and counts by side, timeframe
    and month; one pass, in which each row stands in each kind once."""
    said = F.upper(F.trim("source_regime"))
    source = F.when(F.col("source_regime") != "", said)
    keys = F.array(
        F.struct(F.lit("distribution").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("confusion").alias("kind"), source.alias("key")),
        F.struct(F.lit("side").alias("kind"), F.coalesce("side", F.lit("UNKNOWN")).alias("key")), F.struct(F.lit("timeframe").alias("kind"), F.coalesce("timeframe", F.lit("UNKNOWN")).alias("key")),
        F.struct(F.lit("period").alias("kind"), F.date_format("ts", "yyyy-MM").alias("key")),
    )
    return assigned.select("composite", F.inline(keys)).where("key is not null").groupBy("kind", "key", "composite").agg(F.count(F.lit(1)).alias("n"))


def regime_agreement(assigned: DataFrame) -> DataFrame:
    """One row: rows, the share with a known regime, the share that a source speaks of, and the share of those on which both agree."""
    source = F.when(F.col("source_regime") != "", F.upper(F.trim("source_regime")))
    kind = F.when(source.isin("TRENDING", "TREND"), "TREND").when(source.isin("RANGE", "RANGING", "NEUTRAL"), "RANGE").otherwise(source)
    prefix = F.when(F.col("composite").startswith("TREND_"), "TREND").when(F.col("composite").startswith("RANGE_"), "RANGE").otherwise(F.col("composite"))
    agree = F.count_if((kind == prefix) | (source == F.col("composite")))
    n = F.count(F.lit(1))
    return assigned.agg(n.alias("rows"), F.try_divide(F.count_if(F.col("composite") != "UNKNOWN").cast("double"), n).alias("coverage"), F.try_divide(F.count(source).cast("double"), n).alias("source_coverage"), F.try_divide(agree.cast("double"), F.count(source)).alias("agreement"))
