"""Queries over the bucket sets and over regimes, with every branch of their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from opplens.functions import buckets as B
from opplens.operators import regimes as R

from .registry import query, rounded, table

#: Values on and around every bound, made from the columns of an order line.
_VALUES = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (l_partkey % 21) / 20.0e0 END AS efficiency, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE (l_suppkey % 21) * 5.0e0 END AS rank, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE (l_orderkey % 15) / 100.0e0 END AS spread, (l_orderkey % 13) / 4.0e0 AS stop, (l_partkey % 25) / 10.0e0 AS z, (l_suppkey % 31) / 20.0e0 AS ratio,
  40 + (l_orderkey % 41) / 2.0e0 AS rsi, 45 + (l_partkey % 21) / 2.0e0 AS ema, 42 + (l_orderkey % 37) / 2.0e0 AS wma, CASE WHEN l_partkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, (l_orderkey % 23 - 11) / 2.0e0 AS score, CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE (l_suppkey % 9 - 2) / 2.0e0 END AS current_r, CASE WHEN l_orderkey % 7 > 0 THEN l_linenumber % 3 END AS adds FROM {lineitem}"""


def _case(x: str, spec: tuple) -> str:
    bounds, names, closed = spec
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {'<=' if at else '<'} {b} THEN '{n}'" for b, n, at in zip(bounds, names, closed)) + f" ELSE '{names[-1]}' END"


_PLAIN = {"b1_efficiency": ("efficiency", B.EFFICIENCY), "b2_rank": ("rank", B.RANK), "b3_spread": ("spread", B.SPREAD_R), "b4_stop": ("stop", B.STOP_ATR), "b5_z": ("z", B.ABS_Z), "b6_ratio": ("ratio", B.STD_RATIO), "b7_level": ("rsi", B.ENTRY_LEVEL)}


@query(f"""WITH v AS ({_VALUES.format(lineitem='lineitem')}) SELECT l_orderkey, l_linenumber, {', '.join(f'{_case(c, s)} AS {n}' for n, (c, s) in _PLAIN.items())}, {_case('abs(rsi - ema)', B.EMA_GAP)} AS b7_gap, CASE WHEN side = 'LONG' THEN CASE WHEN rsi > wma THEN 'above_wma' ELSE 'below_wma' END WHEN rsi < wma THEN 'below_wma' ELSE 'above_wma' END AS b7_position,
  CASE WHEN trunc(score) >= 4 THEN 'bullish' WHEN trunc(score) <= -4 THEN 'bearish' ELSE 'neutral' END AS b7_regime, coalesce({_case('current_r', B.MATURITY)}, 'unknown') AS b8_maturity, coalesce({_case('adds', B.PYRAMID)}, 'unknown') AS b8_pyramid FROM v""")
def b1_b8_bucket_sets(spark, d):
    """All bucket sets with their bounds, which of them belong below, and what a missing value is."""
    v = spark.sql(_VALUES, lineitem=table(spark, d, "lineitem"))
    c = F.col
    return v.select("l_orderkey", "l_linenumber", *[B.bucket(c(x), s).alias(n) for n, (x, s) in _PLAIN.items()], B.ema_gap(c("rsi"), c("ema")).alias("b7_gap"), B.wma_position(c("side"), c("rsi"), c("wma")).alias("b7_position"), B.regime_bucket(c("score")).alias("b7_regime"), B.known(B.bucket(c("current_r"), B.MATURITY)).alias("b8_maturity"), B.known(B.bucket(c("adds"), B.PYRAMID)).alias("b8_pyramid"))


#: Rows with every way in which a feature is there or not.
_ROWS = """SELECT l_orderkey * 8 + l_linenumber AS id, l_shipdate AS ts, CASE WHEN l_partkey % 2 = 0 THEN 'LONG' WHEN l_partkey % 31 > 0 THEN 'SHORT' END AS side, CASE WHEN l_suppkey % 5 > 0 THEN 'H1' END AS timeframe, CASE WHEN l_orderkey % 19 = 0 THEN 'CONFLICT' ELSE 'VALID' END AS feature_status, CASE l_partkey % 9 WHEN 0 THEN ' bullish ' WHEN 1 THEN 'mean-reverting' WHEN 2 THEN 'Ranging' WHEN 3 THEN 'odd' WHEN 4 THEN '' WHEN 5 THEN 'TREND' END AS source_regime,
  CASE WHEN l_suppkey % 3 = 0 THEN l_discount * 20.0e0 - 1 END AS composite_regime_score, CASE WHEN l_orderkey % 4 > 0 THEN l_tax * 50.0e0 - 2 END AS price_z20, CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 4 > 0 THEN abs(l_tax * 50.0e0 - 2) END AS price_abs_z20, CASE l_linenumber WHEN 1 THEN 'UP' WHEN 2 THEN 'RANGE' WHEN 3 THEN 'BEAR' END AS d1_bias, CASE l_orderkey % 5 WHEN 0 THEN 'TREND' WHEN 1 THEN 'FLAT' END AS h4_bias, CASE l_partkey % 4 WHEN 0 THEN 'BULL' WHEN 1 THEN 'none' END AS h1_bias,
  CASE WHEN l_partkey % 5 > 1 THEN l_quantity * 1.0e0 WHEN l_partkey % 5 = 1 THEN CAST('NaN' AS DOUBLE) END AS atr_percent, CASE WHEN l_partkey % 7 > 1 THEN l_extendedprice / 1000.0e0 END AS return_std_20, CASE WHEN l_orderkey % 8 > 0 THEN l_tax * 1.0e0 END AS spread_r FROM {lineitem}"""


def _source(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN upper(trim({c})) IN {names} THEN '{state}'" for state, names in R.TREND_NAMES.items()) + " END"


_ATR = "CASE WHEN NOT isnan(atr_percent) THEN atr_percent END"
_ASSIGNED = f"""r AS ({_ROWS.format(lineitem='lineitem')}), tr AS (SELECT * FROM r WHERE ts < TIMESTAMP '1997-01-01' AND feature_status <> 'CONFLICT'),
t AS (SELECT quantile_cont({_ATR}, 1.0/3) AS al, quantile_cont({_ATR}, 2.0/3) AS ah, quantile_cont(return_std_20, 1.0/3) AS sl, quantile_cont(return_std_20, 2.0/3) AS sh, quantile_cont(spread_r, 0.95) AS st, quantile_cont(coalesce(price_abs_z20, abs(price_z20)), 0.75) AS ze FROM tr),
b AS (SELECT *, list_distinct(list_filter([{', '.join(_source(c) for c in R.BIASES)}], lambda x: x IS NOT NULL)) AS biases, {_ATR} AS atr, {_source('source_regime')} AS said FROM r, t),
s AS (SELECT *, CASE WHEN said IS NOT NULL THEN said WHEN composite_regime_score IS NOT NULL THEN CASE WHEN composite_regime_score >= 0.5 THEN 'TRENDING' WHEN composite_regime_score <= -0.5 THEN 'MEAN_REVERTING' ELSE 'NEUTRAL' END WHEN price_z20 IS NOT NULL THEN CASE WHEN abs(price_z20) >= ze THEN 'MEAN_REVERTING' ELSE 'NEUTRAL' END WHEN len(biases) = 1 THEN biases[1] ELSE 'UNKNOWN' END AS trend,
  CASE WHEN coalesce(atr, return_std_20) IS NULL THEN 'UNKNOWN' WHEN coalesce(atr, return_std_20) < CASE WHEN atr IS NULL THEN sl ELSE al END THEN 'LOW' WHEN coalesce(atr, return_std_20) >= CASE WHEN atr IS NULL THEN sh ELSE ah END THEN 'HIGH' ELSE 'NORMAL' END AS volatility, CASE WHEN spread_r IS NULL THEN 'UNKNOWN' WHEN spread_r >= st THEN 'STRESSED' ELSE 'NORMAL' END AS liquidity FROM b),
a AS (SELECT *, CASE WHEN 'UNKNOWN' IN (trend, volatility) THEN 'UNKNOWN' ELSE CASE WHEN trend = 'TRENDING' THEN 'TREND_' ELSE 'RANGE_' END || volatility || '_VOL' END AS composite, (trend = 'UNKNOWN')::INT + (volatility = 'UNKNOWN')::INT + (liquidity = 'UNKNOWN')::INT AS gaps FROM s)"""


def assigned(spark, d):
    r = spark.sql(_ROWS, lineitem=table(spark, d, "lineitem"))
    return R.assign_regimes(r, R.fit_regimes(r.where("ts < timestamp_ntz'1997-01-01'")))


@query(f"""WITH {_ASSIGNED} SELECT id, trend, volatility, liquidity, composite, CASE gaps WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN gaps = 0 THEN 'all_regime_dimensions_available' ELSE concat_ws(';', CASE WHEN trend = 'UNKNOWN' THEN 'insufficient_trend_features' END, CASE WHEN volatility = 'UNKNOWN' THEN 'insufficient_volatility_features' END, CASE WHEN liquidity = 'UNKNOWN' THEN 'insufficient_liquidity_features' END) END AS reason FROM a""")
def r2_regimes(spark, d):
    """The states of each row by thresholds of the training rows, with all fallbacks, the confidence and what was missing."""
    return assigned(spark, d).select("id", "trend", "volatility", "liquidity", "composite", "confidence", "reason")


@query(f"""WITH {_ASSIGNED}, k AS (SELECT 'distribution' AS kind, '' AS key, composite FROM a UNION ALL SELECT 'confusion', CASE WHEN source_regime <> '' THEN upper(trim(source_regime)) END, composite FROM a UNION ALL SELECT 'side', coalesce(side, 'UNKNOWN'), composite FROM a UNION ALL SELECT 'timeframe', coalesce(timeframe, 'UNKNOWN'), composite FROM a UNION ALL SELECT 'period', strftime(ts, '%Y-%m'), composite FROM a)
SELECT kind, key, composite, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL""")
def a24_regime_report(spark, d):
    """Distribution, confusion with the source, and counts by side, timeframe and month."""
    return R.regime_report(assigned(spark, d))


@query(f"""WITH {_ASSIGNED}, g AS (SELECT *, CASE WHEN source_regime <> '' THEN upper(trim(source_regime)) END AS src FROM a), h AS (SELECT *, CASE WHEN src IN ('TRENDING', 'TREND') THEN 'TREND' WHEN src IN ('RANGE', 'RANGING', 'NEUTRAL') THEN 'RANGE' ELSE src END AS kind, CASE WHEN composite LIKE 'TREND%' THEN 'TREND' WHEN composite LIKE 'RANGE%' THEN 'RANGE' ELSE composite END AS prefix FROM g)
SELECT count(*) AS rows, round(count(*) FILTER (composite <> 'UNKNOWN') / count(*), 8) AS coverage, round(count(src) / count(*), 8) AS source_coverage, round(count(*) FILTER (kind = prefix OR src = composite) / count(src), 8) AS agreement FROM h""")
def a24_regime_agreement(spark, d):
    """How many rows have a regime, and how often it is what the source says."""
    return rounded(R.regime_agreement(assigned(spark, d)), "coverage", "source_coverage", "agreement", places=8)
