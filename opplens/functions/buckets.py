"""The bucket sets of the summaries. NULL stays NULL where a missing value is no bucket; where it is one, it is `unknown`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds with the names below each and the last name; whether a bound belongs to the lower bucket.
EFFICIENCY = ((0.25, 0.50), ("low_lt_0p25", "mid_0p25_0p50", "high_ge_0p50"), (False, False))
RANK = ((20.0, 80.0), ("low_lt_20", "normal_20_80", "high_ge_80"), (False, False))
SPREAD_R = ((0.03, 0.10), ("low_le_0p03", "normal_0p03_0p10", "high_gt_0p10"), (True, True))
STOP_ATR = ((1.0, 2.0), ("tight_le_1", "normal_1_2", "wide_gt_2"), (True, True))
ABS_Z = ((1.0, 2.0), ("inside_1sigma", "between_1_2sigma", "outside_2sigma"), (False, False))
STD_RATIO = ((0.80, 1.25), ("compression_lt_0p80", "normal_0p80_1p25", "expansion_gt_1p25"), (False, True))
EMA_GAP = ((1.0, 3.0), ("gap_0_1", "gap_1_3", "gap_3_plus"), (False, False))
ENTRY_LEVEL = ((45.0, 55.0), ("below_45", "mid_45_55", "above_55"), (False, True))
MATURITY = ((0.0, 1.0, 2.0), ("active_r_lt_0", "active_r_0_1", "active_r_1_2", "active_r_ge_2"), (False, False, False))
PYRAMID = ((1.0,), ("before_add1", "after_add1"), (False,))


def bucket(x: Column, spec: tuple) -> Column:
    """The name of the bucket of x; NULL, and what is no number, have none."""
    bounds, names, closed = spec
    out = F.when(x.isNull() | F.isnan(x.cast("double")), None)
    for bound, name, at in zip(bounds, names, closed):
        out = out.when(x <= bound if at else x < bound, name)
    return out.otherwise(names[-1])


def known(name: Column) -> Column:
    return F.coalesce(name, F.lit("unknown"))


def ema_gap(rsi: Column, ema: Column) -> Column:
    return bucket(F.abs(rsi - ema), EMA_GAP)


def wma_position(side: Column, rsi: Column, wma: Column) -> Column:
    """Above or below the mean; an equal value is on the side that the event bets against."""
    return F.when(side == "LONG", F.when(rsi > wma, "above_wma").when(rsi <= wma, "below_wma")).otherwise(F.when(rsi < wma, "below_wma").when(rsi >= wma, "above_wma"))


def regime_bucket(score: Column) -> Column:
    whole = score.cast("int")  # towards zero
    return F.when(whole >= 4, "bullish").when(whole <= -4, "bearish").when(whole.isNotNull(), "neutral")
