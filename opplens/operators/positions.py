"""Positions, sizing, sessions, journals and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opplens.functions.rules import all_reasons, first_reason


def sizing(equity: Column, risk_pct: Column, multiplier: Column, distance: Column, tick_size: Column, tick_value: Column, least: Column, most: Column, step: Column) -> Column:
    """struct<desired, per_lot, raw, lots, actual, reason>: the money at risk, the lots that it buys, floored to the step, and why not."""
    desired, per_lot = equity * risk_pct / 100.0 * multiplier, distance / tick_size * tick_value
    raw = desired / per_lot
    floored = F.round(F.least(most, F.floor(raw / step) * step), 2)
    reason = first_reason({
        "invalid_risk_multiplier": (multiplier > 0) & (multiplier <= 1), "invalid_symbol_specs": (tick_value > 0) & (tick_size > 0) & (step > 0), "invalid_risk_per_lot": per_lot > 0,
        "raw_lot_below_min_lot": raw >= least, "normalized_lot_below_min_lot": floored >= least, "actual_risk_exceeds_desired": per_lot * floored <= desired + 0.01,
    })
    lots = F.when(reason.isin("invalid_risk_multiplier", "invalid_symbol_specs", "invalid_risk_per_lot"), 0.0).when(reason == "raw_lot_below_min_lot", least).otherwise(floored)
    return F.struct(desired.alias("desired"), per_lot.alias("per_lot"), raw.alias("raw"), lots.alias("lots"), (per_lot * lots).alias("actual"), reason.alias("reason"))


def group_values(legs: DataFrame, group: str, at: Column, realised: Column, side: Column, entry: Column, volume: Column) -> DataFrame:
    """(group, legs, value): realised money and what open legs are worth at a price; NULL if one leg is not known."""
    open_ = F.when(F.upper(side) == "LONG", at - entry).otherwise(entry - at) * volume
    known = open_.isNotNull() | (volume == 0)
    return legs.groupBy(group).agg(F.count(F.lit(1)).alias("legs"), F.when(F.bool_and(known), F.sum(realised) + F.sum(F.coalesce(open_, F.lit(0.0)))).alias("value"))


def first_reasons(rows: DataFrame, position: str, order: list[str], reasons: dict[str, Column]) -> DataFrame:
    """(position, reason, order): the first row at which each reason holds, once for each position."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in reasons.items()]))
    seen = rows.select(position, *order, F.explode(named).alias("reason"))
    return seen.groupBy(position, "reason").agg(F.min(F.struct(*order)).alias("o")).select(position, "reason", "o.*")


def journal_fields(line: Column, prefix: str) -> Column:
    """The key=value pairs of a journal line that has the prefix, else NULL."""
    body = F.trim(F.substring_index(line, prefix, -1))
    return F.when(F.contains(line, F.lit(prefix)), F.str_to_map(body, F.lit(" "), F.lit("=")))


def sessions(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, islands, covered, span, gaps, longest_gap, ratio), all in seconds: how much of its span a key's intervals cover."""
    w = Window.partitionBy(key).orderBy(start, end)
    seconds = lambda a, b: F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))
    high = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = rows.select(key, start, end, high.alias("high"))
    gap = F.when(F.col(start) > F.col("high"), seconds(F.col("high"), F.col(start))).otherwise(0)
    out = x.groupBy(key).agg(F.count_if(gap > 0).alias("gaps"), F.sum(gap).alias("open"), F.max(gap).alias("longest_gap"), seconds(F.min(start), F.max(end)).alias("span"))
    return out.select(key, (F.col("gaps") + 1).alias("islands"), (F.col("span") - F.col("open")).alias("covered"), "span", "gaps", "longest_gap", ((F.col("span") - F.col("open")) / F.col("span")).alias("ratio"))


def stage_gate(stops: dict[str, Column], mature: Column, later: dict[str, Column]) -> Column:
    """struct<status, reasons>: FAIL by any stop at once; WAIT while the sample is small; then PASS or FAIL by the later rules. A rule says what must hold."""
    early, late = all_reasons(stops), all_reasons(later)
    status = F.when(F.size(early) > 0, "FAIL").when(~mature, "WAIT").when(F.size(late) > 0, "FAIL").otherwise("PASS")
    return F.struct(status.alias("status"), F.when(mature, F.concat(early, late)).otherwise(early).alias("reasons"))


#: What a path says about its file, the first that holds.
ARTIFACTS = (
    ("STDDEV_SHADOW_TELEMETRY", r"v81-runs/(.*/)?shadow-signals\.csv$"), ("BLOCKED_SIGNAL_SHADOW_TELEMETRY", r"blocked_signals\.csv[^/]*$|v82_runs/"), ("AUDIT_PRESET", r"(stddev|81_|blocked_signal)[^/]*\.set$"), ("PRESET", r"\.set$"), ("MT5_REPORT", r"\.html?$"),
    ("OPPORTUNITY_AUDIT_REPORT", r"v82[^/]*\.(json|md)$"), ("EXPERIMENT_REPORT", r"v81[^/]*\.(json|md)$"), ("JOURNAL", r"journal[^/]*$"), ("FORWARD_REPORT", r"forward[^/]*$"), ("TRADE_HISTORY", r"trade[^/]*\.csv$"), ("TELEMETRY", r"\.csv$"), ("EXPERIMENT_REPORT", r"(summary|report)[^/]*\.(json|md|txt|log|ini)$"),
)


def artifact_type(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce(*[F.when(p.rlike(pattern), name) for name, pattern in ARTIFACTS], F.lit("UNKNOWN"))


def direction(event_type: Column, active: Column, shadow: Column, selected: Column, given: Column) -> Column:
    kind = F.upper(F.trim(event_type))
    return (
        F.when(kind.isin("BLOCKED_OPPOSITE", "BLOCKED_SAME_SIDE"), F.concat(active, F.lit(" active -> "), shadow, F.lit(" blocked"))).when(kind == "SIMULTANEOUS_CONFLICT", F.concat(F.lit("FLAT -> "), selected, F.lit(" selected / "), shadow, F.lit(" blocked")))
        .when(kind == "LONG_ONLY", "FLAT -> LONG control").when(kind == "SHORT_ONLY", "FLAT -> SHORT control").otherwise(F.coalesce(F.nullif(F.trim(given), F.lit("")), F.lit("UNKNOWN")))
    )
