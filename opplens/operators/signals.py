"""Signals of both sides against the position that is held: runs, events and their identities, stops, vetoes; ids, coverage and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bars as B
from .recursions import running

HOURS = 64 * 3600


def with_runs(rows: DataFrame, signal: str, seconds: int = HOURS) -> DataFrame:
    """A row for each run of bars on which signal holds: symbol, the bar it begins on, and how many more bars repeat it. Rows have symbol,
    bar_ts and signal; what came before a block of time is carried, so no task has a whole symbol."""
    on = F.coalesce(F.col(signal), F.lit(False))
    x = running(rows.select("symbol", "bar_ts", on.alias("on")), ["symbol"], "bar_ts", seconds, lasts={"before": F.col("on")})
    fresh = F.col("on") & ~F.coalesce("before", F.lit(False))
    x = running(x.withColumn("fresh", fresh.cast("long")), ["symbol"], "bar_ts", seconds, sums={"run": F.col("fresh")})
    return x.where("on").groupBy("symbol", "run").agg(F.min("bar_ts").alias("bar_ts"), (F.count(F.lit(1)) - 1).alias("repeat_bars")).drop("run")


def conflict(long_side: Column, long_valid: Column, short_valid: Column, held: Column) -> Column:
    """What a signal means for the position that is held: LONG, SHORT or NULL."""
    flat = F.when(long_valid & short_valid, "FLAT_BOTH").when(long_side, "FLAT_LONG_ONLY").otherwise("FLAT_SHORT_ONLY")
    return F.when(held.isNull(), flat).when((held == "LONG") == long_side, "OPEN_SAME_SIDE").otherwise("OPEN_OPPOSITE_SIDE")


def blocked_events(rows: DataFrame, seconds: int = HOURS) -> DataFrame:
    """The events of bars (symbol, bar_ts, long, short, held, group): event_id, symbol, bar_ts, side and event_type.

    A side is fresh on the first bar of its run. Without a position two valid sides of which one is fresh are one SIMULTANEOUS_CONFLICT on the
    short side, else each fresh side is an event of its own; with one, a fresh side is blocked. An identity that comes again is dropped."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = rows.withColumns({"long": yes("long"), "short": yes("short")})
    x = running(x, ["symbol"], "bar_ts", seconds, lasts={"long_before": F.col("long"), "short_before": F.col("short")})
    long, short = F.col("long") & ~yes("long_before"), F.col("short") & ~yes("short_before")
    event = lambda when, side, kind: F.when(when, F.struct(F.lit(side).alias("side"), kind.alias("event_type")))
    flat, both = F.col("held").isNull(), F.col("long") & F.col("short")
    blocked = lambda side: F.when(F.col("held") == side, "BLOCKED_SAME_SIDE").otherwise("BLOCKED_OPPOSITE")
    made = F.array_compact(F.array(
        event(flat & both & (long | short), "SHORT", F.lit("SIMULTANEOUS_CONFLICT")), event(flat & ~both & long, "LONG", F.lit("LONG_ONLY")), event(flat & ~both & short, "SHORT", F.lit("SHORT_ONLY")),
        event(~flat & long, "LONG", blocked("LONG")), event(~flat & short, "SHORT", blocked("SHORT")),
    ))
    x = x.select("symbol", "bar_ts", "group", F.inline(made))
    x = x.withColumn("event_id", F.concat_ws("_", F.unix_seconds(F.col("bar_ts").cast("timestamp")).cast("string"), F.coalesce("group", F.lit("")), "side", "event_type"))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("symbol", "bar_ts"))
    return x.withColumn("__n", first).where("__n = 1").select("event_id", "symbol", "bar_ts", "side", "event_type")


def chandelier(side: Column, atr: Column, multiplier: float = 3.0, n: int = 22) -> Column:
    """The trailing level of a bar: so many ranges below the highest high, or above the lowest low, of the last n bars."""
    long = F.max("h").over(B.last(n)) - atr * multiplier
    short = F.min("l").over(B.last(n)) + atr * multiplier
    return F.when((atr > 0) & (F.count("c").over(B.last(n)) == n), F.when(side == "LONG", long).otherwise(short))


def quality_veto(mode: str, efficiency: Column, bid: Column, ask: Column, risk: Column, low: float = 0.25, most: float = 0.10, point: float = 1e-9) -> Column:
    """Why an entry is refused, NULL if it is not; a value that is not there refuses nothing."""
    if mode == "efficiency":
        return F.when(efficiency < low, "efficiency")
    if mode == "spread_r":
        return F.when((bid > 0) & (ask > 0) & (risk > point) & ((ask - bid) / risk > most), "spread_r")
    return F.lit(None).cast("string")


def risk_multiplier(side: Column, rank: Column, risk: Column, atr: Column, high: float = 80.0, wide: float = 2.0, high_factor: float = 0.5, wide_factor: float = 0.5, point: float = 1e-9) -> Column:
    """struct<multiplier, high_vol, wide_short>: less where the range ranks high, and for short entries with a wide stop."""
    hot = F.coalesce(rank >= high, F.lit(False))
    broad = F.coalesce((side == "SHORT") & (atr > point) & (risk > point) & (risk / atr > wide), F.lit(False))
    factor = F.when(hot, high_factor).otherwise(1.0) * F.when(broad, wide_factor).otherwise(1.0)
    return F.struct(factor.alias("multiplier"), hot.alias("high_vol"), broad.alias("wide_short"))


def upper_slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "UNKNOWN").otherwise(s)


def episode_id(symbol: Column, timeframe: Column, ts: Column, strategy: Column, audit: Column, side: Column, kind: Column, ordinal: Column) -> Column:
    """The logical id of an episode from what it is, and its place among those that are the same in all of that."""
    none = lambda c: upper_slug(F.coalesce(F.nullif(c, F.lit("")), F.lit("NONE")))
    number = F.when(F.length(ordinal.cast("string")) >= 4, ordinal.cast("string")).otherwise(F.lpad(ordinal.cast("string"), 4, "0"))
    return F.concat_ws("-", upper_slug(symbol), upper_slug(timeframe), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), none(strategy), none(audit), upper_slug(side), upper_slug(kind), number)


def missing_rates(rows: DataFrame, features: Sequence[str], by: dict[str, str]) -> DataFrame:
    """(kind, key, feature, n, missing, rate): over all rows, and by each column of by; a text that is empty and a number that is not finite are
    missing, a key that is NULL is UNKNOWN. One pass, in which a row stands once in each kind."""

    def gone(c: str) -> Column:
        x = F.col(c)
        kind = rows.schema[c].dataType.typeName()
        return (x.isNull() | (x == "")) if kind == "string" else (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) if kind in ("double", "float") else x.isNull()

    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), *[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("key")) for k, c in by.items()])
    flags = [gone(f).cast("long").alias(f) for f in features]
    x = rows.select(F.struct(*flags).alias("f"), F.inline(kinds)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"f.{f}").alias(f) for f in features])
    long = x.select("kind", "key", "n", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("missing")) for f in features])))
    return long.withColumn("rate", F.try_divide(F.col("missing").cast("double"), F.col("n")))


def month_span(first: Column, last: Column) -> Column:
    """The number of calendar months from one time to another, both counted."""
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1


def coverage(rows: DataFrame, ts: str, resolved: Column, wanted: int = 500) -> DataFrame:
    """One row: rows, months, resolved rows, their rate a month over the months that have any, and the months until so many are resolved."""
    at = F.col(ts)
    out = rows.agg(F.count(F.lit(1)).alias("n"), month_span(F.min(at), F.max(at)).alias("months"), F.count_if(resolved).alias("resolved"), month_span(F.min(F.when(resolved, at)), F.max(F.when(resolved, at))).alias("own"))
    rate = F.coalesce(F.try_divide(F.col("resolved").cast("double"), F.coalesce("own", "months")), F.lit(0.0))
    return out.select("n", F.coalesce("months", F.lit(0)).alias("months"), "resolved", rate.alias("rate"), F.when(rate > 0, wanted / rate).alias("months_to_go"))


def shared_keys(left: DataFrame, right: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, left, right, both): for each named tuple of columns how many distinct values each side has, and both. A tuple with a NULL is none."""
    out = None
    for name, columns in keys.items():
        known = F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        side = lambda df, n: df.where(known).select(F.struct(*columns).alias("k")).distinct().withColumn(n, F.lit(1))  # noqa: E731, B023
        both = side(left, "a").join(side(right, "b"), "k", "full")
        one = both.agg(F.lit(name).alias("keys"), F.count("a").alias("left"), F.count("b").alias("right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
        out = one if out is None else out.unionByName(one)
    return out


def split_overlaps(rows: DataFrame, id_col: str, split: str, splits: Sequence[str]) -> DataFrame:
    """(first, second, n): how many ids are in both splits, for each two of them in their order; one grouping by id."""
    held = rows.where(F.col(split).isin(*splits)).groupBy(id_col).agg(F.collect_set(split).alias("s"))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    counts = held.agg(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}|{b}") for a, b in pairs])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("n")) for a, b in pairs])))
