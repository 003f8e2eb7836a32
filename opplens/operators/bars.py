"""Bars and closed-bar windows over them. Short history gives NULL; ranks leave the current bar out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def resample(ticks: DataFrame, every: str, symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """OHLC bars with volume by symbol; equal times are ordered by tie."""
    at = F.struct(ts, tie)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, every).start.alias("bar_ts"))
        .agg(F.min_by(price, at).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, at).alias("c"), F.count(F.lit(1)).alias("vol"))
    )


def ordered() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bar_ts")


def last(n: int) -> WindowSpec:
    return ordered().rowsBetween(-(n - 1), 0)


def before(n: int) -> WindowSpec:
    return ordered().rowsBetween(-n, -1)


def full(value: Column, n: int, of: Column) -> Column:
    """value only where the window of n bars has n values."""
    return F.when(F.count(of).over(last(n)) == n, value)


def true_range() -> Column:
    close = F.lag("c").over(ordered())
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - close), F.abs(F.col("l") - close))


def rolling_mean(x: Column, n: int) -> Column:
    return full(F.avg(x).over(last(n)), n, x)


def rolling_std(x: Column, n: int) -> Column:
    return full(F.stddev_pop(x).over(last(n)), n, x)


def log_return() -> Column:
    close = F.lag("c").over(ordered())
    return F.when((close > 0) & (F.col("c") > 0), F.log(F.col("c") / close))


def efficiency(n: int) -> Column:
    """Net move over the sum of moves; needs the column `move`, each bar's absolute move."""
    path = F.sum("move").over(last(n))
    return full(F.when(path < 1e-12, 0.0).otherwise(F.abs(F.col("c") - F.lag("c", n).over(ordered())) / path), n, F.col("move"))


def percent_rank_before(x: str, n: int) -> Column:
    """Share in percent of the n bars before whose value is at most the current one."""
    seen = F.collect_list(x).over(before(n))
    return F.when((F.size(seen) == n) & F.col(x).isNotNull(), F.size(F.filter(seen, lambda v: v <= F.col(x))) * 100.0 / n)


def weighted_mean(x: str, n: int) -> Column:
    """Linear weights, the newest value weighs n."""
    seen = F.collect_list(x).over(last(n))
    return F.when(F.size(seen) == n, F.aggregate(F.zip_with(seen, F.sequence(F.lit(1), F.lit(n)), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2))


def exponential_mean(x: str, n: int, reach: int = 4) -> Column:
    """Exponential mean over n * reach + 1 bars, seeded with the oldest."""
    size, alpha = n * reach + 1, 2.0 / (n + 1)
    seen = F.collect_list(x).over(last(size))
    return F.when(F.size(seen) == size, F.aggregate(F.slice(seen, 2, size), F.element_at(seen, 1), lambda a, v: a + alpha * (v - a)))


def crosses_up(a: Column, b: Column) -> Column:
    return (F.lag(a).over(ordered()) <= F.lag(b).over(ordered())) & (a > b)


def rising_edge(flag: Column) -> Column:
    return flag & ~F.coalesce(F.lag(flag).over(ordered()), F.lit(False))


def armed(flag: Column, n: int) -> Column:
    """A counter set to n at each flag that falls by one a bar down to 0."""
    k = F.row_number().over(ordered())
    since = k - F.last(F.when(flag, k), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.greatest(n - since, F.lit(0)), F.lit(0))


def as_of(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """left with the last value of right's column at or before each bar, by one sort of both: no join, no look-ahead."""
    both = left.select("symbol", "bar_ts", F.lit(None).cast(right.schema[column].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(right.select("symbol", "bar_ts", F.col(column).alias("__v"), F.lit(0).alias("__side")))
    w = Window.partitionBy("symbol").orderBy("bar_ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(column, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("symbol", "bar_ts", column)
