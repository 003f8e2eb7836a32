"""Event studies: what the bars after an event did, in units of its risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bars


def signals(rows: DataFrame, n: int = 20, level: float = 1.0) -> DataFrame:
    """Rising edges of a close further than level standard deviations from its mean: against the move, risk one deviation."""
    z = rows.withColumn("mean", bars.rolling_mean(F.col("c"), n)).withColumn("sd", bars.rolling_std(F.col("c"), n))
    z = z.withColumn("z", F.when(F.col("sd") > 1e-12, (F.col("c") - F.col("mean")) / F.col("sd"))).withColumn("k", F.row_number().over(bars.ordered()))
    out = z.withColumn("hot", F.coalesce(F.abs("z") >= level, F.lit(False))).withColumn("edge", bars.rising_edge(F.col("hot"))).where("edge")
    return out.select("symbol", "bar_ts", "k", F.when(F.col("z") > 0, "SHORT").otherwise("LONG").alias("side"), F.col("c").alias("entry"), F.col("sd").alias("risk"))


def first_touch(events: DataFrame, rows: DataFrame, horizon: int = 12, returns: tuple[int, ...] = (6, 12), floor_zero: bool = True) -> DataFrame:
    """Each event with mfe_r, mae_r, first_hit and the return at each age, over the horizon bars after it.

    Bar numbers are cut into stretches of the horizon's length; an event meets the bars of the two stretches that its horizon
    touches, so the join is on symbol and stretch, and no event meets all bars of its symbol.
    """
    stretch = lambda n: F.floor(n / horizon)
    future = rows.withColumn("n", F.row_number().over(bars.ordered())).select(F.col("symbol").alias("s"), "n", "h", "l", "c", stretch(F.col("n")).alias("at"))
    near = events.withColumn("near", F.explode(F.array_distinct(F.array(stretch(F.col("k") + 1), stretch(F.col("k") + horizon)))))
    pairs = near.join(future, (F.col("symbol") == F.col("s")) & (F.col("near") == F.col("at")) & (F.col("n") > F.col("k")) & (F.col("n") <= F.col("k") + horizon))
    long = F.col("side") == "LONG"
    good = F.when(long, F.col("h") - F.col("entry")).otherwise(F.col("entry") - F.col("l")) / F.col("risk")
    bad = F.when(long, F.col("l") - F.col("entry")).otherwise(F.col("entry") - F.col("h")) / F.col("risk")
    moved = F.when(long, F.col("c") - F.col("entry")).otherwise(F.col("entry") - F.col("c")) / F.col("risk")
    age = F.col("n") - F.col("k")
    grouped = pairs.select("symbol", "bar_ts", "side", good.alias("good"), bad.alias("bad"), moved.alias("moved"), age.alias("age")).groupBy("symbol", "bar_ts", "side")
    zero = F.lit(0.0)
    out = grouped.agg(
        (F.greatest(zero, F.max("good")) if floor_zero else F.max("good")).alias("mfe_r"),
        (F.least(zero, F.min("bad")) if floor_zero else F.min("bad")).alias("mae_r"),
        F.min(F.when(F.col("good") >= 1, F.col("age"))).alias("plus"),
        F.min(F.when(F.col("bad") <= -1, F.col("age"))).alias("minus"),
        F.count(F.lit(1)).alias("bars"),
        *[F.max(F.when(F.col("age") == h, F.col("moved"))).alias(f"return_{h}") for h in returns],
    )
    hit = F.when(F.col("plus").isNull() & F.col("minus").isNull(), "NONE").when(F.col("plus") == F.col("minus"), "AMBIGUOUS").when(F.col("minus").isNull() | (F.col("plus") < F.col("minus")), "PLUS_1R").otherwise("MINUS_1R")
    return out.withColumn("first_hit", hit).withColumn("completed", F.col("bars") >= horizon)


def hit_metrics() -> list[Column]:
    plus, minus = F.count_if(F.col("first_hit") == "PLUS_1R"), F.count_if(F.col("first_hit") == "MINUS_1R")
    return [F.count(F.lit(1)).alias("events"), plus.alias("plus"), minus.alias("minus"), (plus + minus).alias("resolved"), F.try_divide(plus.cast("double"), (plus + minus).cast("double")).alias("rate")]


def cycles(deals: DataFrame, position: str, order: list[str], volume: Column, epsilon: float = 1e-7) -> DataFrame:
    """deals with running volume and the number of their closed cycle: a cycle ends where the volume is back at zero."""
    w = Window.partitionBy(position).orderBy(*order)
    out = deals.withColumn("running", F.sum(volume).over(w)).withColumn("flat", (F.abs("running") <= epsilon).cast("int"))
    return out.withColumn("cycle", F.coalesce(F.sum("flat").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
