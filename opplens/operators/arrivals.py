"""Records in their order of arrival, as tables: the gate on event time, collapsed duplicates, outcomes that come later, missed regions.

streaming/keyed.py has the first three over streams with the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursions import running

RETURNS = (6, 12, 24, 48)
#: Rows of whole keys that a task of collapse gets: about so many, and where that asks for more than TASKS tasks about so many at most.
ROWS_A_TASK, MOST_ROWS_A_TASK = 100_000, 2_000_000
#: To so many tasks Spark deals rows straight into their files (spark.shuffle.sort.bypassMergeThreshold); for more it holds and sorts them first.
TASKS = 200


def gate(rows: DataFrame, run: str, ts: str, received: str, arrival: str, kind: str, in_order: str = "DIAGNOSTIC", future: str = "5 seconds", oldest: str | None = None, stretch: int = 4096) -> DataFrame:
    """rows with reason, NULL where they are accepted; arrival is a number. The greatest accepted time before a row is carried over
    stretches of that many arrivals, so no task has a whole run."""
    at, got = F.col(ts), F.col(received)
    reason = F.when(at > got + F.expr(f"interval {future}"), "EVENT_TIMESTAMP_IN_FUTURE")
    if oldest:
        reason = reason.when(got - F.expr(f"interval {oldest}") > at, "EVENT_TOO_OLD")
    x = rows.withColumn("reason", reason)
    # what is out of order is below the greatest accepted time, so it does not move it
    x = running(x, [run], arrival, F.floor(F.col(arrival) / stretch), tops={"__high": F.when(F.col("reason").isNull(), at)})
    late = F.col("reason").isNull() & (F.col(kind) == in_order) & (at < F.col("__high"))
    return x.withColumn("reason", F.when(late, "OUT_OF_ORDER_EVENT").otherwise(F.col("reason"))).drop("__high")


def collapse(rows: DataFrame, keys: list[str], source_id: str, arrival: list[str], reason: str, valid: str) -> DataFrame:
    """rows with status, representative, observations and duplicates so far; see the stream of this name.

    The first row of a key that is not stale represents it; what came before it is stale. Rows are dealt by key to as many tasks as
    their number asks for and sorted twice there, so what a task holds is bounded unless a single key has very many rows."""
    order = [F.col(c) for c in arrival]
    one = Window.partitionBy(*keys, source_id).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # this order serves the window of a key without order, and then that of a source in it
    n = rows.count()
    tasks = max(min(n // ROWS_A_TASK + 1, TASKS), n // MOST_ROWS_A_TASK + 1)
    x = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, source_id, *arrival)
    first = F.min(F.when(F.col(reason).isNull(), F.struct(*arrival))).over(Window.partitionBy(*keys))
    x = x.withColumn("__begun", F.coalesce(F.struct(*arrival) > first, F.lit(False)))
    counts = F.col(reason).isNull() | F.col("__begun")
    x = x.withColumn("__again", counts & F.coalesce(F.max(F.when(counts, True)).over(one), F.lit(False)))
    fresh = counts & ~F.col("__again")
    x = x.withColumn("observations", F.sum(fresh.cast("long")).over(upto))
    x = x.withColumn("representative", F.first(F.when(F.col(reason).isNull(), F.col(source_id)), ignorenulls=True).over(upto))
    status = F.when(F.col("__again"), "REJECTED_DUPLICATE").when(F.col("__begun"), "DUPLICATE_COLLAPSED").when(F.col(reason).isNotNull(), "REJECTED_STALE").when(F.col(valid), "ACCEPTED").otherwise("INVALID")
    return x.select(*rows.columns, status.alias("status"), "representative", "observations", F.greatest(F.col("observations") - 1, F.lit(0)).cast("long").alias("duplicates"))


def outcomes(predictions: DataFrame, bars: DataFrame, horizon: int = 48, wait_hours: int = 72, needed: int = 24) -> DataFrame:
    """One outcome for each prediction (id, symbol, side, event_ts, committed, entry, risk) from the bars (symbol, bar_ts, h, l, c) after it
    was committed, at most horizon of them within wait_hours; see the stream of this name.

    Predictions meet the bars of the stretches of time that they wait for, an equi-join; what a prediction gathers is bounded."""
    width = wait_hours * 3600
    stretch = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / width)
    given = bars.select(F.col("symbol").alias("__s"), "bar_ts", "h", "l", "c", stretch(F.col("bar_ts")).alias("__at"))
    last = F.col("committed") + F.expr(f"interval {wait_hours} hours")
    near = predictions.withColumn("__at", F.explode(F.sequence(stretch(F.col("event_ts")), stretch(last))))
    met = near.join(given, (F.col("symbol") == F.col("__s")) & near["__at"].eqNullSafe(given["__at"]) & (F.col("bar_ts") > F.col("event_ts")) & (F.col("bar_ts") <= last), "left")
    after = F.col("bar_ts") > F.col("committed")
    own = ["id", "symbol", "side", "event_ts", "committed", "entry", "risk"]
    seen = met.groupBy(*own).agg(F.count("bar_ts").alias("__seen"), F.slice(F.array_sort(F.collect_list(F.when(after, F.struct("bar_ts", "h", "l", "c")))), 1, horizon).alias("b"))
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    r = lambda price: sign * (price - F.col("entry")) / F.col("risk")
    best = lambda x: F.greatest(r(x["h"]), r(x["l"]))
    worst = lambda x: F.least(r(x["h"]), r(x["l"]))
    kinds = F.filter(F.transform("b", lambda x: F.when((best(x) >= 1) & (worst(x) <= -1), "AMBIGUOUS").when(best(x) >= 1, "PLUS_1R").when(worst(x) <= -1, "MINUS_1R")), lambda k: k.isNotNull())
    x = seen.select("id", "symbol", F.col("__seen"), F.size("b").alias("bars"), F.get(kinds, F.lit(0)).alias("hit"), F.array_max(F.transform("b", best)).alias("mfe"), F.array_min(F.transform("b", worst)).alias("mae"), *[r(F.get("b", F.lit(h - 1))["c"]).alias(f"r{h}") for h in RETURNS])
    label = F.when(F.col("hit") == "PLUS_1R", 1).when(F.col("hit") == "MINUS_1R", 0)
    reason = F.when((F.col("bars") == 0) & (F.col("__seen") > 0), "PREDICTION_AFTER_OUTCOME").when(F.col("bars") == 0, "NO_FUTURE_BARS").when(F.col("hit") == "AMBIGUOUS", "AMBIGUOUS_SAME_BAR").when(F.col("hit").isNull(), "NO_FIRST_HIT").when(F.col(f"r{needed}").isNull(), f"MISSING_{needed}BAR_OUTCOME")
    status = F.when(reason.isNull(), "RESOLVED").when(reason == "PREDICTION_AFTER_OUTCOME", "INVALID").otherwise("INCOMPLETE")
    return x.select("id", "symbol", status.alias("status"), label.alias("label"), reason.alias("reason"), "bars", "mfe", "mae", *[f"r{h}" for h in RETURNS])


def missed_regions(seen: DataFrame, sizes: DataFrame, source: str, lo: str, hi: str, size: str) -> DataFrame:
    """(source, lo, hi) of each stretch of a source, from 0 to its size, that no interval of seen covers. A source without any is missed whole."""
    ends = seen.select(source, F.col(lo).alias("__a"), F.col(hi).alias("__b")).where("__a < __b").unionByName(sizes.select(source, F.col(size).alias("__a"), F.col(size).alias("__b")))
    before = F.max("__b").over(Window.partitionBy(source).orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1))
    gaps = ends.select(source, F.coalesce(before, F.lit(0)).alias(lo), F.col("__a").alias(hi)).where(F.col(lo) < F.col(hi))
    return gaps.join(sizes, source).where(F.col(lo) < F.col(size)).select(source, lo, F.least(F.col(hi), F.col(size)).alias(hi))


def recover(lines: DataFrame, regions: DataFrame, known: DataFrame, source: str, offset: str, key: list[str], valid: Column, early: Column, lo: str = "lo", hi: str = "hi", width: int = 1 << 16) -> DataFrame:
    """The lines that start in a missed region, with outcome: INVALID, BEFORE_START, ALREADY_KNOWN, or RECORDED, once for each key.

    Regions are cut at multiples of width, so lines meet them by an equi-join. Nothing of it counts as seen in time: it is late."""
    cut = regions.select(source, lo, hi, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))).alias("__at"))
    inside = lines.withColumn("__at", F.floor(F.col(offset) / width)).join(cut, [source, "__at"]).where((F.col(offset) >= F.col(lo)) & (F.col(offset) < F.col(hi))).select(*lines.columns)
    have = known.select(*key).distinct().withColumn("__known", F.lit(True))
    judged = inside.join(have, key, "left").withColumn("__why", F.when(~F.coalesce(valid, F.lit(False)), "INVALID").when(early, "BEFORE_START").when(F.col("__known"), "ALREADY_KNOWN"))
    nth = F.row_number().over(Window.partitionBy(*key, F.col("__why").isNull()).orderBy(source, offset))
    outcome = F.coalesce("__why", F.when(nth == 1, "RECORDED").otherwise("ALREADY_KNOWN"))
    return judged.withColumn("outcome", outcome).select(*lines.columns, "outcome")
