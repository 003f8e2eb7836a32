"""Temporal splits and score metrics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opplens.sources.files import work_folder


def temporal_split(rows: DataFrame, ts: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """rows with split: TRAIN, VALIDATION or OOS by cut-offs at fractions of the distinct times, so no time is in two splits."""
    times = rows.select(ts).distinct().where(F.col(ts).isNotNull()).select(ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.lit(1).alias("one"))
    n = times.count()
    placed = running_before(times, "at", "one", "place")  # no task sorts all times, and two times reach the driver
    a, b = placed.agg(*[F.min(F.when(F.col("place") >= int(n * f), F.col(ts))) for f in (train, train + validation)]).first()
    return rows.withColumn("split", F.when(F.col(ts) < F.lit(a), "TRAIN").when(F.col(ts) < F.lit(b), "VALIDATION").otherwise("OOS"))


def running_before(rows: DataFrame, order: str, value: str, out: str, buckets: int = 256, group: Sequence[str] = (), then: Sequence[str] = ()) -> DataFrame:
    """rows with the sum of value over lesser orders, in each group; rows of one order follow each other by then, in each group.

    Rows are dealt by approximate quantiles of order and summed within a bucket; the sums of the buckets before, at most
    `buckets` rows a group, are joined. So no task sorts all rows, and the result is exact whatever the bounds are.
    """
    x = rows.withColumn("__b", bucket_of(F.col(order).cast("double"), approximate_bounds(rows, order, buckets)))
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(*group, "__b").agg(F.sum(value).alias("__t")).select(*group, "__b", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*group, "__b").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    side = before if group else F.broadcast(before)  # without groups it has `buckets` rows
    return x.withColumn("__own", own).join(side, [*group, "__b"]).withColumn(out, F.col("__own") + F.col("__before")).select(*rows.columns, out)


def approximate_bounds(rows: DataFrame, order: str, buckets: int = 256) -> list[float]:
    return sorted(set(rows.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(i / buckets) for i in range(1, buckets)]))).first()[0] or []))


def _kept(df: DataFrame) -> DataFrame:
    """df written as a table and read again, so that what it is made of runs once."""
    folder = f"{work_folder(df.sparkSession)}/counts-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucket_of(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are less than x, by binary search."""
    held, n = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), len(bounds)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    further = lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) < x), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), further) if n else F.lit(0)


def exact_quantiles(rows: DataFrame, value: str, wanted: dict[str, tuple[str, float]], group: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """(group, name of each wanted quantile): rule linear, nearest (of rank) or lower (index rounded down), and a fraction. times: a column
    that says how often a row counts.

    Quantiles are read off the places of the distinct values, so neither a group's rows nor its values meet in one task. Groups
    must not be null.
    """
    by = _kept(rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("__c")))
    x = by.withColumn("__b", bucket_of(F.col(value).cast("double"), approximate_bounds(by, value)))
    n = F.col("__n")
    at = {
        "linear": lambda p: ((n - 1) * p, F.floor((n - 1) * p + 1e-9), F.ceil((n - 1) * p - 1e-9)),
        "nearest": lambda p: (F.greatest(F.ceil(n * p - 1e-9) - 1, F.lit(0)),) * 3,
        "lower": lambda p: (F.floor((n - 1) * p + 1e-9),) * 3,
    }
    one = Window.partitionBy(*(group or [F.lit(1)]))
    sums = x.groupBy(*group, "__b").agg(F.sum("__c").alias("__t"))
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__t").over(one.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__t").over(one)})
    asked = [i for rule, p in wanted.values() for i in at[rule](p)[1:]]
    # only the values of the buckets that hold an asked place are put in order
    sums = sums.where(reduce(or_, [(F.col("__before") <= i) & (i < F.col("__before") + F.col("__t")) for i in asked]))
    placed = x.join(sums if group else F.broadcast(sums), [*group, "__b"])
    own = F.sum("__c").over(Window.partitionBy(*group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("__below", F.col("__before") + F.coalesce(own, F.lit(0)))
    held = lambda i: F.max(F.when((F.col("__below") <= i) & (i < F.col("__below") + F.col("__c")), F.col(value)))
    made = []
    for name, (rule, p) in wanted.items():
        place, low, high = at[rule](p)
        made += [held(low).alias(f"__low_{name}"), held(high).alias(f"__high_{name}"), F.max(place - low).alias(f"__part_{name}")]
    out = placed.groupBy(*group).agg(*made)
    between = lambda q: F.when(F.col(f"__low_{q}") == F.col(f"__high_{q}"), F.col(f"__low_{q}")).otherwise(F.col(f"__low_{q}") + (F.col(f"__high_{q}") - F.col(f"__low_{q}")) * F.greatest(F.col(f"__part_{q}"), F.lit(0.0)))
    return out.select(*group, *[between(q).alias(q) for q in wanted])


def average_precision(rows: DataFrame, score: str, label: str, index: str) -> DataFrame:
    """(positives, average_precision): precision at each positive in the order of falling scores, then index, averaged.

    What stands above a score is read off the counts of the distinct scores, and rows of one score are dealt by their index, so
    neither all rows nor those of one score are sorted in one task."""
    x = rows.where(F.col(score).isNotNull()).select((-F.col(score)).alias("__s"), F.col(label).cast("long").alias("__y"), F.col(index).alias("__i"), F.lit(1).alias("__one"))
    kinds = x.groupBy("__s").agg(F.sum("__y").alias("__p"), F.count(F.lit(1)).alias("__c"))
    above = running_before(running_before(kinds, "__s", "__p", "__hits_above"), "__s", "__c", "__above").select("__s", "__hits_above", "__above")
    x = running_before(running_before(x, "__i", "__y", "__hits", group=["__s"]), "__i", "__one", "__rank", group=["__s"]).join(above, "__s")
    gain = F.when(F.col("__y") == 1, (F.col("__hits") + F.col("__hits_above") + 1) / (F.col("__rank") + F.col("__above") + 1))
    return x.agg(F.sum("__y").alias("positives"), F.round(F.try_divide(F.sum(gain), F.sum("__y").cast("double")), 8).alias("average_precision"))


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """n and auc from counts by distinct score: ties get the mean rank."""
    by = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("c"))
    by = running_before(by.where(F.col(score).isNotNull()), score, "c", "below")
    ranks = by.select("p", "c", (F.col("p") * (F.col("below") + (F.col("c") + 1) / 2)).alias("k"))
    p = F.sum("p")
    return ranks.agg(F.sum("c").alias("n"), F.round(F.try_divide(F.sum("k") - p * (p + 1) / 2, (p * (F.sum("c") - p)).cast("double")), 8).alias("auc"))


def medians(rows: DataFrame, group: Sequence[str], columns: dict[str, str | Column]) -> DataFrame:
    """(group, the exact median of each column under its name): all columns as one long table of (group, name, value), so that no
    task holds the values of a group. Groups must not be null."""
    each = [F.struct(F.lit(name).alias("__name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("__value")) for name, c in columns.items()]
    long = rows.select(*group, F.inline(F.array(*each)))
    q = exact_quantiles(long, "__value", {"__q": ("linear", 0.5)}, [*group, "__name"])
    return q.groupBy(*group).agg(*[F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name) for name in columns])
