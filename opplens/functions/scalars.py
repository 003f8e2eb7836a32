"""Column functions: typed parsing, identifiers, buckets, and the three quantile rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """A finite number, else NULL: blanks, words, nan and infinities do not pass."""
    x = F.trim(text).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_flag(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ladder(x: Column, bounds: list[float], names: list[str], closed: bool = False) -> Column:
    """The first name whose bound is above x (or reached, if closed); NULL stays NULL."""
    out = F.when(x.isNull(), None)
    for b, name in zip(bounds, names):
        out = out.when(x <= b if closed else x < b, name)
    return out.otherwise(names[-1])


def probability_bin(p: Column, bins: int) -> Column:
    return F.least(F.greatest((p * bins).cast("int"), F.lit(0)), F.lit(bins - 1))


def quantile_linear(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def quantile_nearest(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {x})")


def quantile_lower(x: Column, percent: int) -> Column:
    values = F.sort_array(F.collect_list(x))
    return F.get(values, ((F.size(values) - 1) * percent / 100).cast("int"))


def profit_factor(profit: Column) -> Column:
    gain, loss = F.sum(F.when(profit > 0, profit).otherwise(0.0)), -F.sum(F.when(profit < 0, profit).otherwise(0.0))
    return F.when(loss > 0, gain / loss).when(gain > 0, float("inf")).otherwise(0.0)
