"""Feature vectors with the statistics of training rows only: imputed and scaled numbers with indicators, one-hot categories with an unknown
slot, what is out of what training saw, and a fingerprint of each snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import exact_quantiles

#: Levels of a category that a model may have; more are an error, as each is a column of every vector.
MOST_LEVELS = 1000


def number(x: Column) -> Column:
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def word(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x.cast("string"))), F.lit(""))


class Vectors:
    """What was learned: of each number its count, mean, median and deviation, and the levels of each category in order."""

    def __init__(self, numbers: dict[str, dict[str, float]], levels: dict[str, list[str]], z_limit: float, imputation: str) -> None:
        self.numbers, self.levels, self.z_limit, self.imputation = numbers, levels, z_limit, imputation

    @property
    def names(self) -> list[str]:
        """The names of the places of a vector."""
        return [*[n for f in self.numbers for n in (f, f"{f}__missing")], *[n for f, known in self.levels.items() for n in (*[f"{f}={v}" for v in known], f"{f}__missing")]]

    def _z(self, f: str) -> Column:
        return (number(F.col(f)) - self.numbers[f]["mean"]) / self.numbers[f]["std"]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with vector, completeness, reasons (why a row is out of what training saw), ood_score (the greatest |z|) and snapshot (a hash of
        the vector, rounded to twelve places, and the names of its places)."""
        one = lambda c: c.cast("double")
        places: list[Column] = []
        for f, s in self.numbers.items():
            filled = F.coalesce(number(F.col(f)), F.lit(s[self.imputation]))
            places += [(filled - s["mean"]) / s["std"], one(number(F.col(f)).isNull())]
        for f, known in self.levels.items():
            w = word(F.col(f))
            places += [one(F.coalesce(w == v, F.lit(False))) for v in known] + [one(w.isNull() | ~w.isin(known) if known else F.lit(True))]
        filled = [number(F.col(f)).isNotNull() for f in self.numbers] + [word(F.col(f)).isNotNull() for f in self.levels]
        complete = sum((c.cast("int") for c in filled), F.lit(0)) / len(filled)
        reasons = [F.when(number(F.col(f)).isNotNull(), F.lit(f"{f}:unseen")) if not s["count"] else F.when(F.abs(self._z(f)) > self.z_limit, F.lit(f"{f}:far")) for f, s in self.numbers.items()]
        reasons += [F.when(word(F.col(f)).isNotNull() & (~word(F.col(f)).isin(known) if known else F.lit(True)), F.lit(f"{f}:unseen_category")) for f, known in self.levels.items()]
        out = rows.withColumns({"vector": F.array(*places), "completeness": complete, "reasons": F.array_compact(F.array(*reasons)), "ood_score": F.coalesce(F.array_max(F.array_compact(F.array(*[F.abs(self._z(f)) for f in self.numbers]))), F.lit(0.0))})
        plain = F.array_join(F.transform("vector", lambda v: (F.round(v, 12) + F.lit(0.0)).cast("string")), ",")
        return out.withColumn("snapshot", F.sha2(F.concat_ws("|", F.lit(",".join(self.names)), plain), 256))


def fit_vectors(train: DataFrame, numbers: Sequence[str], categories: Sequence[str], imputation: str = "mean", z_limit: float = 4.0) -> Vectors:
    """Learns from train: one aggregation for the moments, exact medians by counts of values, and the distinct levels. A number that training
    never has is zero with deviation one; so is the deviation of a constant."""
    x = train.select(*[number(F.col(c)).alias(c) for c in numbers], *[word(F.col(c)).alias(c) for c in categories])
    sums = x.agg(*[e for c in numbers for e in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    learned = {}
    for c in numbers:
        n, mean, std = sums[f"n_{c}"], sums[f"m_{c}"], sums[f"s_{c}"]
        middle = exact_quantiles(x, c, {"mid": ("linear", 0.5)}).first()["mid"] if n and imputation == "median" else None
        learned[c] = {"count": n, "mean": mean if n else 0.0, "median": middle or 0.0, "std": std if n and std > 1e-15 else 1.0}
    levels = {}
    for c in categories:
        found = x.where(F.col(c).isNotNull()).select(c).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        levels[c] = sorted(r[0] for r in found)
    return Vectors(learned, levels, z_limit, imputation)
