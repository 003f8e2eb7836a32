"""Quality gates: named checks with a severity, counted over rows, keys and references, and the verdict over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import relation_holds

#: Severities by rank, and what a first touch may be.
SEVERITIES = {"INFO": 0, "WARN": 1, "ERROR": 2, "FATAL": 3}
FIRST_HITS = ("", "NONE", "PLUS_1R", "MINUS_1R", "AMBIGUOUS", "UNRESOLVED")
SHAPE = "name string, severity string, broken long"


def total(flags: Sequence[Column]) -> Column:
    """How many of the conditions hold in a row; one that is NULL does not."""
    return sum((F.coalesce(f, F.lit(False)).cast("long") for f in flags), F.lit(0).cast("long"))


def row_checks(rows: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(name, severity, broken) of checks that say for each row how often it breaks them: one aggregation over the rows."""
    sums = rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, (_, c) in checks.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.col(n).alias("broken")) for n, (s, _) in checks.items()])))


def _one(name: str, severity: str, found: DataFrame) -> DataFrame:
    return found.agg(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.count(F.lit(1)).alias("broken"))


def repeated_keys(rows: DataFrame, key: Sequence[str], name: str, severity: str = "FATAL") -> DataFrame:
    """The check that no key is there more than once; a key that is NULL is none."""
    known = [F.col(c).isNotNull() for c in key]
    counted = rows.where(total(known) == len(known)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return _one(name, severity, counted.where("n > 1"))


def orphans(rows: DataFrame, parents: DataFrame, key: Sequence[str], name: str, severity: str = "FATAL") -> DataFrame:
    """The check that each row that names a parent has one."""
    known = [F.col(c).isNotNull() for c in key]
    return _one(name, severity, rows.where(total(known) == len(known)).join(parents.select(*key).distinct(), list(key), "left_anti"))


def unlike_identities(rows: DataFrame, id_col: str, of: Sequence[str], name: str, severity: str = "FATAL") -> DataFrame:
    """The check that rows of one id agree in what the id is made of."""
    spread = rows.groupBy(id_col).agg(F.count_distinct(F.struct(*of)).alias("n"))
    return _one(name, severity, spread.where("n > 1"))


def gate(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks with passed, and a row `overall` that counts the failed ones of at least ERROR: it passes if there are none."""
    all_ = checks[0]
    for c in checks[1:]:
        all_ = all_.unionByName(c)
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITIES.items()])
    worst = F.count_if((F.col("broken") > 0) & (rank >= SEVERITIES["ERROR"]))
    overall = all_.agg(F.lit("overall").alias("name"), F.when(worst > 0, "FAIL").otherwise("PASS").alias("severity"), worst.alias("broken"))
    return all_.unionByName(overall).withColumn("passed", F.col("broken") == 0)


def not_finite(columns: Sequence[str]) -> Column:
    return total([F.isnan(c) | (F.abs(c) == float("inf")) for c in columns])


def signal_checks(numbers: Sequence[str], deviations: Sequence[str], ranks: Sequence[str], horizons: Sequence[int]) -> dict[str, tuple[str, Column]]:
    """The row checks of blocked signals."""
    diff = [F.abs(F.col(f"opportunity_diff_{h}bar_r") - (F.col(f"shadow_return_{h}bar_r") - F.col(f"active_continuation_{h}bar_r"))) > 1e-5 for h in horizons]
    hits = [~F.coalesce(F.col(c), F.lit("")).isin(*FIRST_HITS) for c in ("shadow_first_hit", "active_first_hit", "actual_selected_first_hit")]
    needed = [F.col(c).isNull() for c in ("shadow_mfe_r", "shadow_mae_r", *[f"shadow_return_{h}bar_r" for h in horizons])]
    return {
        "missing_timestamp": ("ERROR", F.col("event_time").isNull()), "invalid_numeric": ("ERROR", not_finite(numbers)), "negative_stddev": ("ERROR", total([F.col(c) < 0 for c in deviations])),
        "rank_out_of_range": ("ERROR", total([~F.col(c).between(0, 100) for c in ranks])), "invalid_direction": ("ERROR", ~F.coalesce(relation_holds(), F.lit(False))), "diff_consistency": ("ERROR", total(diff)),
        "invalid_first_hit": ("ERROR", total(hits)), "missing_completed_outcome": ("ERROR", F.coalesce(F.col("completed"), F.lit(False)) & (total(needed) > 0)), "lookahead": ("FATAL", F.coalesce(F.col("entry_bar_time") > F.col("event_time"), F.lit(False))),
    }
