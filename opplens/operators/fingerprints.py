"""Fingerprints of tables that do not depend on the order or the partitions of their rows, and the keys of nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .features import _kept

#: Decimal places that floating numbers are rounded to before they are hashed.
PLACES = 12
#: Hex digits of the first and the second level of the tree of digests.
LEVELS = (4, 2)


@F.pandas_udf(StringType())
def shortest(x: pd.Series) -> pd.Series:
    """The shortest text that reads back as the number, as SQL engines write it; Java 17 adds needless digits and other exponents."""
    return x.map(lambda v: repr(float(v)), na_action="ignore")


def canonical_row(df: DataFrame, columns: Sequence[str], places: int | None = PLACES) -> Column:
    """name=value of the columns in the order of their names, floating numbers rounded, or whole if places is None; a NULL has a sign of its
    own. A number that is not finite is an error, as it has no stable text."""

    def text(c: str) -> Column:
        if df.schema[c].dataType.typeName() in ("double", "float"):
            x = F.col(c).cast("double")
            odd = F.isnan(x) | (F.abs(x) == float("inf"))
            plain = shortest(x) if places is None else (F.round(x, places) + F.lit(0.0)).cast("string")
            return F.when(odd, F.raise_error(F.lit(f"{c} holds a number that is not finite"))).otherwise(plain)
        return F.col(c).cast("string")

    return F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(text(c), F.lit("\x00"))) for c in sorted(columns)])


def fingerprint(df: DataFrame, columns: Sequence[str], part: str, places: int | None = PLACES) -> DataFrame:
    """One row (part, rows, digest). Equal rows are counted first; the rows' hashes are then dealt by their first digits into buckets, whose
    digests are joined by fewer digits and at last into one: no task sees more than a bucket or the digests of a level."""
    h = df.select(F.sha2(canonical_row(df, columns, places), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat("h", F.lit(":"), F.col("n").cast("string"))
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("e")), ";"), 256)
    level = h.select(F.col("h").alias("key"), entry.alias("e"), "n")
    for digits in LEVELS:
        level = level.groupBy(F.substring("key", 1, digits).alias("key")).agg(joined().alias("d"), F.sum("n").alias("n")).select("key", F.concat("key", F.lit("="), "d").alias("e"), "n")
    return level.agg(F.lit(part).alias("part"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), joined().alias("digest"))


def dataset(parts: Sequence[DataFrame], versions: dict[str, str]) -> DataFrame:
    """The parts, and a row `dataset` whose digest is that of the parts' digests and the versions of what made them."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    named = ";".join(f"{k}={v}" for k, v in sorted(versions.items()))
    whole = F.sha2(F.concat_ws("|", F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit("="), "digest"))), ";"), F.lit(named)), 256)  # a row a part
    return all_.unionByName(all_.agg(F.lit("dataset").alias("part"), F.sum("rows").alias("rows"), whole.alias("digest")))


def json_entries(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, key, kind, text) of everything in the JSON of each row, to any depth, objects and arrays: one round of variant_explode a level,
    until no container is left. The containers of a level are written as a table, so each is unpacked from the one above it and not from the
    text again. What is no JSON has no entries. kind: OBJECT, ARRAY, or the type of the value; text: that of a plain value."""
    level = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null")
    found = None
    while True:
        each = rows.sparkSession.sql("SELECT x.id, x.path, e.pos, e.key, e.value AS v, schema_of_variant(e.value) AS kind FROM {x} x, LATERAL variant_explode(x.v) e", x=level)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        each = each.select("id", F.concat("path", step).alias("path"), "key", F.regexp_extract("kind", "^[A-Z]+", 0).alias("kind"), "v")
        box = F.col("kind").isin("OBJECT", "ARRAY")
        one = each.select("id", "path", "key", "kind", F.when(~box, F.expr("try_variant_get(v, '$', 'string')")).alias("text"))
        found = one if found is None else found.unionByName(one)
        level = _kept(each.where(box).select("id", "path", "v"))
        if level.isEmpty():
            return found


#: Texts that stand for numbers that are not finite.
NOT_FINITE = ("nan", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")


def refused(entries: DataFrame, outcome: Column) -> DataFrame:
    """The entries that must not be in a payload: keys that tell of outcomes, at any depth, and texts of numbers that are not finite."""
    why = F.when(F.coalesce(outcome, F.lit(False)), "OUTCOME_KEY").when(F.lower(F.trim("text")).isin(*NOT_FINITE), "NOT_FINITE")
    return entries.withColumn("why", why).where("why is not null").select("id", "path", "why")
