"""Queries over event sources: tables written as the CSV files that a source exports, and read through it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opplens.sources import events as S
from opplens.sources.files import work_folder

from .registry import query, table

#: Rows of the three exports as text, some of them broken in each way that is checked. epoch is that of the time.
_COMMON = "l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR(20)) AS price, CASE l_suppkey % 5 WHEN 0 THEN 'buy' WHEN 1 THEN ' SHORT ' WHEN 2 THEN 'Long' WHEN 3 THEN 'sell' ELSE 'flat' END AS side, l_orderkey * 8 + l_linenumber AS k, l_shipdate AS ts"
_KINDS = {
    "STDDEV": "CASE k % 5 WHEN 0 THEN 'flat_long_only' WHEN 1 THEN 'OPEN_SAME_SIDE' WHEN 2 THEN ' ' WHEN 3 THEN 'ODD' ELSE 'FLAT_X' END",
    "BLOCKED": "CASE k % 6 WHEN 0 THEN 'blocked_opposite' WHEN 1 THEN 'BLOCKED_SAME_SIDE' WHEN 2 THEN 'LONG_ONLY' WHEN 3 THEN 'SIMULTANEOUS_CONFLICT' WHEN 4 THEN 'ODD' ELSE 'SHORT_ONLY' END",
    "TELEMETRY": "CASE k % 3 WHEN 0 THEN 'tick' WHEN 1 THEN '' ELSE 'Signal' END",
}
_SOURCES = {"STDDEV": S.STDDEV, "BLOCKED": S.BLOCKED, "TELEMETRY": S.TELEMETRY}


def _rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The export as its source writes it: text columns, those of no interest filled with zeros."""
    source = _SOURCES[name]
    x = spark.sql(f"SELECT {_COMMON} FROM {{lineitem}}", lineitem=table(spark, d, "lineitem"))
    day = F.date_format("ts", "yyyy.MM.dd HH:mm")
    text = F.when(F.col("k") % 23 == 0, "").when(F.col("k") % 29 == 0, "soon").when(F.col("k") % 2 == 0, day).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")) + F.when(F.col("k") % 31 == 0, 60).otherwise(0)
    event = F.concat(F.when(F.col("k") % 37 == 0, F.lit("x")).otherwise(F.lit("")), epoch.cast("string"), F.lit("_"), F.col("k").cast("string"))
    own = {"event_id": F.when(F.col("k") % 41 == 0, "  ").otherwise(event), source.time: text, source.kind: F.expr(_KINDS[name]), "side": F.col("side"), source.price: F.col("price"), "number": F.col("k").cast("string")}
    return x.select(*[own.get(c, F.lit("0")).alias(c) for c in dict.fromkeys([*source.required, "side", source.price, "number"])])


_CLASS = {
    "STDDEV": "CASE WHEN kind LIKE 'FLAT%' THEN 'FLAT_SIGNAL' WHEN kind LIKE 'OPEN%' THEN 'BLOCKED_SIGNAL' ELSE 'SIGNAL' END",
    "BLOCKED": "CASE WHEN kind IN ('BLOCKED_OPPOSITE', 'BLOCKED_SAME_SIDE') THEN 'BLOCKED_SIGNAL' WHEN kind IN ('LONG_ONLY', 'SHORT_ONLY') THEN 'CONTROL_SIGNAL' WHEN kind = 'SIMULTANEOUS_CONFLICT' THEN 'SIGNAL' END",
    "TELEMETRY": "kind",
}


def _sql(name: str) -> str:
    blocked = name == "BLOCKED"
    return f"""SELECT '{name}' AS source, coalesce(CASE WHEN k % 41 = 0 THEN 'MISSING_ID' WHEN k % 23 = 0 THEN 'MISSING_TIME' {"WHEN k % 37 = 0 THEN 'MISSING_EPOCH'" if blocked else ''} WHEN k % 29 = 0 {'OR k % 31 = 0' if blocked else ''} THEN 'BAD_TIME' WHEN {_CLASS[name]} IS NULL THEN 'UNSUPPORTED_TYPE' END, 'ACCEPTED') AS outcome, {_CLASS[name]} AS event_type,
  CASE side WHEN 'buy' THEN 'LONG' WHEN 'Long' THEN 'LONG' WHEN 'sell' THEN 'SHORT' WHEN ' SHORT ' THEN 'SHORT' END AS side, {"'BTCUSD'" if name != 'TELEMETRY' else "'UNKNOWN'"} AS symbol, CASE WHEN k % 23 > 0 AND k % 29 > 0 {'AND k % 31 > 0 AND k % 37 > 0 AND k % 41 > 0' if blocked else ''} THEN ts END AS stamp, l_partkey FROM
  (SELECT *, upper(coalesce(nullif(trim({_KINDS[name]}), ''), 'UNKNOWN')) AS kind FROM (SELECT l_partkey, {_COMMON} FROM lineitem))"""


@query(f"""SELECT source, outcome, event_type, side, symbol, count(*) AS n, min(stamp) AS first, max(stamp) AS last, CAST(sum(l_partkey) AS BIGINT) AS price FROM ({' UNION ALL '.join(map(_sql, _SOURCES))}) GROUP BY ALL""")
def s3_s4_s5_sources(spark, d):
    """The three exports through their sources: events of one shape, and the rows that do not pass with their reasons."""
    out = None
    for name, source in _SOURCES.items():
        folder = f"{work_folder(spark)}/export-{uuid.uuid4().hex}"
        _rows(spark, d, name).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
        both = S.read_judged(spark, folder, source).withColumns({"outcome": F.coalesce("reason", F.lit("ACCEPTED")), "source": F.lit(name)})
        out = both if out is None else out.unionByName(both)
    return out.groupBy("source", "outcome", "event_type", "side", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ts").cast("timestamp_ntz")).alias("first"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last"), F.sum("price").cast("long").alias("price"))
