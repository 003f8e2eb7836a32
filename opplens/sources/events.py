"""Event sources: audit exports and telemetry as CSV files, into events of one shape; a row that does not pass keeps its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opplens.functions import rules as R
from opplens.functions.scalars import parse_number
from opplens.operators.episodes import event_class

from .files import read_csv

#: The columns that each source must have.
STDDEV_FIELDS = (
    "event_id", "setup_id", "time", "side", "entry_price", "initial_sl", "risk_distance", "conflict_type", "entry_rsi", "entry_atr_pct", "entry_return_std_20", "entry_return_std_rank", "entry_price_std_20", "entry_price_std_100", "entry_price_std_pct_20",
    "entry_std_ratio_20_100", "entry_price_z20", "entry_price_abs_z20", "entry_rsi_std_20", "entry_rsi_std_rank", "entry_atr_return_std_ratio", "entry_atr_return_std_rank", "first_hit", "mfe_r", "mae_r", "return_6", "return_12", "return_24", "return_48", "completed",
)
BLOCKED_FIELDS = (
    "event_id", "event_time", "entry_bar_time", "fold", "side", "event_type", "active_side", "shadow_side", "actual_selected_side", "blocked_side", "direction", "setup_generation", "active_group_id", "active_base_position_identifier", "shadow_build_valid",
    "shadow_entry_price", "shadow_initial_sl", "shadow_risk_distance", "completed", "incomplete_reason",
)
TELEMETRY_FIELDS = ("event_id", "event_time", "event_type")
EVENT = ("event_id", "event_type", "raw_type", "ts", "source_time", "symbol", "timeframe", "side", "strategy", "audit", "price")


@dataclass(frozen=True)
class Source:
    """Which columns a source must have, where its time and type are, and what it says about itself."""

    required: tuple[str, ...]
    time: str
    kind: str
    price: str
    symbol: str | None = None
    timeframe: str | None = None
    strategy: str | None = None
    audit: str | None = None
    epoch: bool = False


STDDEV = Source(STDDEV_FIELDS, "time", "conflict_type", "entry_price", "BTCUSD", "H1", "V26", "V81")
BLOCKED = Source(BLOCKED_FIELDS, "event_time", "event_type", "shadow_entry_price", "BTCUSD", "H1", "V26", "V82", epoch=True)
TELEMETRY = Source(TELEMETRY_FIELDS, "event_time", "event_type", "price")


def _filled(df: DataFrame, c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")


def judged_events(raw: DataFrame, source: Source, zone: str = "UTC") -> DataFrame:
    """The events of raw (all columns text) with reason, NULL where they are accepted: MISSING_ID, MISSING_TIME, MISSING_EPOCH (the id does not
    begin with digits), BAD_TIME (no known format, or not the time of the id's epoch) or UNSUPPORTED_TYPE."""
    missing = [c for c in source.required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    # in steps, so that what several columns are made of is worked out once a row
    symbol = F.lit(source.symbol) if source.symbol else _filled(raw, "symbol")
    timeframe = F.lit(source.timeframe) if source.timeframe else _filled(raw, "timeframe")
    price = F.col(source.price) if source.price in raw.columns else F.lit(None).cast("string")
    side = F.col("side") if "side" in raw.columns else F.lit(None).cast("string")
    x = raw.select(_filled(raw, "event_id").alias("event_id"), _filled(raw, source.time).alias("source_time"), F.upper(F.coalesce(_filled(raw, source.kind), F.lit("UNKNOWN"))).alias("raw_type"), symbol.alias("symbol"), timeframe.alias("timeframe"), side.alias("side"), price.alias("price"))
    hint = F.substring_index("event_id", "_", 1)
    epoch = F.when(hint.rlike("^[0-9]+$"), hint).try_cast("long") if source.epoch else F.lit(None).cast("long")
    x = x.withColumns({
        "__epoch": epoch, "ts": R.timestamp_of(F.col("source_time"), zone), "event_type": event_class(F.lit(source.audit), F.col("raw_type")) if source.audit else F.col("raw_type"),
        "symbol": F.col("symbol") if source.symbol else R.symbol(F.coalesce("symbol", F.lit("UNKNOWN"))), "timeframe": F.col("timeframe") if source.timeframe else R.timeframe(F.coalesce("timeframe", F.lit("H1"))),
        "side": R.side(F.col("side")), "price": parse_number(F.col("price")), "strategy": F.lit(source.strategy).cast("string"), "audit": F.lit(source.audit).cast("string"),
    })
    if source.epoch:
        x = x.withColumn("ts", F.when(F.unix_seconds("ts") == F.col("__epoch"), F.col("ts")))
    rules = {"MISSING_ID": F.col("event_id").isNotNull(), "MISSING_TIME": F.col("source_time").isNotNull(), **({"MISSING_EPOCH": F.col("__epoch").isNotNull()} if source.epoch else {}), "BAD_TIME": F.col("ts").isNotNull(), "UNSUPPORTED_TYPE": F.col("event_type").isNotNull()}
    return x.select(*EVENT, R.first_reason(rules).alias("reason"))


def read_judged(spark: SparkSession, path: str | list[str], source: Source, zone: str = "UTC") -> DataFrame:
    """All events of CSV files with reason, as judged_events: for what needs both kinds of rows the files are read once."""
    return judged_events(read_csv(spark, path, source.required), source, zone)


def read_events(spark: SparkSession, path: str | list[str], source: Source, zone: str = "UTC", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected rows with their reason) of CSV files; with strict a rejected row is an error when the events are read."""
    x = read_judged(spark, path, source, zone)
    good = x.where("reason is null") if not strict else x.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "reason", F.coalesce("event_id", F.lit("?"))))))
    return good.drop("reason"), x.where("reason is not null")


def source_of(columns: list[str]) -> Source | None:
    """The source whose columns these are; the more particular one first."""
    if "entry_return_std_20" in columns:
        return STDDEV
    if {"event_id", "event_type", "shadow_return_48bar_r"} <= set(columns):
        return BLOCKED
    return TELEMETRY if set(TELEMETRY_FIELDS) <= set(columns) else None
