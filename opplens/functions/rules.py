"""Rules over columns: the first reason that applies, lists of all reasons, and normalised identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timeframes and their spellings.
TIMEFRAMES = {"1m": "M1", "m1": "M1", "5m": "M5", "m5": "M5", "15m": "M15", "m15": "M15", "30m": "M30", "m30": "M30", "1h": "H1", "h1": "H1", "4h": "H4", "h4": "H4", "1d": "D1", "d1": "D1", "60": "H1", "16385": "H1"}
#: The time formats that inputs use.
TIME_FORMATS = ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that is broken; a rule that is NULL counts as broken; NULL if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])


def all_reasons(rules: dict[str, Column]) -> Column:
    """The names of all broken rules in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))


def timestamp_of(text: Column, zone: str = "UTC", epoch: Column | None = None) -> Column:
    """The time in UTC of a text in one of TIME_FORMATS at zone; NULL if it has none of them, or if it is not the time that an epoch
    in seconds gives. Only the format that has the text's signs is tried: a format that fails costs a thrown error."""
    t = F.trim(text)
    signs = F.upper(F.translate(t, "+0123456789", ""))  # a year may have a sign
    shape = lambda f: re.sub("[yMdHms']", "", f)
    parsed = F.coalesce(*[F.when(signs.isin(shape(f), "-" + shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in TIME_FORMATS])
    at = F.to_utc_timestamp(parsed, zone)
    return at if epoch is None else F.when(F.unix_seconds(at) == epoch, at)


def symbol(text: Column) -> Column:
    s = F.upper(F.trim(text))
    return F.when(s.rlike("^[A-Z0-9._-]+$"), s)


def timeframe(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TIMEFRAMES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(text)))


def side(text: Column) -> Column:
    s = F.upper(F.trim(text))
    return F.when(s.isin("LONG", "BUY"), "LONG").when(s.isin("SHORT", "SELL"), "SHORT")


def fold(ts: Column) -> Column:
    """The evaluation period of a time by calendar year."""
    y = F.year(ts)
    return F.when(y.between(2019, 2022), "development").when(y.between(2023, 2024), "validation").when(y >= 2025, "oos").otherwise("other")


def is_close(a: Column, b: Column, absolute: float, relative: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
