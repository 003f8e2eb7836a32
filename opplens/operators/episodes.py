"""Trading episodes: event classes, canonical identity, the canonical view, event metrics, quality counters and promotion gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import medians

#: Event labels of the two audits and what they have in common.
SEMANTICS = {"FLAT_LONG_ONLY": "LONG_ONLY", "FLAT_SHORT_ONLY": "SHORT_ONLY", "OPEN_OPPOSITE_SIDE": "BLOCKED_OPPOSITE", "OPEN_SAME_SIDE": "BLOCKED_SAME_SIDE"}
#: Names that tell of an outcome and so are no features, and prefixes of such names.
OUTCOME_NAMES = ("result_r", "net_profit", "exit_price", "exit_reason", "mfe_r", "mae_r", "hit_plus_1r_first", "hit_minus_1r_first", "first_hit", "completed", "incomplete_reason")
OUTCOME_PREFIXES = ("future_return_", "forward_return_", "shadow_mfe_r", "shadow_mae_r", "shadow_return_", "shadow_plus_1r_hit", "shadow_minus_1r_hit", "shadow_first_hit", "active_value_", "active_continuation_", "active_plus_1r_hit", "active_minus_1r_hit", "active_first_hit", "actual_selected_", "opportunity_diff_")
HORIZONS = (6, 12, 24, 48)
ACTIVE_TYPES = ("BLOCKED_OPPOSITE", "BLOCKED_SAME_SIDE")


def text(c: Column) -> Column:
    """Trimmed upper case, or NULL as a word."""
    t = F.upper(F.trim(c))
    return F.when(t.isNull() | (t == ""), "NULL").otherwise(t)


def number(c: Column) -> Column:
    """A decimal without needless zeros, so that 1.50 and 1.5 have one identity."""
    d = c.cast("decimal(28,8)")
    plain = F.rtrim(F.rtrim(d.cast("string"), F.lit("0")), F.lit("."))  # eight decimals are always written
    return F.when(c.isNull(), "NULL").when(d == 0, "0").otherwise(plain)


def semantic(event_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEMANTICS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text(event_type)), text(event_type))


def identity_key(strategy: Column, symbol: Column, timeframe: Column, side: Column, event_type: Column, entry: Column, stop: Column, risk: Column, version: str = "canonical-opportunity/1") -> Column:
    """The nine parts that make two audit rows one opportunity; none of them names an audit or a file."""
    parts = {"linkage_version": F.lit(version), "strategy": text(strategy), "symbol": text(symbol), "timeframe": text(timeframe), "side": text(side), "candidate_semantic": semantic(event_type), "entry": number(entry), "stop": number(stop), "risk_distance": number(risk)}
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()])


def canonical_id(key: Column) -> Column:
    return F.concat(F.lit("opp-"), F.sha2(key, 256))


def event_class(audit: Column, raw: Column) -> Column:
    """The class of a raw event type; NULL where the second audit's type is not supported."""
    r = text(raw)
    first = F.when(r.startswith("FLAT_"), "FLAT_SIGNAL").when(r.startswith("OPEN_"), "BLOCKED_SIGNAL").otherwise("SIGNAL")
    second = F.when(r.isin(*ACTIVE_TYPES), "BLOCKED_SIGNAL").when(r.isin("LONG_ONLY", "SHORT_ONLY"), "CONTROL_SIGNAL").when(r == "SIMULTANEOUS_CONFLICT", "SIGNAL")
    return F.when(audit == "V81", first).when(audit == "V82", second)


def episode_kind(audit: Column, raw: Column) -> Column:
    """struct<kind, candidate> of an event."""
    r = text(raw)
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("candidate"))
    second = F.when(r.isin(*ACTIVE_TYPES), kind("BLOCKED_OPPORTUNITY", "BLOCKED")).when(r.isin("LONG_ONLY", "SHORT_ONLY"), kind("CONTROL_OPPORTUNITY", "CONTROL")).when(r == "SIMULTANEOUS_CONFLICT", kind("SIMULTANEOUS_CONFLICT", "CONTROL"))
    first = F.when(r.startswith("FLAT_"), kind("FLAT_CANDIDATE", "FLAT")).when(r.startswith("OPEN_"), kind("BLOCKED_OPPORTUNITY", "BLOCKED"))
    return F.coalesce(F.when(audit == "V82", second).when(audit == "V81", first), kind("UNKNOWN", "UNKNOWN"))


def fold_type(given: Column, ts: Column) -> Column:
    """The fold named by a prefix, else by the calendar year."""
    g, y = F.coalesce(F.upper(F.trim(given)), F.lit("")), F.year(ts)
    named = F.coalesce(*[F.when(g.startswith(p), p) for p in ("TRAIN", "VALIDATION", "OOS", "FORWARD", "SMOKE")])
    return F.coalesce(named, F.when(y.isin(2023, 2024), "VALIDATION").when(y >= 2025, "OOS").otherwise("UNKNOWN"))


def is_outcome_name(name: str) -> bool:
    return name.lower() in OUTCOME_NAMES or name.lower().startswith(OUTCOME_PREFIXES)


def require_features(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """df, or an error before any job if a column tells of an outcome or is not allowed."""
    if leaked := [c for c in df.columns if is_outcome_name(c)]:
        raise ValueError(f"columns tell of outcomes: {', '.join(leaked)}")
    if unknown := [c for c in df.columns if c not in allowed]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df


def outcome_keys(json: Column) -> Column:
    """The keys of a JSON object, and of objects in it, that tell of outcomes; NULL where it is no object."""
    keys = F.array_union(F.json_object_keys(json), F.coalesce(F.flatten(F.transform(F.map_values(F.from_json(json, "map<string,string>")), lambda v: F.coalesce(F.json_object_keys(v), F.expr("cast(array() as array<string>)")))), F.expr("cast(array() as array<string>)")))
    return F.filter(keys, lambda k: F.lower(k).isin(*OUTCOME_NAMES) | F.coalesce(*[F.when(F.lower(k).startswith(p), True) for p in OUTCOME_PREFIXES], F.lit(False)))


#: Further names, prefixes and endings of names that tell of what comes later.
FUTURE_NAMES = ("outcome", "outcomes", "label", "labels", "future", "future_bars", "price_after")
FUTURE_PREFIXES, FUTURE_ENDINGS = ("future_",), ("_outcome", "_label")
#: The same in SQL, for a column key.
FUTURE_SQL = "(lower(trim(key)) IN {} OR {})".format((*OUTCOME_NAMES, *FUTURE_NAMES), " OR ".join([f"starts_with(lower(trim(key)), '{p}')" for p in (*OUTCOME_PREFIXES, *FUTURE_PREFIXES)] + [f"ends_with(lower(trim(key)), '{e}')" for e in FUTURE_ENDINGS]))


def future_key(name: Column) -> Column:
    """Whether a key tells of an outcome or of what comes later."""
    n = F.lower(F.trim(name))
    return reduce(or_, [n.isin(*OUTCOME_NAMES, *FUTURE_NAMES), *[n.startswith(p) for p in (*OUTCOME_PREFIXES, *FUTURE_PREFIXES)], *[n.endswith(e) for e in FUTURE_ENDINGS]])


def canonical_view(rows: DataFrame, key: str, ts: str, source: str, audit: str, fields: Sequence[str], absolute: float = 1e-4, relative: float = 1e-5) -> DataFrame:
    """One row for each key: the latest time, the audits, and each field's mean where all of its values are compatible with the first one.

    The first value is that of the least (time, audit, source). A field with incompatible values is NULL and CONFLICT, one
    without values INSUFFICIENT. A row is CONFLICT if a field is, INSUFFICIENT without values, PARTIAL with some, else VALID.
    What is compatible with the first value is an interval around it, so the least and the greatest value tell whether all are:
    one aggregation, without a join. Rows are dealt by their key as they are: the states of the aggregates are several times as wide, and
    keys of a few rows would hardly shrink in a task.
    """
    order = F.struct(ts, audit, source)
    rows = rows.select(key, *dict.fromkeys([ts, source, audit, *fields])).repartition(key)
    near = lambda c, x: F.abs(F.col(f"{x}_{c}") - F.col(f"first_{c}")) <= F.greatest(relative * F.greatest(F.abs(F.col(f"{x}_{c}")), F.abs(F.col(f"first_{c}"))), F.lit(absolute))
    out = rows.groupBy(key).agg(
        F.max(ts).alias(ts), F.count(F.lit(1)).alias("observations"), F.array_sort(F.collect_set(audit)).alias("audits"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"first_{c}") for c in fields],
        *[f(c).alias(f"{name}_{c}") for c in fields for name, f in (("n", F.count), ("low", F.min), ("high", F.max))], *[F.avg(c).alias(c) for c in fields],
    )
    out = out.withColumns({f"same_{c}": near(c, "low") & near(c, "high") for c in fields})
    state = lambda c: F.when(F.col(f"n_{c}") == 0, "INSUFFICIENT").when(F.col(f"same_{c}"), "VALID").otherwise("CONFLICT")
    out = out.withColumns({f"status_{c}": state(c) for c in fields})
    known = sum((F.col(f"status_{c}") == "VALID").cast("int") for c in fields)
    conflicts = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"status_{c}") == "CONFLICT", F.lit(c)) for c in fields])))
    status = F.when(F.size(conflicts) > 0, "CONFLICT").when(known == 0, "INSUFFICIENT").when(known < len(fields), "PARTIAL").otherwise("VALID")
    return out.select(key, ts, "observations", "audits", *[F.when(F.col(f"status_{c}") == "VALID", F.col(c)).alias(c) for c in fields], *[f"status_{c}" for c in fields], conflicts.alias("conflicts"), status.alias("status"))


def first_hit_label(hit: Column, plus: Column, minus: Column, resolved: Column) -> Column:
    """1 or 0 where the first touch is known and nothing contradicts it, else NULL."""
    p, m = F.coalesce(plus, F.lit(False)), F.coalesce(minus, F.lit(False))
    unclear = ~F.coalesce(resolved, F.lit(False)) | (F.coalesce(hit, F.lit("")) == "AMBIGUOUS") | (p & m) | ((hit == "PLUS_1R") & (plus.isNotNull() & ~p | m)) | ((hit == "MINUS_1R") & (minus.isNotNull() & ~m | p))
    return F.when(F.coalesce(unclear, F.lit(False)), None).when((hit == "PLUS_1R") | (p & ~m), 1).when((hit == "MINUS_1R") | (m & ~p), 0)


def hit_metrics(prefix: str) -> list[Column]:
    hit = F.col(f"{prefix}first_hit")
    plus, minus = F.count_if(hit == "PLUS_1R"), F.count_if(hit == "MINUS_1R")
    return [plus.alias(f"{prefix}plus1r_first"), minus.alias(f"{prefix}minus1r_first"), (plus + minus).alias(f"{prefix}resolved_events"), F.try_divide(plus.cast("double"), (plus + minus).cast("double")).alias(f"{prefix}plus1r_first_rate")]


def event_metrics(rows: DataFrame, by: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """All metrics of populations of completed valid events."""
    out = [F.count(F.lit(1)).alias("events"), F.count(F.lit(1)).alias("complete_events")]
    for prefix in ("shadow_", "active_", "actual_selected_"):
        out += hit_metrics(prefix)
    for family in ("shadow_return", "active_continuation", "opportunity_diff"):
        for h in horizons:
            out.append(F.avg(f"{family}_{h}bar_r").alias(f"mean_{family}_{h}_r"))
    middle = {f"median_{f}_{h}_r": f"{f}_{h}bar_r" for f in ("shadow_return", "active_continuation", "opportunity_diff") for h in horizons}
    middle |= {f"median_{p}_{m}": f"{p}_{m}" for p in ("shadow", "active", "actual_selected") for m in ("mfe_r", "mae_r")}
    return rows.groupBy(*by).agg(*out).join(medians(rows, by, middle), list(by), "left")


def relation_holds() -> Column:
    """Whether the sides of an event fit its type."""
    kind, side, active, shadow, chosen, blocked = (F.col(c) for c in ("event_type", "side", "active_side", "shadow_side", "actual_selected_side", "blocked_side"))
    own = shadow == side
    held = active.isin("LONG", "SHORT") & own & (chosen == "NONE") & (blocked == shadow) & F.when(kind == "BLOCKED_OPPOSITE", active != shadow).otherwise(active == shadow)
    both = (active == "NONE") & own & (chosen == "LONG") & (blocked == shadow)
    expected = F.when(kind == "LONG_ONLY", "LONG").otherwise("SHORT")
    alone = (active == "NONE") & (side == expected) & (shadow == expected) & (chosen == expected) & (blocked == "NONE")
    return F.when(kind.isin(*ACTIVE_TYPES), held).when(kind == "SIMULTANEOUS_CONFLICT", both).when(kind.isin("LONG_ONLY", "SHORT_ONLY"), alone)


def event_quality(expected_bars: int = 48, horizons: Sequence[int] = HORIZONS) -> list[Column]:
    """The counters of a blocked-signal export, one aggregate each."""
    count = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    risk, age, valid, done = F.col("shadow_risk_distance"), F.col("age_bars"), F.col("shadow_build_valid"), F.col("completed")
    sides = ~F.col("side").isin("LONG", "SHORT") | ~F.col("shadow_side").isin("LONG", "SHORT") | ~F.col("active_side").isin("LONG", "SHORT", "NONE") | ~F.col("actual_selected_side").isin("LONG", "SHORT", "NONE")
    known = F.col("event_type").isin(*ACTIVE_TYPES, "LONG_ONLY", "SHORT_ONLY", "SIMULTANEOUS_CONFLICT")
    families = [f"{p}_{h}bar_r" for p in ("shadow_return", "active_continuation", "opportunity_diff") for h in horizons]
    early = [(F.col(f).isNotNull() & (age < int(f.split("_")[-2].removesuffix("bar")))).cast("long") for f in families]
    finite = [(F.isnan(F.col(f)) | (F.abs(F.col(f)) == float("inf"))).cast("long") for f in families]
    needed = [f"shadow_return_{h}bar_r" for h in horizons]
    missing = valid & done & F.coalesce(*[F.when(F.col(f).isNull(), True) for f in needed], F.lit(False))
    zero = F.lit(0).cast("long")
    add = lambda xs: F.coalesce(F.sum(sum((F.coalesce(x, zero) for x in xs), zero)), zero)
    return [
        F.count(F.lit(1)).alias("rows"), count(F.col("event_id").isNull(), "missing_event_id"), (F.count("event_id") - F.count_distinct("event_id")).alias("duplicate_event_ids"), add(finite).alias("nan_or_inf"),
        count(sides, "invalid_side"), count(~known, "invalid_event_type"), count(known & ~F.coalesce(relation_holds(), F.lit(False)), "invalid_relation"), count(F.col("event_time").isNull() | F.col("entry_bar_time").isNull(), "invalid_time"),
        count(risk < 0, "negative_risk"), count((risk.isNull() & valid) | ((risk == 0) & valid), "zero_or_missing_risk"), count(age < 0, "negative_age"), count(done & (age.isNull() | (age < expected_bars)), "completed_before_horizon"),
        (F.coalesce(F.count_if(F.col("entry_bar_time") > F.col("event_time")), F.lit(0)) + add(early)).alias("lookahead"), count(missing, "missing_outcome"), count(valid & done & ~missing, "valid_completed"), count(valid & ~done, "incomplete_valid"), count(~valid, "invalid_build"),
    ]


def promotion_gates(rows: DataFrame, by: Sequence[str], fold: str, year: str, least: int = 30) -> DataFrame:
    """For each hypothesis the five gates over its completed events and the conclusion."""
    snap = rows.groupBy(*by).pivot(fold, ["validation", "oos"]).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count_if(F.col("shadow_first_hit") == "PLUS_1R").cast("double"), F.count_if(F.col("shadow_first_hit").isin("PLUS_1R", "MINUS_1R")).cast("double")).alias("blocked"),
        F.try_divide(F.count_if(F.col("active_first_hit") == "PLUS_1R").cast("double"), F.count_if(F.col("active_first_hit").isin("PLUS_1R", "MINUS_1R")).cast("double")).alias("active"),
    )
    middle = medians(rows, [*by, fold], {"d24": "opportunity_diff_24bar_r", "d48": "opportunity_diff_48bar_r"}).groupBy(*by).pivot(fold, ["validation", "oos"]).agg(F.max("d24").alias("d24"), F.max("d48").alias("d48"))
    years = rows.groupBy(*by, year).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(medians(rows, [*by, year], {"d": "opportunity_diff_24bar_r"}), [*by, year], "left")
    years = years.groupBy(*by).agg(F.count(F.lit(1)).alias("years"), F.count_if(F.col("d") > 0).alias("positive_years"))
    v, o = (lambda c: F.col(f"validation_{c}")), (lambda c: F.col(f"oos_{c}"))
    no = F.lit(False)
    gates = {
        "sample": (F.coalesce(v("n"), F.lit(0)) >= least) & (F.coalesce(o("n"), F.lit(0)) >= least),
        "direction": F.coalesce((v("d24") > 0) & (o("d24") > 0), no),
        "materiality": F.coalesce(v("d48") >= 0.2, no) | F.coalesce(o("d48") >= 0.2, no) | F.coalesce(v("blocked") - v("active") >= 0.08, no) | F.coalesce(o("blocked") - o("active") >= 0.08, no),
        "stability": F.coalesce((v("d24") > 0) & (o("d24") > 0) | (v("d24") < 0) & (o("d24") < 0), no),
        "year_concentration": (F.coalesce("years", F.lit(0)) >= 3) & (F.coalesce("positive_years", F.lit(0)) >= 3),
    }
    out = snap.join(middle, list(by), "left").join(years, list(by), "left").withColumns(gates)
    all_ = F.col("sample") & F.col("direction") & F.col("materiality") & F.col("stability") & F.col("year_concentration")
    conclusion = F.when(all_, "PROMISING_FOR_EXECUTION_EXPERIMENT").when(~F.col("sample"), "INSUFFICIENT_SAMPLE").otherwise("INSUFFICIENT_EVIDENCE")
    return out.select(*by, *gates, conclusion.alias("conclusion"))
