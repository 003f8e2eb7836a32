"""Streams with keyed state: a gate on event time, duplicates collapsed with counters, and outcomes that come later and once.

State is kept by key for a stated time after the watermark and then forgotten; it lives in the checkpoint, so a query that is started again
goes on where it ended. `batch` has the same operators over tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The ages in bars at which returns are taken, and the one that a resolved outcome must have.
RETURNS = (6, 12, 24, 48)
NEEDED = 24


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], added])


def _millis(x: pd.Series) -> np.ndarray:
    return x.to_numpy("datetime64[ms]").astype(np.int64)


def _ordered(chunks: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of a key in one micro-batch, in their order of arrival."""
    return pd.concat(list(chunks)).sort_values(by, kind="stable").reset_index(drop=True)


def gate(stream: DataFrame, run: str, ts: str, received: str, arrival: str, kind: str, in_order: str = "DIAGNOSTIC", future_ms: int = 5_000, oldest_ms: int | None = None, late: str = "1 hour", forget_ms: int = 86_400_000) -> DataFrame:
    """The rows with reason, NULL where they are accepted: EVENT_TIMESTAMP_IN_FUTURE, EVENT_TOO_OLD, or, for rows whose kind is
    in_order, OUT_OF_ORDER_EVENT if an accepted row of the run has a later time. Other kinds are accepted in any order.

    State is the latest accepted time of each run. It is forgotten forget_ms after the last row's receipt has passed."""

    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x = _ordered(chunks, [arrival])
        at, got = _millis(x[ts]), _millis(x[received])
        reason = np.where(at > got + future_ms, "EVENT_TIMESTAMP_IN_FUTURE", None)
        if oldest_ms is not None:
            reason = np.where((reason == None) & (got - at > oldest_ms), "EVENT_TOO_OLD", reason)  # noqa: E711
        none = np.iinfo(np.int64).min
        # what is out of order is below the greatest accepted time, so it does not move it
        high = np.maximum.accumulate(np.concatenate([[state.get[0] if state.exists else none], np.where(reason == None, at, none)]))  # noqa: E711
        out = (reason == None) & (x[kind] == in_order).to_numpy() & (at < high[:-1])  # noqa: E711
        state.update((int(high[-1]),))
        state.setTimeoutTimestamp(max(int(got.max()), state.getCurrentWatermarkMs()) + forget_ms)
        yield x.assign(reason=np.where(out, "OUT_OF_ORDER_EVENT", reason))

    return stream.withWatermark(received, late).groupBy(run).applyInPandasWithState(judge, _schema(stream, "reason string"), "latest long", "append", GroupStateTimeout.EventTimeTimeout)


def collapse(stream: DataFrame, keys: list[str], source_id: str, received: str, arrival: str, reason: str, valid: str, late: str = "1 hour", forget_ms: int = 86_400_000) -> DataFrame:
    """The rows with status, representative (the source id of the first accepted row of the key), observations and duplicates so far.

    A source id that the key has had is REJECTED_DUPLICATE and counts for nothing; another row of a known key is DUPLICATE_COLLAPSED,
    whatever its reason; the first row of a key is REJECTED_STALE if it has a reason, else ACCEPTED, or INVALID if it is not valid.
    Source ids are held with their key until it is forgotten, forget_ms after its last row."""

    def settle(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x = _ordered(chunks, [arrival])
        held = json.loads(state.get[0]) if state.exists else {"first": None, "n": 0, "seen": []}
        seen, out = set(held["seen"]), []
        for one, why, good in zip(x[source_id].astype(str), x[reason], x[valid]):
            if one in seen:
                status = "REJECTED_DUPLICATE"
            elif held["first"] is not None:
                status, held["n"] = "DUPLICATE_COLLAPSED", held["n"] + 1
            elif isinstance(why, str):
                status = "REJECTED_STALE"
            else:
                status, held["first"], held["n"] = "ACCEPTED" if good else "INVALID", one, 1
            if status != "REJECTED_STALE":
                seen.add(one)
            out.append((status, held["first"], held["n"], max(held["n"] - 1, 0)))
        held["seen"] = sorted(seen)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(int(_millis(x[received]).max()), state.getCurrentWatermarkMs()) + forget_ms)
        yield x.assign(**dict(zip(("status", "representative", "observations", "duplicates"), map(list, zip(*out)))))

    added = "status string, representative string, observations long, duplicates long"
    return stream.withWatermark(received, late).groupBy(*keys).applyInPandasWithState(settle, _schema(stream, added), "held string", "append", GroupStateTimeout.EventTimeTimeout)


OUTCOME = "id string, symbol string, status string, label int, reason string, bars int, mfe double, mae double, " + ", ".join(f"r{h} double" for h in RETURNS)


def _follow(p: dict, at: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, horizon: int) -> None:
    """A pending prediction after more bars, which come in order."""
    if len(at) and at[-1] > p["event"]:
        p["seen"] = True
    later = at > p["committed"]
    n = min(int(later.sum()), horizon - p["n"])
    if not n:
        return
    sign = 1.0 if p["side"] == "LONG" else -1.0
    up, down, moved = (sign * (x[later][:n] - p["entry"]) / p["risk"] for x in ((high, low, close) if sign > 0 else (low, high, close)))
    if p["hit"] is None:
        touched = np.flatnonzero((up >= 1) | (down <= -1))
        if len(touched):
            p["hit"] = "AMBIGUOUS" if up[touched[0]] >= 1 and down[touched[0]] <= -1 else "PLUS_1R" if up[touched[0]] >= 1 else "MINUS_1R"
    for h in RETURNS:
        if p["n"] < h <= p["n"] + n:
            p[f"r{h}"] = float(moved[h - p["n"] - 1])
    p["mfe"] = float(max(up.max(), down.max(), -np.inf if p["mfe"] is None else p["mfe"]))
    p["mae"] = float(min(up.min(), down.min(), np.inf if p["mae"] is None else p["mae"]))
    p["n"] += n


def _outcome(p: dict) -> tuple:
    label = {"PLUS_1R": 1, "MINUS_1R": 0}.get(p["hit"])
    if not p["n"]:
        status, reason = ("INVALID", "PREDICTION_AFTER_OUTCOME") if p["seen"] else ("INCOMPLETE", "NO_FUTURE_BARS")
    elif label is None:
        status, reason = "INCOMPLETE", "AMBIGUOUS_SAME_BAR" if p["hit"] else "NO_FIRST_HIT"
    elif p[f"r{NEEDED}"] is None:
        status, reason = "INCOMPLETE", f"MISSING_{NEEDED}BAR_OUTCOME"
    else:
        status, reason = "RESOLVED", None
    return (p["id"], p["symbol"], status, label, reason, p["n"], p["mfe"], p["mae"], *[p[f"r{h}"] for h in RETURNS])


def outcomes(predictions: DataFrame, bars: DataFrame, horizon: int = 48, wait_ms: int = 72 * 3_600_000, late: str = "1 hour", lanes: int = 8) -> DataFrame:
    """One outcome for each prediction (id, symbol, side, event_ts, committed, entry, risk), from the bars (symbol, bar_ts, h, l, c) after it
    was committed: once it has horizon bars, or, with what there is, once the watermark is wait_ms past its commit.

    Bars are taken in order, when the watermark has passed them; until then state keeps them beside the path so far of each open
    prediction. A symbol's predictions are dealt over lanes, each of which gets its bars, so that no symbol is one task."""
    from pyspark.sql import functions as F

    kinds = "symbol string, lane int, at timestamp, at_ms long, id string, side string, event_ms long, entry double, risk double, h double, l double, c double"
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    filled = lambda df: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(k.split(" ")[1]).alias(n) for n, k in zip(names, kinds.split(", "))])
    asked = filled(predictions.withColumnsRenamed({"committed": "at"}).withColumns({"lane": F.pmod(F.xxhash64("id"), F.lit(lanes)), "at_ms": F.unix_millis("at"), "event_ms": F.unix_millis("event_ts")}))
    given = filled(bars.withColumnsRenamed({"bar_ts": "at"}).withColumns({"lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), "at_ms": F.unix_millis("at")}))

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": [], "bars": [], "last": None}
        if not state.hasTimedOut:
            x = pd.concat(list(chunks))
            at = x["at_ms"].to_numpy(np.int64)
            new = x["id"].notna().to_numpy()
            held["bars"] += [[int(t), *map(float, v)] for t, v in zip(at[~new], x.loc[~new, ["h", "l", "c"]].to_numpy(float))]
            for t, event, (i, side, entry, risk) in zip(at[new], x["event_ms"][new], x.loc[new, ["id", "side", "entry", "risk"]].itertuples(index=False)):
                held["open"].append({"id": i, "symbol": key[0], "side": side, "entry": float(entry), "risk": float(risk), "committed": int(t), "event": int(event), "n": 0, "hit": None, "mfe": None, "mae": None, "seen": held["last"] is not None and held["last"] > int(event), **{f"r{h}": None for h in RETURNS}})
        mark = state.getCurrentWatermarkMs()
        ready = sorted({b[0]: b for b in held["bars"] if b[0] <= mark}.values())  # a bar that comes again is one bar
        held["bars"] = [b for b in held["bars"] if b[0] > mark]
        path = np.asarray(ready, float).reshape(-1, 4).T
        done, left = [], []
        for p in held["open"]:
            _follow(p, path[0], path[1], path[2], path[3], horizon)
            (done if p["n"] >= horizon or p["committed"] + wait_ms <= mark else left).append(p)
        held["open"] = left
        held["last"] = ready[-1][0] if ready else held["last"]
        if state.hasTimedOut and not left and not held["bars"]:
            state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min([*[b[0] for b in held["bars"]], *[p["committed"] + wait_ms for p in left]], default=mark + wait_ms), mark + 1))
        if done:
            yield pd.DataFrame([_outcome(p) for p in done], columns=[c.split(" ")[0] for c in OUTCOME.split(", ")]).astype({"label": "Int32", "bars": "int32"})

    both = asked.unionByName(given).withWatermark("at", late)
    return both.groupBy("symbol", "lane").applyInPandasWithState(follow, OUTCOME, "held string", "append", GroupStateTimeout.EventTimeTimeout)
