"""Recursions, tick paths, fingerprints, the bootstrap, payload walks, the frozen index, regimes and event sources against plain rules."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opplens.functions import buckets
from opplens.operators import bootstrap, features, fingerprints, recursions, regimes, similar, ticks
from opplens.operators import episodes as E
from opplens.sources import events as S

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.mark.parametrize("fan_in", [2, 64])
def test_affine_recursion_over_blocks_of_any_size(spark, fan_in, monkeypatch):
    monkeypatch.setattr(recursions, "FAN_IN", fan_in)
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for s in "ab":
        x = y = 0.0
        for k in sorted(rng.choice(400, 150, replace=False).tolist()):  # bars are missing here and there
            a = None if rng.random() < 0.1 else float(rng.uniform(-1, 1))
            b = float(rng.normal())
            if a is not None:
                x, y = a * x + b, a * y + 1
            rows.append((s, START + k * HOUR, a, b))
            want[s, START + k * HOUR] = (x, y)
    df = spark.createDataFrame(rows, "s string, t timestamp, a double, b double")
    got = recursions.affine(df, ["s"], "t", 7 * 3600, F.col("a"), {"x": F.col("b"), "y": F.lit(1.0)})
    got = {(r.s, r.t): (r.x, r.y) for r in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_wilder_rsi_before_its_first_moves_and_without_moves(spark):
    close = [10.0, 11.0, 10.5] + [12.0] * 20
    rows = [("s", START + k * HOUR, c) for k, c in enumerate(close)] + [("flat", START + k * HOUR, 1.0) for k in range(20)]
    got = recursions.wilder_rsi(spark.createDataFrame(rows, "symbol string, bar_ts timestamp, c double"), seconds=3 * 3600)
    got = {(r.symbol, r.bar_ts): r.rsi for r in got.collect()}
    up = down = 0.0
    for k in range(1, len(close)):
        d = close[k] - close[k - 1]
        up, down = (up + max(d, 0) / 14, down + max(-d, 0) / 14) if k <= 14 else ((up * 13 + max(d, 0)) / 14, (down * 13 + max(-d, 0)) / 14)
        rsi = got["s", START + k * HOUR]
        assert rsi is None if k < 14 else math.isclose(rsi, 100 * up / (up + down))
    assert got["flat", START + 15 * HOUR] == 50.0 and got["flat", START + 13 * HOUR] is None


def walk_fan(rows, rules):
    """The machine as a plain loop over the bars of one side, with the lines as that side sees them."""
    out, m, age = [], None, 10**5
    for k, (t, rsi, ema, wma) in enumerate(rows):
        p = rows[k - 1] if k else None
        over = lambda a, b: p is not None and p[a] <= p[b] and rows[k][a] > rows[k][b]  # noqa: E731, B023
        under = lambda a, b: p is not None and p[a] >= p[b] and rows[k][a] < rows[k][b]  # noqa: E731, B023
        age = 0 if under(1, 3) else age + 1
        span = max(rsi, ema, wma) - min(rsi, ema, wma)
        if under(2, 3) and 1 <= age <= rules["window"] and span <= rules["spread"]:
            if m:
                m["ended"] = m["ended"] or "RESTARTED"
            m = {"phase": 1, "age": 0, "since": 0, "first": rsi, "retest": rsi, "e": {}, "span": span, "ended": None, "t": t}
            out.append(m)
            continue
        if m is None or m["phase"] in (0, 6):
            continue
        m["age"] += 1
        if m["age"] > rules["max_age"]:
            m["phase"], m["ended"] = 0, "EXPIRED"
            continue
        m["span"] = max(m["span"], span)
        cross = over(1, 3)
        if m["phase"] == 1:
            m["first"] = min(m["first"], rsi)
            if m["span"] < rules["expansion"]:
                continue
            if over(1, 2) and not cross:
                m["phase"], m["retest"] = 2, rsi
        elif m["phase"] == 2:
            if rsi <= ema and not cross:
                m["phase"], m["retest"] = 3, rsi
        elif m["phase"] == 3:
            if rsi <= ema:
                m["retest"] = min(m["retest"], rsi)
            if over(1, 2) and not cross:
                if m["retest"] >= m["first"] + rules["higher_low"]:
                    m.update(phase=4, since=0, entry=rsi)
                    m["e"][1] = t
                else:
                    m["phase"], m["ended"] = 0, "INVALID"
                continue
        elif m["phase"] == 4:
            m["since"] += 1
            if m["since"] >= rules["entry2_after"] and ema < rsi <= wma and rsi > m["entry"] and not cross:
                m["phase"] = 5
                m["e"][2] = t
        if cross:
            m["phase"], m["ended"] = 6, "COMPLETE"
            m["e"][3] = t
    return out


def test_fan_against_a_loop_over_bars(spark):
    """With a short and a longer life of trackers, so that each way to end occurs."""
    rng = np.random.default_rng(2)
    bars, ended, entries = {}, set(), set()
    for s in ("a", "b"):
        rsi = 50 + np.cumsum(rng.normal(0, 2, 600)) * 0.3 + rng.normal(0, 3, 600)
        ema, wma = (np.convolve(rsi, np.ones(n) / n)[:600] for n in (6, 15))
        bars[s] = [(START + k * HOUR, *(round(float(x[k]), 4) for x in (rsi, ema, wma))) for k in range(20, 600)]
    # one with all three entries
    lines = [(61, 60.5, 60), (59, 60.2, 60), (57, 59.5, 60), (55, 58, 60), (58.5, 57.5, 60), (56, 57, 60), (57.5, 57, 60), (58, 57.2, 60), (61, 58, 60)]
    bars["c"] = [(START + k * HOUR, *map(float, x)) for k, x in enumerate(lines)]
    df = spark.createDataFrame([(s, *b) for s, own in bars.items() for b in own], "symbol string, bar_ts timestamp, rsi double, ema double, wma double")
    for max_age in (20, 4):
        rules, want = recursions.FAN | {"spread": 8.0, "expansion": 3.0, "max_age": max_age, "higher_low": 0.2}, []
        for s, own in bars.items():
            for side, sign in (("LONG", 1), ("SHORT", -1)):
                want += [(s, side, m["t"], m["e"].get(1), m["e"].get(2), m["e"].get(3), m["ended"] or "OPEN", m["age"]) for m in walk_fan([(b[0], *(sign * x for x in b[1:])) for b in own], rules)]
        got = [(r.symbol, r.side, r.origin_ts, r.entry1, r.entry2, r.entry3, r.ended, r.age) for r in recursions.fan_trackers(df, seconds=16 * 3600, rules=rules).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        ended |= {w[6] for w in want}
        entries |= {k for w in want for k in (3, 4, 5) if w[k]}
    assert ended >= {"COMPLETE", "EXPIRED", "INVALID", "RESTARTED"} and entries == {3, 4, 5}


@pytest.mark.parametrize("narrow,in_wide", [(900, 16), (60, 3), (7200, 2)])
def test_tick_paths_against_all_ticks(spark, narrow, in_wide):
    rng = np.random.default_rng(3)
    price = 100 + np.cumsum(rng.normal(0, 0.4, 1500))
    times = np.sort(rng.integers(0, 5 * 86400, 1500))  # some ticks have the same time
    book = [("X", START + dt.timedelta(seconds=int(t)), i, float(p), float(p) + 0.2) for i, (t, p) in enumerate(zip(times, price))] + [("X", START, -1, 0.0, 0.0)]
    events = [(i, "X", ["LONG", "SHORT"][i % 2], START + dt.timedelta(seconds=int(t)), float(price[min(np.searchsorted(times, t), 1499)]), float(rng.uniform(0.2, 12))) for i, t in enumerate(rng.integers(0, 5 * 86400, 150))]
    events += [(900, "none", "LONG", START, 1.0, 1.0), (901, "X", "LONG", START + dt.timedelta(days=9), 1.0, 1.0), (902, "X", "LONG", START, 1.0, 0.0)]
    got = ticks.tick_paths(spark.createDataFrame(events, "id long, symbol string, side string, ts timestamp, entry double, risk double"), spark.createDataFrame(book, "symbol string, ts timestamp, n long, bid double, ask double"), 30, narrow, in_wide)
    got = {r.id: (r.first_hit, r.mfe_r, r.mae_r) for r in got.collect()}
    want = {}
    for i, s, side, at, entry, risk in events:
        if risk <= 0:
            continue
        hit, best, worst = "NONE", 0.0, 0.0
        for sym, t, _, bid, ask in book:
            if sym == s and bid > 0 and at < t <= at + 30 * HOUR:
                r = (bid - entry) / risk if side == "LONG" else (entry - ask) / risk
                best, worst = max(best, r), min(worst, r)
                if hit == "NONE" and abs(r) >= 1:
                    hit = "PLUS_1R" if r >= 1 else "MINUS_1R"
        want[i] = (hit, best, worst)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and np.allclose(got[i][1:], want[i][1:]) for i in want)
    assert {w[0] for w in want.values()} == {"NONE", "PLUS_1R", "MINUS_1R"}


def test_fingerprint_sees_values_and_nothing_else(spark):
    rows = [(i, None if i % 7 == 0 else i / 3, f"n{i % 5}") for i in range(300)] + [(1, 1 / 3, "n1")] * 50
    schema = "a long, b double, c string"
    of = lambda df: fingerprints.fingerprint(df, ["a", "b", "c"], "p").first()
    base = of(spark.createDataFrame(rows, schema))
    assert base.rows == 350
    assert of(spark.createDataFrame(rows[::-1], schema).repartition(7).select("c", "a", "b")) == base
    assert of(spark.createDataFrame([(a, None if b is None else b + 1e-14, c) for a, b, c in rows], schema)) == base  # beyond twelve places
    assert of(spark.createDataFrame([(0, -0.0, "x")], schema)).digest == of(spark.createDataFrame([(0, 0.0, "x")], schema)).digest
    for changed in ([*rows[:-1]], [*rows, rows[0]], [(a, b, "n9" if a == 8 else c) for a, b, c in rows], [(a, b or 0.0, c) for a, b, c in rows]):
        assert of(spark.createDataFrame(changed, schema)).digest != base.digest
    with pytest.raises(Exception, match="not finite"):
        of(spark.createDataFrame([(1, float("inf"), "x")], schema))
    parts = [fingerprints.fingerprint(spark.createDataFrame(rows, schema), ["a"], n) for n in ("p", "q")]
    whole = lambda ps, v: fingerprints.dataset(ps, v).where("part = 'dataset'").first().digest
    assert whole(parts, {"x": "1"}) == whole(parts[::-1], {"x": "1"}) != whole(parts, {"x": "2"})
    assert fingerprints.fingerprint(spark.createDataFrame([], schema), ["a"], "none").first().rows == 0


def test_payload_walk_to_any_depth(spark):
    deep = {"a": [1, {"b": {"c": [[{"mfe_r": 1}], "inf"]}}], "Future_X": {}, "ok": {"the_label": None, "labels2": 2}, "n": " NaN "}
    rows = [(1, json.dumps(deep)), (2, "{oops"), (3, None), (4, "[]"), (5, '{"x": {"outcome": 3}}'), (6, "7")]
    entries = fingerprints.json_entries(spark.createDataFrame(rows, "id long, js string"), "id", "js")
    got = sorted(tuple(r) for r in fingerprints.refused(entries, E.future_key(F.col("key"))).collect())
    assert got == [(1, "$.Future_X", "OUTCOME_KEY"), (1, "$.a[1].b.c[0][0].mfe_r", "OUTCOME_KEY"), (1, "$.a[1].b.c[1]", "NOT_FINITE"), (1, "$.n", "NOT_FINITE"), (1, "$.ok.the_label", "OUTCOME_KEY"), (5, "$.x.outcome", "OUTCOME_KEY")]


@pytest.mark.parametrize("n", [1, 9, 10, 11, 95, 203])
def test_bootstrap_against_whole_draws(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y = rng.integers(0, 2, n).astype(float)
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, x double, y double").repartition(3)
    out = bootstrap.bootstrap(df, "i", {"sx": F.col("x"), "n1": F.lit(1.0), "sxy": F.col("x") * F.col("y")}, F.col("sxy") / F.col("n1") + F.col("sx"), draws=60).first()
    drawn = {}
    for r in bootstrap.picks(df, n, 10, 60, 42).collect():
        drawn.setdefault(r.draw, []).extend([i for _ in range(r.times) for i in range(r.b * 10, r.b * 10 + r.k)])
    assert len(drawn) == 60 and all(len(v) == n for v in drawn.values())  # as many rows as there are, the last block cut
    stat = lambda at: float((x[at] * y[at]).mean() + x[at].sum())
    s = sorted(stat(np.asarray(v)) for v in drawn.values())
    assert np.allclose([out.estimate, out.lower, out.upper], [stat(np.arange(n)), s[int(0.025 * 59)], s[int(0.975 * 59)]]) and out["count"] == n


def test_frozen_index_is_not_changed_by_later_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similar, "HISTORY", 16)
    monkeypatch.setattr(similar, "QUERIES", 8)
    rng = np.random.default_rng(5)
    names = ["f1", "f2"]
    rows = [(i, i // 3, f"s{i % 2}", ["LONG", "SHORT"][i % 3 == 0], ["A", "B", "UNKNOWN"][i % 5 % 3], i % 13 == 0, None if i % 7 == 0 else i // 3 + int(rng.integers(0, 5)), i % 2 if i % 4 else None, float(i % 9), None if i % 11 == 0 else float(rng.normal()), float(round(rng.normal(), 1))) for i in range(400)]
    schema = "id long, ts long, symbol string, side string, regime string, conflict boolean, outcome_ts long, label int, expected double, f1 double, f2 double"
    df = spark.createDataFrame(rows, schema)
    later = spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows if r[1] > 80], schema)
    digest = similar.freeze(df, names, str(tmp_path / "i"), 80)
    assert digest == similar.freeze(df.unionByName(later).repartition(5), names, str(tmp_path / "j"), 80)
    got = {r.id: r for r in similar.neighbours(similar.frozen(spark, str(tmp_path / "i"), names), df, names, k=5).collect()}
    for q in rows:
        r = got[q[0]]
        past = [h for h in rows if h[1] <= 80 and not h[5] and h[1] < q[1]] if not q[5] else []
        symbol = [h for h in past if h[2] == q[2]]
        side = [h for h in symbol if h[3] == q[3]]
        regime = [h for h in side if q[4] == "UNKNOWN" or h[4] in (q[4], "UNKNOWN")]
        free = [h for h in regime if h[6] is not None and h[6] < q[1]]
        assert (r.past, r.same_symbol, r.compatible_side, r.compatible_regime, r.outcome_available) == tuple(map(len, (past, symbol, side, regime, free)))
        gap = lambda h: math.sqrt(np.mean([(a - b) ** 2 for a, b in zip(q[9:], h[9:]) if a is not None and b is not None]))  # noqa: E731, B023
        assert r.distance_eligible == len(free)  # f2 is always there
        assert [x.id for x in r.near] == [h[0] for h in sorted(free, key=lambda h: (gap(h), h[1], h[0]))[:5]]
    spark.createDataFrame([(1, 2)], "a long, b long").write.mode("overwrite").parquet(str(tmp_path / "other"))
    rows_ = spark.read.parquet(str(tmp_path / "i/rows")).withColumn("f2", F.col("f2") + 1)
    rows_.write.parquet(str(tmp_path / "k/rows"))
    for n in ("bounds", "fingerprint"):
        spark.read.parquet(str(tmp_path / f"i/{n}")).write.parquet(str(tmp_path / f"k/{n}"))
    with pytest.raises(ValueError, match="frozen"):
        similar.frozen(spark, str(tmp_path / "k"), names)


def test_regimes_without_thresholds(spark):
    schema = "id long, feature_status string, source_regime string, composite_regime_score double, price_z20 double, price_abs_z20 double, d1_bias string, h4_bias string, h1_bias string, atr_percent double, return_std_20 double, spread_r double"
    rows = [(1, None, "up", None, None, None, None, None, None, 1.0, None, 1.0), (2, None, None, None, 5.0, None, "UP", "BEAR", "odd", None, 1.0, float("inf")), (3, None, None, None, None, None, "UP", "RANGE", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    none = regimes.fit_regimes(df.limit(0))
    got = {r.id: (r.trend, r.volatility, r.liquidity, r.composite, r.confidence) for r in regimes.assign_regimes(df, none).collect()}
    assert got == {1: ("TRENDING", "UNKNOWN", "UNKNOWN", "UNKNOWN", "LOW"), 2: ("TRENDING", "UNKNOWN", "UNKNOWN", "UNKNOWN", "LOW"), 3: ("UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "LOW")}


def test_buckets_have_no_name_for_what_is_no_number(spark):
    x = spark.createDataFrame([(None,), (float("nan"),), (0.8,), (1.25,), (1.26,)], "x double").select(buckets.bucket(F.col("x"), buckets.STD_RATIO)).collect()
    assert [r[0] for r in x] == [None, None, "normal_0p80_1p25", "normal_0p80_1p25", "expansion_gt_1p25"]


def test_medians_of_many_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i % 3), None if rng.random() < 0.2 else float(rng.integers(0, 6)), float(rng.normal())) for i in range(200)] + [(9, None, 1.0)]
    got = {r.g: (r.a, r.b) for r in features.medians(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], {"a": "a", "b": F.col("b") * 2}).collect()}
    for g in {r[0] for r in rows}:
        a, b = ([r[k] for r in rows if r[0] == g and r[k] is not None] for k in (1, 2))
        assert (got[g][0] is None if not a else math.isclose(got[g][0], np.median(a))) and math.isclose(got[g][1], 2 * np.median(b))


def test_event_sources(spark, tmp_path):
    at = int(dt.datetime(2024, 3, 1, 10, tzinfo=dt.timezone.utc).timestamp())
    head = ",".join(S.BLOCKED_FIELDS)
    line = lambda event, time, kind: ",".join({"event_id": event, "event_time": time, "event_type": kind, "side": "buy"}.get(c, "0") for c in S.BLOCKED_FIELDS)
    (tmp_path / "v82.csv").write_text("﻿" + "\n".join([head, line(f"{at}_1", "2024.03.01 12:00", "blocked_opposite"), line(f"{at + 1}_2", "2024.03.01 12:00", "LONG_ONLY"), line("x_3", "2024.03.01 12:00", "LONG_ONLY"), line(f"{at}_4", "2024.03.01 12:00", "WHAT"), line("", "2024.03.01 12:00", "LONG_ONLY"), line(f"{at}_6", "", "LONG_ONLY")]) + "\n")
    good, bad = S.read_events(spark, str(tmp_path / "v82.csv"), S.BLOCKED, zone="Etc/GMT-2")
    assert [(r.event_id, r.event_type, r.side, r.audit) for r in good.collect()] == [(f"{at}_1", "BLOCKED_SIGNAL", "LONG", "V82")]
    assert good.select(F.unix_seconds("ts")).first()[0] == at
    assert sorted(r.reason for r in bad.collect()) == ["BAD_TIME", "MISSING_EPOCH", "MISSING_ID", "MISSING_TIME", "UNSUPPORTED_TYPE"]
    strict, _ = S.read_events(spark, str(tmp_path / "v82.csv"), S.BLOCKED, strict=True)
    with pytest.raises(Exception, match="BAD_TIME|MISSING|UNSUPPORTED"):
        strict.collect()
    (tmp_path / "short.csv").write_text("event_id,event_time\n1,2\n")
    with pytest.raises(ValueError, match="event_type"):
        S.read_events(spark, str(tmp_path / "short.csv"), S.TELEMETRY)
    assert S.source_of(list(S.STDDEV_FIELDS)) is S.STDDEV and S.source_of(list(S.TELEMETRY_FIELDS)) is S.TELEMETRY and S.source_of(["a"]) is None


def test_vectors_know_the_training_rows_only(spark):
    from opplens.operators.vectors import fit_vectors

    schema = "id long, a double, b double, c string"
    train = spark.createDataFrame([(1, 1.0, 5.0, " x "), (2, 3.0, 5.0, "Y"), (3, None, 5.0, ""), (4, float("inf"), None, None), (5, 8.0, 5.0, "x")], schema)
    model = fit_vectors(train, ["a", "b"], ["c"], imputation="median", z_limit=1.5)
    assert model.names == ["a", "a__missing", "b", "b__missing", "c=X", "c=Y", "c__missing"]
    rows = spark.createDataFrame([(1, None, 6.0, "y"), (2, 20.0, None, "new"), (3, None, None, None)], schema)
    got = {r.id: r for r in model.transform(rows).collect()}
    std = float(np.std([1, 3, 8]))
    assert np.allclose(got[1].vector, [(3 - 4) / std, 1, 1, 0, 0, 1, 0]) and np.allclose(got[2].vector, [16 / std, 0, 0, 1, 0, 0, 1])
    assert got[1].reasons == [] and got[2].reasons == ["a:far", "c:unseen_category"] and (got[3].completeness, got[3].ood_score) == (0.0, 0.0)
    again = {r.id: r.snapshot for r in model.transform(rows.repartition(3)).collect()}
    assert again == {i: r.snapshot for i, r in got.items()} and len(set(again.values())) == 3
    empty = fit_vectors(train.limit(0), ["a"], ["c"])
    r = empty.transform(rows).where("id = 2").first()
    assert r.vector == [20.0, 0.0, 1.0] and r.reasons == ["a:unseen", "c:unseen_category"]


def test_blocked_events_keep_an_identity_once(spark):
    from opplens.operators import signals

    rows = [("s", START + k * HOUR, *x) for k, x in enumerate([(True, None, None, "g"), (True, True, None, "g"), (True, True, "LONG", "g"), (False, False, "LONG", "g"), (True, True, "LONG", None), (None, False, None, "g"), (False, True, None, "g")])]
    rows += [("t", START, True, False, None, "g")]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp, long boolean, short boolean, held string, group string")
    got = [(r.bar_ts, r.side, r.event_type) for r in signals.blocked_events(df, 2 * 3600).orderBy("bar_ts", "side").collect()]
    at = lambda k: START + k * HOUR
    assert got == [(at(0), "LONG", "LONG_ONLY"), (at(1), "SHORT", "SIMULTANEOUS_CONFLICT"), (at(4), "LONG", "BLOCKED_SAME_SIDE"), (at(4), "SHORT", "BLOCKED_OPPOSITE"), (at(6), "SHORT", "SHORT_ONLY")]
    runs = signals.with_runs(df.where("symbol = 's'"), "long", 2 * 3600)
    assert sorted((r.bar_ts, r.repeat_bars) for r in runs.collect()) == [(at(0), 2), (at(4), 0)]


def test_fingerprints_take_whole_numbers_as_sql_does(spark, tmp_path):
    import duckdb

    from opplens.plans import registry

    odd = [0.1 + 0.2, 1e7, 123456789.25, 2e-3, 1e-4, 5e-324, 1e16, 1.5e300, -0.0, 2.0 / 3, 2.2e-322, 1e23, 2e23, None]
    con = duckdb.connect()
    for name, key in (("customer", "c"), ("supplier", "s")):
        spark.createDataFrame([(i, f"n{i}", v) for i, v in enumerate(odd)], f"{key}_{'cust' if key == 'c' else 'supp'}key long, {key}_name string, {key}_acctbal double").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert tuple(registry.QUERIES["d3_bundle"](spark, str(tmp_path)).first()) == con.execute(registry.ORACLE_SQL["d3_bundle"]).fetchone()


def test_dataset_of_odd_numbers_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from opplens.plans import registry

    con = duckdb.connect()
    for name, columns in {"customer": ("c_custkey", "c_name", "c_acctbal"), "supplier": ("s_suppkey", "s_name", "s_acctbal")}.items():
        spark.createDataFrame([(i, f"n{i}", v) for i, v in enumerate((1 / 3, 1e7, 2e-3, -0.0, None))], "{} long, {} string, {} double".format(*columns)).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, 2, "O"), (2, None, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("customer", "supplier", "orders"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(tuple(r) for r in registry.QUERIES["c4_c5_dataset"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.ORACLE_SQL["c4_c5_dataset"]).fetchall())


def test_hashes_of_picks_are_those_of_md5():
    import hashlib

    at = np.array([0, 1, 9, 10, 99, 100, 12345, 999999, 1000000, 4096, 10**12 + 7])
    for prefix in ("42:7:", "42:999:", "1234567890:123456789012345:"):
        assert bootstrap.hashes(prefix, at).tolist() == [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in at]


def test_bootstrap_meets_no_picks_as_rows(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "PART", 8)
    monkeypatch.setattr(bootstrap, "STRETCH", 7)
    monkeypatch.setattr(bootstrap, "PACKED", 50)
    monkeypatch.setattr(bootstrap, "picks", None)  # the plain definition is for small tables
    test_bootstrap_of = spark.range(1003).select("id", (F.col("id") % 17).cast("double").alias("v"))
    out = bootstrap.bootstrap(test_bootstrap_of, "id", {"s": F.col("v"), "n1": F.lit(1.0)}, F.col("s") / F.col("n1"), draws=40).first()
    monkeypatch.undo()
    drawn = bootstrap.picks(test_bootstrap_of, 1003, 10, 40, 42).collect()
    sums = {}
    for r in drawn:
        sums[r.draw] = sums.get(r.draw, 0) + r.times * sum(i % 17 for i in range(r.b * 10, r.b * 10 + r.k))
    s = sorted(v / 1003 for v in sums.values())
    assert np.allclose([out.lower, out.upper], [s[int(0.025 * 39)], s[int(0.975 * 39)]]) and out.blocks == 101


def test_tick_paths_where_all_ticks_share_a_few_minutes(spark):
    rng = np.random.default_rng(6)
    price = np.round(100 + np.cumsum(rng.normal(0, 0.3, 2000)), 2)
    at = [START + dt.timedelta(milliseconds=100 * (i // 3)) for i in range(2000)]  # three ticks of a time
    book = spark.createDataFrame([("X", t, i, float(p), float(p) + 0.25) for i, (t, p) in enumerate(zip(at, price))], "symbol string, ts timestamp, n long, bid double, ask double")
    rows = [(i, "X", ["LONG", "SHORT"][i % 2], at[i], float(price[i]) + 0.25 * (i % 2 == 0), float(rng.uniform(0.2, 9))) for i in range(0, 2000, 7)]
    found = ticks.tick_paths(spark.createDataFrame(rows, "id long, symbol string, side string, ts timestamp, entry double, risk double"), book, 1, chunk=64, visits=50)
    for r in found.collect():
        entry, risk = rows[r.id // 7][4:]
        later = [(p - entry) / risk if r.side == "LONG" else (entry - p - 0.25) / risk for t, p in zip(at, price.tolist()) if t > at[r.id]]
        first = next((x for x in later if abs(x) >= 1), 0)
        assert r.first_hit == ("NONE" if not first else "PLUS_1R" if first > 0 else "MINUS_1R")
        assert np.allclose([r.mfe_r, r.mae_r], [max([0, *later]), min([0, *later])])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["j9_d4_history", "j2_j4_o2_named_queries"])
def test_episodes_are_made_once(spark, name):
    from opplens.plans import registry

    assert _plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001")).count("Relation [") == 1


def test_least_canonical_is_told_by_the_fields_of_the_identity(spark):
    from opplens.plans import registry

    assert "__entry" in _plan(registry.QUERIES["j19_least_canonical"](spark, "/root/testdata/sf0.001"))


def test_canonical_view_deals_rows_and_not_states(spark):
    from opplens.plans import registry

    assert "RepartitionByExpression" in _plan(registry.QUERIES["c2_a26_canonical_view"](spark, "/root/testdata/sf0.001"))


def test_quantiles_count_their_rows_once_and_order_few(spark):
    x = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5003).cast("double").alias("v"))
    found = features.exact_quantiles(x, "v", {"a": ("linear", 0.5), "b": ("nearest", 0.95), "c": ("lower", 0.025)}, ["g"])
    assert "Range (" not in _plan(found)  # what the values are made of is not made again
    for r in found.collect():
        v = sorted(i * 7 % 5003 for i in range(5000) if i % 3 == r.g)
        assert math.isclose(r.a, np.median(v)) and r.b == v[math.ceil(len(v) * 0.95) - 1] and r.c == v[int((len(v) - 1) * 0.025)]
