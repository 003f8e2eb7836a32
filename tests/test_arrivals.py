"""Keyed streams over several starts from one checkpoint, against the same operators over tables and plain rules."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from opplens.operators import arrivals
from opplens.streaming import events, keyed

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=float(minutes))


def drain(make, tmp_path, name):
    """What the query over all files that have landed gives, after one more start."""
    q = make().writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-check")
    q.trigger(availableNow=True).start().awaitTermination(180)


def land(spark, rows, schema, tmp_path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")


def test_gate_over_two_starts(spark, tmp_path):
    rng = np.random.default_rng(4)
    schema = "n long, run string, ts timestamp, received timestamp, kind string"
    rows = [(i, f"r{i % 2}", at(i + int(rng.integers(-20, 20))), at(i), ["DIAGNOSTIC", "OPPORTUNITY"][i % 3 == 0]) for i in range(60)]
    make = lambda: keyed.gate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "run", "ts", "received", "n", "kind", oldest_ms=15 * 60_000)
    for part in (rows[:25], rows[25:40], rows[40:]):
        land(spark, part, schema, tmp_path, "in")
        drain(make, tmp_path, "gate")
    got = {r.n: r.reason for r in spark.read.parquet(f"{tmp_path}/gate-out").collect()}
    high, want = {}, {}
    for n, run, ts, received, kind in rows:
        why = "EVENT_TIMESTAMP_IN_FUTURE" if ts > received + dt.timedelta(seconds=5) else "EVENT_TOO_OLD" if received - ts > dt.timedelta(minutes=15) else None
        if why is None and kind == "DIAGNOSTIC" and run in high and ts < high[run]:
            why = "OUT_OF_ORDER_EVENT"
        if why is None:
            high[run] = max(ts, high.get(run, ts))
        want[n] = why
    assert got == want and len(set(want.values())) == 4
    assert any(want[n] is None and ts < max(t for m, r, t, _, _ in rows if m < n and r == run and want[m] is None) for n, run, ts, _, kind in rows[4:] if kind == "OPPORTUNITY")
    table = arrivals.gate(spark.createDataFrame(rows, schema), "run", "ts", "received", "n", "kind", oldest="15 minutes", stretch=7)
    assert {r.n: r.reason for r in table.collect()} == want


def test_gate_forgets_a_run(spark, tmp_path):
    schema = "n long, run string, ts timestamp, received timestamp, kind string"
    make = lambda: keyed.gate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "run", "ts", "received", "n", "kind", forget_ms=60_000, late="1 minute")
    for part in ([(1, "a", at(10), at(10), "DIAGNOSTIC")], [(2, "b", at(100), at(100), "DIAGNOSTIC")], [(3, "a", at(9), at(100), "DIAGNOSTIC"), (4, "b", at(99), at(101), "DIAGNOSTIC")]):
        land(spark, part, schema, tmp_path, "in")
        drain(make, tmp_path, "gate")
    assert {r.n: r.reason for r in spark.read.parquet(f"{tmp_path}/gate-out").collect()} == {1: None, 2: None, 3: None, 4: "OUT_OF_ORDER_EVENT"}


def test_collapse_over_two_starts(spark, tmp_path):
    rng = np.random.default_rng(5)
    schema = "n long, canonical string, source string, received timestamp, reason string, valid boolean"
    rows = [(i, f"c{int(rng.integers(0, 5))}", f"s{int(rng.integers(0, 25))}", at(i), "EVENT_TOO_OLD" if rng.random() < 0.4 else None, bool(rng.random() < 0.8)) for i in range(80)]
    make = lambda: keyed.collapse(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["canonical"], "source", "received", "n", "reason", "valid")
    for part in (rows[:30], rows[30:]):
        land(spark, part, schema, tmp_path, "in")
        drain(make, tmp_path, "collapse")
    columns = ("n", "status", "representative", "observations", "duplicates")
    got = sorted(tuple(r[c] for c in columns) for r in spark.read.parquet(f"{tmp_path}/collapse-out").collect())
    first, count, seen, want = {}, {}, set(), []
    for n, key, source, _, reason, valid in rows:
        if (key, source) in seen:
            status = "REJECTED_DUPLICATE"
        elif key in first:
            status, count[key] = "DUPLICATE_COLLAPSED", count[key] + 1
        elif reason:
            status = "REJECTED_STALE"
        else:
            status, first[key], count[key] = "ACCEPTED" if valid else "INVALID", source, 1
        if status != "REJECTED_STALE":
            seen.add((key, source))
        want.append((n, status, first.get(key), count.get(key, 0), max(count.get(key, 0) - 1, 0)))
    assert got == want and len({w[1] for w in want}) >= 4
    table = arrivals.collapse(spark.createDataFrame(rows, schema), ["canonical"], "source", ["n"], "reason", "valid")
    assert sorted(tuple(r[c] for c in columns) for r in table.collect()) == want


def test_outcomes_once_as_a_stream_and_as_a_table(spark, tmp_path):
    rng = np.random.default_rng(6)
    asked = "id string, symbol string, side string, event_ts timestamp, committed timestamp, entry double, risk double"
    given = "symbol string, bar_ts timestamp, h double, l double, c double"
    price = np.cumsum(rng.normal(0, 1, 160)) + 100
    bars = [("X", at(60 * k), float(price[k] + 1), float(price[k] - 1), float(price[k])) for k in range(160) if k % 17]
    bars += [("Y", at(60 * k), 5.0, 4.0, 4.5) for k in range(3)]
    ask = lambda i, s, hour, gap, risk: (i, s, ["LONG", "SHORT"][len(i) % 2], at(60 * hour), at(60 * hour + gap), float(price[hour]) if s == "X" else 4.5, risk)
    predictions = [ask(f"p{k}", "X", 3 * k, int(rng.integers(0, 90)), float(rng.uniform(1, 9))) for k in range(26)] + [ask("far", "X", 10, 0, 500.0), ask("y", "Y", 0, 30, 9.0), ask("after", "Y", 0, 300, 1.0), ask("none", "Z", 0, 0, 1.0)]

    def make():
        p, b = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for s, n in ((asked, "p"), (given, "b")))
        return keyed.outcomes(p, b, lanes=2)

    # the second file's bars are not in order, one comes again, and predictions come after bars that they wait for
    cut = lambda rows, time, lo, hi: [r for r in rows if lo <= (r[time] - DAY).total_seconds() / 3600 < hi]
    for lo, hi in ((0, 40), (40, 100), (100, 10_000)):
        part = cut(bars, 1, lo, hi)
        land(spark, [*part[::-1], *part[:1]], given, tmp_path, "b")
        land(spark, cut(predictions, 4, lo, hi) or predictions[:0], asked, tmp_path, "p")
        drain(make, tmp_path, "o")
    land(spark, [("end", at(60 * 1000), 1.0, 1.0, 1.0)], given, tmp_path, "b")  # time goes on, and what is open times out
    drain(make, tmp_path, "o")
    columns = [c.split(" ")[0] for c in keyed.OUTCOME.split(", ")]
    tidy = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)
    got = tidy(spark.read.parquet(f"{tmp_path}/o-out"))
    assert len(got) == len(predictions) == len({r[0] for r in got})
    want = tidy(arrivals.outcomes(spark.createDataFrame(predictions, asked), spark.createDataFrame(bars, given)))
    assert got == want
    states = {r[0]: (r[2], r[4]) for r in got}
    assert states["far"] == ("INCOMPLETE", "NO_FIRST_HIT") and states["none"] == ("INCOMPLETE", "NO_FUTURE_BARS") and states["after"] == ("INVALID", "PREDICTION_AFTER_OUTCOME")
    assert {s for s, _ in states.values()} == {"RESOLVED", "INCOMPLETE", "INVALID"}


def test_missed_regions_and_late_rows_are_kept_once(spark, tmp_path):
    seen = spark.createDataFrame([("a", 0, 10), ("a", 5, 20), ("a", 30, 30), ("a", 35, 90), ("b", 2, 4)], "s string, lo long, hi long")
    sizes = spark.createDataFrame([("a", 50), ("b", 4), ("c", 3), ("d", 0)], "s string, n long")
    gaps = arrivals.missed_regions(seen, sizes, "s", "lo", "hi", "n")
    assert sorted(map(tuple, gaps.collect())) == [("a", 20, 35), ("b", 0, 2), ("c", 0, 3)]
    lines = spark.createDataFrame([("a", o, f"k{o % 3}", o) for o in range(0, 50, 4)] + [("c", 0, "k9", -1), ("c", 1, "k8", 1)], "s string, o long, k string, v long")
    out = arrivals.recover(lines, gaps, spark.createDataFrame([("k2",)], "k string"), "s", "o", ["k"], F.col("v") >= 0, F.col("v") < 5, width=8)
    assert sorted(map(tuple, out.select("s", "o", "outcome").collect())) == [("a", 20, "ALREADY_KNOWN"), ("a", 24, "RECORDED"), ("a", 28, "RECORDED"), ("a", 32, "ALREADY_KNOWN"), ("c", 0, "INVALID"), ("c", 1, "BEFORE_START")]


def test_late_repeats_are_rejected(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text('{"id": "a", "ts": "2023-12-31T00:00:00"}\n')
        raw = events.judged(events.lines(spark, str(tmp_path / "in")), "id string, ts timestamp", {"BAD": F.col("id").isNotNull()})
        events.collect_events(raw, ["id"], "ts", f"{tmp_path}/out", f"{tmp_path}/check", start="2024-01-01", availableNow=True).awaitTermination(90)
    assert spark.read.parquet(f"{tmp_path}/out/late").count() == 1
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()] == ["DUPLICATE"]
