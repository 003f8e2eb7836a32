"""Sources and sinks over small files, streams run to their end, and models against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from opplens.functions.rules import all_reasons, first_reason
from opplens.operators import models
from opplens.operators.features import running_before
from opplens.sources import files
from opplens.streaming import events

SCHEMA = "id string, ts timestamp, value double"


def test_csv_with_bom_missing_columns_and_bad_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,n,ok\n1, 2.5 ,yes\n2,,\n3,inf,maybe\n".encode())
    df = files.normalise_fields(files.read_csv(spark, str(tmp_path / "a.csv"), ("id", "n")), ("n",), ("ok",))
    assert sorted(map(tuple, df.select("id", "n", "ok", "bad_fields").collect())) == [("1", 2.5, True, []), ("2", None, None, []), ("3", None, None, ["n", "ok"])]
    with pytest.raises(ValueError, match="gone"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ("gone",))


def test_presets_json_and_inventory(spark, tmp_path):
    (tmp_path / "a.set").write_text("# note\nRisk=0.5\nOn=true\nRisk=1\nUrl=a=b\n")
    (tmp_path / "b.set").write_text("# note\nRisk=0.5\nOn=true\nRisk=1\nUrl=a=b\n")
    got = files.read_presets(spark, str(tmp_path / "a.set")).select("key", "value", "number", "flag", "duplicate").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("Risk", "0.5", 0.5, None, True), ("Risk", "1", 1.0, True, True), ("On", "true", None, True, False), ("Url", "a=b", None, None, False)], key=str)
    rows = files.inventory(spark, str(tmp_path)).sort("path").collect()
    assert [(r["size"], r["lines"], r["duplicate"]) for r in rows] == [(39, 5, False), (39, 5, True)]
    good, bad = files.parse_json(spark.createDataFrame([('{"id": "a"}',), ("{oops",)], "value string"), "id string, n int")
    assert good.collect() == [("a", None)] and bad.collect() == [("{oops",)]


def test_html_tables_and_labels(spark):
    page = "<title> My\n page</title><table><tr><th>Net profit:</th><td> 12  <b>34</b></td></tr><tr><td>x</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    t = files.html_tables(df, "id")
    assert sorted(map(tuple, t.collect())) == [(1, 0, ["Net profit:", "12 34"]), (1, 1, ["x"])]
    assert files.labelled_values(t, "id").collect() == [(1, "Net profit", "12 34")]
    assert df.where("id = 1").select(files.title(F.col("html"))).first()[0] == "My page"


def test_replace_version_leaves_other_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_version(spark.createDataFrame([(1, "a"), (2, "b")], "n int, version string"), path, "version")
    files.replace_version(spark.createDataFrame([(3, "b")], "n int, version string"), path, "version")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (3, "b")]


def test_rules_take_null_as_broken(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "n int")
    rules = {"POSITIVE": F.col("n") > 0, "SMALL": F.col("n") < 5}
    assert [tuple(r) for r in df.select(first_reason(rules), all_reasons(rules)).collect()] == [(None, []), ("POSITIVE", ["POSITIVE"]), ("POSITIVE", ["POSITIVE", "SMALL"])]


def put(folder, name, *rows):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_stream_keeps_every_record_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    row = lambda i, t="2024-01-02T00:00:00", v=1.0: {"id": i, "ts": t, "value": v}

    def run():
        raw = events.judged(events.lines(spark, str(src)), SCHEMA, {"BAD_JSON": F.col("id").isNotNull(), "NO_TIME": F.col("ts").isNotNull(), "NEGATIVE": F.col("value") >= 0})
        events.collect_events(raw, ["id"], "ts", out, str(tmp_path / "check"), start="2024-01-01", availableNow=True).awaitTermination(90)

    put(src, "1.json", row("a"), row("b", v=-1), "{oops", row("a", "2024-01-03T00:00:00"), row("c", "2023-12-31T00:00:00"))
    run()
    put(src, "2.json", row("a"), row("d"))
    run()
    read = lambda name, c: sorted(r[0] for r in spark.read.parquet(f"{out}/{name}").select(c).collect())
    assert read("accepted", "id") == ["a", "d"]
    assert read("late", "id") == ["c"]
    assert read("rejected", "reason") == ["BAD_JSON", "DUPLICATE", "DUPLICATE", "NEGATIVE"]


def test_stream_bars_close_after_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "1.json", *[{"s": "x", "ts": f"2024-01-01T0{h}:30:00", "p": float(h), "n": h} for h in range(4)])
    ticks = spark.readStream.schema("s string, ts timestamp, p double, n long").json(str(src))
    bars = events.stream_bars(ticks, "1 hour", "30 minutes", "s", "ts", "p", "n")
    q = bars.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["o"], r["vol"]) for r in spark.table("bars").collect()) == [(0.0, 1), (1.0, 1), (2.0, 1)]


def test_models_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2)).round(3)
    y = (x @ [1.0, -2.0] + rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)] + [(None, 1.0, 1)], "a double, b double, y int")
    want = np.array([np.log(y.mean() / (1 - y.mean())), 0, 0])  # the fit starts at the logit of the mean label
    full = np.hstack([np.ones((200, 1)), x])
    for _ in range(5):
        slope = full.T @ (1 / (1 + np.exp(-full @ want)) - y) / 200
        slope[1:] += want[1:]  # the penalty is not divided by the rows
        want = want - 0.05 * slope
    assert np.allclose(models.fit_logistic(df, ["a", "b"], "y", steps=5), want)
    penalty = np.diag([0.0, 1.0, 1.0])
    assert np.allclose(models.fit_ridge(df, ["a", "b"], "y"), np.linalg.solve(full.T @ full + penalty, full.T @ y))
    assert models.fit_logistic(df.where("y = 1"), ["a", "b"], "y", steps=1)[0] > 3
    assert not models.fit_logistic(df.where("y = 7"), ["a", "b"], "y", steps=1).any()


def test_running_sum_by_buckets_is_exact(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v"))
    got = running_before(df, "k", "v", "t", buckets=7).sort("k").collect()
    total = 0
    for r in got:
        assert r["t"] == total
        total += r["v"]
    assert running_before(df.limit(0), "k", "v", "t").count() == 0


def test_more_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x;y\n1;2\n")
    (tmp_path / "b.csv").write_text("x\tz\n3\t4\n")
    both = files.sniffed_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ("x",))
    assert sorted(map(tuple, both.select("x", "y", "z").collect()), key=str) == [("1", "2", None), ("3", None, "4")]
    with pytest.raises(ValueError):
        files.sniffed_csv(spark, [str(tmp_path / "a.csv")], ("q",))
    (tmp_path / "s.json").write_text('{"b": {"c": 1},\n "a": 2}')
    assert files.json_keys(spark, str(tmp_path / "s.json")).first().keys == ["a", "b"]
    html = "<title>A &amp; B&#233; &lt;x&gt;</title><table><tr><td>Deals</td></tr><tr><th>Time</th><th>Deal</th><th>Type</th><th>Direction</th><th>Volume</th><th>Price</th><th>Profit</th><th>Balance</th></tr><tr><td>t1</td><td>1</td><td>buy</td><td>in</td><td>0.10</td><td>16 516.65</td><td>0</td><td>1 000.00</td></tr><tr><td>t2</td><td>2</td><td>balance</td><td></td><td></td><td></td><td></td><td></td></tr><tr><td>t3</td><td>3</td><td>sell</td><td>out by</td><td>0.10</td><td>x</td><td>-2.5</td><td>997.50</td></tr></table>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert pages.select(files.title(F.col("html"))).first()[0] == "A & Bé <x>"
    got = files.deals(files.html_tables(pages, "page_id"), "page_id").orderBy("row").collect()
    assert [(r.time, r.deal, r.price, r.balance) for r in got] == [("t1", 1.0, 16516.65, 1000.0), ("t3", 3.0, None, 997.5)]
    kept = files.snapshot(spark, str(tmp_path), "*.csv", str(tmp_path / "manifest"), "t1")
    files.snapshot(spark, str(tmp_path), "a.csv", str(tmp_path / "manifest"), "t2")
    assert kept.count() == 2 and spark.read.parquet(str(tmp_path / "manifest")).count() == 3
    rows = spark.createDataFrame([(2, "x|y")], "b long, a string")
    assert files.report_lines(rows).first()[0] == '{"a":"x|y","b":2}'
    assert files.markdown(rows).splitlines()[-1] == "| 2 | x\\|y |"
    with pytest.raises(ValueError):
        files.markdown(rows.union(rows), 1)


def test_streams_with_bounded_state(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spark.createDataFrame([("a", "X", at(0)), ("a", "X", at(1)), ("b", "X", at(2))], "id string, symbol string, committed timestamp").coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("X", at(1), 1.0), ("X", at(3), 2.0), ("X", at(9), 3.0), ("Y", at(1), 4.0)], "symbol string, bar_ts timestamp, c double").coalesce(1).write.parquet(str(tmp_path / "b"))
    read = lambda n, s: spark.readStream.schema(s).parquet(str(tmp_path / n))
    p = events.first_of_key(read("p", "id string, symbol string, committed timestamp"), ["id"], "committed", "6 hours")
    met = events.attach_outcomes(p, read("b", "symbol string, bar_ts timestamp, c double"), "4 hours", "6 hours")
    weighed = events.scored(met, [0.0, 1.0], ["c"], spark.createDataFrame([("X", 0.5)], "symbol string, prior double"), ["symbol"])
    weighed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out = sorted((r.id, r.c, r.prior, round(r.probability, 4)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [("a", 1.0, 0.5, 0.7311), ("a", 2.0, 0.5, 0.8808), ("b", 2.0, 0.5, 0.8808)]


def test_one_class_and_edges(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 1)], "a double, y int")
    assert np.allclose(models.fit_logistic(df, ["a"], "y"), [models.logit(1.0), 0])
    assert models.fit_platt(df.limit(0), "a", "y").tolist() == [0.0, 1.0]
    assert models.edge_status(30, 0.2, 0.25, 0.6, 0.01) == "DEMONSTRATED" and models.edge_status(5, 0.2, 0.25, 0.6, 0.01) == "INSUFFICIENT_DATA"
