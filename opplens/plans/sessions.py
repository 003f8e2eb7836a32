"""Queries over positions, sizing, sessions, journals, gates and forward evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opplens.operators import bars as B
from opplens.operators import episodes as E
from opplens.operators import positions as P
from opplens.operators import study as Y

from .episodes import _S, SIGNALS, made
from .registry import BARS, STUDY, hourly, query, rounded, table


@query("""WITH x AS (SELECT o_orderkey, o_totalprice * 0.5 AS equity, CASE o_orderkey % 6 WHEN 0 THEN 1.5e0 ELSE 0.5e0 END AS mult, (o_custkey % 40) / 8e0 AS distance, CASE WHEN o_orderkey % 17 = 0 THEN 0e0 ELSE 0.25e0 END AS tick FROM orders),
p AS (SELECT *, equity * 0.75e0 / 100e0 * mult AS desired, CASE WHEN tick <> 0 THEN distance / tick * 0.5e0 END AS per_lot FROM x), r AS (SELECT *, CASE WHEN per_lot <> 0 THEN desired / per_lot END AS raw FROM p), f AS (SELECT *, round(least(50e0, floor(raw / 0.125e0) * 0.125e0), 2) AS floored FROM r),
w AS (SELECT *, CASE WHEN NOT (mult > 0 AND mult <= 1) THEN 'invalid_risk_multiplier' WHEN NOT tick > 0 THEN 'invalid_symbol_specs' WHEN NOT coalesce(per_lot > 0, false) THEN 'invalid_risk_per_lot' WHEN NOT raw >= 0.125e0 THEN 'raw_lot_below_min_lot' WHEN NOT floored >= 0.125e0 THEN 'normalized_lot_below_min_lot' WHEN NOT per_lot * floored <= desired + 0.01 THEN 'actual_risk_exceeds_desired' END AS reason FROM f)
SELECT coalesce(reason, 'OK') AS reason, count(*) AS n, round(sum(CASE WHEN reason IN ('invalid_risk_multiplier', 'invalid_symbol_specs', 'invalid_risk_per_lot') THEN 0 WHEN reason = 'raw_lot_below_min_lot' THEN 0.125e0 ELSE floored END), 2) AS lots FROM w GROUP BY 1""")
def q13_sizing(spark, d):
    """Lots for a share of equity at risk, floored to the volume step, with the first reason to refuse."""
    x = table(spark, d, "orders").select((F.col("o_totalprice") * 0.5).alias("equity"), F.when(F.col("o_orderkey") % 6 == 0, 1.5).otherwise(0.5).alias("mult"), ((F.col("o_custkey") % 40) / 8).alias("distance"), F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(0.25).alias("tick"))
    plan = P.sizing(F.col("equity"), F.lit(0.75), F.col("mult"), F.nullif(F.col("distance"), F.lit(0.0)), F.col("tick"), F.lit(0.5), F.lit(0.125), F.lit(50.0), F.lit(0.125))
    return x.select(plan.alias("p")).groupBy(F.coalesce("p.reason", F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p.lots"), 2).alias("lots"))


@query("""WITH x AS (SELECT l_suppkey AS g, l_quantity * 0.01 AS realised, CASE WHEN l_returnflag = 'A' THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS entry, l_linenumber % 3 AS v FROM lineitem)
SELECT g, count(*) AS legs, CASE WHEN count(*) FILTER (entry IS NULL AND v <> 0) = 0 THEN round(sum(realised) + coalesce(sum(CASE WHEN side = 'LONG' THEN 900 - entry ELSE entry - 900 END * v), 0), 2) END AS value FROM x GROUP BY 1""")
def w38_w39_group_value(spark, d):
    """What each group of positions is worth at a stop price: realised plus open legs, unknown if a leg is."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_quantity") * 0.01).alias("realised"), F.when(F.col("l_returnflag") == "A", "LONG").otherwise("SHORT").alias("side"), F.when(F.col("l_orderkey") % 997 > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"), (F.col("l_linenumber") % 3).alias("v"))
    return rounded(P.group_values(x, "g", F.lit(900.0), F.col("realised"), F.col("side"), F.col("entry"), F.col("v")), "value", places=2)


@query(f"""WITH {BARS}, x AS (SELECT *, lag(c) OVER w AS p, avg(c) OVER w6 AS fast, lag(avg_c) OVER w AS pf FROM (SELECT *, avg(c) OVER w6 AS avg_c FROM bars WINDOW w6 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 5 PRECEDING)) WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts), w6 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 5 PRECEDING)),
r AS (SELECT symbol, bar_ts, unnest([CASE WHEN p >= 60 AND c < 60 THEN 'CURL' END, CASE WHEN p >= pf AND c < fast THEN 'CROSS' END, CASE WHEN l < 0.5 THEN 'INVALIDATED' END]) AS reason FROM x)
SELECT symbol, reason, min(bar_ts) AS bar_ts FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
def w41_exit_reasons(spark, d):
    """The first bar at which each exit reason holds, once for each symbol."""
    x = hourly(spark, d).withColumn("fast", F.avg("c").over(B.last(6)))
    before = lambda c: F.lag(c).over(B.ordered())
    x = x.withColumns({"p": before("c"), "pf": before("fast")})
    return P.first_reasons(x, "symbol", ["bar_ts"], {"CURL": (F.col("p") >= 60) & (F.col("c") < 60), "CROSS": (F.col("p") >= F.col("pf")) & (F.col("c") < F.col("fast")), "INVALIDATED": F.col("l") < 0.5})


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'other line' ELSE '12:00 MONITOR key=' || event_id || ' buildFail=' || (event_id % 7) || ' state=' || event_type END AS line FROM events), k AS (SELECT user_id, event_id, CAST(regexp_extract(line, 'key=(\\d+)', 1) AS BIGINT) AS key, CAST(regexp_extract(line, 'buildFail=(\\d+)', 1) AS BIGINT) AS fails, regexp_extract(line, 'state=(\\w+)', 1) AS state FROM l WHERE line LIKE '%MONITOR%')
SELECT user_id, max(key) AS key, arg_max(fails, event_id) AS last_fails, arg_max(state, event_id) AS last_state, count(*) AS samples FROM k GROUP BY 1""")
def s12_s13_journal(spark, d):
    """Samples and counters out of journal lines: the greatest key, the last number of failures, the last state."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, "other line").otherwise(F.concat(F.lit("12:00 MONITOR key="), "event_id", F.lit(" buildFail="), F.col("event_id") % 7, F.lit(" state="), "event_type"))
    x = e.select("user_id", "event_id", P.journal_fields(line, "MONITOR").alias("f")).where("f is not null")
    get = lambda k: F.try_element_at("f", F.lit(k))
    return x.groupBy("user_id").agg(F.max(get("key").try_cast("long")).alias("key"), F.max_by(get("buildFail").try_cast("long"), "event_id").alias("last_fails"), F.max_by(get("state"), "event_id").alias("last_state"), F.count(F.lit(1)).alias("samples"))


@query("""WITH x AS (SELECT user_id, ts AS a, ts + INTERVAL 1 SECOND * (600 + event_id % 9000) AS b FROM events), h AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM x), g AS (SELECT *, CASE WHEN a > high THEN epoch(a)::BIGINT - epoch(high)::BIGINT ELSE 0 END AS gap FROM (SELECT user_id, date_trunc('second', a) AS a, date_trunc('second', b) AS b, date_trunc('second', high) AS high FROM h)),
s AS (SELECT user_id, count(*) FILTER (gap > 0) AS gaps, sum(gap) AS open, max(gap) AS longest_gap, epoch(max(b))::BIGINT - epoch(min(a))::BIGINT AS span FROM g GROUP BY 1)
SELECT user_id, gaps + 1 AS islands, CAST(span - open AS BIGINT) AS covered, span, gaps, longest_gap, round((span - open) / span, 6) AS ratio, CASE WHEN (span - open) / span >= 0.2 AND longest_gap <= 500000 THEN 'PASS' ELSE 'FAIL' END AS evidence FROM s""")
def a27_a28_q12_sessions(spark, d):
    """Coverage of each user's sessions, their gaps, and whether that is evidence enough."""
    x = table(spark, d, "events").select("user_id", F.date_trunc("second", "ts").alias("a"), F.date_trunc("second", F.col("ts") + F.make_dt_interval(secs=(600 + F.col("event_id") % 9000).cast("decimal(18,6)"))).alias("b"))
    out = P.sessions(x, "user_id", "a", "b")
    return rounded(out.withColumn("evidence", F.when((F.col("ratio") >= 0.2) & (F.col("longest_gap") <= 500000), "PASS").otherwise("FAIL")), "ratio")


@query("""WITH x AS (SELECT l_suppkey AS s, count(*) AS n, sum(l_extendedprice * (l_discount - 0.05)) AS net, sum(greatest(l_extendedprice * (l_discount - 0.05), 0)) AS gain, sum(greatest(-l_extendedprice * (l_discount - 0.05), 0)) AS loss, date_diff('day', min(l_shipdate), max(l_shipdate)) AS days, count(*) FILTER (l_tax > 0.079) AS faults FROM lineitem GROUP BY 1),
r AS (SELECT s, faults = 0 AS ok, days >= 700 AND n >= 30 AS mature, gain / loss >= 0.95 AS pf, net / n > 0 AS payoff FROM x)
SELECT s, CASE WHEN NOT ok THEN 'FAIL' WHEN NOT mature THEN 'WAIT' WHEN NOT pf OR NOT payoff THEN 'FAIL' ELSE 'PASS' END AS status, concat_ws(',', CASE WHEN NOT ok THEN 'FAULTS' END, CASE WHEN mature AND NOT pf THEN 'PROFIT_FACTOR' END, CASE WHEN mature AND NOT payoff THEN 'PAYOFF' END) AS reasons FROM r""")
def q9_q10_stage_gate(spark, d):
    """A stage gate for each supplier: stops, then maturity, then performance, with all reasons."""
    p = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("net"), F.sum(F.greatest(p, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-p, F.lit(0.0))).alias("loss"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("days"), F.count_if(F.col("l_tax") > 0.079).alias("faults"))
    gate = P.stage_gate({"FAULTS": F.col("faults") == 0}, (F.col("days") >= 700) & (F.col("n") >= 30), {"PROFIT_FACTOR": F.col("gain") / F.col("loss") >= 0.95, "PAYOFF": F.col("net") / F.col("n") > 0})
    return x.select("s", gate.alias("g")).select("s", "g.status", F.array_join("g.reasons", ",").alias("reasons"))


@query(r"""WITH f AS (SELECT doc_id, list_extract(['outputs/v81-runs/a/shadow-signals.csv', 'x/blocked_signals.csv', 'p/26_v81_stddev.set', 'p/plain.SET', 'r/report.html', 'o/v82_audit.json', 'o/v81_notes.md', 'logs/journal-1.log', 'forward/forward_week.csv', 'd/trades.csv', 'd/ticks.csv', 'o/summary.txt', 'bin/tool.exe'], (doc_id % 13 + 1)::INT) AS path FROM documents)
SELECT list_extract(['STDDEV_SHADOW_TELEMETRY', 'BLOCKED_SIGNAL_SHADOW_TELEMETRY', 'AUDIT_PRESET', 'PRESET', 'MT5_REPORT', 'OPPORTUNITY_AUDIT_REPORT', 'EXPERIMENT_REPORT', 'JOURNAL', 'FORWARD_REPORT', 'TRADE_HISTORY', 'TELEMETRY', 'EXPERIMENT_REPORT', 'UNKNOWN'], (doc_id % 13 + 1)::INT) AS artifact, path, count(*) AS n FROM f GROUP BY ALL""")
def s15_artifacts(spark, d):
    """What paths say about their files."""
    paths = ["outputs/v81-runs/a/shadow-signals.csv", "x/blocked_signals.csv", "p/26_v81_stddev.set", "p/plain.SET", "r/report.html", "o/v82_audit.json", "o/v81_notes.md", "logs/journal-1.log", "forward/forward_week.csv", "d/trades.csv", "d/ticks.csv", "o/summary.txt", "bin/tool.exe"]
    x = table(spark, d, "documents").select(F.get(F.array(*map(F.lit, paths)), (F.col("doc_id") % 13).cast("int")).alias("path"))
    return x.groupBy(P.artifact_type(F.col("path")).alias("artifact"), "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_S} SELECT CASE WHEN event_type LIKE 'BLOCKED%' THEN active_side || ' active -> ' || shadow_side || ' blocked' WHEN event_type = 'SIMULTANEOUS_CONFLICT' THEN 'FLAT -> ' || actual_selected_side || ' selected / ' || shadow_side || ' blocked' WHEN event_type = 'LONG_ONLY' THEN 'FLAT -> LONG control' ELSE 'FLAT -> SHORT control' END AS direction,
  count(*) AS n, count(*) FILTER (completed AND side = 'LONG' AND event_type LIKE 'BLOCKED%') AS kept, count(*) FILTER (adds >= 2 AND y >= 1996) AS chosen FROM s GROUP BY 1""")
def p14_p22_s16_directions(spark, d):
    """Direction texts, with completed events of a kind and events under given conditions only."""
    s = made(spark, d, SIGNALS)
    text = P.direction(F.col("event_type"), F.col("active_side"), F.col("shadow_side"), F.col("actual_selected_side"), F.lit(None).cast("string"))
    wanted = {"adds": (">=", 2), "y": (">=", 1996)}
    chosen = F.lit(True)
    for column, (op, value) in wanted.items():  # only the conditions that are asked for are in the plan
        chosen = chosen & F.expr(f"{column} {op} {value}")
    kept = F.col("completed") & (F.col("side") == "LONG") & F.col("event_type").startswith("BLOCKED")
    return s.groupBy(text.alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"), F.count_if(chosen).alias("chosen"))


@query(f"""WITH {_S} SELECT k, '{{"side":"' || shadow_side || '","type":"' || event_type || '","age":' || age_bars || ',"valid":' || (shadow_build_valid AND coalesce(shadow_risk_distance > 0, false))::VARCHAR || '}}' AS payload FROM s""")
def p10_p12_p23_payloads(spark, d):
    """Events as stream payloads: context only, no column that tells of an outcome."""
    s = made(spark, d, SIGNALS)
    context = s.select("k", F.col("shadow_side").alias("side"), F.col("event_type").alias("type"), F.col("age_bars").alias("age"), (F.col("shadow_build_valid") & F.coalesce(F.col("shadow_risk_distance") > 0, F.lit(False))).alias("valid"))
    E.require_features(context.drop("k"), ["side", "type", "age", "valid"])
    return context.select("k", F.to_json(F.struct("side", "type", "age", "valid")).alias("payload"))


@query("""WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"rsi":1,"mfe_r":2}' WHEN 1 THEN '{"ctx":{"shadow_return_6bar_r":1},"a":2}' WHEN 2 THEN '{"rsi":1}' ELSE 'broken' END AS js FROM events)
SELECT CASE event_id % 4 WHEN 0 THEN 'mfe_r' WHEN 1 THEN 'shadow_return_6bar_r' WHEN 2 THEN '' END AS leaked, count(*) AS n FROM j GROUP BY 1""")
def p16_p17_outcome_keys(spark, d):
    """Keys of nested JSON that tell of outcomes."""
    js = F.expr("""case event_id % 4 when 0 then '{"rsi":1,"mfe_r":2}' when 1 then '{"ctx":{"shadow_return_6bar_r":1},"a":2}' when 2 then '{"rsi":1}' else 'broken' end""")
    x = table(spark, d, "events").select(js.alias("js"))
    return x.groupBy(F.array_join(E.outcome_keys(F.col("js")), ",").alias("leaked")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT event_id, user_id, ts AS committed, CASE WHEN event_id % 6 = 0 THEN 'REPLAY' ELSE 'FORWARD' END AS mode, (event_id % 9 > 0)::INT AS valid FROM events), o AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts + INTERVAL 1 HOUR END AS observed, CASE event_id % 5 WHEN 0 THEN 'INCOMPLETE' ELSE 'RESOLVED' END AS status, value FROM events WHERE event_id % 4 > 0)
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(committed) AS first FROM p JOIN o USING (event_id) WHERE mode = 'FORWARD' AND valid = 1 AND status = 'RESOLVED' AND committed < observed GROUP BY 1""")
def j8_p15_forward(spark, d):
    """Predictions joined with event, run and outcome, valid forward rows only."""
    e = table(spark, d, "events")
    p = e.select("event_id", "user_id", F.col("ts").alias("committed"), F.expr("case when event_id % 6 = 0 then 'REPLAY' else 'FORWARD' end").alias("mode"), (F.col("event_id") % 9 > 0).cast("int").alias("valid"))
    o = e.where("event_id % 4 > 0").select("event_id", F.expr("case when event_id % 7 = 0 then ts - interval 1 hour else ts + interval 1 hour end").alias("observed"), F.expr("case event_id % 5 when 0 then 'INCOMPLETE' else 'RESOLVED' end").alias("status"), "value")
    kept = p.where("mode = 'FORWARD' and valid = 1").join(o.where("status = 'RESOLVED'"), "event_id").where("committed < observed")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("committed").alias("first"))


@query("""WITH r AS (SELECT o_orderkey AS run, o_custkey % 10 AS bundle, o_orderdate AS started, o_orderstatus AS print FROM orders), c AS (SELECT DISTINCT o_custkey % 10 AS bundle, TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * ((o_custkey % 10) * 30)::INT AS opens, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS print FROM orders)
SELECT bundle, count(*) FILTER (r.print = c.print) AS attached, count(*) FILTER (r.print <> c.print) AS excluded, min(run) FILTER (r.print = c.print) AS first_run FROM r JOIN c USING (bundle) WHERE started >= opens GROUP BY 1""")
def j18_campaigns(spark, d):
    """Runs that belong to a campaign: same bundle, started within its window, same fingerprint."""
    o = table(spark, d, "orders")
    r = o.select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 10).alias("bundle"), F.col("o_orderdate").alias("started"), F.col("o_orderstatus").alias("print"))
    c = o.select((F.col("o_custkey") % 10).alias("bundle")).distinct().select("bundle", F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(cast(bundle * 30 as int))").alias("opens"), F.when(F.col("bundle") % 2 == 0, "F").otherwise("O").alias("own"))
    m = r.join(F.broadcast(c), "bundle").where("started >= opens")  # ten campaigns
    same = F.col("print") == F.col("own")
    return m.groupBy("bundle").agg(F.count_if(same).alias("attached"), F.count_if(~same).alias("excluded"), F.min(F.when(same, F.col("run"))).alias("first_run"))


@query(f"""WITH {STUDY}, a AS (SELECT symbol, bar_ts, side, avg(moved) FILTER (age = 6) AS r6, max(good) AS best, min(bad) AS worst, count(*) AS bars, arg_min(CASE WHEN good >= 1 AND bad <= -1 THEN 'AMBIGUOUS' WHEN good >= 1 THEN 'PLUS_1R' ELSE 'MINUS_1R' END, age) FILTER (good >= 1 OR bad <= -1) AS hit FROM pairs GROUP BY ALL)
SELECT symbol, bar_ts, side, round(r6, 6) AS r6, round(best, 6) AS mfe, round(worst, 6) AS mae, CASE hit WHEN 'PLUS_1R' THEN 1 WHEN 'MINUS_1R' THEN 0 END AS label, CASE WHEN hit IS NULL OR hit = 'AMBIGUOUS' OR r6 IS NULL THEN 'INCOMPLETE' ELSE 'RESOLVED' END AS status, CASE WHEN hit IS NULL THEN 'NO_FIRST_HIT' WHEN hit = 'AMBIGUOUS' THEN 'AMBIGUOUS_SAME_BAR' WHEN r6 IS NULL THEN 'MISSING_OUTCOME' END AS reason FROM a""")
def l3_l4_resolution(spark, d):
    """Outcomes of predictions from the bars after them: directional returns, the first touch, the state and why it is not resolved."""
    rows = hourly(spark, d)
    x = Y.first_touch(Y.signals(rows), rows, floor_zero=False)
    label = F.when(F.col("first_hit") == "PLUS_1R", 1).when(F.col("first_hit") == "MINUS_1R", 0)
    reason = F.when(F.col("first_hit") == "NONE", "NO_FIRST_HIT").when(F.col("first_hit") == "AMBIGUOUS", "AMBIGUOUS_SAME_BAR").when(F.col("return_6").isNull(), "MISSING_OUTCOME")
    out = x.select("symbol", "bar_ts", "side", F.col("return_6").alias("r6"), F.col("mfe_r").alias("mfe"), F.col("mae_r").alias("mae"), label.alias("label"), F.when(reason.isNull(), "RESOLVED").otherwise("INCOMPLETE").alias("status"), reason.alias("reason"))
    return rounded(out, "r6", "mfe", "mae")


@query(f"""WITH {STUDY}, x AS (SELECT symbol, bar_ts, side, max(moved) FILTER (age = 6) AS exit_6, max(moved) FILTER (age = 12) AS last_12 FROM pairs GROUP BY ALL), o AS (SELECT *, last_12 - exit_6 AS continuation, lag(exit_6) OVER (PARTITION BY symbol ORDER BY bar_ts) AS held FROM x)
SELECT symbol, side, count(*) AS n, round(avg(continuation), 6) AS mean_continuation, round(median(continuation), 6) AS median_continuation, round(avg((continuation > 0)::INT), 6) AS positive, round(avg(exit_6 - held), 6) AS opportunity_diff FROM o GROUP BY 1, 2""")
def w27_w28_continuation(spark, d):
    """What an exit after six bars gave up, and how a new signal did against the one that was held."""
    rows = hourly(spark, d)
    x = Y.first_touch(Y.signals(rows), rows).withColumn("continuation", F.col("return_12") - F.col("return_6")).withColumn("held", F.lag("return_6").over(Window.partitionBy("symbol").orderBy("bar_ts")))
    out = x.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.avg("continuation").alias("mean_continuation"), F.median("continuation").alias("median_continuation"), F.avg((F.col("continuation") > 0).cast("int")).alias("positive"), F.avg(F.col("return_6") - F.col("held")).alias("opportunity_diff"))
    return rounded(out, "mean_continuation", "median_continuation", "positive", "opportunity_diff")


@query(f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS k, CASE WHEN lag(c) OVER w IS NULL THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)), a AS (SELECT *, CASE WHEN k >= 14 THEN avg(tr) OVER w14 END AS atr, CASE WHEN k >= 20 THEN stddev_pop(c) OVER w20 END AS risk FROM x WINDOW w14 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 19 PRECEDING))
SELECT symbol, bar_ts, CASE WHEN c > 0 THEN round(atr / c * 100, 6) END AS atr_pct, CASE WHEN risk > 1e-9 THEN round(0.5 / risk, 6) END AS spread_r, CASE WHEN atr > 1e-9 THEN round(risk / atr, 6) END AS sl_atr, coalesce(CASE WHEN risk > 1e-9 THEN 0.5 / risk END > 0.01, false) AS high_spread FROM a""")
def w36_market_state(spark, d):
    """Range in percent of the price, spread and stop in units of risk and range, and the flag for a wide spread."""
    x = hourly(spark, d).withColumn("tr", F.coalesce(B.true_range(), F.col("h") - F.col("l")))
    x = x.select("symbol", "bar_ts", "c", B.rolling_mean(F.col("tr"), 14).alias("atr"), B.rolling_std(F.col("c"), 20).alias("risk"))
    spread = F.when(F.col("risk") > 1e-9, 0.5 / F.col("risk"))
    out = x.select("symbol", "bar_ts", F.when(F.col("c") > 0, F.col("atr") / F.col("c") * 100).alias("atr_pct"), spread.alias("spread_r"), F.when(F.col("atr") > 1e-9, F.col("risk") / F.col("atr")).alias("sl_atr"), F.coalesce(spread > 0.01, F.lit(False)).alias("high_spread"))
    return rounded(out, "atr_pct", "spread_r", "sl_atr")


@query(f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS k, avg(c) OVER w3 AS fast, avg(c) OVER w9 AS slow FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts), w3 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 2 PRECEDING), w9 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 8 PRECEDING)),
y AS (SELECT *, coalesce(lag(c) OVER w <= lag(slow) OVER w AND c > slow, false) AS first_cross, coalesce(lag(fast) OVER w <= lag(slow) OVER w AND fast > slow, false) AS second_cross, greatest(c, fast, slow) - least(c, fast, slow) AS span FROM x WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)), z AS (SELECT *, k - max(CASE WHEN first_cross THEN k END) OVER (PARTITION BY symbol ORDER BY bar_ts) AS since FROM y)
SELECT symbol, bar_ts, second_cross AND since BETWEEN 1 AND 5 AND span <= slow AS origin, since FROM z WHERE since IS NOT NULL""")
def w44_fan_origin(spark, d):
    """A second cross one to five bars after the first one, while the lines are close."""
    x = hourly(spark, d).withColumns({"k": F.row_number().over(B.ordered()), "fast": F.avg("c").over(B.last(3)), "slow": F.avg("c").over(B.last(9))})
    cross = lambda a, b: F.coalesce((F.lag(a).over(B.ordered()) <= F.lag(b).over(B.ordered())) & (F.col(a) > F.col(b)), F.lit(False))
    x = x.withColumns({"first_cross": cross("c", "slow"), "second_cross": cross("fast", "slow"), "span": F.greatest("c", "fast", "slow") - F.least("c", "fast", "slow")})
    since = F.col("k") - F.max(F.when(F.col("first_cross"), F.col("k"))).over(B.ordered())
    x = x.withColumn("since", since).where("since is not null")
    return x.select("symbol", "bar_ts", (F.col("second_cross") & F.col("since").between(1, 5) & (F.col("span") <= F.col("slow"))).alias("origin"), "since")
