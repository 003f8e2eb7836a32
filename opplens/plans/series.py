"""Queries over bars: oscillators, crossings, regimes, gates, bar joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opplens.functions.rules import first_reason
from opplens.operators import bars as B

from .registry import BARS, hourly, query, rounded, table

W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts), w14 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 19 PRECEDING), w6 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 5 PRECEDING)"


def numbered(spark, d):
    return hourly(spark, d).withColumn("k", F.row_number().over(B.ordered())).withColumn("p", F.lag("c").over(B.ordered()))


@query(f"""WITH {BARS}, x AS (SELECT *, c - lag(c) OVER w AS d FROM bars {W}), y AS (SELECT *, avg(greatest(d, 0)) OVER w14 AS up, avg(greatest(-d, 0)) OVER w14 AS down, count(d) OVER w14 AS n FROM x {W})
SELECT symbol, bar_ts, CASE WHEN n = 14 THEN round(CASE WHEN up + down > 1e-12 THEN 100 * up / (up + down) ELSE 50 END, 6) END AS rsi FROM y""")
def w1_simple_mean_rsi(spark, d):
    """Relative strength over simple means of the last 14 moves; 50 where nothing moved."""
    x = numbered(spark, d).withColumn("move", F.col("c") - F.col("p"))
    x = x.select("symbol", "bar_ts", F.count("move").over(B.last(14)).alias("n"), F.avg(F.when(F.col("move").isNotNull(), F.greatest("move", F.lit(0.0)))).over(B.last(14)).alias("up"), F.avg(F.when(F.col("move").isNotNull(), F.greatest(-F.col("move"), F.lit(0.0)))).over(B.last(14)).alias("down"))
    return rounded(x.select("symbol", "bar_ts", F.when(F.col("n") == 14, F.when(F.col("up") + F.col("down") > 1e-12, 100 * F.col("up") / (F.col("up") + F.col("down"))).otherwise(50.0)).alias("rsi")), "rsi")


@query(f"""WITH {BARS}, x AS (SELECT *, list(c) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 20 PRECEDING) AS seen FROM bars)
SELECT symbol, bar_ts, CASE WHEN len(seen) = 21 THEN round(list_reduce(seen, lambda a, v: a + (v - a) / 3), 6) END AS ema FROM x""")
def w3_exponential_mean(spark, d):
    return rounded(hourly(spark, d).select("symbol", "bar_ts", B.exponential_mean("c", 5).alias("ema")), "ema")


@query(f"""WITH {BARS}, x AS (SELECT *, CASE WHEN row_number() OVER w >= 20 THEN avg(c) OVER w20 END AS m FROM bars {W}), y AS (SELECT *, coalesce(lag(c) OVER w <= lag(m) OVER w AND c > m, false) AS up, coalesce(lag(c) OVER w >= lag(m) OVER w AND c < m, false) AS down FROM x {W})
SELECT symbol, bar_ts, up, down, bool_or(up) OVER w6 AS up_within_5, bool_or(l <= m * 0.5) OVER w6 AS deep_within_5 FROM y {W}""")
def w5_w7_crossings(spark, d):
    x = hourly(spark, d).withColumn("m", B.rolling_mean(F.col("c"), 20))
    before_c, before_m = F.lag("c").over(B.ordered()), F.lag("m").over(B.ordered())
    x = x.withColumn("up", F.coalesce((before_c <= before_m) & (F.col("c") > F.col("m")), F.lit(False))).withColumn("down", F.coalesce((before_c >= before_m) & (F.col("c") < F.col("m")), F.lit(False)))
    return x.select("symbol", "bar_ts", "up", "down", F.bool_or("up").over(B.last(6)).alias("up_within_5"), F.bool_or(F.col("l") <= F.col("m") * 0.5).over(B.last(6)).alias("deep_within_5"))


@query(f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS k, avg(c) OVER w20 AS m, stddev_pop(c) OVER w20 AS s20, stddev_pop(c) OVER w6 AS s6 FROM bars {W}),
y AS (SELECT symbol, bar_ts, k, c, m, CASE WHEN k >= 20 THEN round(s20, 9) END AS s20, CASE WHEN k >= 6 THEN s6 END AS s6 FROM x), z AS (SELECT *, list(s20) FILTER (s20 IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS past FROM y)
SELECT symbol, bar_ts, CASE WHEN s20 > 1e-12 THEN round((c - m) / s20, 6) END AS z, CASE WHEN s20 > 1e-12 THEN round(s6 / s20, 6) END AS ratio, CASE WHEN s20 IS NOT NULL AND len(past) = 24 THEN len(list_filter(past, lambda v: v <= s20)) * 100.0::DOUBLE / 24 END AS std_rank FROM z""")
def w13_w15_deviation_ranks(spark, d):
    """Z-score, ratio of two deviations, and the rank of a deviation among the 24 before it."""
    x = hourly(spark, d).withColumn("m", F.avg("c").over(B.last(20))).withColumn("s20", F.round(B.rolling_std(F.col("c"), 20), 9)).withColumn("s6", B.rolling_std(F.col("c"), 6))
    some = F.col("s20") > 1e-12
    return rounded(x.select("symbol", "bar_ts", F.when(some, (F.col("c") - F.col("m")) / F.col("s20")).alias("z"), F.when(some, F.col("s6") / F.col("s20")).alias("ratio"), B.percent_rank_before("s20", 24).alias("std_rank")), "z", "ratio")


@query(f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS k, avg(c) OVER w6 AS fast, avg(c) OVER w20 AS slow FROM bars {W}),
s AS (SELECT *, (sign(c - fast) + sign(c - slow) + sign(fast - slow) + sign(c - o))::INT AS score FROM x WHERE k >= 20)
SELECT symbol, bar_ts, score, CASE WHEN score >= 4 THEN 'bull' WHEN score <= -4 THEN 'bear' ELSE 'mixed' END AS regime, CASE WHEN c > fast AND fast > slow THEN 'LONG' WHEN c < fast AND fast < slow THEN 'SHORT' ELSE 'NEUTRAL' END AS bias, (c > fast)::INT + (c > slow)::INT + (fast > slow)::INT AS aligned,
  CASE WHEN NOT vol >= 2 THEN 'THIN' WHEN NOT abs(score) >= 2 THEN 'NO_TREND' WHEN NOT h - l <= slow THEN 'WIDE' END AS reason, CASE WHEN abs(score) >= 4 THEN 1.0::DOUBLE WHEN abs(score) >= 2 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS multiplier FROM s""")
def w18_w20_w37_w43_regime_gates(spark, d):
    """Bias, signed regime score, count of aligned states, first failing gate and the size ladder."""
    x = numbered(spark, d).withColumn("fast", F.avg("c").over(B.last(6))).withColumn("slow", F.avg("c").over(B.last(20))).where("k >= 20")
    c, fast, slow = F.col("c"), F.col("fast"), F.col("slow")
    x = x.withColumn("score", (F.signum(c - fast) + F.signum(c - slow) + F.signum(fast - slow) + F.signum(c - F.col("o"))).cast("int"))
    strong = F.abs("score")
    return x.select("symbol", "bar_ts", "score", F.when(F.col("score") >= 4, "bull").when(F.col("score") <= -4, "bear").otherwise("mixed").alias("regime"), F.when((c > fast) & (fast > slow), "LONG").when((c < fast) & (fast < slow), "SHORT").otherwise("NEUTRAL").alias("bias"),
                    ((c > fast).cast("int") + (c > slow).cast("int") + (fast > slow).cast("int")).alias("aligned"), first_reason({"THIN": F.col("vol") >= 2, "NO_TREND": strong >= 2, "WIDE": F.col("h") - F.col("l") <= slow}).alias("reason"), F.when(strong >= 4, 1.0).when(strong >= 2, 0.5).otherwise(0.25).alias("multiplier"))


@query(f"""WITH {BARS}, x AS (SELECT *, c > o AS long, l < lag(l) OVER w AS short, CASE WHEN lag(c) OVER w > lag(o) OVER w THEN 'LONG' WHEN lag(c) OVER w < lag(o) OVER w THEN 'SHORT' END AS held FROM bars {W}),
y AS (SELECT symbol, bar_ts, held, long, coalesce(short, false) AS short FROM x)
SELECT symbol, bar_ts, CASE WHEN long AND short THEN 'SIMULTANEOUS_CONFLICT' WHEN NOT long AND NOT short THEN 'NONE' WHEN held IS NULL THEN CASE WHEN long THEN 'FLAT_LONG_ONLY' ELSE 'FLAT_SHORT_ONLY' END WHEN (held = 'LONG') = long THEN 'OPEN_SAME_SIDE' ELSE 'OPEN_OPPOSITE_SIDE' END AS conflict,
  concat_ws('_', epoch(bar_ts)::BIGINT, symbol, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END) AS identity FROM y""")
def w24_w45_conflicts(spark, d):
    """What two signals mean for the side that is held, and the identity of the event."""
    before = lambda c: F.lag(c).over(B.ordered())
    long, short = F.col("c") > F.col("o"), F.coalesce(F.col("l") < before("l"), F.lit(False))
    held = F.when(before("c") > before("o"), "LONG").when(before("c") < before("o"), "SHORT")
    x = hourly(spark, d).select("symbol", "bar_ts", long.alias("long"), short.alias("short"), held.alias("held"))
    kind = F.when(F.expr("long and short"), "SIMULTANEOUS_CONFLICT").when(F.expr("not long and not short"), "NONE").when(F.col("held").isNull(), F.when(F.col("long"), "FLAT_LONG_ONLY").otherwise("FLAT_SHORT_ONLY"))
    kind = kind.when((F.col("held") == "LONG") == F.col("long"), "OPEN_SAME_SIDE").otherwise("OPEN_OPPOSITE_SIDE")
    return x.select("symbol", "bar_ts", kind.alias("conflict"), F.concat_ws("_", F.unix_timestamp(F.col("bar_ts").cast("timestamp")).cast("string"), "symbol", F.when(F.col("long"), "LONG").otherwise("SHORT")).alias("identity"))


@query("""WITH x AS (SELECT event_id, user_id, ts, event_type, value, lead(ts) OVER w AS next, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN NOT coalesce(value >= 0, false) THEN 'BAD_VALUE' WHEN ts < TIMESTAMP '2024-01-05' THEN 'BEFORE_START' WHEN ts > TIMESTAMP '2024-01-25' THEN 'FUTURE' WHEN ts < high THEN 'OUT_OF_ORDER' END AS reason, coalesce(next - ts > INTERVAL 6 HOURS, false) AS long_gap FROM x""")
def p19_w35_time_gate(spark, d):
    """The first failing rule of each event in the order of arrival."""
    arrived = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = table(spark, d, "events").withColumn("high", F.max("ts").over(arrived)).withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rules = {"BAD_VALUE": F.col("value") >= 0, "BEFORE_START": F.expr("ts >= timestamp_ntz'2024-01-05'"), "FUTURE": F.expr("ts <= timestamp_ntz'2024-01-25'"), "OUT_OF_ORDER": F.expr("high is null or ts >= high")}
    return x.select("event_id", first_reason(rules).alias("reason"), F.coalesce(F.expr("next - ts > interval 6 hours"), F.lit(False)).alias("long_gap"))


@query(f"""WITH {BARS}, e AS (SELECT event_id, event_type AS symbol, ts, value FROM events WHERE value > 50), p AS (SELECT e.*, b.bar_ts, b.h, b.l, b.c FROM e LEFT JOIN bars b ON e.symbol = b.symbol AND b.bar_ts > e.ts AND b.bar_ts <= e.ts + INTERVAL 24 HOURS)
SELECT event_id, CASE WHEN count(bar_ts) = 0 THEN 'INVALID' WHEN count(bar_ts) < 6 THEN 'INCOMPLETE' ELSE 'RESOLVED' END AS status, count(bar_ts) AS bars, max(h) AS best, min(l) AS worst, arg_max(c, bar_ts) AS last_close FROM p GROUP BY event_id""")
def j14_l4_delayed_outcomes(spark, d):
    """Each event with the bars of the day after it. Days bucket the range, so the join is an equi join."""
    b = hourly(spark, d).select(F.col("symbol").alias("s"), "bar_ts", "h", "l", "c", F.date_trunc("day", "bar_ts").cast("date").alias("day"))
    e = table(spark, d, "events").where("value > 50").select("event_id", F.col("event_type").alias("symbol"), "ts")
    near = e.withColumn("at", F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))))
    met = near.join(b, (F.col("symbol") == F.col("s")) & (F.col("at") == F.col("day")) & (F.col("bar_ts") > F.col("ts")) & F.expr("bar_ts <= ts + interval 24 hours"), "left")
    n = F.count("bar_ts")
    return met.groupBy("event_id").agg(F.when(n == 0, "INVALID").when(n < 6, "INCOMPLETE").otherwise("RESOLVED").alias("status"), n.alias("bars"), F.max("h").alias("best"), F.min("l").alias("worst"), F.max_by("c", "bar_ts").alias("last_close"))


@query("""WITH x AS (SELECT user_id, ts AS a, ts + INTERVAL 2 HOURS AS b, event_id FROM events), y AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM x), z AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY a, event_id) AS island FROM y)
SELECT user_id, CAST(island AS BIGINT) AS island, min(a) AS opened, max(b) AS closed, count(*) AS n FROM z GROUP BY ALL""")
def a27_interval_union(spark, d):
    """Overlapping intervals of a user joined into islands."""
    w = Window.partitionBy("user_id").orderBy("a", "event_id")
    x = table(spark, d, "events").select("user_id", F.col("ts").alias("a"), F.expr("ts + interval 2 hours").alias("b"), "event_id")
    x = x.withColumn("fresh", F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    return x.groupBy("user_id", "island").agg(F.min("a").alias("opened"), F.max("b").alias("closed"), F.count(F.lit(1)).alias("n"))
