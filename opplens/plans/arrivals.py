"""Queries over records in their order of arrival: the time gate, collapsed duplicates, delayed outcomes, missed regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opplens.operators import arrivals as A
from opplens.operators import recursions as R

from .registry import BARS, hourly, query, rounded, table

_ARRIVED = """SELECT event_id, user_id % 20 AS run, ts, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL '1' MINUTE WHEN event_id % 31 = 0 THEN ts + INTERVAL '6' HOUR ELSE ts + INTERVAL '1' SECOND END AS received, CASE WHEN event_type IN ('error', 'signup') THEN 'OPPORTUNITY' ELSE 'DIAGNOSTIC' END AS kind FROM {events}"""


@query(f"""WITH a AS ({_ARRIVED.format(events='events')}), j AS (SELECT *, CASE WHEN ts > received + INTERVAL 5 SECONDS THEN 'EVENT_TIMESTAMP_IN_FUTURE' WHEN received - INTERVAL 5 HOURS > ts THEN 'EVENT_TOO_OLD' END AS why FROM a),
h AS (SELECT *, max(CASE WHEN why IS NULL THEN ts END) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM j)
SELECT event_id, CASE WHEN why IS NOT NULL THEN why WHEN kind = 'DIAGNOSTIC' AND ts < high THEN 'OUT_OF_ORDER_EVENT' END AS reason FROM h""")
def t5_time_gate(spark, d):
    """Diagnostics out of order are rejected, opportunities are not; what is too early or too old is, with its reason."""
    return A.gate(spark.sql(_ARRIVED, events=table(spark, d, "events")), "run", "ts", "received", "event_id", "kind", oldest="5 hours").select("event_id", "reason")


_SEEN = "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey AS canonical, l_orderkey % 40 AS source_id, CASE WHEN l_quantity < 20 THEN 'EVENT_TOO_OLD' END AS reason, l_discount < 0.08 AS valid FROM {lineitem}"


@query(f"""WITH s AS ({_SEEN.format(lineitem='lineitem')}), b AS (SELECT *, coalesce(bool_or(reason IS NULL) OVER (PARTITION BY canonical ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM s), c AS (SELECT *, reason IS NULL OR begun AS counts FROM b),
g AS (SELECT *, counts AND row_number() OVER (PARTITION BY canonical, source_id, counts ORDER BY l_shipdate, l_orderkey, l_linenumber) > 1 AS again FROM c),
o AS (SELECT *, sum((counts AND NOT again)::INT) OVER w AS n, first_value(CASE WHEN reason IS NULL THEN source_id END IGNORE NULLS) OVER w AS rep FROM g WINDOW w AS (PARTITION BY canonical ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, CASE WHEN again THEN 'REJECTED_DUPLICATE' WHEN begun THEN 'DUPLICATE_COLLAPSED' WHEN reason IS NOT NULL THEN 'REJECTED_STALE' WHEN valid THEN 'ACCEPTED' ELSE 'INVALID' END AS status, rep AS representative, CAST(n AS BIGINT) AS observations, CAST(greatest(n - 1, 0) AS BIGINT) AS duplicates FROM o""")
def t4_collapsed_duplicates(spark, d):
    """The first fresh row of a key represents it, later ones are counted and collapsed, repeated source ids count for nothing."""
    s = spark.sql(_SEEN, lineitem=table(spark, d, "lineitem"))
    return A.collapse(s, ["canonical"], "source_id", ["l_shipdate", "l_orderkey", "l_linenumber"], "reason", "valid").select("l_orderkey", "l_linenumber", "status", "representative", "observations", "duplicates")


_ASKED = """SELECT CAST(event_id AS VARCHAR(20)) AS id, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, ts AS event_ts, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL '2' HOUR ELSE ts + INTERVAL '40' MINUTE END AS committed, value AS entry, 2.1e0 + event_id % 90 AS risk FROM {events} WHERE value > 60"""


@query(f"""WITH {BARS}, p AS ({_ASKED.format(events='events')}), met AS (SELECT id, bar_ts, row_number() OVER (PARTITION BY id ORDER BY bar_ts) AS n, CASE WHEN side = 'LONG' THEN (h - entry) / risk ELSE (entry - l) / risk END AS best, CASE WHEN side = 'LONG' THEN (l - entry) / risk ELSE (entry - h) / risk END AS worst, CASE WHEN side = 'LONG' THEN (c - entry) / risk ELSE (entry - c) / risk END AS r
  FROM p JOIN bars b ON b.symbol = p.symbol AND bar_ts > committed AND bar_ts <= committed + INTERVAL 72 HOURS), kept AS (SELECT * FROM met WHERE n <= 48),
o AS (SELECT id, count(*) AS bars, max(best) AS mfe, min(worst) AS mae, arg_min(CASE WHEN best >= 1 AND worst <= -1 THEN 'AMBIGUOUS' WHEN best >= 1 THEN 'PLUS_1R' ELSE 'MINUS_1R' END, n) FILTER (best >= 1 OR worst <= -1) AS hit, {', '.join(f'max(r) FILTER (n = {h}) AS r{h}' for h in A.RETURNS)} FROM kept GROUP BY id),
q AS (SELECT p.id, p.symbol, coalesce(bars, 0) AS bars, mfe, mae, hit, {', '.join(f'r{h}' for h in A.RETURNS)}, EXISTS (SELECT 1 FROM bars b WHERE b.symbol = p.symbol AND b.bar_ts > event_ts AND b.bar_ts <= committed) AS passed FROM p LEFT JOIN o USING (id)),
z AS (SELECT *, CASE WHEN bars = 0 THEN CASE WHEN passed THEN 'PREDICTION_AFTER_OUTCOME' ELSE 'NO_FUTURE_BARS' END WHEN hit = 'AMBIGUOUS' THEN 'AMBIGUOUS_SAME_BAR' WHEN hit IS NULL THEN 'NO_FIRST_HIT' WHEN r24 IS NULL THEN 'MISSING_24BAR_OUTCOME' END AS reason FROM q)
SELECT id, symbol, CASE WHEN reason IS NULL THEN 'RESOLVED' WHEN reason = 'PREDICTION_AFTER_OUTCOME' THEN 'INVALID' ELSE 'INCOMPLETE' END AS status, CASE hit WHEN 'PLUS_1R' THEN 1 WHEN 'MINUS_1R' THEN 0 END AS label, reason, bars, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in ('mfe', 'mae', *[f'r{h}' for h in A.RETURNS]))} FROM z""")
def t8_outcomes(spark, d):
    """One outcome for each prediction with its state, from the bars after its commit."""
    x = A.outcomes(spark.sql(_ASKED, events=table(spark, d, "events")), hourly(spark, d).select("symbol", "bar_ts", "h", "l", "c"))
    return rounded(x, "mfe", "mae", *[f"r{h}" for h in A.RETURNS])


_LINES = "SELECT event_id, event_type AS source, ts, value, user_id, event_id // 3 AS line_key, 20 + event_id % 30 AS bytes FROM events"


@query(f"""WITH a AS ({_LINES}), l AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY event_id) - bytes AS pos FROM a), sizes AS (SELECT source, max(pos + bytes) AS size FROM l GROUP BY 1), seen AS (SELECT source, pos AS lo, pos + 200 + event_id % 90 AS hi FROM l WHERE event_id % 12 = 0 AND source <> 'view'),
e AS (SELECT source, lo AS a, hi AS b FROM seen UNION ALL SELECT source, size, size FROM sizes), g AS (SELECT e.source, coalesce(max(b) OVER (PARTITION BY e.source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, least(a, size) AS hi FROM e JOIN sizes USING (source)), gaps AS (SELECT * FROM g WHERE lo < hi),
k AS (SELECT DISTINCT source, line_key FROM l WHERE event_id % 21 = 0), j AS (SELECT l.*, CASE WHEN NOT coalesce(value >= 10, false) THEN 'INVALID' WHEN ts < TIMESTAMP '2024-01-04' THEN 'BEFORE_START' WHEN k.line_key IS NOT NULL THEN 'ALREADY_KNOWN' END AS why FROM l JOIN gaps ON l.source = gaps.source AND l.pos >= gaps.lo AND l.pos < gaps.hi LEFT JOIN k ON k.source = l.source AND k.line_key = l.line_key)
SELECT event_id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY source, line_key, why IS NULL ORDER BY pos) = 1 THEN 'RECORDED' ELSE 'ALREADY_KNOWN' END) AS outcome FROM j""")
def t6_missed_regions(spark, d):
    """What no reader has seen of each source, and its lines: recorded once, or why not."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), "ts", "value", F.floor(F.col("event_id") / 3).alias("line_key"), (20 + F.col("event_id") % 30).alias("bytes"))
    lines = R.running(e, ["source"], "event_id", F.floor(F.col("event_id") / 4096), sums={"upto": F.col("bytes")}).withColumn("at", F.col("upto") - F.col("bytes"))
    seen = lines.where("event_id % 12 = 0 and source <> 'view'").select("source", F.col("at").alias("lo"), (F.col("at") + 200 + F.col("event_id") % 90).alias("hi"))
    gaps = A.missed_regions(seen, lines.groupBy("source").agg(F.max("upto").alias("size")), "source", "lo", "hi", "size")
    known = lines.where("event_id % 21 = 0")
    return A.recover(lines, gaps, known, "source", "at", ["source", "line_key"], F.col("value") >= 10, F.expr("ts < timestamp_ntz'2024-01-04'"), width=4096).select("event_id", "outcome")
