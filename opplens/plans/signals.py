"""Queries over signals of both sides, stops and vetoes, ids, missing values and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opplens.operators import bars as B
from opplens.operators import signals as G

from .episodes import _O, _S, OBSERVED, SIGNALS, made
from .registry import BARS, hourly, query, rounded, table

_BOTH = f"""{BARS}, y AS (SELECT *, c > 40 AS long, l < 12 AS short, row_number() OVER w AS k, CASE WHEN row_number() OVER w % 5 = 0 THEN NULL WHEN o > 45 THEN 'LONG' WHEN o < 25 THEN 'SHORT' END AS held FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))"""


def both_sides(spark, d):
    x = hourly(spark, d).withColumn("k", F.row_number().over(B.ordered()))
    held = F.when(F.col("k") % 5 == 0, None).when(F.col("o") > 45, "LONG").when(F.col("o") < 25, "SHORT")
    return x.select("symbol", "bar_ts", (F.col("c") > 40).alias("long"), (F.col("l") < 12).alias("short"), held.alias("held"))


@query(f"""WITH {_BOTH}, e AS (SELECT *, long AND NOT coalesce(lag(long) OVER w, false) AS fresh FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY symbol ORDER BY bar_ts) AS run FROM e)
SELECT symbol, min(bar_ts) AS bar_ts, count(*) - 1 AS repeat_bars FROM r WHERE long GROUP BY symbol, run""")
def w21_repeated_bars(spark, d):
    """Each run of a signal with how often it repeats."""
    return G.with_runs(both_sides(spark, d), "long")


@query(f"""WITH {_BOTH}, s AS (SELECT *, unnest([true, false]) AS is_long FROM y)
SELECT symbol, bar_ts, is_long, CASE WHEN held IS NULL THEN CASE WHEN long AND short THEN 'FLAT_BOTH' WHEN is_long THEN 'FLAT_LONG_ONLY' ELSE 'FLAT_SHORT_ONLY' END WHEN (held = 'LONG') = is_long THEN 'OPEN_SAME_SIDE' ELSE 'OPEN_OPPOSITE_SIDE' END AS conflict FROM s WHERE CASE WHEN is_long THEN long ELSE short END""")
def w24_conflict_types(spark, d):
    """What each valid side means for the position that is held."""
    x = both_sides(spark, d).withColumn("is_long", F.explode(F.array(F.lit(True), F.lit(False)))).where(F.when(F.col("is_long"), F.col("long")).otherwise(F.col("short")))
    return x.select("symbol", "bar_ts", "is_long", G.conflict(F.col("is_long"), F.col("long"), F.col("short"), F.col("held")).alias("conflict"))


@query(f"""WITH {_BOTH}, e AS (SELECT *, long AND NOT coalesce(lag(long) OVER w, false) AS fl, short AND NOT coalesce(lag(short) OVER w, false) AS fs, 'g' || length(symbol) AS g FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
v AS (SELECT symbol, bar_ts, g, 'SHORT' AS side, 'SIMULTANEOUS_CONFLICT' AS event_type FROM e WHERE held IS NULL AND long AND short AND (fl OR fs) UNION ALL SELECT symbol, bar_ts, g, 'LONG', 'LONG_ONLY' FROM e WHERE held IS NULL AND NOT (long AND short) AND fl UNION ALL SELECT symbol, bar_ts, g, 'SHORT', 'SHORT_ONLY' FROM e WHERE held IS NULL AND NOT (long AND short) AND fs
  UNION ALL SELECT symbol, bar_ts, g, 'LONG', CASE WHEN held = 'LONG' THEN 'BLOCKED_SAME_SIDE' ELSE 'BLOCKED_OPPOSITE' END FROM e WHERE held IS NOT NULL AND fl UNION ALL SELECT symbol, bar_ts, g, 'SHORT', CASE WHEN held = 'SHORT' THEN 'BLOCKED_SAME_SIDE' ELSE 'BLOCKED_OPPOSITE' END FROM e WHERE held IS NOT NULL AND fs),
i AS (SELECT epoch(bar_ts)::BIGINT || '_' || g || '_' || side || '_' || event_type AS event_id, * FROM v)
SELECT event_id, symbol, bar_ts, side, event_type FROM i QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY symbol, bar_ts) = 1""")
def w24_w45_blocked_events(spark, d):
    """Events of fresh signals with their identities, of which each is kept once; symbols of equal length share a group here."""
    x = both_sides(spark, d).withColumn("group", F.concat(F.lit("g"), F.length("symbol").cast("string")))
    return G.blocked_events(x)


_ATR = """t AS (SELECT *, row_number() OVER w AS k, CASE WHEN lag(c) OVER w IS NULL THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
a AS (SELECT *, CASE WHEN k >= 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 13 PRECEDING) END AS atr, max(h) OVER w22 AS top, min(l) OVER w22 AS bottom FROM t WINDOW w22 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 21 PRECEDING))"""


@query(f"""WITH {BARS}, {_ATR} SELECT symbol, bar_ts, CASE WHEN k >= 22 AND atr > 0 THEN round(top - atr * 3, 6) END AS long_level, CASE WHEN k >= 22 AND atr > 0 THEN round(bottom + atr * 3, 6) END AS short_level FROM a""")
def w17_chandelier(spark, d):
    """Trailing levels of both sides over 22 bars."""
    x = hourly(spark, d).withColumn("tr", F.coalesce(B.true_range(), F.col("h") - F.col("l"))).withColumn("atr", B.rolling_mean(F.col("tr"), 14))
    return rounded(x.select("symbol", "bar_ts", G.chandelier(F.lit("LONG"), F.col("atr")).alias("long_level"), G.chandelier(F.lit("SHORT"), F.col("atr")).alias("short_level")), "long_level", "short_level")


_VETO = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 > 0 THEN l_discount * 6 END AS efficiency, CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE 100.0e0 END AS bid, 100.0e0 + l_tax AS ask, (l_suppkey % 9) / 10.0e0 AS risk, CASE WHEN l_partkey % 5 > 0 THEN (l_orderkey % 41) * 2.5e0 END AS rank, (l_orderkey % 7) / 10.0e0 AS atr, CASE WHEN l_partkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM {lineitem}"


@query(f"""WITH v AS ({_VETO.format(lineitem='lineitem')}) SELECT l_orderkey, l_linenumber, CASE WHEN efficiency < 0.25 THEN 'efficiency' END AS by_efficiency, CASE WHEN bid > 0 AND ask > 0 AND risk > 1e-9 AND (ask - bid) / risk > 0.1 THEN 'spread_r' END AS by_spread,
  CASE WHEN coalesce(rank >= 80, false) THEN 0.5 ELSE 1 END * CASE WHEN side = 'SHORT' AND atr > 1e-9 AND risk > 1e-9 AND risk / atr > 2 THEN 0.5::DOUBLE ELSE 1 END AS multiplier, coalesce(rank >= 80, false) AS high_vol, side = 'SHORT' AND atr > 1e-9 AND risk > 1e-9 AND risk / atr > 2 AS wide_short FROM v""")
def w43_vetoes(spark, d):
    """Both vetoes of an entry, which values that are not there pass, and the risk it is taken with."""
    c = F.col
    v = spark.sql(_VETO, lineitem=table(spark, d, "lineitem"))
    out = v.select("l_orderkey", "l_linenumber", *[G.quality_veto(m, c("efficiency"), c("bid"), c("ask"), c("risk")).alias(f"by_{n}") for m, n in (("efficiency", "efficiency"), ("spread_r", "spread"))], G.risk_multiplier(c("side"), c("rank"), c("risk"), c("atr")).alias("m"))
    return out.select("l_orderkey", "l_linenumber", "by_efficiency", "by_spread", "m.*")


@query(f"""WITH {_O}, n AS (SELECT *, row_number() OVER (PARTITION BY ts, side, event_type ORDER BY episode_id, symbol, entry) AS place FROM o)
SELECT episode_id, upper(symbol) || '-H1-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '-V26-' || CASE WHEN episode_id % 5 = 0 THEN 'NONE' ELSE audit_version END || '-' || upper(side) || '-' || replace(event_type, '_', '-') || '-' || CASE WHEN place > 999 THEN place::VARCHAR ELSE lpad(place::VARCHAR, 4, '0') END AS logical_id FROM n""")
def p8_episode_ids(spark, d):
    """Logical ids of episodes, numbered within time, side and kind."""
    c = F.col
    place = F.row_number().over(Window.partitionBy("ts", "side", "event_type").orderBy("episode_id", "symbol", "entry"))
    o = made(spark, d, OBSERVED).withColumn("place", place)
    return o.select("episode_id", G.episode_id(c("symbol"), c("timeframe"), c("ts"), c("strategy"), F.when(c("episode_id") % 5 > 0, c("audit_version")), c("side"), c("event_type"), c("place")).alias("logical_id"))


_GAPS = ("rsi", "atr", "spread", "first_hit")


@query(f"""WITH {_O}, x AS (SELECT *, CASE WHEN episode_id % 3 = 0 THEN NULL WHEN ts < TIMESTAMP '1997-01-01' THEN 'TRAIN' ELSE 'OOS' END AS split FROM o), g AS (SELECT 'all' AS kind, '' AS key, * FROM x UNION ALL SELECT 'split', coalesce(split, 'UNKNOWN'), * FROM x UNION ALL SELECT 'audit', coalesce(audit_version, 'UNKNOWN'), * FROM x),
r AS ({' UNION ALL '.join(f"SELECT kind, key, '{f}' AS feature, count(*) AS n, count(*) FILTER ({f} IS NULL) AS missing FROM g GROUP BY 1, 2" for f in _GAPS)}) SELECT *, round(missing / n, 8) AS rate FROM r""")
def a23_missing_rates(spark, d):
    """How often each feature is missing, over all rows, by split and by audit."""
    split = F.when(F.col("episode_id") % 3 == 0, None).when(F.expr("ts < timestamp_ntz'1997-01-01'"), "TRAIN").otherwise("OOS")
    return rounded(G.missing_rates(made(spark, d, OBSERVED).withColumn("split", split), _GAPS, {"split": "split", "audit": "audit_version"}), "rate", places=8)


@query(f"""WITH {_S}, m AS (SELECT count(*) AS n, (year(max(event_time)) - year(min(event_time))) * 12 + month(max(event_time)) - month(min(event_time)) + 1 AS months, count(*) FILTER (completed) AS resolved, (year(max(event_time) FILTER (completed)) - year(min(event_time) FILTER (completed))) * 12 + month(max(event_time) FILTER (completed)) - month(min(event_time) FILTER (completed)) + 1 AS own FROM s WHERE event_time > TIMESTAMP '1996-03-15')
SELECT n, CAST(months AS INT) AS months, resolved, round(resolved / own, 8) AS rate, round(500 / (resolved / own), 8) AS months_to_go FROM m""")
def a32_coverage(spark, d):
    """Months covered, resolved rows a month, and the months until 500 are resolved."""
    s = made(spark, d, SIGNALS).where("event_time > timestamp_ntz'1996-03-15'")
    return rounded(G.coverage(s, "event_time", F.col("completed")), "rate", "months_to_go", places=8)


_FIT = """x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity * 1.0e0 END AS q, CASE WHEN l_orderkey % 9 = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice * 1.0e0 END AS p, CASE WHEN l_orderkey % 5 = 0 THEN ' ' ELSE lower(l_returnflag) || CASE WHEN year(l_shipdate) > 1997 THEN 'x' ELSE '' END END AS f, l_linestatus AS g, year(l_shipdate) < 1996 AS train FROM lineitem),
v AS (SELECT *, CASE WHEN NOT isnan(p) THEN p END AS pp, nullif(upper(trim(f)), '') AS ff FROM x), s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(pp) AS mp, stddev_pop(pp) AS sp, list_sort(list(DISTINCT ff) FILTER (ff IS NOT NULL)) AS kf, list_sort(list(DISTINCT g)) AS kg FROM v WHERE train),
o AS (SELECT l_orderkey, l_linenumber, coalesce((q - mq) / sq, 0) AS zq, (q IS NULL)::INT AS nq, coalesce((pp - mp) / sp, 0) AS zp, (pp IS NULL)::INT AS np, list_transform(kf, lambda k: coalesce(ff = k, false)::INT) AS hot, (ff IS NULL OR NOT list_contains(kf, ff))::INT AS nf, ((q IS NOT NULL)::INT + (pp IS NOT NULL)::INT + (ff IS NOT NULL)::INT + 1) / 4 AS completeness,
  concat_ws(',', CASE WHEN abs((q - mq) / sq) > 1.6 THEN 'q:far' END, CASE WHEN abs((pp - mp) / sp) > 1.6 THEN 'p:far' END, CASE WHEN ff IS NOT NULL AND NOT list_contains(kf, ff) THEN 'f:unseen_category' END, CASE WHEN NOT list_contains(kg, g) THEN 'g:unseen_category' END) AS reasons, greatest(coalesce(abs((q - mq) / sq), 0), coalesce(abs((pp - mp) / sp), 0)) AS far FROM v, s)"""


@query(f"""WITH {_FIT} SELECT l_orderkey, l_linenumber, round(zq, 6) + 0 AS zq, nq, round(zp, 6) + 0 AS zp, np, array_to_string(hot, '') AS hot, nf, completeness, reasons, round(far, 6) AS ood_score FROM o""")
def f3_f5_vectors(spark, d):
    """Vectors by the statistics of the training years: scaled numbers with indicators, one-hot levels with an unknown slot, how complete a row is
    and why it is out of what training saw."""
    from opplens.operators.vectors import fit_vectors

    q, p = F.when(~(F.col("l_tax") > 0.07), F.col("l_quantity").cast("double")), F.when(F.col("l_orderkey") % 9 == 0, float("nan")).otherwise(F.col("l_extendedprice").cast("double"))
    f = F.when(F.col("l_orderkey") % 5 == 0, " ").otherwise(F.concat(F.lower("l_returnflag"), F.when(F.year("l_shipdate") > 1997, "x").otherwise("")))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), p.alias("p"), f.alias("f"), F.col("l_linestatus").alias("g"), (F.year("l_shipdate") < 1996).alias("train"))
    model = fit_vectors(x.where("train"), ["q", "p"], ["f", "g"], z_limit=1.6)
    n = len(model.levels["f"])
    v = lambda k: F.get("vector", F.lit(k))
    out = model.transform(x)
    hot = F.array_join(F.transform(F.slice("vector", 5, n), lambda h: h.cast("int").cast("string")), "")
    return rounded(out.select("l_orderkey", "l_linenumber", v(0).alias("zq"), v(1).cast("int").alias("nq"), v(2).alias("zp"), v(3).cast("int").alias("np"), hot.alias("hot"), v(4 + n).cast("int").alias("nf"), "completeness", F.array_join("reasons", ",").alias("reasons"), "ood_score"), "zq", "zp", "ood_score")


_KEYS = {"event": ("k",), "time_side": ("event_time", "side"), "time_side_type": ("event_time", "side", "event_type"), "risk_side": ("shadow_risk_distance", "active_current_r", "side")}


@query(f"""WITH {_S}, a AS (SELECT * FROM s WHERE k % 3 > 0), b AS (SELECT * FROM s WHERE k % 4 > 0) {' UNION ALL '.join(f"SELECT '{n}' AS keys, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM a WHERE {' AND '.join(f'{x} IS NOT NULL' for x in c)})) AS left, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM b WHERE {' AND '.join(f'{x} IS NOT NULL' for x in c)})) AS right, (SELECT count(*) FROM (SELECT {', '.join(c)} FROM a WHERE {' AND '.join(f'{x} IS NOT NULL' for x in c)} INTERSECT SELECT {', '.join(c)} FROM b)) AS both" for n, c in _KEYS.items())}""")
def o8_shared_keys(spark, d):
    """How many values of four tuples of keys two sets of signals share."""
    s = made(spark, d, SIGNALS)
    return G.shared_keys(s.where("k % 3 > 0"), s.where("k % 4 > 0"), _KEYS)


@query("""WITH r AS (SELECT o_custkey AS id, CASE year(o_orderdate) % 4 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'VALIDATION' WHEN 2 THEN 'OOS' ELSE 'FORWARD' END AS split FROM orders WHERE o_orderkey % 7 = 0), p AS (SELECT * FROM (VALUES ('TRAIN', 'VALIDATION'), ('TRAIN', 'OOS'), ('TRAIN', 'FORWARD'), ('VALIDATION', 'OOS'), ('VALIDATION', 'FORWARD'), ('OOS', 'FORWARD')) AS t(first, second))
SELECT first, second, (SELECT count(DISTINCT a.id) FROM r a JOIN r b ON a.id = b.id WHERE a.split = first AND b.split = second) AS n FROM p""")
def o10_split_overlaps(spark, d):
    """How many ids each two of four splits share."""
    split = F.expr("case year(o_orderdate) % 4 when 0 then 'TRAIN' when 1 then 'VALIDATION' when 2 then 'OOS' else 'FORWARD' end")
    r = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("id"), split.alias("split"))
    return G.split_overlaps(r, "id", "split", ["TRAIN", "VALIDATION", "OOS", "FORWARD"])
