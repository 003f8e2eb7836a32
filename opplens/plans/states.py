"""Queries over states of events and features: buckets with unknowns, outcome projections, completeness, drift, composite regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opplens.functions import scalars as S
from opplens.operators import bars as B
from opplens.operators import episodes as E
from opplens.operators.features import exact_quantiles

from .episodes import _S, SIGNALS, made
from .registry import query, table


@query(f"""WITH {_S}, x AS (SELECT CASE WHEN k % 9 > 0 THEN active_current_r END AS r, CASE WHEN k % 5 > 0 THEN adds END AS adds, side, shadow_return_6bar_r AS gap FROM s)
SELECT CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0 THEN 'active_r_lt_0' WHEN r < 1 THEN 'active_r_0_1' WHEN r < 2 THEN 'active_r_1_2' ELSE 'active_r_ge_2' END AS maturity, CASE WHEN adds IS NULL THEN 'unknown' WHEN adds < 1 THEN 'before_add1' ELSE 'after_add1' END AS pyramid,
  CASE WHEN gap IS NULL THEN 'unknown' WHEN (gap > 0) = (side = 'LONG') THEN 'with_side' ELSE 'against_side' END AS position, count(*) AS n FROM x GROUP BY ALL""")
def b7_b8_a15_states(spark, d):
    """Maturity, pyramid and side-aware position of events; a value that is not known is a bucket of its own."""
    s = made(spark, d, SIGNALS)
    r, adds, gap = F.when(F.col("k") % 9 > 0, F.col("active_current_r")), F.when(F.col("k") % 5 > 0, F.col("adds")), F.col("shadow_return_6bar_r")
    known = lambda x: F.coalesce(x, F.lit("unknown"))
    position = F.when((gap > 0) == (F.col("side") == "LONG"), "with_side").when(gap.isNotNull(), "against_side")
    return s.groupBy(known(S.ladder(r, [0, 1, 2], ["active_r_lt_0", "active_r_0_1", "active_r_1_2", "active_r_ge_2"])).alias("maturity"), known(S.ladder(adds, [1], ["before_add1", "after_add1"])).alias("pyramid"), known(position).alias("position")).agg(F.count(F.lit(1)).alias("n"))


_FAMILIES = ("shadow_return", "active_continuation", "opportunity_diff", "actual_selected_return")


@query(f"""WITH {_S}, o AS ({' UNION ALL '.join(f"SELECT '{f}' AS family, {h} AS horizon, completed AS resolved, CASE WHEN completed THEN {f}_{h}bar_r END AS value FROM s" for f in _FAMILIES for h in E.HORIZONS)})
SELECT family, horizon, count(*) AS n, count(value) AS filled, count(*) FILTER (resolved) AS resolved, round(avg(value), 6) + 0 AS mean, max(value) AS top FROM o GROUP BY ALL""")
def p11_outcomes(spark, d):
    """Outcomes of four families at four horizons as rows, of resolved events only."""
    s = made(spark, d, SIGNALS)
    cells = [F.struct(F.lit(f).alias("family"), F.lit(h).alias("horizon"), F.when(F.col("completed"), F.col(f"{f}_{h}bar_r")).alias("value")) for f in _FAMILIES for h in E.HORIZONS]
    x = s.select("completed", F.explode(F.array(*cells)).alias("c")).select("completed", "c.*")
    return x.groupBy("family", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.count_if("completed").alias("resolved"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS b, l_returnflag AS f, l_linestatus AS g, year(l_shipdate) < 1996 AS train FROM lineitem),
s AS (SELECT avg(a) AS ma, greatest(stddev_pop(a), 1e-15) AS sa, avg(b) AS mb, greatest(stddev_pop(b), 1e-15) AS sb FROM x WHERE train), seen AS (SELECT list(DISTINCT f || g) AS known FROM x WHERE train AND l_orderkey % 2 = 0 AND f <> 'N'),
r AS (SELECT ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) / 2 AS completeness, concat_ws(',', CASE WHEN abs((a - ma) / sa) > 1.6 THEN 'a' END, CASE WHEN abs((b - mb) / sb) > 1.6 THEN 'b' END, CASE WHEN NOT list_contains(known, f || g) THEN 'category' END) AS reasons FROM x, s, seen)
SELECT completeness, reasons, count(*) AS n FROM r GROUP BY ALL""")
def f4_completeness(spark, d):
    """Share of filled features and the reasons why a row is out of what training saw: far values, unseen categories."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.when(~(F.col("l_tax") > 0.07), F.col("l_quantity")).alias("a"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_extendedprice")).alias("b"), F.concat("l_returnflag", "l_linestatus").alias("c"), (F.col("l_returnflag") != "N").alias("used"), (F.year("l_shipdate") < 1996).alias("train"))
    stats = x.where("train").agg(*[e for c in "ab" for e in (F.avg(c).alias(f"m{c}"), F.greatest(F.stddev_pop(c), F.lit(1e-15)).alias(f"s{c}"))])
    seen = x.where("train and used and l_orderkey % 2 = 0").agg(F.collect_set("c").alias("known"))  # the categories
    x = x.join(F.broadcast(stats)).join(F.broadcast(seen))  # one row each
    far = lambda c: F.when(F.abs((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")) > 1.6, F.lit(c))
    reasons = F.concat_ws(",", far("a"), far("b"), F.when(~F.array_contains("known", F.col("c")), "category"))
    return x.groupBy(((F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")) / 2).alias("completeness"), reasons.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT CASE WHEN year(l_shipdate) < 1996 THEN 'old' ELSE 'new' END AS p, CASE WHEN l_orderkey % 7 = 0 AND year(l_shipdate) < 1996 THEN NULL ELSE l_quantity END AS q, l_returnflag AS f FROM lineitem), m AS (SELECT abs(avg((q IS NULL)::INT) FILTER (p = 'new') - avg((q IS NULL)::INT) FILTER (p = 'old')) AS v FROM x),
q AS (SELECT p, quantile_cont(q, [0.1, 0.5, 0.9]) AS t FROM x GROUP BY 1), s AS (SELECT greatest(abs(a.t[1] - b.t[1]), abs(a.t[2] - b.t[2]), abs(a.t[3] - b.t[3])) / greatest(abs(a.t[3] - a.t[1]), 1e-12) AS v FROM q a, q b WHERE a.p = 'old' AND b.p = 'new'),
c AS (SELECT f, count(*) FILTER (p = 'old') / (SELECT count(*) FROM x WHERE p = 'old') AS o, count(*) FILTER (p = 'new') / (SELECT count(*) FROM x WHERE p = 'new') AS n FROM x GROUP BY 1), t AS (SELECT sum(abs(o - n)) / 2 AS v FROM c), r AS (SELECT 'missing_rate' AS kind, v FROM m UNION ALL SELECT 'quantile_shift', v FROM s UNION ALL SELECT 'category_change', v FROM t)
SELECT kind, round(v, 6) AS value, CASE WHEN v >= 0.25 THEN 'HIGH' WHEN v >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM r""")
def d1_drift_kinds(spark, d):
    """Three kinds of drift between two periods: missing rates, quantiles, categories."""
    old = F.year("l_shipdate") < 1996
    x = table(spark, d, "lineitem").select(F.when(old, "old").otherwise("new").alias("p"), F.when(~(old & (F.col("l_orderkey") % 7 == 0)), F.col("l_quantity")).alias("q"), F.col("l_returnflag").alias("f"))
    share = lambda p: F.avg(F.when(F.col("p") == p, F.col("q").isNull().cast("int")))
    missing = x.agg(F.abs(share("new") - share("old")).alias("v")).select(F.lit("missing_rate").alias("kind"), "v")
    t = exact_quantiles(x, "q", {"t1": ("linear", 0.1), "t5": ("linear", 0.5), "t9": ("linear", 0.9)}, ["p"])
    at = lambda p, c: F.max(F.when(F.col("p") == p, F.col(c)))
    gaps = [F.abs(at("old", c) - at("new", c)) for c in ("t1", "t5", "t9")]
    shift = t.agg((F.greatest(*gaps) / F.greatest(F.abs(at("old", "t9") - at("old", "t1")), F.lit(1e-12))).alias("v")).select(F.lit("quantile_shift").alias("kind"), "v")
    n = F.broadcast(x.agg(F.count_if(F.col("p") == "old").alias("no"), F.count_if(F.col("p") == "new").alias("nn")))  # one row
    by = x.groupBy("f").agg(F.count_if(F.col("p") == "old").alias("o"), F.count_if(F.col("p") == "new").alias("n")).join(n)
    change = by.agg((F.sum(F.abs(F.col("o") / F.col("no") - F.col("n") / F.col("nn"))) / 2).alias("v")).select(F.lit("category_change").alias("kind"), "v")
    out = missing.unionByName(shift).unionByName(change)
    return out.select("kind", F.round("v", 6).alias("value"), F.when(F.col("v") >= 0.25, "HIGH").when(F.col("v") >= 0.1, "MEDIUM").otherwise("LOW").alias("severity"))


_STATE = """{n} AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{every}', ts) + INTERVAL '{every}' AS bar_ts, arg_max(value, (ts, event_id)) AS c, arg_min(value, (ts, event_id)) AS o FROM events GROUP BY ALL)"""


@query(f"""WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts FROM events GROUP BY ALL), {_STATE.format(n='d1', every='1 day')}, {_STATE.format(n='h4', every='4 hours')}, x AS (SELECT b.symbol, b.bar_ts, sign(d1.c - d1.o) AS day FROM b ASOF LEFT JOIN d1 ON b.symbol = d1.symbol AND b.bar_ts >= d1.bar_ts),
y AS (SELECT x.*, sign(h4.c - h4.o) AS four FROM x ASOF LEFT JOIN h4 ON x.symbol = h4.symbol AND x.bar_ts >= h4.bar_ts), z AS (SELECT *, CAST(2 * day + four AS INT) AS composite FROM y)
SELECT symbol, bar_ts, composite, CASE WHEN composite >= 3 THEN 'bull' WHEN composite <= -3 THEN 'bear' WHEN composite IS NULL THEN 'unknown' ELSE 'mixed' END AS regime FROM z""")
def w19_composite_regime(spark, d):
    """The states of the last closed day and of the last closed four hours at each hourly bar, the day's counting twice."""
    ticks = table(spark, d, "events")
    hours = B.resample(ticks, "1 hour").select("symbol", "bar_ts")

    def closed(every: str, name: str):
        bars_ = B.resample(ticks, every)
        return bars_.select("symbol", (F.col("bar_ts") + F.expr(f"interval {every}")).alias("bar_ts"), F.signum(F.col("c") - F.col("o")).alias(name))

    day, four = B.as_of(hours, closed("1 day", "day"), "day"), B.as_of(hours, closed("4 hours", "four"), "four")
    composite = (2 * F.col("day") + F.col("four")).cast("int")
    x = day.join(four, ["symbol", "bar_ts"]).select("symbol", "bar_ts", composite.alias("composite"))
    return x.withColumn("regime", F.when(F.col("composite") >= 3, "bull").when(F.col("composite") <= -3, "bear").when(F.col("composite").isNull(), "unknown").otherwise("mixed"))
