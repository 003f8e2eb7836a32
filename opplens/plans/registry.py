"""All queries of the analytics operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opplens.functions import scalars as S
from opplens.operators import bars as B
from opplens.operators import study as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(table(spark, d, "events"), "1 hour")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
  arg_max(value, (ts, event_id)) AS c, count(*) AS vol FROM events GROUP BY ALL)"""


@query(f"WITH {BARS} SELECT * FROM bars")
def t13_bars(spark, d):
    return hourly(spark, d)


@query(f"""WITH {BARS}, x AS (SELECT *, lag(c) OVER w AS p, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
y AS (SELECT *, abs(c - p) AS move, CASE WHEN p IS NOT NULL THEN greatest(h - l, abs(h - p), abs(l - p)) ELSE h - l END AS tr, CASE WHEN p > 0 AND c > 0 THEN ln(c / p) END AS r FROM x)
SELECT symbol, bar_ts, CASE WHEN k >= 14 THEN round(avg(tr) OVER w14, 6) END AS atr, CASE WHEN k >= 20 THEN round(avg(c) OVER w20, 6) END AS sma,
  CASE WHEN k >= 20 THEN round(stddev_pop(c) OVER w20, 6) END AS sd, CASE WHEN count(r) OVER w20 = 20 THEN round(stddev_pop(r) OVER w20, 6) END AS return_sd,
  CASE WHEN count(move) OVER w20 = 20 THEN round(CASE WHEN sum(move) OVER w20 < 1e-12 THEN 0 ELSE abs(c - lag(c, 20) OVER w) / sum(move) OVER w20 END, 6) END AS efficiency,
  CASE WHEN k > 20 THEN vol >= 1.5 * avg(vol) OVER b20 END AS spike, min(l) OVER w10 AS swing_low, max(h) OVER w10 AS swing_high
FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts), w10 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 9 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 13 PRECEDING),
  w20 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 19 PRECEDING), b20 AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def w2_w17_indicators(spark, d):
    x = hourly(spark, d).withColumn("k", F.row_number().over(B.ordered())).withColumn("move", F.abs(F.col("c") - F.lag("c").over(B.ordered()))).withColumn("tr", B.true_range()).withColumn("r", B.log_return())
    x = x.withColumn("tr", F.coalesce("tr", F.col("h") - F.col("l")))
    out = x.select("symbol", "bar_ts", B.rolling_mean(F.col("tr"), 14).alias("atr"), B.rolling_mean(F.col("c"), 20).alias("sma"), B.rolling_std(F.col("c"), 20).alias("sd"), B.rolling_std(F.col("r"), 20).alias("return_sd"), B.efficiency(20).alias("efficiency"),
                   F.when(F.col("k") > 20, F.col("vol") >= 1.5 * F.avg("vol").over(B.before(20))).alias("spike"), F.min("l").over(B.last(10)).alias("swing_low"), F.max("h").over(B.last(10)).alias("swing_high"))
    return rounded(out, "atr", "sma", "sd", "return_sd", "efficiency")


@query(f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS k, list(c) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS past,
  list(c) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 8 PRECEDING) AS nine FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))
SELECT symbol, bar_ts, CASE WHEN k > 48 THEN len(list_filter(past, lambda v: v <= c)) * 100.0::DOUBLE / 48 END AS rank,
  CASE WHEN k >= 9 THEN round(list_sum(list_transform(nine, lambda v, i: v * i)) / 45, 6) END AS wma FROM x""")
def w4_w8_rank_and_weighted_mean(spark, d):
    return rounded(hourly(spark, d).select("symbol", "bar_ts", B.percent_rank_before("c", 48).alias("rank"), B.weighted_mean("c", 9).alias("wma")), "wma")


@query(f"""WITH {BARS}, x AS (SELECT *, c > o AS up, row_number() OVER w AS k, lag(c > o) OVER w AS before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
y AS (SELECT *, up AND NOT coalesce(before, false) AS edge FROM x)
SELECT symbol, bar_ts, edge, CAST(sum(edge::INT) OVER w AS BIGINT) AS generation, CAST(coalesce(greatest(5 - (k - max(CASE WHEN edge THEN k END) OVER w), 0), 0) AS INT) AS armed
FROM y WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)""")
def w21_w22_w42_edges(spark, d):
    x = hourly(spark, d).withColumn("up", F.col("c") > F.col("o")).withColumn("edge", B.rising_edge(F.col("up")))
    return x.select("symbol", "bar_ts", "edge", F.sum(F.col("edge").cast("int")).over(B.ordered()).alias("generation"), B.armed(F.col("edge"), 5).cast("int").alias("armed"))


@query(f"""WITH {BARS}, days AS (SELECT event_type AS symbol, date_trunc('day', ts) AS bar_ts, arg_max(value, (ts, event_id)) AS day_close FROM events GROUP BY ALL)
SELECT b.symbol, b.bar_ts, d.day_close FROM bars b ASOF LEFT JOIN days d ON b.symbol = d.symbol AND b.bar_ts >= d.bar_ts + INTERVAL 1 DAY""")
def j15_as_of_timeframe(spark, d):
    days = B.resample(table(spark, d, "events"), "1 day").select("symbol", (F.col("bar_ts") + F.expr("interval 1 day")).alias("bar_ts"), F.col("c").alias("day_close"))
    return B.as_of(hourly(spark, d), days, "day_close")


STUDY = f"""{BARS}, n AS (SELECT *, row_number() OVER w AS k, CASE WHEN row_number() OVER w >= 20 THEN avg(c) OVER w20 END AS mean, CASE WHEN row_number() OVER w >= 20 THEN stddev_pop(c) OVER w20 END AS sd
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts), w20 AS (PARTITION BY symbol ORDER BY bar_ts ROWS 19 PRECEDING)),
z AS (SELECT *, CASE WHEN sd > 1e-12 THEN (c - mean) / sd END AS z FROM n), hot AS (SELECT *, coalesce(abs(z) >= 1, false) AS hot FROM z),
signals AS (SELECT symbol, bar_ts, k, CASE WHEN z > 0 THEN 'SHORT' ELSE 'LONG' END AS side, c AS entry, sd AS risk FROM hot QUALIFY hot AND NOT coalesce(lag(hot) OVER (PARTITION BY symbol ORDER BY bar_ts), false)),
pairs AS (SELECT s.symbol, s.bar_ts, side, b.k - s.k AS age, CASE WHEN side = 'LONG' THEN h - entry ELSE entry - l END / risk AS good, CASE WHEN side = 'LONG' THEN l - entry ELSE entry - h END / risk AS bad,
  CASE WHEN side = 'LONG' THEN b.c - entry ELSE entry - b.c END / risk AS moved FROM signals s JOIN n b ON s.symbol = b.symbol AND b.k > s.k AND b.k <= s.k + 12),
study AS (SELECT symbol, bar_ts, side, greatest(0, max(good)) AS mfe_r, least(0, min(bad)) AS mae_r, min(age) FILTER (good >= 1) AS plus, min(age) FILTER (bad <= -1) AS minus, count(*) AS bars,
  max(moved) FILTER (age = 6) AS return_6, max(moved) FILTER (age = 12) AS return_12 FROM pairs GROUP BY ALL),
hits AS (SELECT *, CASE WHEN plus IS NULL AND minus IS NULL THEN 'NONE' WHEN plus = minus THEN 'AMBIGUOUS' WHEN minus IS NULL OR plus < minus THEN 'PLUS_1R' ELSE 'MINUS_1R' END AS first_hit FROM study)"""


@query(f"""WITH {STUDY} SELECT symbol, side, count(*) AS events, count(*) FILTER (first_hit = 'PLUS_1R') AS plus, count(*) FILTER (first_hit = 'MINUS_1R') AS minus,
  count(*) FILTER (first_hit IN ('PLUS_1R', 'MINUS_1R')) AS resolved, round(count(*) FILTER (first_hit = 'PLUS_1R') / nullif(count(*) FILTER (first_hit IN ('PLUS_1R', 'MINUS_1R')), 0), 6) AS rate,
  round(median(mfe_r), 6) AS median_mfe, round(median(mae_r), 6) AS median_mae, round(avg(return_6), 6) AS mean_6, round(avg(return_12), 6) AS mean_12 FROM hits GROUP BY ALL""")
def event_study(spark, d):
    rows = hourly(spark, d)
    done = E.first_touch(E.signals(rows), rows)
    out = done.groupBy("symbol", "side").agg(*E.hit_metrics(), F.median("mfe_r").alias("median_mfe"), F.median("mae_r").alias("median_mae"), F.avg("return_6").alias("mean_6"), F.avg("return_12").alias("mean_12"))
    return rounded(out, "rate", "median_mfe", "median_mae", "mean_6", "mean_12")


@query("""SELECT year(o_orderdate) AS y, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first, max(o_orderdate) AS last
FROM orders GROUP BY GROUPING SETS ((y, status), (y), ())""")
def a1_a11_grouping_sets(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status"), "o_totalprice", "o_custkey", "o_orderdate")
    return o.groupingSets([["y", "status"], ["y"], []], "y", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1""")
def a3_duplicates(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= 1000 GROUP BY 1""")
def j1_inner_joins(spark, d):
    return table(spark, d, "orders").where("o_totalprice >= 1000").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5_orphans(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT l_returnflag AS side, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 6) AS linear, quantile_disc(l_extendedprice, 0.95) AS nearest,
  round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1""")
def a19_a21_quantiles(spark, d):
    from opplens.operators.features import exact_quantiles

    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), "l_quantity", "l_extendedprice")
    out = x.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("sd"))
    out = out.join(exact_quantiles(x, "l_quantity", {"med": ("linear", 0.5)}, ["side"]), "side").join(exact_quantiles(x, "l_extendedprice", {"linear": ("linear", 0.9), "nearest": ("nearest", 0.95)}, ["side"]), "side")
    return rounded(out, "mean", "med", "linear", "sd")


@query("""WITH x AS (SELECT l_suppkey AS position, l_extendedprice * (l_discount - 0.05) AS profit FROM lineitem)
SELECT position, count(*) AS trades, round(sum(profit), 4) AS net, round(CASE WHEN sum(greatest(-profit, 0)) > 0 THEN sum(greatest(profit, 0)) / sum(greatest(-profit, 0)) WHEN sum(greatest(profit, 0)) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS pf FROM x GROUP BY 1""")
def a17_profit_factor(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("position"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("profit"))
    return x.groupBy("position").agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("profit"), 4).alias("net"), F.round(S.profit_factor(F.col("profit")), 6).alias("pf"))


@query("""WITH x AS (SELECT l_suppkey AS position, l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM lineitem),
r AS (SELECT *, sum(v) OVER (PARTITION BY position ORDER BY l_shipdate, l_orderkey, l_linenumber) AS running FROM x),
c AS (SELECT *, coalesce(sum((running = 0)::INT) OVER (PARTITION BY position ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cycle FROM r)
SELECT position, CAST(cycle AS BIGINT) AS cycle, count(*) AS deals, min(l_shipdate) AS opened, max(l_shipdate) AS closed FROM c GROUP BY ALL""")
def w29_cycles(spark, d):
    x = table(spark, d, "lineitem").withColumn("position", F.col("l_suppkey"))
    out = E.cycles(x, "position", ["l_shipdate", "l_orderkey", "l_linenumber"], F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1))
    return out.groupBy("position", "cycle").agg(F.count(F.lit(1)).alias("deals"), F.min("l_shipdate").alias("opened"), F.max("l_shipdate").alias("closed"))


@query("""SELECT event_id, user_id, max(value) OVER w AS peak, max(value) OVER w - value AS drawdown, lag(event_type) OVER w IS DISTINCT FROM event_type AS changed, row_number() OVER w AS ordinal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w30_w33_w34_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.max("value").over(run).alias("peak"), (F.max("value").over(run) - F.col("value")).alias("drawdown"), (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).alias("changed"), F.row_number().over(w).alias("ordinal"))


@query("""SELECT a.vec_id AS q, b.vec_id AS n, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1] - p[2])::DOUBLE * (p[1] - p[2])::DOUBLE)) / len(a.embedding)), 5) AS distance
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1] - p[2])::DOUBLE * (p[1] - p[2])::DOUBLE)), b.vec_id) <= 5""")
def j12_k1_past_neighbours(spark, d):
    """The five nearest of the earlier vectors of a label."""
    from opplens.operators import similar as N

    e = table(spark, d, "embeddings")
    names = [f"x{k}" for k in range(e.select(F.size("embedding")).first()[0])]
    plain = {"ts": F.col("vec_id"), "symbol": F.col("label"), "side": F.lit("ANY"), "regime": F.lit("UNKNOWN"), "conflict": F.lit(False), "outcome_ts": F.col("vec_id"), "label": F.lit(0), "expected": F.lit(0.0)}
    c = e.select(F.col("vec_id").alias("id"), *[v.alias(n) for n, v in plain.items()], *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    x = N.neighbours(c, c, names, k=5).select(F.col("id").alias("q"), F.explode("near").alias("x"))
    return x.select("q", F.col("x.id").alias("n"), F.round("x.distance", 5).alias("distance"))


@query("""WITH t AS (SELECT ts, dense_rank() OVER (ORDER BY ts) AS k, count(DISTINCT ts) OVER () AS n FROM (SELECT DISTINCT ts FROM events)), c AS (SELECT min(ts) FILTER (k > floor(n * 0.6)) AS a, min(ts) FILTER (k > floor(n * 0.8)) AS b FROM t)
SELECT CASE WHEN ts < a THEN 'TRAIN' WHEN ts < b THEN 'VALIDATION' ELSE 'OOS' END AS split, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events, c GROUP BY 1""")
def f1_f2_temporal_split(spark, d):
    from opplens.operators.features import temporal_split

    return temporal_split(table(spark, d, "events"), "ts").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""WITH x AS (SELECT l.toxic AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM x)
SELECT count(*) AS n, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc FROM r""")
def m5_w31_auc(spark, d):
    from opplens.operators.features import roc_auc

    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("s"))
    return roc_auc(x, "s", "y")


@query("""SELECT l_partkey, l_suppkey, 'opp-' || sha256('part=' || l_partkey || '|supplier=' || l_suppkey) AS canonical, count(*) AS n, CASE WHEN max(l_tax) - min(l_tax) <= 1e-4 THEN round(avg(l_tax), 6) END AS tax,
  CASE WHEN max(l_tax) - min(l_tax) <= 1e-4 THEN 'VALID' ELSE 'CONFLICT' END AS status FROM lineitem GROUP BY ALL""")
def c1_a26_canonical(spark, d):
    same = F.max("l_tax") - F.min("l_tax") <= 1e-4
    key = F.concat(F.lit("opp-"), F.sha2(F.concat(F.lit("part="), F.col("l_partkey"), F.lit("|supplier="), F.col("l_suppkey")), 256))
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.when(same, F.round(F.avg("l_tax"), 6)).alias("tax"), F.when(same, "VALID").otherwise("CONFLICT").alias("status")).withColumn("canonical", key)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS bucket, least(greatest(CAST(floor(l_discount * 10) AS INT), 0), 9) AS bin FROM lineitem""")
def b1_b9_buckets(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.ladder(F.col("l_discount"), [0.03, 0.07], ["low", "mid", "high"]).alias("bucket"), S.probability_bin(F.col("l_discount"), 10).alias("bin"))
