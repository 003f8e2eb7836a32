"""Queries that prepare features, assign regimes, score and measure scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opplens.functions import scalars as S
from opplens.functions.rules import is_close
from opplens.operators import models as M
from opplens.operators.features import _kept, exact_quantiles, running_before

from .registry import query, rounded, table


@query("""WITH s AS (SELECT median(l_quantity) AS mid, avg(l_quantity) AS m, greatest(stddev_pop(l_quantity), 1e-15) AS sd FROM lineitem WHERE year(l_shipdate) < 1996),
x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity END AS q, l_returnflag AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, round((coalesce(q, mid) - m) / sd, 6) AS z, (q IS NULL)::INT AS missing, (f = 'A')::INT AS flag_a, (f = 'R')::INT AS flag_r, (f NOT IN ('A', 'R'))::INT AS flag_other, abs((coalesce(q, mid) - m) / sd) > 1.5 AS far FROM x, s""")
def f3_f5_features(spark, d):
    """Imputed, scaled and one-hot features with the statistics of the training years only, and whether a row is far out."""
    x = table(spark, d, "lineitem")
    train = x.where(F.year("l_shipdate") < 1996)
    s = train.agg(F.avg("l_quantity").alias("m"), F.greatest(F.stddev_pop("l_quantity"), F.lit(1e-15)).alias("sd")).join(F.broadcast(exact_quantiles(train, "l_quantity", {"mid": ("linear", 0.5)})))  # one row each
    x = x.withColumn("q", F.when(~(F.col("l_tax") > 0.07), F.col("l_quantity"))).join(F.broadcast(s))  # one row
    z = (F.coalesce("q", "mid") - F.col("m")) / F.col("sd")
    flag = F.col("l_returnflag")
    return x.select("l_orderkey", "l_linenumber", F.round(z, 6).alias("z"), F.col("q").isNull().cast("int").alias("missing"), (flag == "A").cast("int").alias("flag_a"), (flag == "R").cast("int").alias("flag_r"), (~flag.isin("A", "R")).cast("int").alias("flag_other"), (F.abs(z) > 1.5).alias("far"))


@query("""WITH t AS (SELECT quantile_cont(value, 1.0/3) AS lo, quantile_cont(value, 2.0/3) AS hi, quantile_cont(value, 0.95) AS top FROM events WHERE ts < TIMESTAMP '2024-01-15'),
x AS (SELECT user_id, ts, event_id, CASE WHEN value >= top THEN 'extreme' WHEN value >= hi THEN 'high' WHEN value >= lo THEN 'normal' ELSE 'low' END AS regime FROM events, t), y AS (SELECT *, lag(regime) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM x)
SELECT regime, count(*) AS n, count(*) FILTER (before <> regime) AS entered FROM y GROUP BY 1""")
def r1_r2_a24_regimes(spark, d):
    """Thresholds from the training period, assigned to all rows, with transitions."""
    e = table(spark, d, "events")
    t = exact_quantiles(e.where("ts < timestamp_ntz'2024-01-15'"), "value", {"lo": ("linear", 1 / 3), "hi": ("linear", 2 / 3), "top": ("linear", 0.95)})
    x = e.join(F.broadcast(t)).withColumn("regime", F.when(F.expr("value >= top"), "extreme").when(F.expr("value >= hi"), "high").when(F.expr("value >= lo"), "normal").otherwise("low"))  # one row
    x = x.withColumn("before", F.lag("regime").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return x.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("regime")).alias("entered"))


@query("""SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, round(avg((p - y) * (p - y)), 8) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss FROM (SELECT event_type, least(greatest(1 / (1 + exp(-(value - 50) / 50)), 1e-12), 1 - 1e-12) AS p, (user_id % 2)::DOUBLE AS y FROM events) GROUP BY ROLLUP (event_type)""")
def m5_m7_probability_metrics(spark, d):
    x = table(spark, d, "events").select("event_type", M.sigmoid((F.col("value") - 50) / 50).alias("p"), (F.col("user_id") % 2).cast("double").alias("y"))
    out = x.rollup("event_type").agg(*M.probability_metrics(F.col("p"), F.col("y")))
    return rounded(out.withColumn("event_type", F.coalesce("event_type", F.lit("ALL"))), "brier", "log_loss", places=8)


@query("""WITH x AS (SELECT least(value / 300, 1) AS p, user_id % 2 AS y FROM events), b AS (SELECT least(greatest(CAST(floor(p * 10) AS INT), 0), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM x GROUP BY 1)
SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(sum(n * abs(mean_p - rate)) OVER () / sum(n) OVER (), 6) AS ece FROM b""")
def m5_calibration(spark, d):
    x = table(spark, d, "events").select(F.least(F.col("value") / 300, F.lit(1.0)).alias("p"), (F.col("user_id") % 2).alias("y"))
    b = x.groupBy(S.probability_bin(F.col("p"), 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    w = Window.partitionBy(F.lit(1))  # ten rows
    return rounded(b.withColumn("ece", F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))).over(w) / F.sum("n").over(w)), "mean_p", "rate", "ece")


@query("""WITH x AS (SELECT l_returnflag AS flag, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY flag ORDER BY a) + (count(*) OVER (PARTITION BY flag, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY flag ORDER BY b) + (count(*) OVER (PARTITION BY flag, b) - 1) / 2 AS rb FROM x)
SELECT flag, count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(median(abs(a - b)), 6) AS median_error, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY 1""")
def m6_regression_metrics(spark, d):
    """Errors by group and the rank correlation, ties at their mean rank. Equal rows are counted first, and all else is made from the counts."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    x = _kept(x.groupBy("flag", "a", "b").agg(F.count(F.lit(1)).alias("k")))
    size = x.groupBy("flag").agg(F.sum("k").alias("size"))  # a row a flag

    def ranks(c: str):
        by = running_before(x.groupBy("flag", c).agg(F.sum("k").alias("times")), c, "times", "below", group=["flag"]).join(F.broadcast(size), "flag")
        # from the middle rank, so that sums of squares stay exact where ranks are all one
        return by.select("flag", c, (F.col("below") + (F.col("times") + 1) / 2 - (F.col("size") + 1) / 2).alias(f"r{c}"))

    k, miss, n = F.col("k"), F.abs(F.col("a") - F.col("b")), F.sum("k")
    total = lambda c: F.sum(c * k)
    both = lambda p, q: total(F.col(p) * F.col(q)) - total(F.col(p)) * total(F.col(q)) / n
    ranked = x.join(ranks("a"), ["flag", "a"]).join(ranks("b"), ["flag", "b"])
    out = ranked.groupBy("flag").agg(n.alias("n"), (total(miss) / n).alias("mae"), F.sqrt(total(miss * miss) / n).alias("rmse"), F.try_divide(both("ra", "rb"), F.sqrt(both("ra", "ra") * both("rb", "rb"))).alias("spearman"))
    out = out.join(exact_quantiles(x.withColumn("miss", miss), "miss", {"median_error": ("linear", 0.5)}, ["flag"], times="k"), "flag")
    return rounded(out, "mae", "rmse", "median_error", "spearman")


@query("""WITH x AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my FROM x)
SELECT round(my - mx * sxy / (sxx + 1), 5) AS intercept, round(sxy / (sxx + 1), 6) AS slope FROM s""")
def m2_ridge(spark, d):
    w = M.fit_ridge(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")), ["x"], "y")
    return spark.range(1).select(F.round(F.lit(float(w[0])), 5).alias("intercept"), F.round(F.lit(float(w[1])), 6).alias("slope"))


@query("""WITH p AS (SELECT o_orderkey AS k, o_totalprice / 3 AS s FROM orders), r AS (SELECT o_orderkey AS k, round(o_totalprice / 3, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 9 END) AS s FROM orders WHERE o_orderkey % 11 > 0)
SELECT CASE WHEN r.k IS NULL THEN 'MISSING' WHEN abs(p.s - r.s) <= 1e-8 THEN 'SAME' ELSE 'DIFFERENT' END AS parity, count(*) AS n FROM p LEFT JOIN r USING (k) GROUP BY 1""")
def d2_j17_parity(spark, d):
    """Scores compared with a replay of them within a tolerance; the replay lacks some rows and rounds others."""
    o = table(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 3).alias("s"))
    r = o.where("o_orderkey % 11 > 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 == 0, F.round(F.col("o_totalprice") / 3, 1)).otherwise(F.round(F.col("o_totalprice") / 3, 9)).alias("t"))
    kind = F.when(F.col("t").isNull(), "MISSING").when(is_close(F.col("s"), F.col("t"), 1e-8), "SAME").otherwise("DIFFERENT")
    return p.join(r, "k", "left").groupBy(kind.alias("parity")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT source, CASE WHEN quality IS NULL THEN 'UNRESOLVED' WHEN quality = 1 AND toxic = 1 THEN 'CONTRADICTORY' WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS label, count(*) AS n FROM x GROUP BY ALL""")
def l1_l2_j10_labels(spark, d):
    """Labels with abstention: what is not known or contradicts itself gets no class."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    label = F.when(F.col("quality").isNull(), "UNRESOLVED").when(F.expr("quality = 1 and toxic = 1"), "CONTRADICTORY").when(F.col("quality") == 1, "GOOD").otherwise("BAD")
    return x.groupBy("source", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
