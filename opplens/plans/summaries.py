"""Queries that summarise: grouped statistics, vocabularies, missing values, priors, quality checks, drift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opplens.functions import scalars as S
from opplens.operators.features import exact_quantiles

from .registry import query, rounded, table


@query("SELECT coalesce(lang, 'NULL') AS lang, count(*) AS n, max(strlen(text)) AS longest, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (n_chars > 500) AS long, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def a4_a7_sizes(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("NULL")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("longest"), F.sum(size).alias("bytes"), F.count_if(F.col("n_chars") > 500).alias("long"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""WITH x AS (SELECT year(l_shipdate) AS y, l_returnflag AS side, l_extendedprice * (l_discount - 0.05) AS p FROM lineitem), g AS (SELECT y, side FROM (SELECT DISTINCT y FROM x), (SELECT DISTINCT side FROM x))
SELECT y, side, count(p) AS trades, round(coalesce(sum(p), 0), 4) AS net, count(p) >= 30 AS adequate FROM g LEFT JOIN x USING (y, side) GROUP BY ALL""")
def a12_a18_dense_grid(spark, d):
    """Every year has every side; the grid is made from the two short lists of values."""
    x = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("side"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("p"))
    by = x.groupBy("y", "side").agg(F.count("p").alias("trades"), F.sum("p").alias("net"))
    listed = by.withColumn("sides", F.collect_set("side").over(Window.partitionBy(F.lit(1))))  # one row a year and side
    grid = listed.select("y", F.explode("sides").alias("side")).distinct()
    out = grid.join(by, ["y", "side"], "left").select("y", "side", F.coalesce("trades", F.lit(0)).alias("trades"), F.round(F.coalesce("net", F.lit(0.0)), 4).alias("net"))
    return out.withColumn("adequate", F.col("trades") >= 30)


@query("""WITH x AS (SELECT l_returnflag AS flag, 'quantity' AS dimension, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS bucket, l_tax FROM lineitem UNION ALL SELECT l_returnflag, 'discount', CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END, l_tax FROM lineitem)
SELECT coalesce(flag, 'ALL') AS flag, dimension, bucket, count(*) AS n, round(avg(l_tax), 6) AS mean FROM x GROUP BY GROUPING SETS ((flag, dimension, bucket), (dimension, bucket))""")
def a9_a15_dimensions(spark, d):
    """Bucket columns unpivoted, then grouped at two levels."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), S.ladder(F.col("l_quantity"), [10, 30], ["low", "mid", "high"]).alias("quantity"), S.ladder(F.col("l_discount"), [0.03, 0.07], ["low", "mid", "high"]).alias("discount"), "l_tax")
    x = x.unpivot(["flag", "l_tax"], ["quantity", "discount"], "dimension", "bucket")
    out = x.groupingSets([["flag", "dimension", "bucket"], ["dimension", "bucket"]], "flag", "dimension", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_tax"), 6).alias("mean"))
    return out.withColumn("flag", F.coalesce("flag", F.lit("ALL")))


@query("""SELECT source, array_to_string(list_sort(list_distinct(list(upper(trim(lang))))), ',') AS vocabulary, round(avg((doc_id NOT IN (SELECT doc_id FROM labels))::INT), 6) AS unlabelled, count(*) AS n FROM documents GROUP BY source""")
def a22_a23_missing(spark, d):
    """Sorted vocabulary and share of rows without a label."""
    x = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(0).alias("has")), "doc_id", "left")
    return x.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set(F.upper(F.trim("lang")))), ",").alias("vocabulary"), F.round(F.avg(F.coalesce("has", F.lit(1))), 6).alias("unlabelled"), F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT source, quality AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT avg(y) AS all_ FROM x), s AS (SELECT source, avg(y) AS own, count(*) AS n FROM x GROUP BY 1)
SELECT source, n, round(CASE WHEN n >= 20 THEN own ELSE all_ END, 6) AS prior FROM s, g""")
def a25_priors(spark, d):
    """Mean label of each source, the overall mean where support is under 20."""
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    s = x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("y"))
    w = Window.partitionBy(F.lit(1))  # one row a source
    s = s.withColumn("all", F.sum("y").over(w) / F.sum("n").over(w))
    return s.select("source", "n", F.round(F.when(F.col("n") >= 20, F.col("y") / F.col("n")).otherwise(F.col("all")), 6).alias("prior"))


@query("SELECT event_type, list_sort(list(value))[((count(*) - 1) * 50 // 100 + 1)::INT] AS p50, list_sort(list(value))[((count(*) - 1) * 95 // 100 + 1)::INT] AS p95, max(value) AS top, count(*) AS n FROM events GROUP BY 1")
def a30_lower_quantiles(spark, d):
    """The lower-index quantile by the places of distinct values."""
    x = table(spark, d, "events").select("event_type", "value")
    top = x.groupBy("event_type").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    return exact_quantiles(x, "value", {"p50": ("lower", 0.5), "p95": ("lower", 0.95)}, ["event_type"]).join(top, "event_type")


@query("""SELECT l_suppkey, round(list_sum(list_sort(list(l_extendedprice), 'DESC')[1:3]) / sum(l_extendedprice) * 100, 6) AS top3 FROM lineitem GROUP BY 1""")
def o4_top3_share(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))
    x = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", F.row_number().over(w).alias("k"))
    return x.groupBy("l_suppkey").agg(F.round(F.sum(F.when(F.col("k") <= 3, F.col("l_extendedprice"))) / F.sum("l_extendedprice") * 100, 6).alias("top3"))


@query("""SELECT o_orderkey, count(*) AS n, CASE WHEN count(DISTINCT o_custkey) > 1 THEN 'COLLISION' ELSE 'OK' END AS identity, sha256(string_agg(sha256(o_custkey || '|' || o_orderstatus), '' ORDER BY sha256(o_custkey || '|' || o_orderstatus))) AS fingerprint FROM orders GROUP BY 1""")
def c3_c5_fingerprints(spark, d):
    """Identity collisions and a fingerprint that does not depend on row order."""
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus"), 256).alias("h"))
    return x.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.when(F.count_distinct("o_custkey") > 1, "COLLISION").otherwise("OK").alias("identity"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("fingerprint"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_quantity IS NULL) AS a, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS b, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS c, count(*) FILTER (l_extendedprice < 2000) AS e FROM lineitem)
SELECT t.name, t.severity, t.broken, t.broken = 0 AS passed FROM c, LATERAL (VALUES ('quantity', 'ERROR', a), ('discount', 'ERROR', b), ('flag', 'FATAL', c), ('cheap', 'WARN', e)) t(name, severity, broken)""")
def q1_q7_quality(spark, d):
    """Named checks with severity from one pass over the rows."""
    checks = [("quantity", "ERROR", F.col("l_quantity").isNull()), ("discount", "ERROR", ~F.col("l_discount").between(0, 1)), ("flag", "FATAL", ~F.col("l_returnflag").isin("A", "N", "R")), ("cheap", "WARN", F.col("l_extendedprice") < 2000)]
    one = table(spark, d, "lineitem").agg(*[F.count_if(broken).alias(name) for name, _, broken in checks])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.col(n).alias("broken")) for n, s, _ in checks])
    return one.select(F.inline(rows)).withColumn("passed", F.col("broken") == 0)


@query("""WITH a AS (SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE year(l_shipdate) < 1996), b AS (SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE year(l_shipdate) >= 1996),
sa AS (SELECT f, quantile_cont(q, 0.1) AS a1, quantile_cont(q, 0.5) AS a5, quantile_cont(q, 0.9) AS a9 FROM a GROUP BY 1), sb AS (SELECT f, quantile_cont(q, 0.1) AS b1, quantile_cont(q, 0.5) AS b5, quantile_cont(q, 0.9) AS b9 FROM b GROUP BY 1), s AS (SELECT f, greatest(abs(b1 - a1), abs(b5 - a5), abs(b9 - a9)) / greatest(abs(a9 - a1), 1e-12) AS x FROM sa JOIN sb USING (f))
SELECT f AS flag, round(x, 6) AS shift, CASE WHEN x >= 0.25 THEN 'HIGH' WHEN x >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""")
def d1_drift(spark, d):
    """Largest shift of three quantiles between two periods, in units of the first one's spread."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.year("l_shipdate") < 1996, "a").otherwise("b").alias("period"), "l_quantity")
    q = exact_quantiles(x, "l_quantity", {"q1": ("linear", 0.1), "q5": ("linear", 0.5), "q9": ("linear", 0.9)}, ["flag", "period"])
    side = lambda p: q.where(F.col("period") == p).select("flag", F.array("q1", "q5", "q9").alias(p))
    both = side("a").join(side("b"), "flag")
    shift = F.array_max(F.zip_with("a", "b", lambda a, b: F.abs(b - a))) / F.greatest(F.abs(F.get("a", F.lit(2)) - F.get("a", F.lit(0))), F.lit(1e-12))
    x = both.select("flag", shift.alias("s"))
    return x.select("flag", F.round("s", 6).alias("shift"), F.when(F.col("s") >= 0.25, "HIGH").when(F.col("s") >= 0.1, "MEDIUM").otherwise("LOW").alias("severity"))
