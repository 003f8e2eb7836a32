"""Queries over raw fields: parsing, identifiers, contracts, HTML tables, keyed sinks, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opplens.functions import rules as R
from opplens.functions import scalars as S
from opplens.sources import files

from .registry import QUERIES, query, table


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' ELSE props END AS raw, CASE event_id % 4 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' ELSE event_type END AS flag, value FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value END AS number, CASE WHEN event_id % 4 IN (0, 2) THEN true WHEN event_id % 4 = 1 THEN false END AS ok, (event_id % 5 IN (2, 3, 4))::INT + (event_id % 4 = 3)::INT AS bad FROM x""")
def p1_p3_typed_fields(spark, d):
    raw = table(spark, d, "events").select("event_id", F.expr("case event_id % 5 when 0 then ' ' || value || ' ' when 1 then '' when 2 then 'nan' when 3 then 'inf' else props end as number"), F.expr("case event_id % 4 when 0 then ' TRUE' when 1 then 'no' when 2 then '1' else event_type end as ok"))
    return files.normalise_fields(raw, ("number",), ("ok",)).select("event_id", "number", "ok", F.size("bad_fields").alias("bad"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 OR event_id % 7 = 0 THEN NULL WHEN event_id % 6 IN (1, 3) THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS at FROM events")
def p4_p5_timestamps(spark, d):
    """Times written in five formats and one broken one, read back and held against an epoch, which is wrong for some."""
    e = table(spark, d, "events")
    forms = [F.date_format("ts", f) for f in R.TIME_FORMATS]
    text = F.coalesce(*[F.when(F.col("event_id") % 6 == i, f) for i, f in enumerate(forms)], F.lit("soon"))
    shown = F.when(F.col("event_id") % 6 == 1, F.date_trunc("minute", "ts")).when(F.col("event_id") % 6 == 3, F.date_trunc("minute", "ts")).otherwise(F.date_trunc("second", "ts"))
    epoch = F.unix_seconds(shown.cast("timestamp")) + F.when(F.col("event_id") % 7 == 0, 3600).otherwise(0)
    return e.select("event_id", R.timestamp_of(text, epoch=epoch).alias("at"))


@query("""SELECT p_partkey, CASE WHEN regexp_full_match(upper(trim(p_brand)), '[A-Z0-9._-]+') THEN upper(trim(p_brand)) END AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'H1' WHEN 1 THEN 'M15' END AS timeframe, CASE p_partkey % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' END AS side,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256(p_name) AS digest FROM part""")
def p6_p8_identifiers(spark, d):
    raw = table(spark, d, "part").withColumn("t", F.expr("case p_partkey % 3 when 0 then ' 1H ' when 1 then 'm15' else 'fortnight' end")).withColumn("s", F.expr("case p_partkey % 3 when 0 then 'buy' when 1 then ' Short' else 'flat' end"))
    return raw.select("p_partkey", R.symbol(F.col("p_brand")).alias("symbol"), R.timeframe(F.col("t")).alias("timeframe"), R.side(F.col("s")).alias("side"), S.slug(F.col("p_name")).alias("slug"), F.sha2("p_name", 256).alias("digest"))


@query("""SELECT coalesce(CASE WHEN NOT o_totalprice > 1000 THEN 'PRICE' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'STATUS' WHEN year(o_orderdate) < 1995 THEN 'TOO_OLD' END, 'ACCEPTED') AS reason, count(*) AS n,
  CAST(sum((NOT o_totalprice > 1000)::INT + (o_orderstatus NOT IN ('F', 'O'))::INT + (year(o_orderdate) < 1995)::INT) AS BIGINT) AS broken FROM orders GROUP BY 1""")
def p18_p20_contract(spark, d):
    """First reason and number of all reasons, counted by reason."""
    rules = {"PRICE": F.col("o_totalprice") > 1000, "STATUS": F.col("o_orderstatus").isin("F", "O"), "TOO_OLD": F.year("o_orderdate") >= 1995}
    x = table(spark, d, "orders").select(F.coalesce(R.first_reason(rules), F.lit("ACCEPTED")).alias("reason"), F.size(R.all_reasons(rules)).alias("k"))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("broken"))


@query("""SELECT CASE WHEN year(o_orderdate + INTERVAL 25 YEARS) BETWEEN 2019 AND 2022 THEN 'development' WHEN year(o_orderdate + INTERVAL 25 YEARS) IN (2023, 2024) THEN 'validation' WHEN year(o_orderdate + INTERVAL 25 YEARS) >= 2025 THEN 'oos' ELSE 'other' END AS fold,
  strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders GROUP BY ALL""")
def p21_b10_a32_folds(spark, d):
    x = table(spark, d, "orders").select(R.fold(F.expr("o_orderdate + interval 25 years")).alias("fold"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus")
    return x.groupBy("fold", "month").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))


_TITLE = "regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"
for _name, _value in files.ENTITIES.items():
    _TITLE = f"replace({_TITLE}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"


@query(f"""SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages""")
def s8_titles(spark, d):
    return table(spark, d, "pages").select("page_id", files.title(F.col("html")).alias("title"))


#: A report page for each order, with labels and values in cells, entities, nested marks, unclosed cells and a heading row.
_REPORT = """concat('<html><head><title>x</title></head><body><TABLE border=1><tr><th>Label:</th><tr><td>Order:</td><td>  <b>', CAST(o_orderkey AS VARCHAR(20)), '</b></td><td nowrap>Customer  key:<td>', CAST(o_custkey AS VARCHAR(20)), '</tr><tr><td>State:</td><td>', o_orderstatus, ' &amp; ', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'more' END, '</td></tr><tr><td>', o_orderpriority, '</td><td>alone:</td></tr></TABLE></body>')"""


@query("""SELECT o_orderkey, label, value FROM orders, LATERAL (VALUES ('Label', NULL), ('Order', CAST(o_orderkey AS VARCHAR)), ('Customer key', CAST(o_custkey AS VARCHAR)), ('State', o_orderstatus || CASE WHEN o_custkey % 3 = 0 THEN ' &' ELSE ' & more' END), ('alone', NULL)) AS t(label, value)""")
def s9_s10_report_values(spark, d):
    """The labelled values of report pages."""
    pages = table(spark, d, "orders").select("o_orderkey", F.expr(_REPORT).alias("html"))
    return files.labelled_values(files.html_tables(pages, "o_orderkey"), "o_orderkey").select("o_orderkey", "label", "value")


def s9_s10_html_cells(spark, d):
    """Cells of the table rows of all pages with the labels among them: no SQL, a small test holds it."""
    t = files.html_tables(table(spark, d, "pages"), "page_id")
    return t.groupBy("page_id").agg(F.count(F.lit(1)).alias("table_rows"), F.sum(F.size("cells")).alias("cells"))


@query("""WITH new AS (SELECT o_orderkey + 10 AS o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT * FROM new UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)) GROUP BY 1""")
def s18_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 10).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return files.upsert(o, new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def s19_o5_o6_latest(spark, d):
    return files.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def s20_j6_j7_unseen(spark, d):
    return files.unseen(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, count(*) AS common, round(count(*) / (SELECT count(*) FROM a), 6) AS precision, round(count(*) / (SELECT count(*) FROM b), 6) AS recall FROM a JOIN b USING (k)""")
def o7_o11_sets(spark, d):
    """Sizes and overlap of two sets by one aggregation of their union."""
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    a, b, both = F.count_if("f"), F.count_if("o"), F.count_if(F.expr("f and o"))
    return o.agg(a.alias("a"), b.alias("b"), both.alias("common"), F.round(both / a, 6).alias("precision"), F.round(both / b, 6).alias("recall"))


@query("""WITH a AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, l_quantity AS q FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.s, b.s) AS s, count(*) AS n, count(*) FILTER (a.q = b.q) AS same, count(*) FILTER (b.i IS NULL) AS only_a, count(*) FILTER (a.i IS NULL) AS only_b FROM a FULL JOIN b ON a.s = b.s AND a.i = b.i GROUP BY 1""")
def j16_q11_positional(spark, d):
    """Two ordered sequences compared place by place."""
    w = Window.partitionBy("s").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    x = table(spark, d, "lineitem").withColumn("s", F.col("l_suppkey"))
    one = lambda flag, q: x.where(F.col("l_returnflag") == flag).select("s", F.row_number().over(w).alias("i"), F.col("l_quantity").alias(q))
    both = one("A", "a").join(one("R", "b"), ["s", "i"], "full")
    return both.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


QUERIES["s9_s10_html_cells"] = s9_s10_html_cells
