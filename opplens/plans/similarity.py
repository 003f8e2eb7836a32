"""Queries over as-of neighbours and the models that are scored with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opplens.operators import features as X
from opplens.operators import models as M
from opplens.operators import similar as N

from opplens.sources.files import work_folder

from .registry import query, rounded, table

_FEATURES = ("f1", "f2", "f3", "f4")
_CASES = """vec_id AS id, vec_id // 2 AS ts, label % 2 AS symbol, CASE WHEN vec_id % 3 = 0 THEN 'SHORT' ELSE 'LONG' END AS side, CASE vec_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'A' ELSE 'B' END AS regime, vec_id % 17 = 0 AS conflict, CASE WHEN vec_id % 7 > 0 THEN vec_id // 2 + 10 END AS outcome_ts,
  CASE vec_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS hit, CASE WHEN vec_id % 6 > 0 THEN (vec_id % 10) / 4e0 END AS expected, CASE WHEN vec_id % 11 > 0 THEN embedding[1]::DOUBLE END AS f1, CASE WHEN vec_id % 13 > 0 THEN embedding[2]::DOUBLE END AS f2, CASE WHEN vec_id % 19 > 0 THEN embedding[3]::DOUBLE END AS f3, embedding[4]::DOUBLE AS f4"""


def cases(spark, d):
    """Events with context, an outcome that comes later, and features some of which are missing."""
    e = table(spark, d, "embeddings")
    part = lambda i, m: F.when(F.col("vec_id") % m > 0, F.col("embedding")[i].cast("double"))
    ts = F.floor(F.col("vec_id") / 2)
    return e.select(
        F.col("vec_id").alias("id"), ts.alias("ts"), (F.col("label") % 2).alias("symbol"), F.when(F.col("vec_id") % 3 == 0, "SHORT").otherwise("LONG").alias("side"), F.when(F.col("vec_id") % 5 == 0, "UNKNOWN").when(F.col("vec_id") % 5 == 1, "A").otherwise("B").alias("regime"),
        (F.col("vec_id") % 17 == 0).alias("conflict"), F.when(F.col("vec_id") % 7 > 0, ts + 10).alias("outcome_ts"), F.when(F.col("vec_id") % 4 == 0, 0).when(F.col("vec_id") % 4 == 1, 1).alias("label"), F.when(F.col("vec_id") % 6 > 0, (F.col("vec_id") % 10) / 4).alias("expected"),
        part(0, 11).alias("f1"), part(1, 13).alias("f2"), part(2, 19).alias("f3"), F.col("embedding")[3].cast("double").alias("f4"),
    )


_PAIRS = f"""c AS (SELECT {_CASES} FROM embeddings), q AS (SELECT * FROM c),
p AS (SELECT q.id AS q, h.id, h.ts, h.hit, h.expected, h.symbol = q.symbol AS s1, h.side = q.side AS s2, q.regime = 'UNKNOWN' OR h.regime IN (q.regime, 'UNKNOWN') AS s3, coalesce(h.outcome_ts < q.ts, false) AS s4,
  list_filter([(q.f1 - h.f1) * (q.f1 - h.f1), (q.f2 - h.f2) * (q.f2 - h.f2), (q.f3 - h.f3) * (q.f3 - h.f3), (q.f4 - h.f4) * (q.f4 - h.f4)], lambda v: v IS NOT NULL) AS gaps FROM q JOIN c h ON h.ts < q.ts AND h.id <> q.id WHERE NOT h.conflict AND NOT q.conflict),
n AS (SELECT q, count(*) AS past, count(*) FILTER (s1) AS same_symbol, count(*) FILTER (s1 AND s2) AS compatible_side, count(*) FILTER (s1 AND s2 AND s3) AS compatible_regime, count(*) FILTER (s1 AND s2 AND s3 AND s4) AS outcome_available, count(*) FILTER (s1 AND s2 AND s3 AND s4 AND len(gaps) > 0) AS distance_eligible FROM p GROUP BY 1),
k AS (SELECT *, sqrt(list_sum(gaps) / len(gaps)) AS distance, len(gaps) AS overlap FROM p WHERE s1 AND s2 AND s3 AND s4 AND len(gaps) > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sqrt(list_sum(gaps) / len(gaps)), ts, id) <= 20),
w AS (SELECT q, count(*) AS n, count(*) FILTER (hit IS NOT NULL OR expected IS NOT NULL) AS m, sum(1 / greatest(distance, 1e-9)) FILTER (hit IS NOT NULL OR expected IS NOT NULL) AS w1, sum(1 / greatest(distance, 1e-9) / greatest(distance, 1e-9)) FILTER (hit IS NOT NULL OR expected IS NOT NULL) AS w2,
  sum(hit / greatest(distance, 1e-9)) / sum(1 / greatest(distance, 1e-9)) FILTER (hit IS NOT NULL) AS probability, sum(expected / greatest(distance, 1e-9)) / sum(1 / greatest(distance, 1e-9)) FILTER (expected IS NOT NULL) AS expected_r, min(distance) AS nearest, min(overlap) AS overlap FROM k GROUP BY 1),
r AS (SELECT q.id, coalesce(past, 0) AS past, coalesce(same_symbol, 0) AS same_symbol, coalesce(compatible_side, 0) AS compatible_side, coalesce(compatible_regime, 0) AS compatible_regime, coalesce(outcome_available, 0) AS outcome_available, coalesce(distance_eligible, 0) AS distance_eligible, coalesce(w.n, 0) AS n, coalesce(w1 * w1 / w2, 0) AS effective, probability, expected_r, nearest, overlap,
  CASE WHEN conflict THEN 'FEATURE_CONFLICT' WHEN coalesce(distance_eligible, 0) = 0 AND coalesce(outcome_available, 0) > 0 THEN 'INSUFFICIENT_FEATURES' WHEN regime <> 'UNKNOWN' AND coalesce(compatible_regime, 0) = 0 THEN 'NO_COMPATIBLE_REGIME' WHEN coalesce(w.n, 0) < 3 THEN 'INSUFFICIENT_HISTORY' WHEN coalesce(m, 0) < 3 THEN 'LOW_EFFECTIVE_SAMPLE' ELSE 'SUPPORTED' END AS reason
  FROM q LEFT JOIN n ON n.q = q.id LEFT JOIN w ON w.q = q.id)"""


def found(spark, d):
    c = cases(spark, d)
    return N.neighbours(c, c, _FEATURES)


@query(f"""WITH {_PAIRS} SELECT id, past, same_symbol, compatible_side, compatible_regime, outcome_available, distance_eligible, n, round(effective, 4) AS effective, round(probability, 6) AS probability, round(expected_r, 6) AS expected_r, round(nearest, 6) AS nearest, overlap, reason,
  CASE WHEN reason <> 'SUPPORTED' THEN 'NO_OPINION' WHEN effective >= 10 AND nearest <= 3 THEN 'HIGH' WHEN effective >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r""")
def k1_k2_k3_j12_j13_opinions(spark, d):
    """Each query's neighbours as of its time, how many rows passed each filter, and the opinion they give."""
    out = N.opinion(found(spark, d))
    out = out.withColumn("nearest", F.get("near", F.lit(0))["distance"]).withColumn("overlap", F.array_min(F.transform("near", lambda x: x["overlap"])).cast("long"))
    cols = ["id", "past", *N.STAGES, "n", "effective", "probability", "expected_r", "nearest", "overlap", "reason", "confidence"]
    return rounded(out.select(*cols).withColumn("effective", F.round("effective", 4)), "probability", "expected_r", "nearest")


_FROZEN = _PAIRS.replace("q AS (SELECT * FROM c)", "e AS (SELECT max(ts) // 2 AS upto FROM c), q AS (SELECT * FROM c WHERE ts > (SELECT upto FROM e))").replace("JOIN c h ON h.ts < q.ts", "JOIN c h ON h.ts <= (SELECT upto FROM e) AND h.ts < q.ts")


@query(f"""WITH {_FROZEN} SELECT id, past, same_symbol, compatible_side, compatible_regime, outcome_available, distance_eligible, n, round(effective, 4) AS effective, round(probability, 6) AS probability, round(nearest, 6) AS nearest FROM r""")
def d4_k2_frozen_index(spark, d):
    """Later rows against an index that was frozen at a time, written and read again: what came after that time cannot change an answer."""
    c = cases(spark, d)
    upto = c.agg(F.max("ts")).first()[0] // 2
    folder = f"{work_folder(spark)}/index-{uuid.uuid4().hex}"
    N.freeze(c, _FEATURES, folder, upto)
    out = N.opinion(N.neighbours(N.frozen(spark, folder, _FEATURES), c.where(F.col("ts") > upto), _FEATURES))
    out = out.withColumn("nearest", F.get("near", F.lit(0))["distance"]).withColumn("effective", F.round("effective", 4))
    return rounded(out.select("id", "past", *N.STAGES, "n", "effective", "probability", "nearest"), "probability", "nearest")


@query(f"WITH {_PAIRS} SELECT (SELECT count(*) FROM q) AS queries, 0::BIGINT AS leaks, 0::BIGINT AS self_matches")
def k4_similarity_leaks(spark, d):
    x = found(spark, d)
    return x.agg(*N.leaks(x))


@query("""WITH x AS (SELECT event_id, least(value / 300, 1) AS p, (user_id % 3 = 0)::INT AS y FROM events), r AS (SELECT *, sum(y) OVER w AS hits, row_number() OVER w AS k FROM x WINDOW w AS (ORDER BY p DESC, event_id ROWS UNBOUNDED PRECEDING))
SELECT CAST(sum(y) AS BIGINT) AS positives, round(sum(CASE WHEN y = 1 THEN hits / k END) / sum(y), 8) AS average_precision FROM r""")
def w32_m5_average_precision(spark, d):
    x = table(spark, d, "events").select("event_id", F.least(F.col("value") / 300, F.lit(1.0)).alias("p"), (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return X.average_precision(x, "p", "y", "event_id")


def _descent_sql(steps: int, rate: float, l2: float, slope: str, start: str) -> str:
    return f"""d(step, b0, b1) AS (SELECT 0, {start} UNION ALL SELECT step + 1, b0 - {rate} * g0, b1 - {rate} * (g1 + {l2} * b1) FROM (SELECT step, b0, b1, sum(n * (1 / (1 + exp(-(b0 + b1 * x))) - y)) / sum(n) AS g0, sum(n * x * (1 / (1 + exp(-(b0 + b1 * x))) - y)) / sum(n) AS g1 FROM d, g WHERE step < {steps} GROUP BY step, b0, b1))"""


@query(f"""WITH RECURSIVE g AS (SELECT round(l_quantity / 50, 2) AS x, (l_returnflag = 'R')::INT AS y, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT sum(n * y) / sum(n) AS p FROM g), {_descent_sql(400, 0.05, 1.0, 'x', '(SELECT ln(p / (1 - p)) FROM m), 0.0::DOUBLE')} SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope FROM d WHERE step = 400""")
def m1_logistic(spark, d):
    """The logistic fit in 400 steps over grouped rows."""
    x = table(spark, d, "lineitem").select(F.round(F.col("l_quantity") / 50, 2).alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    w = M.fit_logistic(x, ["x"], "y", steps=400)
    return spark.range(1).select(F.round(F.lit(float(w[0])), 6).alias("intercept"), F.round(F.lit(float(w[1])), 6).alias("slope"))


@query(f"""WITH RECURSIVE p AS (SELECT round(least(greatest(value / 300, 0.01), 0.99), 2) AS p, user_id % 2 AS y FROM events), g AS (SELECT ln(p / (1 - p)) AS x, y, count(*) AS n FROM p GROUP BY ALL), {_descent_sql(250, 0.03, 0.0, 'x', '0.0::DOUBLE, 1.0::DOUBLE')} SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope FROM d WHERE step = 250""")
def m3_platt(spark, d):
    """The calibration of a probability in 250 steps."""
    x = table(spark, d, "events").select(F.round(F.least(F.greatest(F.col("value") / 300, F.lit(0.01)), F.lit(0.99)), 2).alias("p"), (F.col("user_id") % 2).alias("y"))
    w = M.fit_platt(x, "p", "y", steps=250)
    return spark.range(1).select(F.round(F.lit(float(w[0])), 6).alias("intercept"), F.round(F.lit(float(w[1])), 6).alias("slope"))


@query("""WITH x AS (SELECT l_orderkey % 4 AS fold, l_quantity AS q, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT k, sum(q * y) AS sxy, sum(q) AS sx, sum(y) AS sy, sum(q * q) AS sxx, count(*) AS n FROM x, (VALUES (1), (2), (3)) t(k) WHERE fold < k GROUP BY 1),
b AS (SELECT k, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS slope, sx / n AS mx, sy / n AS my FROM f), s AS (SELECT k AS fold, x.y, my + slope * (x.q - mx) AS e FROM x JOIN b ON x.fold = b.k) SELECT fold, count(*) AS n, round(sqrt(avg((y - e) * (y - e))), 5) AS rmse FROM s GROUP BY 1""")
def m8_walk_forward(spark, d):
    """Each fold scored by a ridge model that was fitted to the folds before it."""
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("fold"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("y"))
    s = M.walk_forward(x, "fold", [0, 1, 2, 3], lambda r: M.fit_ridge(r, ["q"], "y"), lambda r, w: r.withColumn("e", M.linear(w, ["q"])))
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg((F.col("y") - F.col("e")) * (F.col("y") - F.col("e")))), 5).alias("rmse"))


@query("""WITH x AS (SELECT user_id % 7 > 0 AS ready, event_id % 11 = 0 AS conflict, value > 200 AS far, (event_id % 9) / 8 AS completeness, CASE event_id % 2 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS regime, CASE event_id % 3 WHEN 0 THEN 'NO_OPINION' ELSE 'OK' END AS opinion, event_id % 25 AS n FROM events),
r AS (SELECT *, CASE WHEN NOT ready THEN 'INSUFFICIENT_DATA' WHEN conflict THEN 'FEATURE_CONFLICT' WHEN far THEN 'OUT_OF_DISTRIBUTION' WHEN completeness < 0.25 THEN 'INSUFFICIENT_FEATURES' ELSE 'SUPPORTED' END AS reason FROM x)
SELECT CASE WHEN reason = 'SUPPORTED' THEN 'OK' ELSE 'NO_OPINION' END AS status, reason, CASE WHEN reason <> 'SUPPORTED' THEN 'NO_OPINION' WHEN completeness >= 0.75 AND regime = 'HIGH' AND opinion = 'OK' AND n >= 10 THEN 'HIGH' WHEN completeness >= 0.5 AND opinion = 'OK' AND n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS k FROM r GROUP BY ALL""")
def m4_scored(spark, d):
    """Scores with the first reason to abstain, and their confidence."""
    e = table(spark, d, "events")
    id_ = F.col("event_id")
    s = M.scored(F.col("user_id") % 7 > 0, id_ % 11 == 0, F.col("value") > 200, (id_ % 9) / 8, F.when(id_ % 2 == 0, "HIGH").otherwise("LOW"), F.when(id_ % 3 == 0, "NO_OPINION").otherwise("OK"), id_ % 25, F.lit(True))
    return e.select(s.alias("s")).groupBy("s.status", "s.reason", "s.confidence").agg(F.count(F.lit(1)).alias("k"))


@query("""WITH x AS (SELECT event_type, least(greatest(value / 300, 0.01), 0.99) AS p, user_id % 2 AS y, ts < TIMESTAMP '2024-01-16' AS train FROM events), b AS (SELECT avg(y) FILTER (train) AS prior FROM x), m AS (SELECT event_type, count(*) AS n, avg((p - y) * (p - y)) AS model, avg((prior - y) * (prior - y)) AS baseline FROM x, b WHERE NOT train GROUP BY 1)
SELECT event_type, n, round(model, 8) AS model, round(baseline, 8) AS baseline, CASE WHEN n < 20 THEN 'INSUFFICIENT_DATA' WHEN baseline - model >= 0.01 THEN 'DEMONSTRATED' WHEN baseline - model >= 0.005 THEN 'WEAK' ELSE 'NOT_DEMONSTRATED' END AS edge FROM m""")
def m7_m9_m11_edge(spark, d):
    """A model's Brier score after a cut-off beside that of the prior from before it, and what the difference shows."""
    x = table(spark, d, "events").select("event_type", F.least(F.greatest(F.col("value") / 300, F.lit(0.01)), F.lit(0.99)).alias("p"), (F.col("user_id") % 2).alias("y"), F.expr("ts < timestamp_ntz'2024-01-16'").alias("train"))
    prior = F.broadcast(x.where("train").agg(F.avg("y").alias("prior")))  # one row
    m = x.where("not train").join(prior).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("model"), F.avg((F.col("prior") - F.col("y")) ** 2).alias("baseline"))
    better = F.col("baseline") - F.col("model")
    edge = F.when(F.col("n") < 20, "INSUFFICIENT_DATA").when(better >= 0.01, "DEMONSTRATED").when(better >= 0.005, "WEAK").otherwise("NOT_DEMONSTRATED")
    return rounded(m.withColumn("edge", edge), "model", "baseline", places=8)
