"""Queries over quality gates and over what a model's scores show."""

from __future__ import annotations

from pyspark.sql import functions as F

from opplens.operators import episodes as E
from opplens.operators import models as M
from opplens.operators import quality as Q

from .episodes import _REL, _S, SIGNALS, made
from .registry import query, rounded, table

_H = E.HORIZONS
_BAD_HIT = lambda c: f"(coalesce({c}, '') NOT IN {Q.FIRST_HITS})::INT"


@query(f"""WITH {_S}, x AS (SELECT *, CASE WHEN k % 43 = 0 THEN 'SIDEWAYS' ELSE shadow_first_hit END AS hit, CASE WHEN k % 47 = 0 THEN 'Infinity'::DOUBLE WHEN k % 53 = 0 THEN 'NaN'::DOUBLE ELSE shadow_mfe_r END AS mfe, active_current_r * 30 + 40 AS rank_a FROM s), p AS (SELECT k FROM s WHERE k % 59 > 0),
c AS (SELECT 'missing_timestamp' AS name, 'ERROR' AS severity, count(*) FILTER (event_time IS NULL) AS broken FROM x
UNION ALL SELECT 'invalid_numeric', 'ERROR', sum((NOT isfinite(mfe))::INT) FROM x UNION ALL SELECT 'negative_stddev', 'ERROR', count(*) FILTER (shadow_risk_distance < 0) FROM x UNION ALL SELECT 'rank_out_of_range', 'ERROR', count(*) FILTER (NOT rank_a BETWEEN 0 AND 100) FROM x
UNION ALL SELECT 'invalid_direction', 'ERROR', count(*) FILTER (NOT coalesce(({_REL}), false)) FROM x UNION ALL SELECT 'diff_consistency', 'ERROR', sum({' + '.join(f'coalesce((abs(opportunity_diff_{h}bar_r - (shadow_return_{h}bar_r - active_continuation_{h}bar_r)) > 1e-5)::INT, 0)' for h in _H)}) FROM x
UNION ALL SELECT 'invalid_first_hit', 'ERROR', sum({_BAD_HIT('hit')} + {_BAD_HIT('active_first_hit')} + {_BAD_HIT('actual_selected_first_hit')}) FROM x UNION ALL SELECT 'missing_completed_outcome', 'ERROR', count(*) FILTER (completed AND (mfe IS NULL OR shadow_mae_r IS NULL OR {' OR '.join(f'shadow_return_{h}bar_r IS NULL' for h in _H)})) FROM x
UNION ALL SELECT 'lookahead', 'FATAL', count(*) FILTER (entry_bar_time > event_time) FROM x UNION ALL SELECT 'duplicate_event', 'FATAL', (SELECT count(*) FROM (SELECT event_id FROM x WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'outcome_without_context', 'FATAL', (SELECT count(*) FROM x WHERE k NOT IN (SELECT k FROM p)) UNION ALL SELECT 'unlike_identity', 'FATAL', (SELECT count(*) FROM (SELECT event_id FROM x WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (side, event_type)) > 1)) UNION ALL SELECT 'old_rows', 'WARN', count(*) FILTER (y < 1996) FROM x),
o AS (SELECT count(*) FILTER (broken > 0 AND severity IN ('ERROR', 'FATAL')) AS n FROM c)
SELECT name, severity, CAST(broken AS BIGINT) AS broken, broken = 0 AS passed FROM c UNION ALL SELECT 'overall', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n, n = 0 FROM o""")
def q1_q2_gate(spark, d):
    """All row checks of the signals in one pass, the checks of keys and references, and the verdict."""
    k = F.col("k")
    x = made(spark, d, SIGNALS).withColumns({"shadow_first_hit": F.when(k % 43 == 0, "SIDEWAYS").otherwise(F.col("shadow_first_hit")), "shadow_mfe_r": F.when(k % 47 == 0, float("inf")).when(k % 53 == 0, float("nan")).otherwise(F.col("shadow_mfe_r")), "rank_a": F.col("active_current_r") * 30 + 40})
    rows = Q.row_checks(x, Q.signal_checks(["shadow_mfe_r"], ["shadow_risk_distance"], ["rank_a"], _H) | {"old_rows": ("WARN", F.col("y") < 1996)})
    known = x.where("event_id is not null")
    return Q.gate([rows, Q.repeated_keys(x, ["event_id"], "duplicate_event"), Q.orphans(x, x.where("k % 59 > 0"), ["k"], "outcome_without_context"), Q.unlike_identities(known, "event_id", ["side", "event_type"], "unlike_identity")])


_X = "x AS (SELECT event_type, least(greatest(value / 300, 0.01), 0.99) AS p, user_id % 2 AS y, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS fold FROM events)"


@query(f"""WITH {_X}, pr AS (SELECT f.k AS fold, avg(y) AS prior FROM x, (VALUES (1), (2)) f(k) WHERE x.fold < f.k GROUP BY 1), e AS (SELECT x.*, prior, rank() OVER (PARTITION BY event_type, x.fold ORDER BY p) + (count(*) OVER (PARTITION BY event_type, x.fold, p) - 1) / 2 AS r FROM x JOIN pr USING (fold)),
m AS (SELECT event_type, fold, count(*) AS n, avg((p - y) * (p - y)) AS model, avg((prior - y) * (prior - y)) AS baseline, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM e GROUP BY ALL),
j AS (SELECT a.event_type, a.n, a.model, a.baseline, a.auc, b.baseline - b.model AS later FROM m a LEFT JOIN m b ON b.event_type = a.event_type AND b.fold = 2 WHERE a.fold = 1)
SELECT event_type, n, round(model, 8) AS model, round(baseline, 8) AS baseline, round(auc, 8) AS auc, round(later, 8) AS later, CASE WHEN n < 20 OR later IS NULL THEN 'INSUFFICIENT_DATA' WHEN baseline - model >= 0.01 AND coalesce(auc >= 0.55, false) AND later > 0 THEN 'DEMONSTRATED' WHEN (baseline - model >= 0.005 OR coalesce(auc >= 0.52, false)) AND later >= 0 THEN 'WEAK' ELSE 'NOT_DEMONSTRATED' END AS edge FROM j""")
def m7_m9_edge_status(spark, d):
    """A model beside the prior of earlier folds: Brier scores, AUC, what a later fold says, and the edge that this shows."""
    x = table(spark, d, "events").select("event_type", F.least(F.greatest(F.col("value") / 300, F.lit(0.01)), F.lit(0.99)).alias("p"), (F.col("user_id") % 2).alias("y"), F.expr("case when ts < timestamp_ntz'2024-01-11' then 0 when ts < timestamp_ntz'2024-01-21' then 1 else 2 end").alias("fold"))
    later = x.where("fold < 2").select("y", F.explode(F.sequence(F.col("fold") + 1, F.lit(2))).alias("fold"))
    prior = F.broadcast(later.groupBy("fold").agg(F.avg("y").alias("prior")))  # two rows
    e = x.join(prior, "fold")
    m = M.edge_by(e, ["event_type", "fold"], "p", "y", "prior")
    b = m.where("fold = 2").select("event_type", (F.col("baseline") - F.col("model")).alias("later"))
    out = m.where("fold = 1").drop("fold").join(b, "event_type", "left")
    return rounded(out.withColumn("edge", M.edge(F.col("n"), F.col("model"), F.col("baseline"), F.col("auc"), F.col("later"))), "model", "baseline", "auc", "later", places=8)
