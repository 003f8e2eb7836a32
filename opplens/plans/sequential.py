"""Queries over recursions along bars: Wilder's oscillator and the fan of an oscillator and its two means."""

from __future__ import annotations

from pyspark.sql import functions as F

from opplens.operators import bars as B
from opplens.operators import recursions as R

from .registry import BARS, hourly, query, rounded

#: The recursion of the oscillator, one bar a step.
_RSI = f"""RECURSIVE {BARS}, m AS (SELECT symbol, bar_ts, c, row_number() OVER w AS k, c - lag(c) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
r AS (SELECT symbol, k, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM m WHERE k = 1 UNION ALL SELECT m.symbol, m.k, CASE WHEN m.k <= 15 THEN r.up + greatest(d, 0) / 14 ELSE (r.up * 13 + greatest(d, 0)) / 14 END, CASE WHEN m.k <= 15 THEN r.down + greatest(-d, 0) / 14 ELSE (r.down * 13 + greatest(-d, 0)) / 14 END FROM r JOIN m ON m.symbol = r.symbol AND m.k = r.k + 1),
rsi AS (SELECT m.symbol, m.bar_ts, m.c, CASE WHEN k >= 15 THEN round(CASE WHEN up + down > 1e-12 THEN 100 * up / (up + down) ELSE 50 END, 6) END AS rsi FROM m JOIN r USING (symbol, k))"""


@query(f"WITH {_RSI} SELECT symbol, bar_ts, rsi FROM rsi")
def w1_rsi(spark, d):
    """Relative strength by Wilder's recursion over 14 moves."""
    return rounded(R.wilder_rsi(hourly(spark, d).select("symbol", "bar_ts", "c")), "rsi").select("symbol", "bar_ts", "rsi")


#: The oscillator with its exponential mean over 37 bars and its linear mean over 45.
_LINES = f"""{_RSI}, seen AS (SELECT *, list(rsi) FILTER (rsi IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 36 PRECEDING) AS e, list(rsi) FILTER (rsi IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 44 PRECEDING) AS w FROM rsi),
lines AS (SELECT symbol, bar_ts, rsi, round(list_reduce(e, lambda a, v: a + (v - a) * 0.2), 6) AS ema, round(list_sum(list_transform(w, lambda v, i: v * i)) / 1035, 6) AS wma FROM seen WHERE len(w) = 45)"""
_FAN = f"""{_LINES},
sided AS (SELECT symbol, bar_ts, side, rsi * s AS rsi, ema * s AS ema, wma * s AS wma, row_number() OVER (PARTITION BY symbol, side ORDER BY bar_ts) AS k FROM lines, (VALUES ('LONG', 1), ('SHORT', -1)) AS t(side, s)),
crossed AS (SELECT *, greatest(rsi, ema, wma) - least(rsi, ema, wma) AS span, coalesce(lag(rsi) OVER w <= lag(ema) OVER w AND rsi > ema, false) AS over_ema, coalesce(lag(rsi) OVER w <= lag(wma) OVER w AND rsi > wma, false) AS over_wma, coalesce(lag(rsi) OVER w >= lag(wma) OVER w AND rsi < wma, false) AS under, coalesce(lag(ema) OVER w >= lag(wma) OVER w AND ema < wma, false) AS falls FROM sided WINDOW w AS (PARTITION BY symbol, side ORDER BY k)),
aged AS (SELECT *, coalesce(k - max(CASE WHEN under THEN k END) OVER (PARTITION BY symbol, side ORDER BY k), 100000) AS since_cross FROM crossed),
born AS (SELECT *, falls AND since_cross BETWEEN 1 AND 12 AND span <= {{spread}} AS origin FROM aged),
fan AS (
  SELECT symbol, side, k, bar_ts, CASE WHEN origin THEN bar_ts END AS origin_ts, CASE WHEN origin THEN 1 ELSE 0 END AS phase, 0 AS age, 0 AS since, rsi AS first, rsi AS retest, 0.0::DOUBLE AS entry, span, NULL::TIMESTAMP AS e1, NULL::TIMESTAMP AS e2, NULL::TIMESTAMP AS e3, NULL::VARCHAR AS ended FROM born WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.side, n.k, n.bar_ts, CASE WHEN n.origin THEN n.bar_ts ELSE origin_ts END, CASE WHEN n.origin THEN 1 ELSE nx.p END, CASE WHEN n.origin THEN 0 WHEN nx.live THEN age + 1 ELSE age END, CASE WHEN phase = 3 AND nx.p = 4 THEN 0 WHEN phase = 4 THEN since + 1 ELSE since END,
    CASE WHEN n.origin THEN n.rsi WHEN phase = 1 AND NOT nx.old THEN least(first, n.rsi) ELSE first END, CASE WHEN n.origin OR (phase = 1 AND nx.p = 2) OR (phase = 2 AND nx.p = 3) THEN n.rsi WHEN phase = 3 AND n.rsi <= n.ema THEN least(retest, n.rsi) ELSE retest END, CASE WHEN phase = 3 AND nx.p = 4 THEN n.rsi ELSE entry END,
    CASE WHEN n.origin THEN n.span WHEN nx.live AND NOT nx.old THEN greatest(f.span, n.span) ELSE f.span END, CASE WHEN n.origin THEN NULL WHEN phase = 3 AND nx.p = 4 THEN n.bar_ts ELSE e1 END, CASE WHEN n.origin THEN NULL WHEN phase = 4 AND nx.p = 5 THEN n.bar_ts ELSE e2 END, CASE WHEN n.origin THEN NULL WHEN nx.live AND nx.p = 6 THEN n.bar_ts ELSE e3 END,
    CASE WHEN n.origin THEN NULL WHEN nx.old THEN 'EXPIRED' WHEN phase = 3 AND nx.p = 0 THEN 'INVALID' WHEN nx.live AND nx.p = 6 THEN 'COMPLETE' ELSE ended END
  FROM fan f JOIN born n ON n.symbol = f.symbol AND n.side = f.side AND n.k = f.k + 1, LATERAL (SELECT phase BETWEEN 1 AND 5 AS live, phase BETWEEN 1 AND 5 AND age + 1 > {{age}} AS old,
    CASE WHEN phase IN (0, 6) THEN phase WHEN age + 1 > {{age}} THEN 0
      WHEN phase = 1 THEN CASE WHEN greatest(f.span, n.span) < {{expansion}} THEN 1 WHEN n.over_wma THEN 6 WHEN n.over_ema THEN 2 ELSE 1 END
      WHEN phase = 2 THEN CASE WHEN n.over_wma THEN 6 WHEN n.rsi <= n.ema THEN 3 ELSE 2 END
      WHEN phase = 3 THEN CASE WHEN n.over_wma THEN 6 WHEN n.over_ema THEN CASE WHEN CASE WHEN n.rsi <= n.ema THEN least(retest, n.rsi) ELSE retest END >= first + 1.5 THEN 4 ELSE 0 END ELSE 3 END
      WHEN phase = 4 THEN CASE WHEN n.over_wma THEN 6 WHEN n.rsi > n.ema AND n.rsi <= n.wma AND n.rsi > entry THEN 5 ELSE 4 END
      ELSE CASE WHEN n.over_wma THEN 6 ELSE 5 END END AS p) AS nx),
ends AS (SELECT *, lead(origin_ts) OVER (PARTITION BY symbol, side ORDER BY k) AS next_origin, origin_ts IS NOT NULL AND origin_ts IS DISTINCT FROM lead(origin_ts) OVER (PARTITION BY symbol, side ORDER BY k) AS final FROM fan)
SELECT symbol, side, origin_ts, e1 AS entry1, e2 AS entry2, e3 AS entry3, coalesce(ended, CASE WHEN next_origin IS NOT NULL THEN 'RESTARTED' ELSE 'OPEN' END) AS ended, age, round(span, 6) AS max_span FROM ends WHERE final"""


def lines(spark, d):
    x = rounded(R.wilder_rsi(hourly(spark, d).select("symbol", "bar_ts", "c")), "rsi")
    return rounded(x.select("symbol", "bar_ts", "rsi", B.exponential_mean("rsi", 9).alias("ema"), B.weighted_mean("rsi", 45).alias("wma")).where("wma is not null"), "ema", "wma")


@query(f"WITH {_FAN.format(spread=3.0, age=72, expansion=4.0)}")
def w23_fan_trackers(spark, d):
    """The fan's trackers of both sides from each origin on: their entries, how they ended, their age and span."""
    return rounded(R.fan_trackers(lines(spark, d)), "max_span")


@query(f"WITH {_FAN.format(spread=8.0, age=24, expansion=2.0)}")
def w23_wide_fan_trackers(spark, d):
    """The same with limits under which origins are frequent and trackers expire."""
    return rounded(R.fan_trackers(lines(spark, d), rules=R.FAN | {"spread": 8.0, "max_age": 24, "expansion": 2.0}), "max_span")
