"""As-of neighbours: every query against the rows before it whose outcome was known by then, and what these say about it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import running_before
from .fingerprints import fingerprint

#: Rows of history and of queries that meet in one task.
HISTORY, QUERIES = 4096, 4096
#: Queries whose distances a task holds at once.
SLICE = 128
STAGES = ("same_symbol", "compatible_side", "compatible_regime", "outcome_available", "distance_eligible")
NEAR = "array<struct<distance:double,ts:long,id:long,overlap:int,label:int,expected:double>>"


def distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root mean square distance over the components that both rows have, how many these are) of all rows of a and b."""
    fa, fb = np.isfinite(a), np.isfinite(b)
    x, y = np.where(fa, a, 0.0), np.where(fb, b, 0.0)
    overlap = fa.astype(np.int64) @ fb.T.astype(np.int64)
    square = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        square += np.where(fa[:, i, None] & fb[None, :, i], (x[:, i, None] - y[None, :, i]) ** 2, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(square / overlap), overlap


def nearest(a: np.ndarray, b: np.ndarray, ok: Callable[[slice, np.ndarray], np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of a, place in b, distance, overlap) of the k nearest rows of b to each row of a, of equal distances the earlier ones, and at
    last how many rows of b may be taken for each row of a, for SLICE rows of a at a time; ok(rows of a, overlap) tells which may.

    Matrix products give distances but for rounding; the rows that could be among the k nearest within that error are measured
    one by one, as `distances` does, so the result is the same."""
    fa, fb = np.isfinite(a), np.isfinite(b)
    x, y = np.where(fa, a, 0.0), np.where(fb, b, 0.0)
    ga, gb = fa.astype(np.float64), fb.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        xx, yy = x * x, y * y
        most = yy.sum(1).max(initial=0.0)
        for lo in range(0, len(a), SLICE):
            rows = slice(lo, lo + SLICE)
            overlap = ga[rows] @ gb.T
            may = ok(rows, overlap)
            near = np.where(may, (xx[rows] @ gb.T + ga[rows] @ yy.T - 2 * (x[rows] @ y.T)) / overlap, np.inf)
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(near), np.inf)
            error = 16 * (a.shape[1] + 4) * np.finfo(np.float64).eps * (xx[rows].sum(1) + most)
            row, at = np.nonzero(may & ~(near > (limit + error)[:, None]))  # what is not a number may be near
            square = np.zeros(len(row))
            for i in range(a.shape[1]):
                square += np.where(fa[rows][row, i] & fb[at, i], (x[rows][row, i] - y[at, i]) ** 2, 0.0)
            shared = overlap[row, at]
            distance = np.sqrt(square / shared)
            order = np.lexsort((at, distance, row))
            row, at, distance, shared = row[order], at[order], distance[order], shared[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield row[kept] + lo, at[kept], distance[kept], shared[kept].astype(np.int64), may.sum(1)


#: What a history row is asked for, and what it is counted by.
_HISTORY = ("id", "ts", "symbol", "side", "regime", "outcome_ts", "label", "expected")


class Index:
    """A frozen history: rows in blocks of about HISTORY, by symbol and side and by the time from which they may be used, and the bounds of
    the blocks. A row may be used by queries later than itself and than its outcome; without an outcome it is counted only."""

    def __init__(self, rows: DataFrame, bounds: DataFrame, features: Sequence[str]) -> None:
        self.rows, self.bounds, self.features = rows, bounds, list(features)


def index_of(history: DataFrame, features: Sequence[str], rows_a_block: int = HISTORY) -> Index:
    """The index of the rows that are not in conflict; history has _HISTORY, conflict and the features."""
    free = F.when(F.col("outcome_ts").isNotNull(), F.greatest("ts", "outcome_ts"))
    rows = history.where("not conflict").select(*_HISTORY, *features, free.alias("free"))
    placed = running_before(rows.where("free is not null").withColumn("__one", F.lit(1)), "free", "__one", "__at", group=("symbol", "side"), then=("id",))
    blocked = placed.withColumn("block", F.floor(F.col("__at") / rows_a_block)).drop("__one", "__at").unionByName(rows.where("free is null").withColumn("block", F.lit(-1).cast("long")))
    bounds = blocked.where("block >= 0").groupBy("symbol", "side", "block").agg(F.min("free").alias("low"), F.max("free").alias("high"), F.count(F.lit(1)).alias("n"))
    return Index(blocked, bounds, features)


def freeze(history: DataFrame, features: Sequence[str], folder: str, upto: int) -> str:
    """Writes the index of the rows up to that time to folder and gives its fingerprint, which does not depend on the order of the rows."""
    made = index_of(history.where(F.col("ts") <= upto), features)
    made.rows.repartition("symbol", "side", "block").sortWithinPartitions("symbol", "side", "block", "free").write.parquet(f"{folder}/rows")
    rows = history.sparkSession.read.parquet(f"{folder}/rows")
    made.bounds.write.parquet(f"{folder}/bounds")
    plain = rows.drop("block")
    print_ = fingerprint(plain, plain.columns, "index")
    print_.write.parquet(f"{folder}/fingerprint")
    return history.sparkSession.read.parquet(f"{folder}/fingerprint").first()["digest"]


def frozen(spark: SparkSession, folder: str, features: Sequence[str]) -> Index:
    """The index in folder; an error if its rows are not those of its fingerprint."""
    rows, bounds = (spark.read.parquet(f"{folder}/{n}") for n in ("rows", "bounds"))
    plain = rows.drop("block")
    if fingerprint(plain, plain.columns, "index").first()["digest"] != spark.read.parquet(f"{folder}/fingerprint").first()["digest"]:
        raise ValueError("the index is not what was frozen")
    return Index(rows, bounds, features)


def _stages(index: Index, queries: DataFrame) -> DataFrame:
    """(id, past and the counts of the stages but the last): of how many rows each query is later, by running counts in one pass."""
    h = index.rows
    key = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    at = lambda k, t: F.struct(k.alias("k"), t.alias("t"))
    unknown = F.lit("UNKNOWN")
    counted = F.array(
        at(key("P"), F.col("ts")), at(key("S", "symbol"), F.col("ts")), at(key("D", "symbol", "side"), F.col("ts")), at(key("R", "symbol", "side", "regime"), F.col("ts")),
        at(key("AD", "symbol", "side"), F.col("free")), at(key("AR", "symbol", "side", "regime"), F.col("free")),
    )
    events = h.select(F.inline(counted)).where("t is not null").groupBy("k", "t").agg(F.count(F.lit(1)).alias("c"))
    names = ("past", "same_symbol", "compatible_side", "own", "other", "free_side", "free_own", "free_other")
    keys = (key("P"), key("S", "symbol"), key("D", "symbol", "side"), key("R", "symbol", "side", "regime"), key("R", "symbol", "side", unknown), key("AD", "symbol", "side"), key("AR", "symbol", "side", "regime"), key("AR", "symbol", "side", unknown))
    asked = queries.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), k.alias("k"), F.col("ts").alias("t")) for n, k in zip(names, keys)])))
    both = events.unionByName(asked.select("k", "t", F.lit(0).cast("long").alias("c"))).groupBy("k", "t").agg(F.sum("c").alias("c"))
    before = running_before(both, "t", "c", "n", group=("k",))
    wide = asked.join(before.select("k", "t", "n"), ["k", "t"]).groupBy("id").agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])
    x = queries.select("id", "regime").join(wide, "id")
    any_ = F.col("regime") == "UNKNOWN"
    return x.select("id", "past", "same_symbol", "compatible_side", F.when(any_, F.col("compatible_side")).otherwise(F.col("own") + F.col("other")).alias("compatible_regime"), F.when(any_, F.col("free_side")).otherwise(F.col("free_own") + F.col("free_other")).alias("outcome_available"))


def neighbours(history: DataFrame | Index, queries: DataFrame, features: Sequence[str], k: int = 20, min_overlap: int = 1) -> DataFrame:
    """(id, past, the counts of STAGES, near): the k nearest of the rows that are strictly earlier, not in conflict, of the same symbol and
    side, of the same regime or an unknown one, and whose outcome came before the query; by (distance, ts, id).

    Rows have id, ts (long), symbol, side, regime, conflict, outcome_ts, label, expected and the features. A block of queries meets the
    blocks of history of its symbol and side that begin before its end, so nothing is compared with the future, and a meeting gives
    k rows a query. How many rows passed each filter but the last are running counts, not pairs.
    """
    index = history if isinstance(history, Index) else index_of(history, features)
    names, by = list(features), ["symbol", "side"]
    asked = queries.where("not conflict").select("id", "ts", "symbol", "side", "regime", *names)
    placed = running_before(asked.withColumn("__one", F.lit(1)), "ts", "__one", "__at", group=by, then=("id",))
    q = placed.withColumn("qb", F.floor(F.col("__at") / QUERIES)).drop("__one", "__at")
    ends = q.groupBy(*by, "qb").agg(F.max("ts").alias("last"))
    meetings = ends.join(index.bounds.select(*by, F.col("block").alias("hb"), "low"), by).where("low < last").select(*by, "qb", "hb")
    h = index.rows.where("block >= 0").select(*by, F.col("block").alias("hb"), "id", "regime", "free", "ts", "label", "expected", *names)
    q = q.join(meetings, [*by, "qb"])
    # names of its own for the history: both sides may come from one table
    h = h.join(meetings, [*by, "hb"])
    h = h.select(*[F.col(c).alias(f"h_{c}") for c in h.columns])

    def meet(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(h):
            return pd.DataFrame(columns=["id", "eligible", "distance", "ts", "hid", "overlap", "label", "expected"])
        h = h.rename(columns=lambda c: c.removeprefix("h_")).sort_values(["ts", "id"], kind="stable")
        qr, hr, qt, free, qi, hi = q["regime"].to_numpy(), h["regime"].to_numpy(), q["ts"].to_numpy(), h["free"].to_numpy(), q["id"].to_numpy(), h["id"].to_numpy()

        def ok(rows: slice, overlap: np.ndarray) -> np.ndarray:
            regime = (qr[rows, None] == "UNKNOWN") | (hr[None, :] == qr[rows, None]) | (hr[None, :] == "UNKNOWN")
            return (free[None, :] < qt[rows, None]) & (hi[None, :] != qi[rows, None]) & regime & (overlap >= min_overlap)

        parts = []
        for row, at, distance, overlap, eligible in nearest(q[names].to_numpy(np.float64), h[names].to_numpy(np.float64), ok, k):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            counted = np.zeros(len(row), np.int64)
            counted[first] = eligible[row[first] % SLICE]
            parts.append(pd.DataFrame({"id": qi[row], "eligible": counted, "distance": distance, "ts": h["ts"].to_numpy()[at], "hid": hi[at], "overlap": overlap, "label": h["label"].to_numpy(np.float64)[at], "expected": h["expected"].to_numpy(np.float64)[at]}))
        return pd.concat(parts)

    made = "id long, eligible long, distance double, ts long, hid long, overlap int, label double, expected double"
    met = q.groupBy(*by, "qb", "hb").cogroup(h.groupBy("h_symbol", "h_side", "h_qb", "h_hb")).applyInPandas(meet, made)
    one = F.struct("distance", "ts", F.col("hid").alias("id"), "overlap", F.nanvl("label", F.lit(None)).cast("int").alias("label"), F.nanvl("expected", F.lit(None)).alias("expected"))
    best = met.groupBy("id").agg(F.sum("eligible").alias("distance_eligible"), F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("near"))
    counts = _stages(index, queries.where("not conflict"))
    out = queries.select("id", "ts", "regime", "conflict").join(counts, "id", "left").join(best, "id", "left")
    return out.select("id", "ts", "regime", "conflict", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("past", *STAGES)], F.coalesce("near", F.expr(f"cast(array() as {NEAR})")).alias("near"))


def opinion(found: DataFrame, least: int = 3) -> DataFrame:
    """found with n, effective, probability, expected_r, status, reason and confidence, from inverse distances of rows with an outcome."""
    with_outcome = F.filter("near", lambda x: x["label"].isNotNull() | x["expected"].isNotNull())
    weight = lambda x: 1.0 / F.greatest(x["distance"], F.lit(1e-9))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    of = lambda field: F.filter("near", lambda x: x[field].isNotNull())
    mean = lambda field: F.when(F.size(of(field)) > 0, total(of(field), lambda x: weight(x) * x[field]) / total(of(field), weight))
    n, m = F.size("near"), F.size(with_outcome)
    w, w2 = total(with_outcome, weight), total(with_outcome, lambda x: weight(x) * weight(x))
    reason = (
        F.when(F.col("conflict"), "FEATURE_CONFLICT").when((F.col("distance_eligible") == 0) & (F.col("outcome_available") > 0), "INSUFFICIENT_FEATURES")
        .when((F.col("regime") != "UNKNOWN") & (F.col("compatible_regime") == 0), "NO_COMPATIBLE_REGIME").when(n < least, "INSUFFICIENT_HISTORY").when(m < least, "LOW_EFFECTIVE_SAMPLE").otherwise("SUPPORTED")
    )
    x = found.withColumns({"n": n, "effective": F.when(m > 0, w * w / w2).otherwise(0.0), "probability": mean("label"), "expected_r": mean("expected"), "reason": reason})
    close = F.get("near", F.lit(0))["distance"] <= 3.0
    confidence = F.when(F.col("reason") != "SUPPORTED", "NO_OPINION").when((F.col("effective") >= max(10, 2 * least)) & close, "HIGH").when(F.col("effective") >= least, "MEDIUM").otherwise("LOW")
    return x.withColumn("status", F.when(F.col("reason") == "SUPPORTED", "OK").otherwise("NO_OPINION")).withColumn("confidence", confidence)


def leaks(found: DataFrame) -> list[Column]:
    """Aggregates that must be zero: neighbours that are not earlier, and queries among their own neighbours."""
    late = F.size(F.filter("near", lambda x: x["ts"] >= F.col("ts")))
    own = F.exists("near", lambda x: x["id"] == F.col("id"))
    return [F.count(F.lit(1)).alias("queries"), F.sum(late).alias("leaks"), F.count_if(own).alias("self_matches")]
