"""Small tests of the findings of round 3 that were settled after it."""

import pytest
from pyspark.sql import functions as F

from opplens.functions import rules as R
from opplens.plans import registry

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f6_exports_are_read_once_and_times_are_as_by_all_formats(spark):
    assert plan_of(registry.QUERIES["s3_s4_s5_sources"](spark, DATA)).count("FileScan csv") == 3
    days = ["2024.01.31", "2024-01-31", "2024-02-30", "2024.1.31", "-2024-01-31", "+12024-01-31", "24-01-31", "2024/01/31", ""]
    texts = [f"{a}{day}{gap}{clock}{b}" for day in days for gap in (" ", "T", "t", "  ") for clock in ("10:20:30", "10:20", "25:00", "1:20", "") for a, b in (("", ""), (" ", " "), ("", "Z"), ("x", ""))] + [None, "soon", ":", "-- ::"]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in R.TIME_FORMATS])
    rows = x.select("t", plain.cast("string").alias("want"), R.timestamp_of(F.col("t")).cast("string").alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []
    assert sum(r.want is not None for r in rows) > 20


def test_op8_a_task_gives_links_that_join_and_no_pairs():
    import numpy as np

    from opplens.llm import near

    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**62, 200).astype(np.uint64)
    words = []
    for k in range(80):  # each differs from its neighbours by few words, from far ones by many
        base = base.copy()
        base[rng.choice(200, 8, replace=False)] = rng.integers(1, 2**62, 8)
        words.append(base)
    words += [rng.integers(1, 2**62, 200).astype(np.uint64) for _ in range(20)]
    n = len(words)
    kind, one, block = np.arange(n), np.full(n, True), np.zeros(n, np.int64)
    i, j = near.joining_pairs(kind, one, block, np.zeros((n, 24), np.int64), 0, words, 0.8)
    assert len(i) == 79  # 80 texts in one class; the pairs that are alike are many more
    alike = [(a, b) for a in range(n) for b in range(a) if near.similarity_of(words[a], words[b], 0.8) is not None]
    assert len(alike) > 200

    def classes(links):
        name = list(range(n))
        for a, b in links:
            x, y = name[a], name[b]
            name = [x if c == y else c for c in name]
        return {frozenset(k for k in range(n) if name[k] == c) for c in set(name)}

    assert classes(zip(i, j)) == classes(alike)


def test_f10_f16_nearest_is_exact_and_holds_a_slice_of_distances():
    import tracemalloc

    import numpy as np

    from opplens.operators import similar as N

    rng = np.random.default_rng(7)
    for a, b, k in ((rng.normal(size=(300, 6)).round(1), rng.normal(size=(900, 6)).round(1), 20), (np.ones((200, 3)), np.ones((50, 3)), 5), (rng.normal(size=(130, 2)) * 1e9 + 1e12, rng.normal(size=(400, 2)) * 1e-3 + 1e12, 7), (np.full((3, 2), 1e200), rng.normal(size=(40, 2)), 4)):
        a, b = a.copy(), b.copy()
        a[rng.random(a.shape) < 0.2], b[rng.random(b.shape) < 0.2] = np.nan, np.nan
        free = rng.random((len(a), len(b))) < 0.8
        got = list(N.nearest(a, b, lambda rows, overlap: free[rows] & (overlap >= 1), k))
        with np.errstate(over="ignore"):
            distance, overlap = N.distances(a, b)
        may = free & (overlap >= 1)
        want = [(i, j, distance[i, j], overlap[i, j]) for i in range(len(a)) for j in sorted(np.flatnonzero(may[i]), key=lambda j: (distance[i, j], j))[:k]]
        assert [t for part in got for t in zip(*(c.tolist() for c in part[:4]))] == [tuple(map(lambda v: v.item() if hasattr(v, "item") else v, w)) for w in want]
        assert np.concatenate([part[4] for part in got]).tolist() == may.sum(1).tolist()
    tracemalloc.start()
    for _ in N.nearest(rng.normal(size=(1024, 8)), rng.normal(size=(4096, 8)), lambda rows, overlap: overlap >= 1, 20):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # all distances at once take 34 MB for each of several matrices


def test_f11_payloads_are_parsed_once(spark):
    plan = plan_of(registry.QUERIES["p17_refused_entries"](spark, DATA))
    assert plan.count("testdata/sf0.001/events.parquet") == 1  # the other levels read what the one above them wrote


def test_f14_equal_rows_are_counted_before_they_are_ranked(spark):
    plan = plan_of(registry.QUERIES["m6_regression_metrics"](spark, DATA))
    assert "l_extendedprice" not in plan  # what is left to do reads counts, not rows


def test_op9_texts_are_cut_by_spark_and_searched_in_small_batches(spark, monkeypatch):
    from opplens.llm import repeats

    name, seen, find = "spark.sql.execution.arrow.maxRecordsPerBatch", [], repeats.find_runs
    monkeypatch.setattr(repeats, "find_runs", lambda *a: seen.append(int(spark.conf.get(name))) or find(*a))
    usual = spark.conf.get(name)
    same = "abé中" * 8
    texts = [f"{same}x", f"y\u0000{same}", f"1{same}2{same}3", "alone" * 3, None, ""]
    out = repeats.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 40)
    assert seen == [1000] and spark.conf.get(name) == usual
    assert "ArrowEvalPython" not in plan_of(out) and "MapInArrow" not in plan_of(out)  # a task of the last step holds a row, not a batch of texts
    rows = {r.doc_id: r for r in out.collect()}
    assert [bytes(rows[i].kept).decode() for i in range(6)] == ["x", "y\u0000", "123", "alone" * 3, "", ""]
    assert [rows[i].n_spans for i in range(6)] == [1, 1, 2, 0, 0, 0] and [tuple(s) for s in rows[2].removed] == [(1, 57), (58, 114)]


@pytest.mark.parametrize("adaptive", [True, False])
def test_op9_rows_meet_their_counts_in_one_join(spark, monkeypatch, adaptive):
    """Runs of one anchor with many contents: no row is looked up in a list of frequent values where Spark splits partitions itself."""
    from collections import Counter

    from opplens.llm import repeats

    plans, store = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, *a: plans.append(plan_of(df)) or store(df, *a))
    monkeypatch.setattr(repeats, "HEAVY", 2)
    name = "spark.sql.adaptive.skewJoin.enabled"
    usual = spark.conf.get(name)
    shared = "a passage that all of the near copies hold in the middle, and two more have as it is"
    texts = [f"{i:03d}{shared}{i:03d}" for i in range(40)] + [shared] * 6 + [f"{shared} {shared}", None, ""]
    spark.conf.set(name, adaptive)
    try:
        rows = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 40).collect()}
    finally:
        spark.conf.set(name, usual)
    assert any("salt" in p for p in plans) != adaptive
    if adaptive:  # the contents of a group are joined as tables, which have shuffles right below the join
        assert [p for p in plans if "LeftOuter" in p] and not any("Aggregate" in p for p in plans if "LeftOuter" in p)
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 40] for t in data for i in range(len(t) - 39))
    for k, t in enumerate(data):
        gone = {j for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1 for j in range(i, i + 40)}
        assert bytes(rows[k].kept) == bytes(c for j, c in enumerate(t) if j not in gone) and rows[k].n_removed == len(gone)


def test_f15_tasks_are_as_many_as_the_rows_ask_for_and_sort_twice(spark, monkeypatch):
    import random

    from opplens.operators import arrivals as A

    monkeypatch.setattr(A, "ROWS_A_TASK", 100)
    plan = plan_of(registry.QUERIES["t4_collapsed_duplicates"](spark, DATA))
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert f"{min(n // 100 + 1, A.TASKS)}), REPARTITION_BY_NUM" in plan and plan.count("Sort [") == 2
    monkeypatch.setattr(A, "MOST_ROWS_A_TASK", 20)
    assert f"{n // 20 + 1}), REPARTITION_BY_NUM" in plan_of(registry.QUERIES["t4_collapsed_duplicates"](spark, DATA))
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), day, k, rng.choice([None, "old"]), rng.random() < 0.5) for k, day in enumerate([None, *sorted(rng.choices(range(5), k=299))])]
    want, state = [], {}
    for key, source, _, k, reason, valid in rows:
        s = state.setdefault(key, {"begun": False, "seen": set(), "rep": None})
        counts = reason is None or s["begun"]
        again = counts and source in s["seen"]
        status = "REJECTED_DUPLICATE" if again else "DUPLICATE_COLLAPSED" if s["begun"] else "REJECTED_STALE" if reason else "ACCEPTED" if valid else "INVALID"
        if counts:
            s["seen"].add(source)
        if reason is None:
            s["begun"] = True
            s["rep"] = source if s["rep"] is None else s["rep"]
        want.append((k, status, s["rep"], len(s["seen"]), max(len(s["seen"]) - 1, 0)))
    got = A.collapse(spark.createDataFrame(rows, "key string, source int, day int, k int, reason string, valid boolean").repartition(7), ["key"], "source", ["day", "k"], "reason", "valid")
    assert sorted(tuple(r) for r in got.select("k", "status", "representative", "observations", "duplicates").collect()) == want
