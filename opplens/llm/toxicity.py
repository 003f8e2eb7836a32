"""Toxic passages by maximum-scoring segments.

Training counts the words of labelled documents. A word's log-odds between toxic and other documents are taken with an
informative Dirichlet prior (pseudo-counts in the proportions of all labelled words, `prior` times their number) and kept if their z-score is at least `min_z`; every
other word has the small negative log-odds of not being such a word. A linear-time scan finds all maximal scoring segments
of a text. Their scores are calibrated as extreme values: with lambda from the background and K from the segments of clean labelled
documents, a segment of score S has the normalised score lambda S - ln(K n), the -ln of how many as good are expected in n
clean words. A text's evidence is that of its best segment. (Adding up the r best segments, less ln r!, was tried: on held-out
documents of check_s it found 533 of 718 toxic ones with 51 false, the best segment alone 655 with 16 false.) A logistic curve
over the evidence, fitted to counts by bins over all labelled training documents, makes it a probability. significant_passages
gives every passage that is significant by itself.

The words of the model are those whose z-score is at least `min_z`, however many these are: the vocabulary of the labelled texts bounds
them, and they are broadcast up to `max_model` of them; beyond that an error asks for a higher `min_z`, as no word is dropped silently.
Labels that are null are ignored; a document with several labels is toxic if one says so.

Null, empty and word-less texts have no segment and get the probability of such documents. Without labels of both kinds all scores
are the share of toxic labels (0 if there are none). Repeated rows and ties get equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, checkpointed, map_text, of_row, row_of, text_bytes, word_hashes, word_spans


#: Labels (an id and a flag) are broadcast up to this many rows; beyond it the texts are shuffled to them.
BROADCAST_LABELS = 1_000_000


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    other: float
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0
    base: float = 0.0
    words: list[str] = field(default_factory=list)


def segments(scores: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of n words: the listed words score as given, all others score other.

    Each listed positive word starts as a segment of its own. It joins the nearest earlier segment that begins lower, if that
    ends lower, and so on until none is left. Every segment keeps a link to its nearest earlier one that begins lower, and a new
    segment follows these links, which makes the scan linear.
    """
    total, at = 0.0, 0
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest earlier one that begins lower
    for i, s in scores:
        total += (i - at) * other
        at = i + 1
        if s <= 0:
            total += s
            continue
        first, low = i, total
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, low, before = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = before
        found.append((first, i + 1, low, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _scan(texts: list[bytes], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    buf, starts, ends, _, first = word_spans(texts)
    words = word_hashes(buf, starts, ends)
    n = np.diff(first)
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    if len(model.hashes) and len(words):
        at = np.minimum(np.searchsorted(model.hashes, words), len(model.hashes) - 1)
        hit = np.flatnonzero(model.hashes[at] == words)
        doc = np.searchsorted(first, hit, side="right") - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], doc, [-1]])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            d = int(doc[a])
            own = list(zip((hit[a:b] - first[d]).tolist(), model.weights[at[hit[a:b]]].tolist()))
            out[d] = segments(own, int(n[d]), model.other)
    return n, out


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many documents of each kind a word is, and a row of null for their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = text_bytes(batch.column(0)), np.asarray(batch.column(1).to_pylist(), np.int64)
            for lo, hi in blocks(texts):
                buf, starts, ends, _, first = word_spans(texts[lo:hi])
                words = word_hashes(buf, starts, ends)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                order = np.lexsort((doc, words))
                w, d = words[order], doc[order]
                once = np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]) if len(w) else np.zeros(0, bool)
                w, d, place = w[once], d[once], order[once]
                begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
                y = toxic[lo:hi]
                t = np.add.reduceat(y[d], begin) if len(begin) else begin
                c = np.diff(np.append(begin, len(w)))
                names = [buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in place[begin].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array(np.append(t, y.sum())), pa.array(np.append(c - t, (1 - y).sum()))], ["word", "toxic", "clean"])

    return labelled.mapInArrow(work, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_words(labelled: DataFrame, prior: float = 0.1, min_z: float = 3.0, max_model: int = 5_000_000) -> Model:
    """The word weights of labelled (text, toxic 0 or 1)."""
    counts = checkpointed(_word_counts(labelled))
    docs = counts.where("word is null").first()
    if not docs or not docs["toxic"] or not docs["clean"]:
        share = docs["toxic"] / (docs["toxic"] + docs["clean"]) if docs and docs["toxic"] + docs["clean"] else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, base=share)
    words = counts.where("word is not null")
    total = words.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    nt, nc = float(total["t"]), float(total["c"])
    a, all_ = F.lit(prior) * (F.col("toxic") + F.col("clean")), prior * (nt + nc)
    t, c = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(t / (nt + all_ - t)) - F.log(c / (nc + all_ - c))
    scored = words.select("word", "toxic", "clean", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
    strong = checkpointed(scored.where(F.col("z") >= min_z))
    if (size := strong.count()) > max_model:
        raise ValueError(f"{size} words have a z-score of {min_z}: more than max_model, which bounds what is broadcast; raise min_z")
    kept = sorted(strong.collect(), key=lambda r: r["word"])
    # what is left over for all other words
    pt, pc = sum(r["toxic"] for r in kept) / nt, sum(r["clean"] for r in kept) / nc
    other = min(math.log(max(1e-6, 1 - pt) / max(1e-6, 1 - pc)), -1e-3)
    raw = [r["word"].encode() for r in kept]
    hashes = np.concatenate([word_hashes(*word_spans([w])[:3])[:1] for w in raw]) if raw else np.zeros(0, np.uint64)
    order = np.lexsort((raw, hashes)) if raw else np.zeros(0, np.int64)
    weights = np.asarray([r["odds"] for r in kept])
    p = np.asarray([(r["clean"] + 0.5) / (nc + 1) for r in kept])
    lam = _root(np.append(weights[order], other), np.append(p[order], max(0.0, 1 - p.sum())))
    return Model(hashes[order], weights[order], other, lam, base=docs["toxic"] / (docs["toxic"] + docs["clean"]), words=[kept[i]["word"] for i in order])


def _root(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive lambda at which the background's mean of exp(lambda * score) is 1."""
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


SEGMENT = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def raw_scores(docs: DataFrame, model: Model, text_col: str = "text", passages: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, best (the best segment's score, 0 without one), evidence (once the model has its K) and,
    if asked for, passages (all maximal segments)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("evidence", T.DoubleType())]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(texts: list[bytes]) -> list[pa.Array]:
        n, found = _scan(texts, shared.value)
        scores = [[s for _, _, s in f] for f in found]
        made = [pa.array(n, pa.int64()), pa.array([max(s, default=0.0) for s in scores], pa.float64()), pa.array([evidence(shared.value, s, int(k)) for s, k in zip(scores, n)], pa.float64())]
        return made + ([pa.array([[{"first": a, "end": b, "score": s} for a, b, s in f] for f in found], kind)] if passages else [])

    return map_text(docs, text_col, T.StructType(fields + [T.StructField("passages", T.ArrayType(SEGMENT))] * passages), work, keep)


def evidence(model: Model, scores: list[float], n: int) -> float:
    """What the best segment of a text of n words says, from 0 to 60 in hundredths, which are the bins of the fit."""
    if not scores:
        return 0.0
    best = model.lam * max(scores) - math.log(model.k * max(n, 1))
    return round(min(max(best, 0.0), 60.0) + 0.01, 2)


def _with_evidence(found: DataFrame, model: Model) -> DataFrame:
    """(evidence, toxic) of (n_words, scores, toxic)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [evidence(model, s, n) for n, s in zip(batch.column("n_words").to_pylist(), batch.column("scores").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.float64()), batch.column("toxic")], ["evidence", "toxic"])

    return found.select("n_words", "scores", "toxic").mapInArrow(work, "evidence double, toxic long")


def fit_constant(model: Model, scored: DataFrame) -> Model:
    """The extreme-value constant from scored (n_words, best, toxic), all rows."""
    clean = scored.where("toxic = 0").agg(F.sum("n_words").alias("n"), F.count_if(F.col("best") > 0).alias("c"), F.min(F.when(F.col("best") > 0, F.col("best"))).alias("x")).first()
    least = clean["x"] if clean["x"] is not None else float(model.weights[model.weights > 0].min(initial=1.0))
    model.k = ((clean["c"] or 0) + 0.5) / max(1, clean["n"] or 0) * math.exp(min(50.0, model.lam * least))
    return model


def calibrate(model: Model, scored: DataFrame) -> Model:
    """The logistic curve from scored (evidence, toxic), all rows."""
    bins = scored.groupBy("evidence").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("evidence").collect()  # 6001 rows at most
    x, t, n = (np.asarray([r[i] for r in bins], float) for i in range(3))
    model.slope, model.offset = fit_logistic(x, t, n)
    return model


def fit_logistic(x: np.ndarray, t: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """slope and offset by Newton's method over bins with t of n rows toxic."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (t - n * p) - ridge * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def probability(model: Model) -> Column:
    if not len(model.hashes):
        return F.lit(float(model.base))
    z = model.slope * F.col("evidence") + model.offset
    return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn: Column | None = None, **how) -> Model:
    """Learns from the documents that have a label and for which may_learn holds (all of them without it)."""
    rows = docs if may_learn is None else docs.where(may_learn)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) != 0).cast("long")).alias("toxic"))
    known = checkpointed(known)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    labelled = rows.select(F.col(id_col).alias("__id"), text.alias("text")).join(known, "__id").select("text", "toxic")
    model = learn_words(labelled, **how)
    if len(model.hashes):
        found = raw_scores(labelled, model, passages=True, keep=["toxic"])
        found = checkpointed(found.select("toxic", "n_words", "best", F.transform("passages", lambda s: s["score"]).alias("scores")))
        model = fit_constant(model, found)
        model = calibrate(model, _with_evidence(found, model))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    rows = raw_scores(docs.select(row_of(kept).alias("kept"), F.col(f"`{text_col}`").alias("text")), model, "text", keep=["kept"])
    return rows.select(*of_row(kept, "kept"), probability(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def significant_passages(docs: DataFrame, model: Model, text_col: str = "text", max_e: float = 0.05) -> DataFrame:
    """docs with passages: every maximal segment of which max_e or fewer are expected in a clean text of that length."""
    rows = raw_scores(docs, model, text_col, passages=True)
    e = lambda s: model.k * F.col("n_words") * F.exp(-model.lam * s["score"])
    return rows.withColumn("passages", F.filter("passages", lambda s: e(s) <= max_e))
