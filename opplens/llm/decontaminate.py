"""Benchmark decontamination: a broadcast hash set of benchmark word windows is held against every window of the corpus.

Words are runs of ASCII digits and letters (A-Z folded) and of characters beyond ASCII. A window is `n` consecutive words
of a benchmark item; an item with fewer words, but not none, is one window. Every hash hit is verified word for word.

The windows are collected and broadcast only up to `broadcast_limit` bytes; a larger benchmark is taken in blocks of
windows of about that size, each held against all documents, and the blocks' hits are merged by the text's digest. Documents
are never shuffled in the usual case, so no key can be hot.

Defined results: a null or empty text has no words and no hits; null or empty items have no window; equal texts get equal
results; repeated item ids count once; an empty benchmark gives no hits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, map_text, scan_before, window_hashes, word_hashes, word_spans

SPAN = T.StructType([T.StructField("word_start", T.LongType()), T.StructField("word_end", T.LongType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_LIMIT = 64 << 20


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n_words, window): the distinct windows of all items, words joined by a space."""
    fold = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(fold, F.lit(WORDS), F.lit(0)).alias("w")).where("size(w) > 0 and item is not null")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))).alias("i")
    return words.select("item", "w", at).select("item", F.least(F.size("w"), F.lit(n)).alias("n_words"), F.concat_ws(" ", F.slice("w", F.col("i"), n)).alias("window")).distinct()


class WindowSet:
    """The windows of one block: sorted hashes by length, and the items of each window."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, set[str]] = {}
        by_length: dict[int, set[bytes]] = {}
        for item, n, window in rows:
            self.items.setdefault(window.encode(), set()).add(item)
            by_length.setdefault(n, set()).add(window.encode())
        self.hashes = {n: np.unique(np.concatenate([_hash_all(w, n) for w in windows])) for n, windows in by_length.items()}

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[list[str]]]:
        """For each text its number of words, the maximal hit runs of words, and the items that occur."""
        buf, starts, ends, offsets, first = word_spans(texts)
        words = word_hashes(buf, starts, ends)
        deep = np.zeros(len(words) + 1, np.int64)
        found: dict[int, set[str]] = {}
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        for n, known in self.hashes.items():
            hashes = window_hashes(words, n)
            if not len(hashes):
                continue
            at = np.searchsorted(known, hashes)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes)
            for i in hit[text_of[hit] == text_of[hit + n - 1]].tolist():
                window = b" ".join(buf[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))
                if items := self.items.get(window):
                    deep[i] += 1
                    deep[i + n] -= 1
                    found.setdefault(int(text_of[i]), set()).update(items)
        covered = np.concatenate([[0], (np.cumsum(deep)[:-1] > 0).astype(np.int8)])
        spans: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for t in found:
            a, b, base = int(first[t]), int(first[t + 1]), int(offsets[t])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[1 + a : 1 + b], [0]])))
            spans[t] = [(int(x), int(y), int(starts[a + x]) - base, int(ends[a + y - 1]) - base) for x, y in zip(edge[::2], edge[1::2])]
        return np.diff(first), spans, [sorted(found.get(t, ())) for t in range(len(texts))]


def _hash_all(window: bytes, n: int) -> np.ndarray:
    buf, starts, ends, _, _ = word_spans([window])
    return window_hashes(word_hashes(buf, starts, ends), n)


def _scan(docs: DataFrame, text_col: str, windows: list, keep: list[str] | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(windows))

    def work(texts: list[bytes]) -> list[pa.Array]:
        n, spans, items = shared.value.find(texts)
        return [pa.array(n, pa.int64()), pa.array([[dict(zip(SPAN.names, s)) for s in x] for x in spans], pa.list_(pa.struct([(k, pa.int64()) for k in SPAN.names]))), pa.array(items, pa.list_(pa.string()))]

    return map_text(docs, text_col, HITS, work, keep)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """docs with n_words, spans (maximal runs of hit words, with byte offsets) and items (sorted ids of what occurs)."""
    windows = benchmark_windows(benchmark, n, item_col, item_text_col)
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 64)).first()[0] or 0
    count = max(1, math.ceil(size / broadcast_limit))
    if count == 1:
        return _scan(docs, text_col, windows.collect(), None)
    key = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), F.col(f"`{text_col}`").alias("t"))
    parts = None
    for b in range(count):  # a stated set of windows, block by block, against all rows
        block = windows.where(F.pmod(F.xxhash64("window"), F.lit(count)) == b).collect()
        part = _scan(keyed, "t", block, ["key"]).where("size(items) > 0")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.dropDuplicates(["key", "spans", "items"]).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select("key", join_spans(F.col("found")).alias("spans"), "items")
    counted = _scan(keyed, "t", [], ["row", "key"]).drop("spans", "items")
    none = F.expr("cast(array() as array<struct<word_start:bigint,word_end:bigint,byte_start:bigint,byte_end:bigint>>)")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in HITS.names]
    return counted.join(merged, "key", "left").select(*kept, "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def join_spans(spans: Column) -> Column:
    """Spans in any order to disjoint ones in order; those that touch are joined."""

    def join(s: Column, reach: Column) -> Column:
        fresh = lambda i: (i == 0) | (F.get(s, i)["word_start"] > F.get(reach, i)["word_end"])
        last = F.get(scan_before(F.concat(s, F.slice(s, 1, 1)), nothing, further), F.size(s))
        end = lambda heads, k, top: F.coalesce(F.get(reach, F.get(heads, k + 1)), top)
        one = lambda heads, i, k, top: F.struct(F.get(s, i)["word_start"].alias("word_start"), end(heads, k, top)["word_end"].alias("word_end"), F.get(s, i)["byte_start"].alias("byte_start"), end(heads, k, top)["byte_end"].alias("byte_end"))
        return let(last, lambda top: let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), fresh), lambda heads: F.transform(heads, lambda i, k: one(heads, i, k, top))))

    nothing = F.struct(*[F.lit(-1).cast("long").alias(n) for n in SPAN.names])
    further = lambda a, b: F.when(b["word_end"] > a["word_end"], b).otherwise(a)
    return F.when(F.size(spans) > 0, let(F.array_sort(spans), lambda s: let(scan_before(s, nothing, further), lambda reach: join(s, reach)))).otherwise(spans)


def remove_spans(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """The scanned documents without their hit spans, for training on what is left of a document."""
    raw = F.col(f"`{text_col}`").cast("string").cast("binary")
    parts = lambda s: F.transform(s, lambda x, i: F.substring(raw, (F.when(i > 0, F.get(s, i - 1)["byte_end"]).otherwise(0) + 1).cast("int"), (x["byte_start"] - F.when(i > 0, F.get(s, i - 1)["byte_end"]).otherwise(0)).cast("int")))
    text = let(F.col("spans"), lambda s: F.array_join(F.transform(F.concat(parts(s), F.array(F.substring(raw, (F.element_at(s, -1)["byte_end"] + 1).cast("int"), F.lit(2147483647)))), lambda b: F.decode(b, "UTF-8")), ""))
    return hits.withColumn(text_col, F.when(F.size("spans") > 0, text).otherwise(F.col(f"`{text_col}`")))


def digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the counts of hit words and items and a digest of the items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["word_end"] - s["word_start"])
    return hits.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def keep_clean(hits: DataFrame) -> DataFrame:
    """Only the documents that no window occurs in."""
    return hits.where("size(items) = 0")
