"""Suffix-array de-duplication: bytes that lie in a window of `length` bytes that also starts somewhere else are removed.

Only the order of suffixes up to `length` bytes matters, and of that only which suffixes are equal, so the suffixes are sorted
by a depth-limited most-significant-digit radix sort, whose digits are held by hashes; groups of one leave the sort.

1. First digit: the anchor of a window, which is the least hashed string of length // 2 bytes in it (of equals the last). Equal
   windows have equal anchors at equal places. The windows that share an anchor occurrence are neighbours and form a run, so one
   row stands for about length // 4 suffixes.
2. Second digit: the content of the whole run. Runs of equal content are repeated in all their windows.
3. Third digit: blocks of BLOCK windows at equal places from the anchor, at anchors where some run has no equal. Windows can
   only be equal if what all windows of their block have in common is, so blocks whose common part is alone leave.
4. Fourth digit: the single windows of the blocks that are left. Groups of two or more are exactly the repeated windows.

All counts are partial sums first, so neither thousands of copies nor a passage in a third of all documents meets in one task;
rows meet their counts in joins of tables that are written before, whose large partitions adaptive execution splits.
Windows never cross documents. Digits beyond the first have 128 bits.

Null and empty texts are empty; texts shorter than `length` lose nothing; copies of a text lose everything that is in a window,
repeated rows too; equal texts get equal results; an empty table gives no rows. The added columns replace input columns of
their names; all others pass through, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, checkpointed, mix, of_row, powers, row_of, stored, text_bytes

#: Odd bases of the two polynomial hashes, and their inverses modulo 2**64.
BASES = tuple(np.uint64(b) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
#: Longer texts are cut into overlapping pieces, each of which holds other windows.
PIECE = 1 << 20
#: Interval tables up to this many bytes are broadcast, beyond it the texts are shuffled.
BROADCAST_BYTES = 48 << 20
#: Windows in a block of the third digit.
BLOCK = 16
#: Without adaptive skew joins, a digit that more rows than this have is dealt to several tasks.
HEAVY = 50_000
#: Rows that go to Python at once while repeats are looked for.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOW = np.uint64(0xFFFFFF)


class Hashes:
    """Polynomial hashes of all substrings of a block."""

    def __init__(self, data: np.ndarray, both: bool = True) -> None:
        self.n = len(data)
        self.sums = []
        values = data.astype(np.uint64) + np.uint64(1)
        for base in BASES[: 2 if both else 1]:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * powers(base, self.n), out=s[1:])
            self.sums.append(s)

    def of(self, starts: np.ndarray, length: np.ndarray | int, which: int) -> np.ndarray:
        s = self.sums[which]
        return (s[starts + length] - s[starts]) * powers(INVERSES[which], self.n)[starts]

    def every(self, length: int) -> np.ndarray:
        s = self.sums[0]
        return (s[length:] - s[:-length]) * powers(INVERSES[0], self.n)[: self.n + 1 - length]


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(text number, offset in it) of each piece, and the pieces one after the other, in blocks."""
    cut = [(i, at) for i, t in enumerate(texts) if len(t) >= length for at in range(0, max(1, len(t) - length + 1), PIECE)]
    parts = [texts[i][at : at + PIECE + length - 1] for i, at in cut]
    for lo, hi in blocks(parts, 256 << 10):
        yield [i for i, _ in cut[lo:hi]], [at for _, at in cut[lo:hi]], parts[lo:hi]


def runs(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(piece, first window, last window, anchor, anchor hash, two content hashes) of each run."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    gram = length // 2
    hashes = Hashes(data)
    rank = mix(hashes.every(gram))
    rank = (rank & ~_LOW) | (_LOW - np.arange(len(rank), dtype=np.uint64))  # of equals the last is least
    span, low = 1, rank
    need = length - gram + 1
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(data) - length + 1
    low = np.minimum(low[:n], low[need - span : need - span + n])
    anchor = (_LOW - (low & _LOW)).astype(np.int64)
    piece = np.repeat(np.arange(len(parts)), sizes)[:n]
    whole = np.arange(n) + length <= ends[piece]
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (piece[1:] != piece[:-1])) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [n]]) - 1
    good = whole[first]
    first, last = first[good], last[good]
    digit = mix(hashes.of(anchor[first], gram, 0))
    # the place of the anchor in the run and the run's size belong to its content
    shape = ((anchor[first] - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    content = [mix(hashes.of(first, last - first + length, h) + mix(shape)) for h in (0, 1)]
    base = np.concatenate([[0], ends[:-1]])[piece[first]]
    return piece[first], first - base, last - base, anchor[first] - base, digit, *content


RUN = "key binary, a long, c1 long, c2 long, lo int, hi int, at int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_runs(keyed: DataFrame, length: int) -> DataFrame:
    """(key, text) to a row for each run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for number, offset, parts in pieces(texts, length):
                piece, lo, hi, at, digit, c1, c2 = runs(parts, length)
                off = np.asarray(offset)[piece]
                names = pa.array([keys[i] for i in number], pa.binary()).take(pa.array(piece))
                yield pa.RecordBatch.from_arrays([names, _signed(digit), _signed(c1), _signed(c2), pa.array((lo + off).astype(np.int32)), pa.array((hi + off).astype(np.int32)), pa.array((at + off).astype(np.int32))], ["key", "a", "c1", "c2", "lo", "hi", "at"])

    return keyed.mapInArrow(work, RUN)


def _blocks(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, last window, block number) of the blocks of runs, counted backwards from the anchor."""
    low, high = (at - hi) // BLOCK, (at - lo) // BLOCK
    run = np.repeat(np.arange(len(lo)), high - low + 1)
    number = np.arange(len(run)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[run]
    return run, np.maximum(lo[run], at[run] - number * BLOCK - BLOCK + 1), np.minimum(hi[run], at[run] - number * BLOCK), number


BLOCKS = "key binary, lo int, hi int, n long, a long, m int, k1 long, k2 long, c1 long, c2 long"


def _find_blocks(with_runs: DataFrame, length: int) -> DataFrame:
    """(key, text, runs) to a row for each block of the runs: its windows, its runs' number, what groups it, and its content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                hashes = Hashes(np.frombuffer(text, np.uint8))
                lo, hi, at, n, a = (np.asarray([r[k] for r in own], np.int64) for k in ("lo", "hi", "at", "n", "a"))
                run, first, last, number = _blocks(lo, hi, at)
                start = at[run] - number * BLOCK
                core = [mix(hashes.of(start, length - BLOCK + 1, h)) for h in (0, 1)]
                shape = mix(((at[run] - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64))
                content = [mix(hashes.of(first, last - first + length, h) + shape) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(run), pa.binary()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(n[run]), pa.array(a[run]), pa.array(number.astype(np.int32)), *map(_signed, core), *map(_signed, content)], [x.split(" ")[0] for x in BLOCKS.split(", ")])

    return with_runs.mapInArrow(work, BLOCKS)


def _find_windows(with_runs: DataFrame, length: int) -> DataFrame:
    """(key, text, runs) to a row for each window of the runs: (key, lo of its run, place, w1, w2, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, own in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                hashes = Hashes(np.frombuffer(text, np.uint8))
                lo, hi, n = (np.asarray([r[k] for r in own], np.int64) for k in ("lo", "hi", "n"))
                size = hi - lo + 1
                run = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + lo[run]
                w = [mix(hashes.of(place, length, h)) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(run), pa.binary()), pa.array(lo[run].astype(np.int32)), pa.array(place.astype(np.int32)), *map(_signed, w), pa.array(n[run])], ["key", "lo", "at", "w1", "w2", "n"])

    return with_runs.mapInArrow(work, "key binary, lo int, at int, w1 long, w2 long, n long")


def _weigh(rows: DataFrame, group: list[str], content: list[str]) -> DataFrame:
    """rows with m, how often their content occurs in their group, and open: whether the group holds a content that is alone
    beside others. Rows that are alone in their group are gone.

    Contents and open groups are written before they are joined: a group of very many contents is one key of that join, and only a
    partition that comes straight from a shuffle can be split."""
    kinds = stored(rows.groupBy(*group, *content).agg(F.sum("n").alias("times")))
    groups = kinds.groupBy(*group).agg(F.min("times").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 and kinds > 1")
    known = kinds.join(stored(groups.select(*group, F.lit(True).alias("open"))), group, "left")
    known = known.select(*group, *content, "times", F.coalesce("open", F.lit(False)).alias("open")).where("times > 1 or open")
    return _spread_join(rows, known, [*group, *content], "times")


def _splits(spark: SparkSession) -> bool:
    """Whether the large partitions of a join are split by Spark itself."""
    return all(spark.conf.get(f"spark.sql.adaptive.{k}enabled").lower() == "true" for k in ("", "skewJoin."))


def _spread_join(rows: DataFrame, known: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows (with key and lo) joined with known, which has a row for each value of on and in n how many rows there are of it.

    A value of very many rows makes a large partition, which adaptive execution splits; known is written before, as that takes a
    shuffle right below either side. Where that is off, values of more than HEAVY rows are salted: their rows are dealt by content
    to several tasks, each of which gets the known row. There are at most rows / HEAVY such values, which bounds what is broadcast.
    """
    known = stored(known)
    if _splits(rows.sparkSession):
        return rows.join(known, on)
    heavy = stored(known.where(F.col(n) > HEAVY).select(*on, F.ceil(F.col(n) / HEAVY).cast("int").alias("salts")), known.count())
    if heavy.isEmpty():
        return rows.join(known, on)
    salts = F.coalesce("salts", F.lit(1))
    salted = rows.join(F.broadcast(heavy), on, "left").withColumn("salt", F.pmod(F.xxhash64("key", "lo"), salts).cast("int")).drop("salts")
    known = known.join(F.broadcast(heavy), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(known, [*on, "salt"]).drop("salt")


def _by_key(rows: DataFrame, *columns: str) -> DataFrame:
    return checkpointed(rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("runs")))


def repeated_intervals(keyed: DataFrame, length: int) -> DataFrame:
    """(key, text) to (key, spans): the byte intervals that repeated windows cover, in order."""
    rows = find_runs(keyed, length)
    known = rows.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    near = stored(_spread_join(rows, known, ["a"], "k").drop("k").withColumn("n", F.lit(1).cast("long")))
    weighed = stored(_weigh(near, ["a"], ["c1", "c2"]).select("key", "a", "c1", "c2", "lo", "hi", "at", "times", "open"))
    spans = weighed.where("times > 1").select("key", "lo", (F.col("hi") + length).alias("end"))
    # of contents that occur more often one run stands for all
    alone = weighed.where("open and times = 1").select("key", "lo", "hi", "at", "a", "times")
    one = weighed.where("open and times > 1").groupBy("a", "c1", "c2").agg(F.min(F.struct("key", "lo", "hi", "at")).alias("r")).select("r.*", "a", F.lit(2).cast("long").alias("times"))
    asked = _by_key(alone.unionByName(one).withColumnRenamed("times", "n"), "lo", "hi", "at", "n", "a")
    parts = stored(_find_blocks(pick_texts(keyed, asked).select("key", "text", "runs"), length))
    weighed = stored(_weigh(parts, ["a", "m", "k1", "k2"], ["c1", "c2"]).select("key", "lo", "hi", "n", "times", "open"))
    spans = spans.unionByName(weighed.where("times > 1 and n = 1").select("key", "lo", (F.col("hi") + length).alias("end")))
    asked = _by_key(weighed.where("open"), "lo", "hi", "n")
    windows = _find_windows(pick_texts(keyed, asked).select("key", "text", "runs"), length)
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("m")).where("m > 1").select("w1", "w2")
    found = windows.where("n = 1").join(twice, ["w1", "w2"]).groupBy("key", "lo").agg(F.min("at").alias("first"), (F.max("at") + length).alias("end"))
    spans = spans.unionByName(found.select("key", F.col("first").alias("lo"), "end")).distinct()
    return spans.groupBy("key").agg(F.collect_list(F.struct("lo", "end")).alias("spans")).mapInArrow(_join_spans, "key binary, spans array<struct<lo:int,end:int>>")


def pick_texts(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts of the keys in asked, with asked's columns. Copies of a text come as often as they are: what is asked of a
    repeated text counts as repeated already, so that does not change a result."""
    size = asked.agg(F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.size("runs")), F.lit(0)) * 40).first()[0]
    return keyed.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "key")


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, spans in any order) with the spans sorted and joined where they touch."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = []
        for spans in batch.column(1):
            done: list[dict] = []
            for lo, end in sorted((s["lo"], s["end"]) for s in spans.as_py()):
                if done and lo <= done[-1]["end"]:
                    done[-1]["end"] = max(done[-1]["end"], end)
                else:
                    done.append({"lo": lo, "end": end})
            rows.append(done)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["key", "spans"])


def cut(text: Column, spans: Column) -> Column:
    """What is left of a binary text without its spans, which are in order and do not touch; a text without spans is not rebuilt."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["lo"]), F.array(F.length(text).cast("int")))
    parts = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(text, a + 1, b - a)))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.unhex(F.array_join(parts, ""))).otherwise(text)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile goes to Python by BATCH_ROWS rows at most: whole texts in the usual batches of 10,000 rows are
    held by each task several times, as Arrow buffers on both sides and as Python values."""
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(usual), BATCH_ROWS) if int(usual) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, usual)


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, removed (the byte intervals), kept_sha256 and kept (the bytes that stay)."""
    added = ("n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "kept")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    with small_batches(docs.sparkSession):
        spans = checkpointed(repeated_intervals(docs.select(key.alias("key"), text.alias("text")), length))
    size = spans.agg(F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.size("spans")), F.lit(0)) * 24).first()[0]
    kept = [c for c in docs.columns if c.lower() not in added]
    # the columns that pass through travel in one struct, so that their names cannot meet those of this operator
    joined = docs.select(row_of(kept).alias("row"), key.alias("key"), text.cast("binary").alias("t")).join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "key", "left")
    known = F.coalesce("spans", F.expr("cast(array() as array<struct<lo:int,end:int>>)"))
    removed = F.transform(known, lambda s: F.struct(s["lo"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    n_removed = F.aggregate(known, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["lo"])
    out = joined.select("row", F.length("t").cast("long").alias("n_bytes"), n_removed.alias("n_removed"), removed.alias("removed"), cut(F.col("t"), known).alias("kept"))
    return out.select(*of_row(kept), "n_bytes", "n_removed", "removed", "kept", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
