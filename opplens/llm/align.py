"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

An event sweep. Each text is encoded by both vocabularies; where a token of either ends is an event. The events of A and B are
united, dealt by document, sorted by offset within their partition, and stream through a machine that keeps only the open
group: where both end, a group closes; between two neighbouring ends one token of A and one of B overlap, which is a link.

1. Events travel in blocks: for BLOCK bytes of a document and one side the ends as a bitmap and the ids in order, so that a row stands
   for some thousand events. The machine takes a block of both sides at a time and carries on what the last common end left open.
2. Links are counted by id pair over the corpus: partial counts in tasks, then sums. A pair is best if no other of its B id has more.
3. The pairs of each document are held against the counts: looked up in sorted arrays while those are small, joined by pair beyond.

The text is encoded in segments, cut at single spaces between characters that are no white space; no token of either vocabulary crosses
such a cut, and segments that come again are encoded once. A vocabulary for which that is not so is refused.

Null and empty texts have no tokens; neither have texts whose joined token bytes of A or B are not a space and the text. Special tokens in
a text are plain text. Repeated rows count as often as they are. Added columns replace input columns of their names, all others pass
through, whatever their names are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, of_row, row_of, salted_join, stored, text_bytes

#: Bytes of a text in a block of events; a multiple of 8.
BLOCK = 1 << 16
#: Segments after which a worker forgets all it remembers before the next block; and segments that are encoded as one string.
REMEMBERED, JOINED = 500_000, 4096
#: Pair counts up to this many are looked up in arrays of 13 bytes each, beyond it they are joined.
LOOKED_UP = 2_000_000
#: Cuts between segments.
CUT, TWO = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


class Vocabularies:
    """Both vocabularies, with the bytes of each token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        to_byte = {chr(b): b for b in printable} | {chr(next(rest)): b for b in range(256) if b not in set(printable)}
        size = self.a.get_vocab_size()
        self.bytes_a = [b""] * size
        for piece, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for k, p in enumerate(pieces) if not self.b.is_byte(k)) or self.a.normalizer is not None:
            raise ValueError("tokens cross the spaces between words")
        self.size_a, self.size_b = size, len(pieces)
        self.lengths = [np.asarray([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.decimal = [str(k).encode() for k in range(max(self.size_a, self.size_b))]
        #: id, then what follows it: another id, side B, another group, or nothing
        self.written = [d + mark for mark in (b",", b"|", b";", b"") for d in self.decimal]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        #: of the remembered segments: ids of both sides one after the other, where each segment's begin, how many, and whether it has any
        self.ids, self.begin, self.count, self.good = [none, none], [none, none], [none, none], np.zeros(0, bool)

    def _both(self, strings: list[str]) -> list[list[list[int]]]:
        """Of both sides the ids of each string, which begins with a space."""
        return [[x.ids for x in self.a.encode_batch_fast(strings, add_special_tokens=False)], self.b.encode([x[1:] for x in strings], num_threads=1)]

    def _fits(self, want: bytes, ids: list[list[int]]) -> bool:
        return all(all(parts) and b"".join(parts) == want for parts in ([held[k] for k in side] for side, held in zip(ids, (self.bytes_a, self.bytes_b))))

    def _split(self, segments: list[str], ids: list[list[int]]) -> list[np.ndarray] | None:
        """For both sides how many ids of their string each of its segments has; None if tokens are not the bytes of segments."""
        if not self._fits(" ".join(["", *segments]).encode(), ids):
            return None
        ends, counts = np.cumsum([len(x.encode()) + 1 for x in segments]), []
        for side, length in zip(ids, self.lengths):
            at = np.cumsum(length[np.asarray(side, np.int64)])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            counts.append(np.diff(np.concatenate([[-1], last])))
        return counts

    def remember(self, segments: list[str]) -> None:
        """Encodes segments, which are given without the space they begin with. Those between other words are joined to long strings,
        which fall into them again, and the others come one by one."""
        inner, alone = [], []
        for x in segments:
            (inner if x and not x[0].isspace() and not x[-1].isspace() else alone).append(x)
        parts = [inner[k : k + JOINED] for k in range(0, len(inner), JOINED)]
        order: list[str] = []
        ids: list[list[int]] = [[], []]
        counts: list[list[np.ndarray]] = [[], []]
        good: list[bool] = []
        for some, *both in zip(parts, *self._both([" ".join(["", *x]) for x in parts])):
            found = self._split(some, both)
            if found is None:
                alone += some
                continue
            order += some
            good += [True] * len(some)
            for side in (0, 1):
                ids[side] += both[side]
                counts[side].append(found[side])
        for x, *both in zip(alone, *self._both([" " + x for x in alone])):
            order.append(x)
            good.append(self._fits((" " + x).encode(), both))
            for side in (0, 1):
                ids[side] += both[side]
                counts[side].append(np.asarray([len(both[side])]))
        for side in (0, 1):
            n = np.concatenate(counts[side])
            self.begin[side] = np.concatenate([self.begin[side], len(self.ids[side]) + np.cumsum(n) - n])
            self.count[side] = np.concatenate([self.count[side], n])
            self.ids[side] = np.concatenate([self.ids[side], np.asarray(ids[side], np.int64)])
        self.good = np.concatenate([self.good, np.asarray(good, bool)])
        first = len(self.known)
        self.known.update(zip(order, range(first, first + len(order))))

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Of each text the ids of both sides, None without tokens."""
        if len(self.known) > REMEMBERED:
            self.forget()
        # where no white space follows another, every space is a cut
        cut = [[] if not t else CUT.split(t) if t[0].isspace() or t[-1].isspace() or TWO.search(t) else t.split(" ") for t in texts]
        if new := set(chain.from_iterable(cut)).difference(self.known):
            self.remember(list(new))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for parts in cut:
            own = np.asarray(list(map(self.known.__getitem__, parts)), np.int64)
            if not len(own) or not self.good[own].all():
                out.append(None)
                continue
            sides = []
            for side in (0, 1):
                n = self.count[side][own]
                sides.append(self.ids[side][np.repeat(self.begin[side][own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
            out.append(tuple(sides))
        return out


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Vocabularies(path_a, path_b)
    return _loaded[path_a, path_b]


def end_events(docs: DataFrame, text_col: str, keep: list[str], path_a: str, path_b: str) -> DataFrame:
    """A row for each block of each side of each document: (k1, k2, block, side, ends, ids, row). row holds the columns that pass
    through, in the first row of a document, where side is -1."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # what tells rows apart: their text and the columns that pass through; rows equal in all are alike and stay side by side
    parts = [text, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in keep if c != text_col]]
    typed = docs.select(F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"), row_of(keep).alias("row"), text.alias("text"))
    schema = T.StructType([*T.StructType.fromDDL("k1 long, k2 long, block int, side int, ends binary, ids binary").fields, T.StructField("row", typed.schema["row"].dataType)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(path_a, path_b)
        kinds = [np.uint16 if n <= 1 << 16 else np.uint32 for n in (both.size_a, both.size_b)]
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = text_bytes(batch.column(3))
            for lo, hi in blocks(texts):
                own, block, side, ends, ids = [], [], [], [], []
                for i, found in enumerate(both.tokens([t.decode() for t in texts[lo:hi]])):
                    own.append(i), block.append(0), side.append(-1), ends.append(None), ids.append(None)
                    for s in (0, 1) if found else ():
                        at = np.cumsum(both.lengths[s][found[s]]) - 1  # the last byte of each token
                        marks = np.zeros(-(-(int(at[-1]) + 1) // 8) * 8, bool)
                        marks[at] = True
                        named = found[s].astype(kinds[s])
                        edges = np.searchsorted(at, np.arange(0, len(marks) + BLOCK, BLOCK))
                        for b in range(-(-len(marks) // BLOCK)):
                            own.append(i), block.append(b), side.append(s)
                            ends.append(np.packbits(marks[b * BLOCK : (b + 1) * BLOCK]).tobytes())
                            ids.append(named[edges[b] : edges[b + 1]].tobytes())
                own, side = np.asarray(own), np.asarray(side)
                rows = batch.column(2).take(pa.array(np.where(side < 0, lo + own, 0), mask=side >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(k1[lo + own]), pa.array(k2[lo + own]), pa.array(block, pa.int32()), pa.array(side.astype(np.int32)), pa.array(ends, pa.binary()), pa.array(ids, pa.binary()), rows], schema=pa.schema([pa.field(n, t) for n, t in zip(schema.names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), rows.type])]))

    return typed.mapInArrow(work, schema)


class Sweep:
    """The machine: takes events in order of offset, closes groups, and adds up a document's counts and links."""

    def __init__(self, both: Vocabularies) -> None:
        self.both = both
        self.begin()

    def begin(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.pairs: list[np.ndarray] = []
        self.open: tuple[np.ndarray, ...] = (np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def take(self, ends_a: np.ndarray, ends_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """The next bytes: whether a token of A and of B ends at each, and the ids of those that do."""
        ends_a, ends_b, ids_a, ids_b = (np.concatenate(x) if len(x[0]) else x[1] for x in zip(self.open, (ends_a, ends_b, ids_a, ids_b)))
        common = np.flatnonzero(ends_a & ends_b)
        if not len(common):
            self.open = (ends_a, ends_b, ids_a, ids_b)
            return
        upto = int(common[-1]) + 1
        marks_a, marks_b = ends_a[:upto], ends_b[:upto]
        at_a, at_b = np.flatnonzero(marks_a), np.flatnonzero(marks_b)
        self.open = (ends_a[upto:], ends_b[upto:], ids_a[len(at_a) :], ids_b[len(at_b) :])
        ids_a, ids_b = ids_a[: len(at_a)], ids_b[: len(at_b)]
        # a link for each stretch between neighbouring ends: the tokens of A and B that end there or next
        ends = np.flatnonzero(marks_a | marks_b)
        self.pairs.append(ids_a[np.searchsorted(at_a, ends)].astype(np.int64) * self.both.size_b + ids_b[np.searchsorted(at_b, ends)])
        last_a, last_b = np.searchsorted(at_a, common) + 1, np.searchsorted(at_b, common) + 1
        group_a, group_b = np.searchsorted(common, at_a), np.searchsorted(common, at_b)
        # ids in the order in which they are written: of each group A, then B; each with the mark that follows it
        n = len(self.both.decimal)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + np.concatenate([[0], last_b])[group_a]] = ids_a
        codes[np.arange(len(ids_b)) + last_a[group_b]] = ids_b
        codes[last_a - 1 + np.concatenate([[0], last_b[:-1]])] += n
        codes[last_b - 1 + last_a] += 2 * n
        if self.n_groups:
            self.digest.update(b";")
        codes[-1] += n  # what may follow is written by the next step
        self.digest.update(b"".join(map(self.both.written.__getitem__, codes.tolist())))
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + len(ids_a), self.n_b + len(ids_b), self.n_groups + len(common), self.n_links + len(ends)

    def end(self) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """The counts, digest and links of the document, which ends here."""
        pairs, times = np.unique(np.concatenate(self.pairs), return_counts=True) if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = (self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest() if self.n_groups else "", pairs, times)
        self.begin()
        return found


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def sweep(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The events to a row for each document: its columns, counts and digest, and its id pairs with how many links each has."""
    parted = events.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block", "side")
    schema = T.StructType([parted.schema["row"], *T.StructType.fromDDL("k1 long, k2 long, " + COUNTS).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(path_a, path_b)
        kinds = [np.uint16 if n <= 1 << 16 else np.uint32 for n in (both.size_a, both.size_b)]
        machine = Sweep(both)
        key: tuple[int, int] | None = None
        copies: list[pa.Array] = []  # the columns of the document that is swept, more than once if it is there more than once
        rows: list[pa.Array] = []
        made: list[tuple] = []
        waiting, done = None, -1  # side A of a block, and the last block that was taken

        def finish() -> None:
            *counts, pairs, times = machine.end()
            rows.extend(copies)
            made.extend([(*key, *counts, pairs.tobytes(), times.astype(np.int32).tobytes())] * len(copies))

        def flush() -> pa.RecordBatch:
            columns = [pa.concat_arrays(rows), *map(pa.array, zip(*made))]
            rows.clear(), made.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            k1, k2, block, side, ends, ids = (batch.column(k).to_pylist() for k in range(6))
            for i in range(batch.num_rows):
                if (k1[i], k2[i]) != key:
                    if key:
                        finish()
                        if len(made) >= 2000:
                            yield flush()
                    key, copies, done = (k1[i], k2[i]), [], -1
                if side[i] < 0:
                    copies.append(batch.column(6).slice(i, 1))
                elif side[i] == 0:
                    waiting = (ends[i], ids[i])
                elif block[i] > done:
                    done = block[i]
                    marks = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (waiting[0], ends[i])]
                    machine.take(*marks, *[np.frombuffer(x, t).astype(np.int64) for x, t in zip((waiting[1], ids[i]), kinds)])
        if key:
            finish()
        if made:
            yield flush()

    return parted.mapInArrow(work, schema)


def _pairs_of(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, their links, number of pairs of each row) of the columns pairs and times at that place."""
    pairs, times = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
    return np.frombuffer(b"".join(pairs), np.int64), np.frombuffer(b"".join(times), np.int32).astype(np.int64), np.asarray([len(x) // 8 for x in pairs], np.int64)


#: Pairs that a task adds up before it sends them.
ADDED_UP = 1_000_000


def count_pairs(swept: DataFrame) -> DataFrame:
    """(pair, n: its links in the corpus, docs: rows that have it)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def added() -> tuple[np.ndarray, ...]:
            pairs, n, docs = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            return pairs[heads], np.add.reduceat(n[order], heads), np.add.reduceat(docs[order], heads)

        for batch in batches:
            pairs, times, _ = _pairs_of(batch, 0)
            if len(pairs):
                held.append((pairs, times, np.ones(len(pairs), np.int64)))
                size += len(pairs)
            if size > ADDED_UP:
                held = [added()]
                size = len(held[0][0])
                if size > ADDED_UP // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n", "docs"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], ["pair", "n", "docs"])

    return swept.select("pairs", "times").mapInArrow(work, "pair long, n long, docs long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _look_up(swept: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """swept with n_best and count_sum, by counts that every task has in sorted arrays."""
    listed = counts.select("pair", "n", "best").toArrow()
    order = np.argsort(listed.column(0).to_numpy())
    known = swept.sparkSession.sparkContext.broadcast(tuple(np.concatenate([listed.column(k).to_numpy()[order], [0]]) for k in range(3)))
    typed = swept.select(F.struct(*columns).alias("own"), "pairs", "times")
    schema = T.StructType([typed.schema["own"], *T.StructType.fromDDL("n_best long, count_sum long").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            pairs, times, sizes = _pairs_of(batch, 1)
            at = np.searchsorted(pair[:-1], pairs)
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array((x[ends] - x[ends - sizes]).astype(np.int64)) for x in sums]], schema.names)

    return typed.mapInArrow(work, schema).select("own.*", "n_best", "count_sum")


def _join(swept: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """swept with n_best and count_sum, by a join of the pairs of each document with counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, sizes = _pairs_of(batch, 2)
            own = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(pairs), pa.array(times)], ["k1", "k2", "pair", "times"])

    once = swept.dropDuplicates(["k1", "k2"]).select("k1", "k2", "pairs", "times")
    rows = once.mapInArrow(work, "k1 long, k2 long, pair long, times long")
    summed = salted_join(rows, counts, ["pair"], "docs", F.struct("k1", "k2")).groupBy("k1", "k2").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return swept.join(summed, ["k1", "k2"], "left").select(*columns, F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None, looked_up: int = LOOKED_UP) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best (links whose pair has the most links of its B id), count_sum (of the links the
    counts of their pairs) and groups_sha256 (of the groups written as a1,a2|b1;a3|b2,b3).

    keep: the columns to pass through (all, but for clashes)."""
    names = [*[x.split(" ")[0] for x in COUNTS.split(", ")], "n_best", "count_sum"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    swept = stored(sweep(end_events(docs, text_col, kept, path_a, path_b), path_a, path_b), codec="zstd")
    both = vocabularies(path_a, path_b)
    counted = stored(count_pairs(swept))
    best = counted.groupBy((F.col("pair") % both.size_b).alias("b")).agg(F.max("n").alias("most"))
    counts = stored(counted.withColumn("b", F.col("pair") % both.size_b).join(best, "b").select("pair", "n", "docs", (F.col("n") == F.col("most")).alias("best")))
    columns = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = _look_up(swept, counts, columns) if counts.count() <= looked_up else _join(swept, counts, columns)
    return found.select(*of_row(kept), *columns[1:], "n_best", "count_sum")


def pair_table(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair of an id of A and an id of B."""
    both = vocabularies(path_a, path_b)
    return count_pairs(sweep(end_events(docs, text_col, [], path_a, path_b), path_a, path_b)).select((F.col("pair") / both.size_b).cast("long").alias("a"), (F.col("pair") % both.size_b).alias("b"), "n")
