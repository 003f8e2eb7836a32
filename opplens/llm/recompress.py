"""Substring de-duplication by recompression: words go that a window covers whose words also start in a document of a smaller id.

Rounds of recompression name runs of equal symbols and then pairs of unlike ones: a pair is merged where a hash puts the left symbol
on the left side and the right one on the right. A name is the hash of what it stands for, so every task gives equal strings equal
names and a round needs no dictionary. What a symbol depends on is known: the words that were looked at to form it, itself and
some neighbours. A symbol all of whose words lie in a window is an interior symbol of the window, wherever its words occur.

1. Each window takes as its anchor, of its interior symbols of the highest level, the one that hashes least. Windows next to each
   other that share an anchor are a run, one row. Its digit is the hash of the words that the anchor depends on, and its content
   that of all its words. Equal windows have equal digits.
2. Digits meet by hash range. A digit of one document is no repeat. Of runs of equal content all but those of the smallest id go at
   once, in the task that found them already if it has several. Runs of that id are looked at further where their digit has
   other contents.
3. Of those runs the single windows are grouped by content, with the smallest id of each group.

Rows travel packed, one for each task and hash range, so that counts of rows stay small. A task sends of a content only the smallest
id's runs, and of a digit with more than MANY contents one row that says so, while all its runs are looked at further. Digits and
contents have 64 bits each and are used together; windows have 128: equality is exact up to a collision of those.

Null and empty texts have no words; texts shorter than a window lose nothing. Of equal texts all but those of the smallest id lose
all that windows cover. Rows of one id are never smaller than each other, so repeated rows have equal results; a null id is
neither smaller nor larger than any: such rows lose nothing and take nothing. The added columns replace input columns of their
names, all others pass through, whatever their names are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, mix, of_row, powers, row_of, salted_join, stored, text_bytes
from .repeats import BASES, INVERSES

#: Runs a task gathers before it sends what it has; some 200 bytes each while they are sorted.
GATHER = 300_000
#: Rows of a batch whose texts are taken out of Arrow at a time.
SLICE = 256
#: Contents of one digit in one task beyond which its runs are looked at window by window without meeting the other tasks' first.
MANY = 32
#: Interval tables up to this many bytes are broadcast, beyond it the texts are shuffled.
BROADCAST_BYTES = 48 << 20
#: Bytes that lie between words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.isin(np.arange(256), SPACES)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rounds_for(window: int) -> int:
    """As many rounds as leave interior symbols in most windows: each about doubles what a symbol depends on."""
    return max(1, window.bit_length() - 2)


def word_names(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """(two 64-bit names of each word, the number of words of each text)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    values = data.astype(np.uint64) + np.uint64(1)
    names = []
    for base, inverse in zip(BASES, INVERSES):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * powers(base, len(data)), out=total[1:])
        names.append(mix((total[ends] - total[starts]) * powers(inverse, len(data))[starts] + (ends - starts).astype(np.uint64) * _ODD))
    return names, np.diff(np.searchsorted(starts, offsets))


class Symbols:
    """The symbols of one level over texts laid end to end: names, the words they cover, and the words they depend on."""

    def __init__(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.name, self.start, self.end, self.first, self.last = name, start, end, first, last

    def joined(self, heads: np.ndarray, name: np.ndarray) -> Symbols:
        """Each stretch from a head to before the next as one symbol of that name."""
        tails = np.concatenate([heads[1:], [len(self.name)]]) - 1
        return Symbols(name, self.start[heads], self.end[tails], np.minimum.reduceat(self.first, heads), np.maximum.reduceat(self.last, heads))

    def runs(self) -> Symbols:
        """Runs of equal symbols get one name; that a run ends where it does depends on its neighbours."""
        heads = np.flatnonzero(np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        size = np.diff(np.concatenate([heads, [len(self.name)]])).astype(np.uint64)
        out = self.joined(heads, np.where(size > 1, mix(self.name[heads] * _ODD + size), self.name[heads]))
        before, after = heads[1:] - 1, heads[1:]
        out.first[1:], out.last[1:] = np.minimum(out.first[1:], self.first[before]), np.maximum(out.last[1:], self.last[before])
        out.first[:-1], out.last[:-1] = np.minimum(out.first[:-1], self.first[after]), np.maximum(out.last[:-1], self.last[after])
        return out

    def pairs(self, level: int) -> Symbols:
        """A left symbol and a right one after it get one name; that a symbol stays alone depends on the neighbour it could join."""
        left = (mix(self.name + np.uint64(level)) & np.uint64(1)) == 0
        merges = left[:-1] & ~left[1:]
        heads = np.flatnonzero(np.concatenate([[True], ~merges]))
        tails = np.concatenate([heads[1:], [len(left)]]) - 1
        out = self.joined(heads, np.where(heads < tails, mix(self.name[heads] * _ODD + mix(self.name[tails] + np.uint64(level))), self.name[heads]))
        alone = np.flatnonzero(heads == tails)
        other = heads[alone] + np.where(left[heads[alone]], 1, -1)
        there = (other >= 0) & (other < len(left))
        alone, other = alone[there], other[there]
        out.first[alone], out.last[alone] = np.minimum(out.first[alone], self.first[other]), np.maximum(out.last[alone], self.last[other])
        return out


def levels(names: np.ndarray, sizes: np.ndarray, rounds: int) -> list[Symbols]:
    """The symbols of each level. A border symbol lies before, between and after the texts, and no window holds one: place p of text i
    is at p + i + 1."""
    texts = np.repeat(np.arange(len(sizes)), sizes)
    total = len(names) + len(sizes) + 1
    name = np.empty(total, np.uint64)
    at = np.arange(len(names)) + texts + 1
    border = np.ones(total, bool)
    border[at] = False
    name[at] = names
    name[border] = mix(np.arange(len(sizes) + 1, dtype=np.uint64) * _ODD + np.uint64(77))  # unlike each other, so never a run
    place = np.arange(total)
    found = [Symbols(name, place, place + 1, place.copy(), place + 1)]
    for k in range(rounds):
        found.append(found[-1].runs().pairs(k + 1))
    return found


def anchors(names: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, first and last word that the anchor depends on) of each run of windows; all in words of
    all texts laid end to end with a border before each."""
    ends = np.cumsum(sizes + 1)  # the border after each text
    starts = ends - sizes
    many = np.maximum(sizes - window + 1, 0)
    p = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    first, last = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    open_ = np.arange(len(p))
    for symbols in reversed(levels(names, sizes, rounds_for(window))):
        usable = np.flatnonzero(symbols.last - symbols.first <= window)
        order = usable[np.argsort(symbols.first[usable], kind="stable")]
        lo, hi, rank = symbols.first[order], symbols.last[order], mix(symbols.name[order] ^ _ODD)
        at = np.searchsorted(lo, p[open_])
        best = np.full(len(open_), -1, np.int64)
        least = np.full(len(open_), np.iinfo(np.uint64).max, np.uint64)
        going = np.arange(len(open_))
        while True:
            going = going[at[going] < len(lo)]
            going = going[lo[at[going]] < p[open_[going]] + window]
            if not len(going):
                break
            here = at[going]
            better = (hi[here] <= p[open_[going]] + window) & ((rank[here] < least[going]) | (best[going] < 0))
            best[going[better]] = here[better]
            least[going[better]] = rank[here[better]]
            at[going] += 1
        done = best >= 0
        first[open_[done]], last[open_[done]] = lo[best[done]], hi[best[done]]
        open_ = open_[~done]
        if not len(open_):
            break
    text = np.repeat(np.arange(len(sizes)), many)
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])])) if len(p) else np.zeros(0, np.int64)
    tail = np.concatenate([head[1:], [len(p)]])[: len(head)] - 1
    return text[head], p[head], p[tail], first[head], last[head], starts


class Stretches:
    """Hashes of stretches of names, over texts laid end to end with a border before each."""

    def __init__(self, names: list[np.ndarray], sizes: np.ndarray) -> None:
        at = np.arange(len(names[0])) + np.repeat(np.arange(len(sizes)), sizes) + 1
        self.n, self.sums = len(names[0]) + len(sizes) + 1, []
        for name, base in zip(names, BASES):
            values = np.zeros(self.n, np.uint64)
            values[at] = name
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * powers(base, self.n), out=total[1:])
            self.sums.append(total)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mix((s[ends] - s[starts]) * powers(INVERSES[which], self.n)[starts] + (ends - starts).astype(np.uint64) * _ODD)


def runs(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, digit, content) of each run; the first window in words of its text."""
    names, sizes = word_names(texts)
    text, lo, hi, first, last, starts = anchors(names[0], sizes, window)
    hashes = Stretches(names, sizes)
    digit = hashes.of(first, last, 0)
    # the place of the anchor in the run and the number of windows belong to the content
    shape = ((first - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    content = mix(hashes.of(lo, hi + window, 1) + mix(shape))
    return text, lo - starts[text], hi - lo + 1, digit, content


#: kind 0: runs to meet others of their digit; 1: digits that are open; 2: runs to look at further; 3: runs that go.
PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("g", "c", "doc", "tag", "lo", "n")])
_KINDS = {"g": np.uint64, "c": np.uint64, "doc": np.int64, "tag": np.int64, "lo": np.int32, "n": np.int32}


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, so that the bytes that are zero throughout compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _joined_planes(parts: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(p, np.uint8).reshape(size, -1).T.copy().view(kind)[:, 0] for p in parts if p]])


def _packed(bucket: int, kind: int, columns: dict[str, np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *[pa.array([_planes(columns[c][pick])], pa.binary()) for c in _KINDS]], PACKED.names)


def _unpacked(rows: list[tuple[bytes, ...]]) -> dict[str, np.ndarray]:
    return {c: _joined_planes([r[k] for r in rows], kind) for k, (c, kind) in enumerate(_KINDS.items())}


def _decide(x: dict[str, np.ndarray], is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs sorted by digit, content and id: (those that go, contents of the digit, whether several ids have the digit, and
    the number of the digit). is_open: digits known to have other contents elsewhere."""
    g, c, doc = x["g"], x["c"], x["doc"]
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
    heads, group, content = np.flatnonzero(new_g), np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    least = doc[np.flatnonzero(new_c)]
    kinds = np.add.reduceat(new_c.astype(np.int64), heads)[group]
    several = (np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads))[group]
    if len(is_open):
        known = np.isin(g, is_open)
        kinds, several = np.where(known, np.maximum(kinds, 2), kinds), several | known
    return doc > least[content], kinds, several, group


def _sorted(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((x["doc"], x["c"], x["g"]))
    return {c: v[order] for c, v in x.items()}


def _by_document(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((x["lo"], x["tag"], x["doc"]))
    return {c: v[order] for c, v in x.items()}


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE rows, so that the texts of a whole batch are not there twice."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def find_runs(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc, tag, text) to packed rows of runs."""

    def send(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = _sorted({c: np.concatenate([p[c] for p in parts]) for c in _KINDS})
        parts.clear()
        gone, _, _, _ = _decide(x, np.zeros(0, np.uint64))
        at = np.flatnonzero(~gone)  # still sorted
        _, kinds, _, group = _decide({c: x[c][at] for c in ("g", "c", "doc")}, np.zeros(0, np.uint64))
        many = kinds > MANY
        heads = many & np.concatenate([[True], group[1:] != group[:-1]])
        for kind, pick in ((3, np.flatnonzero(gone)), (2, at[many]), (1, at[heads]), (0, at[~many])):
            some = _by_document({c: v[pick] for c, v in x.items()})
            bucket = ((some["g"] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64) if kind < 2 else mix(some["doc"].view(np.uint64) ^ some["tag"].view(np.uint64)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                yield _packed(b, kind, some, order[edges[b] : edges[b + 1]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        held = 0
        for batch in sliced(batches):
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = text_bytes(batch.column(2))
            for lo, hi in blocks(texts):
                text, first, n, digit, content = runs(texts[lo:hi], window)
                if len(text):
                    parts.append({"g": digit, "c": content, "doc": ids[lo + text], "tag": tags[lo + text], "lo": first.astype(np.int32), "n": n.astype(np.int32)})
                    held += len(text)
                if held > GATHER:
                    yield from send(parts)
                    held = 0
        if held:
            yield from send(parts)

    return docs.mapInArrow(work, PACKED)


INTERVALS = "doc long, tag long, kind int, spans binary"


def _intervals(x: dict[str, np.ndarray], kind: int, window: int) -> Iterator[pa.RecordBatch]:
    """The runs of each document in one row: the intervals of windows, or of words that go."""
    x = _by_document(x)
    doc, tag = x["doc"], x["tag"]
    if not len(doc):
        return
    heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
    pairs = np.stack([x["lo"], x["lo"] + x["n"] + (0 if kind == 2 else window - 1)], 1).astype(np.int32)
    spans = [p.tobytes() for p in np.split(pairs, heads[1:])]
    for lo in range(0, len(heads), 10_000):
        some = heads[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(tag[some]), pa.array([kind] * len(some), pa.int32()), pa.array(spans[lo : lo + 10_000], pa.binary())], ["doc", "tag", "kind", "spans"])


#: Hash ranges that a task settles, one after the other.
SPREAD = 4


def meet(packed: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed rows by hash range to (doc, tag, kind, spans): what goes (3) and what is looked at further (2)."""

    def settle(rows: dict[int, list[tuple[bytes, ...]]]) -> Iterator[pa.RecordBatch]:
        gone, asked = [_unpacked(rows.get(3, []))], [_unpacked(rows.get(2, []))]
        if 0 in rows:
            x = _sorted(_unpacked(rows[0]))
            goes, kinds, several, _ = _decide(x, _unpacked(rows.get(1, []))["g"])
            ask = several & (kinds > 1) & ~goes
            gone.append({c: v[goes] for c, v in x.items()})
            asked.append({c: v[ask] for c, v in x.items()})
        for kind, parts in ((3, gone), (2, asked)):
            yield from _intervals({c: np.concatenate([p[c] for p in parts]) for c in _KINDS}, kind, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            for bucket, kind, *values in zip(*[column.to_pylist() for column in batch.columns]):
                if bucket != now and rows:
                    yield from settle(rows)
                    rows = {}
                now = bucket
                rows.setdefault(kind, []).append(tuple(values))
        if rows:
            yield from settle(rows)

    return packed.repartition(buckets // SPREAD, "bucket").sortWithinPartitions("bucket").mapInArrow(work, INTERVALS)


def find_windows(asked: DataFrame, window: int) -> DataFrame:
    """(doc, tag, text, spans) to a row for each window asked of, with two hashes of its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, tags, texts, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist()
            for a, b in blocks(texts):
                names, sizes = word_names(texts[a:b])
                hashes = Stretches(names, sizes)
                starts = np.cumsum(sizes + 1) - sizes
                pairs = [np.frombuffer(x, np.int32).reshape(-1, 2).astype(np.int64) for x in listed[a:b]]
                own = np.repeat(np.arange(b - a), [int((x[:, 1] - x[:, 0]).sum()) for x in pairs])
                lo, end = (np.concatenate([x[:, k] for x in pairs]) for k in (0, 1))
                n = end - lo
                place = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = place + starts[own]
                made = [hashes.of(at, at + window, h).view(np.int64) for h in (0, 1)]
                spans = pa.py_buffer(np.stack([place, place + window], 1).astype(np.int32).tobytes())
                spans = pa.Array.from_buffers(pa.binary(8), len(place), [None, spans]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids[a:b], np.int64)[own]), pa.array(np.asarray(tags[a:b], np.int64)[own]), spans, *map(pa.array, made)], ["doc", "tag", "spans", "w1", "w2"])

    return asked.mapInArrow(work, "doc long, tag long, spans binary, w1 long, w2 long")


def merge_spans(parts: list[bytes]) -> list[tuple[int, int]]:
    """Intervals in any order, joined where they touch."""
    if not parts:
        return []
    x = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    head = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    first = np.flatnonzero(head)
    return list(zip(x[first, 0].tolist(), reach[np.concatenate([first[1:], [len(x)]]) - 1].tolist()))


def gather_spans(rows: DataFrame) -> DataFrame:
    """(doc, tag, spans) with any number of rows a document to one row, in which intervals that touch are one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [np.asarray(merge_spans(x), np.int32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(merged, pa.binary())], ["doc", "tag", "spans"])

    return rows.groupBy("doc", "tag").agg(F.collect_list("spans").alias("spans")).mapInArrow(work, "doc long, tag long, spans binary")


def _join_texts(docs: DataFrame, listed: DataFrame, how: str = "inner") -> DataFrame:
    """docs with the spans that listed has of their (doc, tag), broadcast where they are few."""
    size = listed.agg(F.count(F.lit(1)) * 64 + F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()[0]
    return docs.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, ["doc", "tag"], how)


def repeated_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc, tag, text) to (doc, tag, spans): the intervals of words that go, as pairs of 32-bit numbers."""
    buckets = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(meet(find_runs(docs, window, buckets), window, buckets))
    asked = stored(gather_spans(found.where("kind = 2").select("doc", "tag", "spans")))
    windows = stored(find_windows(_join_texts(docs, asked), window))
    twice = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("times")).where("least < most").drop("most")
    more = salted_join(windows, twice, ["w1", "w2"], "times", F.struct("doc", "spans")).where("doc > least").select("doc", "tag", "spans")
    return gather_spans(found.where("kind = 3").select("doc", "tag", "spans").unionByName(more))


def remove_repeated_windows(docs: DataFrame, window: int = 13, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_removed, removed (intervals of words), kept (the words that stay, joined by a space) and kept_sha256.

    keep: the columns to pass through (all, but for clashes)."""
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in added}]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("tag")).where("doc is not null")
    # the tag tells texts of one id apart, if there are any
    several = not ids.groupBy("doc").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a < b").isEmpty()
    own = docs.select(row_of(kept).alias("row"), F.col(f"`{id_col}`").alias("doc"), (F.xxhash64(text) if several else F.lit(0).cast("long")).alias("tag"), text.alias("text"))
    spans = stored(repeated_words(own.where("doc is not null and octet_length(text) >= 2 * %d - 1" % window).select("doc", "tag", "text"), window))
    joined = _join_texts(own, spans, "left").select("row", "text", "spans")
    schema = T.StructType([joined.schema["row"], *added.fields])
    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, listed = text_bytes(batch.column(1)), batch.column(2).to_pylist()
            for a, b in blocks(texts):
                counts, gone, left = [], [], []
                for text, parts in zip(texts[a:b], listed[a:b]):
                    words = text.split()  # of bytes: at ASCII white space
                    spans = np.frombuffer(parts or b"", np.int32).reshape(-1, 2).tolist()
                    counts.append(len(words))
                    gone.append(spans)
                    edges = [0, *(x for s in spans for x in s), len(words)]
                    left.append(b" ".join([w for lo, hi in zip(edges[::2], edges[1::2]) for w in words[lo:hi]] if spans else words))
                made = [pa.array(counts, pa.int64()), pa.array([sum(hi - lo for lo, hi in s) for s in gone], pa.int64()), pa.array([[{"start": lo, "end": hi} for lo, hi in s] for s in gone], interval), pa.array(left, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in left])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made], schema.names)

    return joined.mapInArrow(work, schema).select(*of_row(kept), *added.names)
