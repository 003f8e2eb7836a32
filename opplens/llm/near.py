"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's words (A-Z folded) give its k-mers of `k` words, each labelled with its occurrence number. Each of `sketches`
hash functions picks the `order` least labelled k-mers and keeps them in text order; their hash is one sketch value. Documents
that share a value are candidates, and are linked if their edit similarity, 1 - distance / longer length in words, is at
least `similarity`. The alignment walks diagonals outwards only as far as that similarity allows.

Equal texts are one node from the start, and classes are connected components. A value's group never meets in one task:

1. Every member is aligned with one leader, the least key of its groups. That joins nearly all of a group of copies.
2. In the groups that still hold several classes every pair of members of different classes is looked at: groups are cut into
   blocks, each two blocks meet in one task, and pairs are held against length and word histogram, which bound the edit
   distance. Pairs of one class are never made.
3. The task aligns what is left of its pairs, nearest first, and keeps count of the classes that it has joined, so that pairs
   of what is joined are passed over. It gives the links that join, fewer than it has members: pairs never become rows.

So no pair of candidates is left out that could join two classes; what can be missed are pairs that share no sketch value at all.

Texts without words are only like equal texts; texts of fewer than k words are one k-mer. Null is empty. Rows with equal
texts are of one class; a class is named by its least id, nulls aside. An empty table gives no rows. Input columns keep their
names, whatever they are: columns made here are only read from tables made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, map_text, mix, stored, window_hashes, word_hashes, word_spans

#: Key tables up to this many rows are broadcast, beyond it the texts are shuffled.
BROADCAST_KEYS = 400_000
#: Members of a group that are one block, and the words that they have together, about.
BLOCK, BLOCK_WORDS = 512, 1 << 20
#: Texts on each side of a tile of pairs that are aligned, about.
TILE = 64
#: Buckets of a word histogram, how many of them are first taken together, and pairs that are held against each other in one step.
BUCKETS, TOGETHER, STEP = 1024, 8, 4096
#: Low bits that hold a k-mer's place in its text.
PLACE = np.uint64((1 << 24) - 1)


def order_min_hash(texts: list[bytes], k: int, sketches: int, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text its number of words and its sketch values."""
    buf, starts, ends, _, first = word_spans(texts)
    words = word_hashes(buf, starts, ends)
    n = np.diff(first)
    grams = window_hashes(words, k)
    count = np.maximum(n - k + 1, np.minimum(n, 1))
    base = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(base[-1]) - base[doc] + first[doc]
    values = np.zeros(base[-1], np.uint64)
    long = n[doc] >= k
    values[long] = grams[at[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):  # the whole text is the one k-mer
        values[base[i]] = window_hashes(words[first[i] : first[i + 1]], int(n[i]))[0]
    # occurrence numbers of equal k-mers in a text
    own = mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[by][1:] != own[by][:-1]])
    run = np.flatnonzero(new)
    number = np.empty(len(by), np.uint64)
    number[by] = np.arange(len(by)) - np.repeat(run, np.diff(np.append(run, len(by))))
    labelled = values + number * np.uint64(0xC2B2AE3D27D4EB4F)
    full = np.flatnonzero(count > 0)
    out = np.zeros((len(texts), sketches), np.uint64)
    if len(full):
        cut, size = base[full], count[full]
        place = np.arange(base[-1], dtype=np.uint64) - np.repeat(cut, size).astype(np.uint64)
        for s in range(sketches):
            # the place in the text is in the low bits, so the least values bring their places
            ranks = (mix(labelled ^ mix(np.array([s + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & ~PLACE) | place
            picked = np.zeros((order, len(full)), np.int64)
            for j in range(order):
                least = np.minimum.reduceat(ranks, cut)
                more = size > j
                picked[j] = np.where(more, cut + (least & PLACE).astype(np.int64), picked[j - 1] if j else 0)
                ranks[picked[j][more]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            picked.sort(0)  # text order
            value = np.full(len(full), s, np.uint64)
            for j in range(order):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + labelled[picked[j]])
            out[full, s] = value
    return n, [out[i] if n[i] else out[i, :0] for i in range(len(texts))]


#: One edit touches at most this many word n-grams of this length, so near texts share most of them.
GRAM = 4


def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word n-grams of a text, sorted, and how often it has each."""
    return np.unique(window_hashes(words, GRAM), return_counts=True)


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many word n-grams two texts share, repeated ones as often as both have them."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    return int(np.minimum(x[1][i], y[1][j]).sum())


def edit_distance(a: np.ndarray, b: np.ndarray, most: int, grams: tuple | None = None) -> int | None:
    """The edit distance of two arrays of word hashes, or None if it is above most; grams: their n-grams, if they are known.

    Furthest-reaching points on the diagonals up to NARROW edits: a text is walked once along each diagonal that is reached.
    Texts that differ more are aligned in the whole band.
    """
    if abs(len(a) - len(b)) > most or _shared(*(grams or (grams_of(a), grams_of(b)))) < max(len(a), len(b)) - GRAM + 1 - GRAM * most:
        return None
    x, y = a.tolist(), b.tolist()
    n, m = len(x), len(y)
    reach: dict[int, int] = {}
    for d in range(min(most, NARROW) + 1):
        now: dict[int, int] = {}
        for k in range(max(-d, -n), min(d, m) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1, -k if d else 0)
            i = min(i, n, m - k)
            while i < n and i + k < m and x[i] == y[i + k]:
                i += 1
            if i == n and k == m - n:
                return d
            now[k] = i
        reach = now
    return band_distance(x, y, most) if most > NARROW else None


#: Edits up to which diagonals are followed one by one.
NARROW = 10


def band_distance(x: list[int], y: list[int], most: int) -> int | None:
    """The edit distance of x and y, or None above most: a band of `most` diagonals to each side, a column at a time.

    A column's vertical steps in the band are the bits of two integers, up and down; bit t of column j is row j - most + t. So a
    column takes a few operations on integers of 2 * most + 1 bits. The distance is followed along the diagonal that ends in the
    last cell, on which it never falls.
    """
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return None
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << 2 * most + 1) - 1
    up, down = whole & ~((1 << most) - 1), 0  # rows up to 0 have no steps, the first column's others go up
    track = 1 << most + n - m
    edits = abs(n - m)
    for j in range(1, m + 1):
        at = places.get(y[j - 1], 0)
        at = (at << most + 1 - j if j <= most + 1 else at >> j - most - 1) & whole
        level = (((at & up) + up) ^ up | at | down) & whole  # cells that cost no more than the one before on their diagonal
        right, left = (down | ~(level | up)) & whole, level & up
        if j > m - n and not level & track:
            edits += 1
            if edits > most:
                return None
        level >>= 1
        up, down = (left | ~(level | right)) & whole, level & right
    return edits


def _aligned(pairs: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, g) whose texts have an edit similarity of least.

    The pairs of a group g are tiled by hashes of a and b, and a text goes once to each tile that needs it, not once to each
    pair: a tile has about TILE texts on each side, however many pairs a text or a group has.
    """
    tiles = pairs.groupBy("g").agg(F.ceil(F.approx_count_distinct("a") / TILE).alias("na"), F.ceil(F.approx_count_distinct("b") / TILE).alias("nb"))
    tiles = stored(tiles, most := pairs.count())
    tiled = pairs.join(F.broadcast(tiles) if tiles.count() <= BROADCAST_KEYS else tiles, "g")
    tiled = stored(tiled.select(F.xxhash64("g", F.pmod(F.xxhash64("a"), "na"), F.pmod(F.xxhash64("b"), "nb")).alias("u"), "a", "b"), most)
    needed = stored(tiled.select("u", F.explode(F.array("a", "b")).alias("key")).distinct(), 2 * most)
    wanted = needed.select("key").distinct()
    texts = keyed.join(F.broadcast(wanted) if needed.count() <= BROADCAST_KEYS else wanted, "key", "left_semi").dropDuplicates(["key"])
    rows = needed.join(texts, "key").select("u", F.col("key").alias("a"), F.lit(None).cast("binary").alias("b"), "text")
    rows = rows.unionByName(tiled.withColumn("text", F.lit(None).cast("string"))).repartition("u").sortWithinPartitions("u")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_runs(batches, "u"):
            keys, others, texts = tile.column("a").to_pylist(), tile.column("b").to_pylist(), tile.column("text").to_pylist()
            own = [i for i, b in enumerate(others) if b is None]
            words: dict[bytes, np.ndarray] = {}
            for lo, hi in blocks([(texts[i] or "").encode() for i in own]):
                buf, starts, ends, _, first = word_spans([(texts[i] or "").encode() for i in own[lo:hi]])
                hashes = word_hashes(buf, starts, ends)
                words |= {keys[i]: hashes[first[k] : first[k + 1]] for k, i in enumerate(own[lo:hi])}
            found = [(a, b) for a, b in zip(keys, others) if b is not None and similarity_of(words[a], words[b], least) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return rows.mapInArrow(work, "a binary, b binary")


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a sorted column, whatever the batches are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and len(values) and values[0] != held[-1].column(column)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(values)]):
            if held and lo:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def similarity_of(a: np.ndarray, b: np.ndarray, least: float, grams: tuple | None = None) -> float | None:
    """The edit similarity of two arrays of word hashes if it is at least least."""
    longer = max(len(a), len(b))
    d = edit_distance(a, b, int(longer * (1 - least) + 1e-9), grams) if longer else None
    return None if d is None else 1 - d / longer


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (key, root): the least key of each connected component.

    A step offers every key the labels of its neighbours, every label those of its keys' neighbours and every key the label of
    its label, and keeps the least, by one aggregation. The steps grow with the logarithm of the longest path; each is cut off
    from the last. Labels are broadcast up to BROADCAST_KEYS rows and joined by shuffling beyond.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root"))
    labels = stored(labels, most := 2 * edges.count())
    small = labels.count() <= BROADCAST_KEYS
    while True:
        def of(key: str, root: str) -> DataFrame:
            named = labels.select(F.col("key").alias(key), F.col("root").alias(root))
            return F.broadcast(named) if small else named

        met = both.join(of("a", "ra"), "a").join(of("b", "rb"), "b")
        own = labels.join(of("root", "far"), "root")
        offers = met.select(F.col("a").alias("key"), F.col("rb").alias("root"), F.lit(None).cast("binary").alias("old"))
        offers = offers.unionByName(met.where("rb < ra").select(F.col("ra").alias("key"), F.col("rb").alias("root"), F.lit(None).cast("binary").alias("old")))
        offers = offers.unionByName(own.select("key", F.col("far").alias("root"), F.col("root").alias("old")))
        moved = stored(offers.groupBy("key").agg(F.min("root").alias("root"), F.max("old").alias("old")), most)
        labels = moved.select("key", "root")
        if moved.where("root != old").isEmpty():
            return labels


def merged_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots after links between their classes: only the classes' roots are joined anew."""
    if roots is None:
        return components(links)
    most = roots.count() + 2 * links.count()
    edges = with_roots(with_roots(links, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b").distinct()
    higher = components(stored(edges, most))
    ends = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).distinct()
    everyone = roots.unionByName(ends.join(roots, "key", "left_anti").select("key", F.col("key").alias("root")))
    return stored(with_roots(everyone.withColumnRenamed("root", "old"), higher, "old", "root").select("key", "root"), most)


def histograms(hashes: list[np.ndarray]) -> np.ndarray:
    """How many of each text's words fall into each bucket, 255 at most."""
    counts = [np.minimum(np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8) for h in hashes]
    return np.array(counts, np.uint8).reshape(len(hashes), BUCKETS)


def least_edits(n: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in i and j of the pairs that can have an edit similarity of least, how many edits they have at least): an edit
    adds one word to a histogram and takes one from it at most. Coarse histograms are looked at first."""
    most = (np.maximum(n[i], n[j]) * (1 - least) + 1e-9).astype(np.int64)
    ok = np.flatnonzero(np.abs(n[i] - n[j]) <= most)
    edits = np.zeros(len(ok), np.int64)
    for of in (words.reshape(len(words), -1, TOGETHER).sum(2, dtype=np.int16), words):
        off = of[i[ok]].astype(np.int16) - of[j[ok]]
        up = np.maximum(off, 0).sum(1)
        edits = np.maximum(up, up - off.sum(1))
        like = edits <= most[ok]
        ok, edits = ok[like], edits[like]
    return ok, edits


def _pairs_of(kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j of different kinds, for rows sorted by kind, in steps."""
    n = len(kind)
    after = np.searchsorted(kind, kind, side="right")
    more = n - after
    upto = np.cumsum(more)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP, side="right")))
        first = np.repeat(np.arange(lo, hi), more[lo:hi])
        begin = np.cumsum(more[lo:hi]) - more[lo:hi]
        yield first, np.repeat(after[lo:hi], more[lo:hi]) + np.arange(len(first)) - np.repeat(begin, more[lo:hi])
        lo = hi


def _joining(members: DataFrame, sketched: DataFrame, roots: DataFrame | None, keyed: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the classes of each group as far as any of its pairs would, fewer than its members for each task.

    A pair that shares several sketch values is looked at in the group of the first of them only.
    """
    rooted = with_roots(members.select("h", "s", "key", "n"), roots)
    groups = rooted.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    groups = stored(groups.select("h", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("w") / BLOCK_WORDS)).cast("int").alias("blocks")), most := members.count())
    side = F.broadcast(groups) if groups.count() <= BROADCAST_KEYS else groups
    mixed = stored(rooted.join(side, "h").select("h", "s", "key", "root", "blocks"), most)
    wanted = stored(mixed.select("key").distinct(), most)
    few = wanted.count() <= BROADCAST_KEYS

    def hashed(texts: list[bytes]) -> list[pa.Array]:
        buf, starts, ends, _, first = word_spans(texts)
        hashes = word_hashes(buf, starts, ends)
        return [pa.array([hashes[first[i] : first[i + 1]].tobytes() for i in range(len(texts))], pa.binary())]

    texts = keyed.join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
    read = map_text(texts, "text", T.StructType([T.StructField("words", T.BinaryType())]), hashed, ["key"]).dropDuplicates(["key"])
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    values = sketched.select("key", "sketch").join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
    rows = mixed.join(read, "key").join(values, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("h", F.least("block", "other"), F.greatest("block", "other")).alias("g"), (F.col("block") == F.col("other")).alias("one"), "block", "s", F.xxhash64("root").alias("r"), "key", "words", "sketch")
    # two blocks are a run of equal g; "one" tells whether the run is a single block, whose members all meet
    rows = rows.repartition("g").sortWithinPartitions("g", "r")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "g"):
            one, block, r = (table.column(c).to_numpy() for c in ("one", "block", "r"))
            words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
            sketch = np.asarray(table.column("sketch").to_pylist(), np.int64)
            i, j = joining_pairs(r, one, block, sketch, table.column("s")[0].as_py(), words, least)
            key = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([key.take(pa.array(i, pa.int64())), key.take(pa.array(j, pa.int64()))], ["a", "b"])

    return rows.mapInArrow(meet, "a binary, b binary")


def joining_pairs(kind: np.ndarray, one: np.ndarray, block: np.ndarray, sketch: np.ndarray, own: int, words: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Members i and j of the links that join kinds, for members sorted by kind; pairs of kinds that are joined are not aligned."""
    above: dict[int, int] = {}
    grams: dict[int, tuple] = {}
    found: tuple[list[int], list[int]] = ([], [])

    def top(k: int) -> int:
        while (up := above.get(k, k)) != k:
            above[k] = k = above.get(up, up)
        return k

    def grams_at(i: int) -> tuple:
        if i not in grams:
            grams[i] = grams_of(words[i])
        return grams[i]

    n, counts, kinds = np.array([len(w) for w in words]), histograms(words), kind.tolist()
    for i, j in _pairs_of(kind):
        meet_here = one[i] | (block[i] != block[j])
        i, j = i[meet_here], j[meet_here]
        first = (sketch[i] == sketch[j]).argmax(1) == own
        i, j = i[first], j[first]
        like, edits = least_edits(n, counts, i, j, least)
        for at in like[np.argsort(edits, kind="stable")].tolist():
            x, y = int(i[at]), int(j[at])
            a, b = top(kinds[x]), top(kinds[y])
            if a != b and similarity_of(words[x], words[y], least, (grams_at(x), grams_at(y))) is not None:
                above[a] = b
                found[0].append(x)
                found[1].append(y)
    return found


def with_roots(rows: DataFrame, roots: DataFrame | None, key: str = "key", root: str = "root") -> DataFrame:
    """rows with the root of their key, which is the key itself where roots does not have it."""
    if roots is None:
        return rows.withColumn(root, F.col(key))
    side = roots.select(F.col("key").alias(key), F.col("root").alias("__root"))
    side = F.broadcast(side) if roots.count() <= BROADCAST_KEYS else side
    return rows.join(side, key, "left").select(*rows.columns, F.coalesce("__root", F.col(key)).alias(root))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, sketches: int = 24, order: int = 3, text_col: str = "text") -> DataFrame:
    """(key, root) of the texts that are linked to others; key is the MD5 of the text, root names the class."""
    added = T.StructType([T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])

    def work(texts: list[bytes]) -> list[pa.Array]:
        n, values = order_min_hash(texts, k, sketches, order)
        flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n, pa.int64())]

    keyed = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketched = stored(map_text(keyed, "text", added, work, ["key"]).dropDuplicates(["key"]))
    rows = sketched.select("key", "n", F.posexplode("sketch").alias("s", "h"))
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("lead")).where("c > 1").select("h", "lead")
    members = stored(rows.join(groups, "h"))
    led = stored(members.where("key != lead").groupBy("key").agg(F.min("lead").alias("a")).select("a", F.col("key").alias("b")), members.count())
    links = stored(_aligned(led.withColumn("g", F.xxhash64("a")), keyed, similarity))
    roots = None if links.isEmpty() else components(links)
    found = stored(_joining(members, sketched, roots, keyed, similarity))
    if not found.isEmpty():
        roots = merged_roots(roots, found)
    return roots if roots is not None else docs.sparkSession.createDataFrame([], "key binary, root binary")


def text_key(text_col: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, class_id, class_size): a row for each document; class_id is the least id of the class."""
    roots = near_duplicates(docs, text_col=text_col, **how)
    ids = stored(with_roots(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key")), roots).select("id", "root"))
    classes = ids.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return ids.join(classes, "root").select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class: one with the least id, nulls last; of rows equal in id and text any."""
    roots = near_duplicates(docs, text_col=text_col, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"))
    counted = with_roots(rows.select("id", "key"), roots).groupBy("root", "id", "key").agg(F.count(F.lit(1)).alias("rows"))
    counted = stored(counted)
    kept = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "rows")).alias("k"), F.sum("rows").alias("size"))
    kept = stored(kept.select("root", "k.id", "k.key", "k.rows", "size"))
    lost = counted.join(kept.where("size > rows").select("root", F.col("id").alias("keep_id"), F.col("key").alias("keep_key")), "root")
    lost = stored(lost.where(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key")))).select("id", "key"))
    again = stored(kept.where("rows > 1").select("id", "key"))
    same = F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.key") == F.col("l.key"))
    side = lambda df: (F.broadcast(df) if df.count() <= BROADCAST_KEYS else df).alias("l")
    rest = rows.alias("d").join(side(lost), same, "left_anti")
    if not again.isEmpty():
        one = rest.alias("d").join(side(again), same, "left_semi").dropDuplicates(["id", "key"])
        rest = rest.alias("d").join(side(again), same, "left_anti").unionByName(one)
    return rest.select("row.*")
