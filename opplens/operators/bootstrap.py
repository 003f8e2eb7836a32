"""Block bootstrap of any statistic that is a function of sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import exact_quantiles, running_before

#: Blocks of a part, at most 65,536; places of a draw that are hashed together; picks that a task packs at a time.
PART, STRETCH, PACKED = 8192, 4096, 1 << 20
#: The constants of MD5.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _drawn(places: DataFrame, m: int, seed: int) -> DataFrame:
    """places (draw, place) with the block b that each of them gets, by a hash, so reruns agree."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("place").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return places.withColumn("b", F.pmod(number, F.lit(m)))


def _shape(n: int, block: int) -> tuple[int, int, int]:
    """(blocks, rows of the last one, places of a draw): a short last block makes draws longer; enough places for a draw of nothing else is
    never needed but for tiny tables."""
    m = -(-n // block)
    short = n - (m - 1) * block
    return m, short, m + (0 if short == block else m + 32 if m > 8 else m * block + 8)


def picks(rows: DataFrame, n: int, block: int, draws: int, seed: int) -> DataFrame:
    """(draw, b, k, times): how often each draw takes the first k rows of block b. Blocks are drawn until they hold n rows, and the last
    one is cut. The plain definition, for small tables: bootstrap() gets at the same sums without these rows."""
    m, short, places = _shape(n, block)
    x = _drawn(rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(places))).alias("place")), m, seed)
    x = x.withColumn("size", F.when(F.col("b") == m - 1, short).otherwise(block))
    before = F.sum("size").over(Window.partitionBy("draw").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("k", F.least("size", F.lit(n) - F.coalesce(before, F.lit(0)))).where("k > 0")
    return x.groupBy("draw", "b", F.col("k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("times"))


def hashes(prefix: str, numbers: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of prefix + each number in decimal, many at a time; prefix and number have at most 55 characters."""
    out = np.empty(len(numbers), np.uint32)
    width = np.searchsorted(10 ** np.arange(1, 19), numbers, "right") + 1
    for digits in np.unique(width):
        at = np.flatnonzero(width == digits)
        x, n = numbers[at], len(prefix) + int(digits)
        text = np.zeros((64, len(at)), np.uint8)
        text[: len(prefix)] = np.frombuffer(prefix.encode(), np.uint8)[:, None]
        for i in range(int(digits)):
            x, text[n - 1 - i] = x // 10, x % 10 + 48
        text[n] = 128
        text[56], text[57] = n * 8 & 255, n * 8 >> 8
        # only the first words differ
        words = [np.ascontiguousarray(text[4 * w : 4 * w + 4].T).view("<u4")[:, 0] if w <= n // 4 else text[4 * w : 4 * w + 4, 0].copy().view("<u4")[0] for w in range(16)]
        state = a, b, c, d = [np.full(len(at), v, np.uint32) for v in _START]
        for i in range(64):
            kind = i // 16
            f, word, turn = _mix(kind, b, c, d), words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16], _TURNS[kind][i % 4]
            f += a
            f += word + _ADDED[i] if np.ndim(word) else np.uint32((int(word) + int(_ADDED[i])) & 0xFFFFFFFF)
            high = f >> np.uint32(32 - turn)
            f <<= np.uint32(turn)
            f |= high
            f += b
            a, d, c, b = d, c, b, f
        out[at] = (state[0] + a).byteswap()  # the digest is little-endian, its hex digits are read from the left
    return out


def _mix(kind: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if kind == 0:
        return d ^ (b & (c ^ d))
    return c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)


def _packed(m: int, draws: int, seed: int, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The picks of stretches (draw, s) as bytes by part of the blocks: four or six bytes a pick."""
    draw_type, part_type = "<u2" if draws <= 1 << 16 else "<u4", np.uint16 if m // width < 1 << 16 else np.int64

    def flush(held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        draw, b = np.repeat([d for d, _ in held], [len(x) for _, x in held]).astype(draw_type), np.concatenate([x for _, x in held])
        part = (b // width).astype(part_type)
        order = np.argsort(part, kind="stable")
        draw, b, part = draw[order], (b[order] % width).astype("<u2"), part[order].astype(np.int64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*at[1:], len(part)]
        return pd.DataFrame({"part": part[at], "draws": [draw[i:j].tobytes() for i, j in zip(at, ends)], "blocks": [b[i:j].tobytes() for i, j in zip(at, ends)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for draw, s in zip(batch["draw"], batch["s"]):
                held.append((draw, hashes(f"{seed}:{draw}:", np.arange(s * STRETCH + 1, min((s + 1) * STRETCH, m - 1) + 1)) % np.int64(m)))
                n += len(held[-1][1])
                if n >= PACKED:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _full(totals: DataFrame, names: list[str], m: int, draws: int, seed: int) -> DataFrame:
    """(draw, sums): what the blocks of the places 1 to m - 1 of each draw hold. Those are always taken whole, so their order does not matter.

    Picks go to the blocks of their part as packed bytes, and a part gives one row a draw: neither blocks nor picks meet in one task."""
    spark, width = totals.sparkSession, min(PART, 1 << 16)
    stretches = -(-(m - 1) // STRETCH)
    x = spark.range(draws * stretches, numPartitions=min(-(-draws * stretches // 256), 4096)).select((F.col("id") % draws).alias("draw"), F.floor(F.col("id") / draws).alias("s"))
    packed = x.mapInPandas(_packed(m, draws, seed, width), "part long, draws binary, blocks binary")
    held = totals.withColumn("part", F.floor(F.col("b") / width))

    def add(picked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(picked):
            return pd.DataFrame(columns=["draw", *names])
        of = {c: np.zeros(width) for c in names}
        for c in names:
            of[c][held["b"].to_numpy() % width] = held[c].to_numpy(np.float64)
        out = {c: np.zeros(draws) for c in names}
        for d, b in zip(picked["draws"], picked["blocks"]):
            d, b = np.frombuffer(d, "<u2" if draws <= 1 << 16 else "<u4"), np.frombuffer(b, "<u2")
            for c in names:
                out[c] += np.bincount(d, of[c][b], draws)
        return pd.DataFrame({"draw": np.arange(draws), **out})

    parts = packed.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(add, f"draw long, {', '.join(f'{c} double' for c in names)}")
    return parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in names])


def bootstrap(rows: DataFrame, order: str, sums: dict[str, Column], statistic: Column, block: int = 10, draws: int = 1000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row (count, estimate, lower, upper, blocks): the statistic, an expression over the names of sums, of all rows in the order of
    `order` (a number without ties), and the lower-index quantiles of it over draws of blocks of consecutive rows.

    Rows become running sums within their block, so a draw meets blocks and not rows. A draw of m blocks takes its first m - 1 whole; only
    the few places after them depend on how many rows are there already."""
    total = rows.select(order, *[c.cast("double").alias(n) for n, c in sums.items()])
    placed = running_before(total.withColumn("__one", F.lit(1)), order, "__one", "__at")
    placed = placed.withColumn("b", F.floor(F.col("__at") / block))
    n = rows.count()
    whole = total.agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).alias(c) for c in sums]).select("count", statistic.alias("estimate"))
    if not n:
        return whole.select("count", F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.lit(0).alias("blocks"))
    m, short, places = _shape(n, block)
    ends = _drawn(rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(m), F.lit(places))).alias("place")), m, seed)
    ends = ends.withColumn("size", F.when(F.col("b") == m - 1, short).otherwise(block))
    samples = None
    if m > 1:
        full = _full(placed.groupBy("b").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in sums]), ["__n", *sums], m, draws, seed)
        samples, taken = full.select("draw", *sums), full.select("draw", F.col("__n").cast("long").alias("taken"))
        ends = ends.join(taken, "draw")
    else:
        ends = ends.withColumn("taken", F.lit(0).cast("long"))
    before = F.sum("size").over(Window.partitionBy("draw").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("k", F.least("size", F.lit(n) - F.col("taken") - F.coalesce(before, F.lit(0)))).where("k > 0")
    # a few rows a draw: those places that are reached
    last = placed.select("b", (F.col("__at") % block).alias("__i"), *sums).join(F.broadcast(ends.select("draw", "b", "k")), "b").where("__i < k").select("draw", *sums)
    samples = last if samples is None else samples.unionByName(last)
    samples = samples.groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums]).select(statistic.alias("s"))
    bounds = exact_quantiles(samples, "s", {"lower": ("lower", low), "upper": ("lower", high)})
    return whole.join(F.broadcast(bounds)).withColumn("blocks", F.lit(m))  # one row each
