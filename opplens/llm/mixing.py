"""Mixing sources to target weights by hash-threshold histograms.

Sources in code point order (null last) weigh `weights`, repeating. They share `share` of all words; a source stops at
`max_repeat` times its size and its excess is shared again by weight. What a source gives is whole copies of all its documents
plus those documents whose hash lies below a threshold. The threshold is found without sorting: words are summed by source
and hash digit, the digit in which the budget ends is the only one that is refined by the next digit, and so on, until the
boundary holds a single hash. The boundary hash is taken if that comes nearer to the target.

Only sums by source and digit are shuffled (16**DIGIT rows a source at most, after partial sums). The driver sees one row a
round: the totals of the sources that have reached their limit. Rows equal in id and text have one hash and share one fate.
A null text has no words; sources whose size is 0 have the target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Hex digits of the hash that one histogram resolves.
DIGIT = 3
HASH_DIGITS = 32
#: Columns that the mix adds.
ADDED = ("size", "source_size", "target", "copies")


#: Tables of a row for each source are broadcast up to this many rows, and joined by shuffling beyond it.
BROADCAST_SOURCES = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target), null source included once.

    The rank of a source counts the sources before it, by ranges of the sorted names, so no task sees all of them.
    """
    ranges = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = checkpointed(sizes.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id()))
    inside = Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last())
    ahead = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    ahead = ahead.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = spread.join(F.broadcast(ahead), "__p").withColumn("rank", F.row_number().over(inside) - 1 + F.col("before")).select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeat).alias("most"))
    ranked = checkpointed(ranked)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:  # the level only rises, so this ends after as many rounds as there are steps in which sources fill up
        full = F.lit(False) if level is None else F.col("most") < F.col("weight") * level
        got = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        higher = (total * share - got["held"]) / got["open"]
        if level is not None and higher <= level:
            break
        level = higher
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """The columns in keep, then size, source_size, target and copies (how often the mix repeats the document) of each row. These
    four replace columns of these names in keep, whatever their case; all other names are free."""
    h = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("binary"))
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in ADDED]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    rows = docs.select(row.alias("row"), F.col(f"`{source_col}`").cast("string").alias("__source"), count_words(F.col(f"`{text_col}`").cast("string")).alias("__size"), h.alias("__h"))
    narrow = rows.select("__source", "__size", "__h")
    first = checkpointed(narrow.groupBy("__source", F.substring("__h", 1, DIGIT).alias("prefix")).agg(F.sum("__size").alias("words"), F.min("__h").alias("low"), F.max("__h").alias("high")))
    targets = checkpointed(source_targets(first.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), weights, max_repeat, share))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.select(F.col("source").alias("__source"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    #: Of each source: what still has to be found below the open prefix.
    open_ = budgets.select("__source", "budget", F.lit("").alias("base"))
    hist, done, used = first, None, DIGIT
    while True:
        same = F.col("a.__source").eqNullSafe(F.col("b.__source"))
        run = Window.partitionBy("__source").orderBy("prefix")
        cells = hist.alias("a").join(_small(open_).alias("b"), same).select("a.__source", "budget", "prefix", "words", "low", "high").withColumn("upto", F.sum("words").over(run))
        edge = cells.where("upto > budget").groupBy("__source").agg(F.min_by(F.struct("prefix", "words", "upto", "budget", "low", "high"), "prefix").alias("e")).select("__source", "e.*").withColumn("left", F.col("budget") - (F.col("upto") - F.col("words")))
        edge = checkpointed(edge)
        single = edge.where("low = high" if used < HASH_DIGITS else "true")
        # the boundary is one hash: it is in if that comes nearer
        settled = single.select("__source", F.when(F.col("words") - F.col("left") < F.col("left"), F.concat("high", F.lit("~"))).otherwise(F.col("low")).alias("limit"))
        done = settled if done is None else done.unionByName(settled)
        if used >= HASH_DIGITS:
            break
        rest = edge.where("low < high")
        if rest.isEmpty():
            break
        open_ = rest.select("__source", F.col("left").alias("budget"), F.col("prefix").alias("base"))
        used = min(HASH_DIGITS, used + DIGIT)
        deeper = narrow.alias("a").join(_small(open_).alias("b"), same & F.col("__h").startswith(F.col("base")))
        hist = checkpointed(deeper.groupBy("a.__source", F.substring("__h", 1, used).alias("prefix")).agg(F.sum("__size").alias("words"), F.min("__h").alias("low"), F.max("__h").alias("high")))
    limits = budgets.alias("a").join(done.alias("b"), F.col("a.__source").eqNullSafe(F.col("b.__source")), "left").select("a.__source", "source_size", "target", "whole", F.when(F.col("budget") > 0, F.coalesce("limit", F.lit("~"))).otherwise(F.lit("")).alias("limit"))
    limits = checkpointed(limits)
    out = rows.alias("a").join(_small(limits).alias("b"), F.col("a.__source").eqNullSafe(F.col("b.__source")))
    below = (F.col("__h") < F.col("limit")).cast("long")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("__size").alias("size"), "source_size", "target", F.least(F.col("whole") + below, F.lit(max_repeat)).alias("copies"))
