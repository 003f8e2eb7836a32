"""What the operators share: Arrow batches in blocks of bounded size, and word hashes over UTF-8 bytes.

Columns an operator adds replace input columns of the same name; all other input columns pass through.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step takes at most, unless a single text is longer.
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(keep: str, fold: bool = True) -> np.ndarray:
    """For each byte its folded form inside a word, 0 outside; bytes from 128 on are in words."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in keep:
        table[ord(c)] = ord(c)
    if fold:
        for c in range(65, 91):
            table[c] = c + 32
    return table


#: Words of ASCII digits, letters and everything beyond ASCII, with A-Z folded.
ALNUM = byte_table("0123456789abcdefghijklmnopqrstuvwxyz")


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def word_spans(texts: list[bytes], table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes of all texts with a gap between them, word starts, word ends, text offsets, first word of each text).

    The last array has one entry more than there are texts.
    """
    buf = table[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)]
    edge = np.flatnonzero((buf[1:] != 0) != (buf[:-1] != 0)) + 1
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    return buf, starts, ends, offsets, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf * powers(_BASE, len(buf)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(buf))[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (n - 1 fewer than there are words)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    return [v or b"" for v in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def map_text(df: DataFrame, text_col: str, added: T.StructType, work: Callable[[list[bytes]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """df with columns that work computes from the texts of a block; keep: the input columns to pass on (all, but for clashes)."""
    names = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    typed = df.select(row_of(kept).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([typed.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in blocks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *work(texts[lo:hi])], schema.names)

    return typed.mapInArrow(run, schema).select(*of_row(kept), *added.names)


def row_of(columns: list[str]) -> Column:
    """The columns in one struct, in which their names, whatever they are, meet no other names."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))


def of_row(columns: list[str], row: str = "row") -> list[Column]:
    return [F.col(f"{row}.`{c}`").alias(c) for c in columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: inside a lambda an outer expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_before(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array op over all elements before it, for an associative op with that zero.

    Blocks of about the square root of the length are scanned by themselves and then shifted by what lies before them, so n
    elements take n ** 1.5 copies of an element, not n ** 2.
    """
    grow = lambda a, v: F.concat(a, F.array(op(F.element_at(a, -1), v)))

    def blocks_of(v: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(step, lambda b: F.transform(F.sequence(F.lit(0), F.greatest((F.size(v) - 1) / b, F.lit(0)).cast("int")), lambda i: F.aggregate(F.slice(v, i * b + 1, b), F.array(zero), grow)))

    def shifted(blocks: Column) -> Column:
        heads = F.aggregate(F.transform(blocks, lambda x: F.element_at(x, -1)), F.array(zero), grow)
        return let(heads, lambda h: F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: op(F.get(h, i), y)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks_of(v), shifted)).otherwise(F.slice(F.array(zero), 1, 0)))


def sums_before(sizes: Column) -> Column:
    """For each element of an array of sizes the sum of those before it."""
    return scan_before(F.transform(sizes, lambda v: v.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


#: Code points in a chunk of a text that is cut at many places.
CHUNK = 4096


def chunked(text: Column) -> Column:
    """The text as an array of chunks of CHUNK code points, for cut_from."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut_from(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to before end; only the chunks that hold them are read, not all of the text before them."""
    first = (start / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, ((end - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(part, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. A temporary one is made only where none is set and
    the executors are threads of this machine; on a cluster that is an error, as other executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="opplens-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a narrow table that one task writes, where a bound of the rows is known.
ROWS_A_FILE = 250_000


def stored(df: DataFrame, rows: int | None = None, codec: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read again. If it is narrow and has at most so many rows, by as few tasks as
    that asks for: loops over small tables would else spend their time on empty tasks.

    Smaller than a checkpoint for many rows; and its size is known, while a checkpoint keeps the planner's estimate, which loops
    of joins multiply into numbers of millions of digits."""
    folder = f"{shared_folder(df.sparkSession)}/opplens-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1)).write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key of more rows than this is dealt to several tasks by salted_join, and there are at most so many such keys.
SALT_ROWS, SALT_KEYS = 50_000, 10_000


def salted_join(rows: DataFrame, known: DataFrame, on: list[str], times: str, salt_by: Column, how: str = "inner") -> DataFrame:
    """rows joined with known, which has one row for each value of on and in the column times how many of rows have it.

    Values that very many rows have are salted: salt_by deals their rows to several tasks, each of which gets the known row. A
    value counts as such from rows / SALT_KEYS on, so at most SALT_KEYS of them are broadcast, whatever the size of the data.
    """
    known = stored(known)
    total = known.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    most = max(SALT_ROWS, total // SALT_KEYS)
    heavy = known.where(F.col(times) > most).select(*on, F.ceil(F.col(times) / most).cast("int").alias("salts"))
    if heavy.isEmpty():
        return rows.join(known, on, how)
    salts = F.coalesce("salts", F.lit(1))
    salted = rows.join(F.broadcast(heavy), on, "left").withColumn("salt", F.pmod(F.xxhash64(salt_by), salts).cast("int")).drop("salts")
    known = known.join(F.broadcast(heavy), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(known, [*on, "salt"], how).drop("salt")
