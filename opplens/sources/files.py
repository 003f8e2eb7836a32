"""File sources and sinks: typed CSV, presets, JSON lines with rejects, HTML tables, inventories, and keyed sinks."""

from __future__ import annotations

import tempfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opplens.functions import scalars as S


def read_csv(spark: SparkSession, path: str | list[str], required: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """A CSV with header, all columns text; missing required columns fail before any job over the rows."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def normalise_fields(df: DataFrame, numbers: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Named columns parsed; a filled value that does not parse is NULL and named in the column bad_fields."""
    bad = [F.when((F.trim(c) != "") & parse(F.col(c)).isNull(), F.lit(c)) for cols, parse in ((numbers, S.parse_number), (flags, S.parse_flag)) for c in cols]
    out = df.withColumn("bad_fields", F.array_compact(F.array(*bad)) if bad else F.expr("cast(array() as array<string>)"))
    return out.withColumns({c: S.parse_number(F.col(c)) for c in numbers} | {c: S.parse_flag(F.col(c)) for c in flags})


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, number, flag, duplicate) of key=value lines; # starts a comment; a repeated key is marked."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")
    pair = F.split("line", "=", 2)
    out = lines.select("file", F.trim(pair[0]).alias("key"), F.trim(F.get(pair, F.lit(1))).alias("value"))
    return out.select("*", S.parse_number(F.col("value")).alias("number"), S.parse_flag(F.col("value")).alias("flag"), (F.count(F.lit(1)).over(Window.partitionBy("file", "key")) > 1).alias("duplicate"))


def parse_json(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) JSON lines: what is no object of the schema stays as text among the rejected."""
    typed = T._parse_datatype_string(schema)
    full = T.StructType([*typed.fields, T.StructField("_bad", T.StringType())])
    rows = lines.select(F.col(column).alias("line"), F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    broken = F.col("j").isNull() | F.col("j._bad").isNotNull()
    return rows.where(~broken).select("j.*").drop("_bad"), rows.where(broken).select("line")


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        self.open = tag in ("td", "th") or (self.open and tag != "tr")
        if tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag not in ("td", "th", "tr", "table")

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[-1][-1] += data


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, row, cells) of the table rows of each page, white space collapsed."""

    @F.pandas_udf("array<array<string>>")
    def cells(pages: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[list[str]]:
            parser = _Cells()
            parser.feed(text or "")
            return [[" ".join(c.split()) for c in r] for r in parser.rows if r]

        return pages.map(one)

    return pages.select(key, F.posexplode(cells(html)).alias("row", "cells"))


def labelled_values(tables: DataFrame, key: str) -> DataFrame:
    """(key, label, value): a cell that ends with a colon labels the next cell of its row."""
    cell = tables.select(key, "row", "cells", F.posexplode("cells").alias("at", "cell")).where(F.col("cell").endswith(":"))
    return cell.select(key, F.rtrim("cell", F.lit(":")).alias("label"), F.get("cells", F.col("at") + 1).alias("value"))


#: Named entities that titles hold.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """Named and decimal entities as characters, the ampersand last."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#\d{1,7};|.[^&]*"), F.lit(0))
    point = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, r"^&#(\d+);", 1).cast("int")), 8, "0")), "UTF-32")
    out = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^&#\d{1,7};$"), point(p)).otherwise(p)), "")
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def title(html: Column) -> Column:
    """The page's title with entities decoded and white space collapsed."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(F.when(F.contains(raw, F.lit("&")), unescape(raw)).otherwise(raw), r"\s+", " "))


def sniffed_csv(spark: SparkSession, paths: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Several CSVs as one, each with the separator (, ; or tab) that its header has most; columns that a file lacks are NULL."""
    out = None
    for path in paths:
        header = spark.read.text(path).first()
        best = max(",;\t", key=(header[0] if header else "").count)
        one = read_csv(spark, path, required, best)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def json_keys(spark: SparkSession, path: str) -> DataFrame:
    """(file, keys): the top-level keys of each JSON file, sorted."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.array_sort(F.map_keys(F.from_json("value", "map<string,string>"))).alias("keys"))


def deals(tables: DataFrame, key: str) -> DataFrame:
    """(key, row, and the named columns) of the deals in table rows: below the header row that has Deal and Direction, buys and sells that
    go in, out or out by. Numbers may have spaces as thousands separators."""
    lower = F.transform("cells", lambda c: F.lower(F.trim(c)))
    heads = tables.where(F.array_contains(lower, "deal") & F.array_contains(lower, "direction")).groupBy(key).agg(F.min(F.struct("row", lower.alias("names"))).alias("h"))
    rows = tables.join(heads, key).where(F.col("row") > F.col("h.row"))
    cell = lambda name: F.get("cells", F.array_position("h.names", name).cast("int") - 1)
    number = lambda name: S.parse_number(F.regexp_replace(cell(name), r"[\s\u00a0]", ""))
    out = rows.select(key, "row", F.lower(F.trim(cell("type"))).alias("type"), F.lower(F.trim(cell("direction"))).alias("direction"), cell("time").alias("time"), *[number(n).alias(n) for n in ("deal", "volume", "price", "profit", "balance")])
    return out.where(F.col("type").isin("buy", "sell") & F.col("direction").isin("in", "out", "out by"))


def snapshot(spark: SparkSession, path: str, glob: str, manifest: str, taken: str) -> DataFrame:
    """Appends (taken, path, size, lines, sha256) of the files below path to a manifest, and returns what was appended."""
    rows = inventory(spark, path, glob).select(F.lit(taken).alias("taken"), "path", "size", "lines", "sha256")
    rows.write.mode("append").parquet(manifest)
    return spark.read.parquet(manifest).where(F.col("taken") == taken)


def report_lines(rows: DataFrame) -> DataFrame:
    """One JSON text a row with its keys sorted, for reports that must not depend on the order of columns."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])).alias("value"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of a small result; more rows than `most` are an error, not a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: summarise them first")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, found)])


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, lines, sha256, duplicate) of the files below path; a duplicate has the content of a file with a lesser path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    rows = files.select("path", F.col("length").alias("size"), (F.length(F.regexp_replace(F.decode("content", "ISO-8859-1"), "[^\n]", ""))).alias("lines"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("sha256").orderBy("path")) > 1)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new's keys replaced by new's."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, that with the greatest order."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def unseen(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known, so that a second load adds nothing."""
    return new.join(known.select(*keys).distinct(), keys, "left_anti")


def replace_version(rows: DataFrame, path: str, version: str) -> None:
    """Writes rows partitioned by version; only the versions that rows has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """The folder for tables that a query writes and reads again, as spark.checkpoint.dir names it; a temporary one only where none is set and
    the executors are threads of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="opplens-work-")
    return folder
