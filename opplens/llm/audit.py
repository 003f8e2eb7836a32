"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

The orders form a trie of permutations. It is walked depth first: a node's survivors are a persisted DataFrame of documents, and an edge
applies one more filter to it and counts what that removes. Nodes of equal filters, in whatever order they were applied, have equal
survivors, so a node is visited once and its counts are remembered: 2 ** n states and n * 2 ** (n - 1) edges stand for n! orders.
At most n survivor frames are persisted at a time; if an executor is lost, they are filtered again from a stored table.

A document is one row. Null texts are empty, null parts the empty string; a null doc_id is no document's smaller one, and has no labels.
Repeated rows count as often as they are; rows of one id and text are no copies of each other, as neither id is smaller. A part
none of whose rows survive has rows of zeros; an empty table gives no rows. A filter that is null does not fail.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shared_folder, stored

EDGE = "struct<filter:string,removed:long,good_lost:long,toxic_lost:long>"
#: The folder of the state in which no filter is applied.
START = "none"


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails A to D: few words, few distinct words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    counts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("kinds"))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"counts": counts, "C": capitals * 100 > F.length(text) * 5, "D": text.rlike(r"[#$%&*|]")}


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """A narrow row for each document: part, whether it fails A to E, and whether labels call it good and toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tests = text_filters(text)
    seen = own.select("doc_id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), tests["counts"].alias("w"), tests["C"].alias("C"), tests["D"].alias("D"))
    # the texts are read once; from here on rows are narrow
    seen = stored(seen.select("doc_id", "part", "key", (F.col("w.n") < 50).alias("A"), (F.col("w.kinds") * 100 < F.col("w.n") * 65).alias("B"), "C", "D"))
    firsts = seen.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = salted_join(seen, firsts, ["key"], "times", F.col("doc_id"), how="left")
    rows = rows.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    return rows.select("part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def walk(judged: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """The edges of the trie: what a filter removes, by part, from the survivors of each set of the others."""
    spark, folder = judged.sparkSession, f"{shared_folder(judged.sparkSession)}/opplens-{uuid.uuid4().hex}"
    fails = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in filters]
    rows = judged.select("part", *fails, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), F.lit(1).cast("long").alias("n"))
    # a row of no documents that nothing removes, so that each part has counts in every state
    none = [F.lit(False).alias(c) for c in (*filters, "good", "toxic")]
    rows = stored(rows.unionByName(judged.select("part").distinct().select("part", *none, F.lit(0).cast("long").alias("n"))))
    visited: set[str] = set()
    # the same columns for every state, so that Spark compiles them once; what a state has applied already removes nothing there
    count = lambda *all_of: F.coalesce(F.sum(F.when(F.expr(" and ".join(f"`{c}`" for c in all_of)), F.col("n"))), F.lit(0))
    edges = [F.struct(F.lit(f).alias("filter"), count(f).alias("removed"), count(f, "good").alias("good_lost"), count(f, "toxic").alias("toxic_lost")) for f in filters]

    def visit(state: str, survivors: DataFrame) -> None:
        if state in visited or len(state) == len(filters):
            return
        visited.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy("part").agg(F.sum("n").alias("survivors"), F.array(*edges).alias("edges")).write.parquet(f"{folder}/state={state or START}")
        for f in filters:
            if f not in state:
                visit("".join(sorted(state + f)), survivors.where(~F.col(f)))
        survivors.unpersist()

    visit("", rows)
    found = spark.read.schema(f"part string, survivors long, edges array<{EDGE}>, state string").parquet(folder)
    state = F.when(F.col("state") == START, "").otherwise(F.col("state"))
    return found.select("part", state.alias("state"), "survivors", F.inline("edges")).where(~F.contains("state", "filter"))


def orders(edges: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of the edges."""
    n = len(filters)
    steps = [("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in permutations(filters) for k in range(n)]
    steps = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    # how many orders pass each edge
    weight = F.get(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.length("state"))
    whole = edges.groupBy("part", "filter").agg(F.max(F.when(F.col("state") == "", F.col("removed"))).alias("failing"), F.max(F.when(F.length("state") == n - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    rows = edges.join(whole, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])  # n! * n steps, whatever the data
    return rows.select("part", "filter_order", "step", (F.col("survivors") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, by part."""
    return orders(walk(judge(docs, labels)))
