"""Streams of JSON lines: every record ends among the accepted, the rejected with a reason, or the late; first of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opplens.functions.rules import first_reason


def lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The lines of the files that land in folder. Files must be complete when they land (written elsewhere, then moved)."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)


def judged(raw: DataFrame, schema: str, rules: dict[str, Column]) -> DataFrame:
    """The parsed columns with line and reason, NULL where a record is accepted."""
    parsed = raw.select(F.col("value").alias("line"), F.from_json("value", schema).alias("j")).select("line", "j.*")
    return parsed.withColumn("reason", first_reason(rules))


def collect_events(stream: DataFrame, key: list[str], ts: str, out: str, checkpoint: str, start: str | None = None, **trigger) -> StreamingQuery:
    """Appends each batch to out/accepted, out/rejected and out/late.

    A batch writes its own folder by batch number with overwrite, so a batch that is run again after a failure leaves no second
    copy. Known keys are those of earlier batches; of equal keys in a batch the earliest stays, the others are rejected as
    duplicates. Records older than start are late: kept, never counted.
    """
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        first = F.row_number().over(Window.partitionBy(*key).orderBy(ts, "line"))
        good = rows.where("reason is null").withColumn("__n", first)
        late = F.col(ts) < F.lit(start) if start else F.lit(False)
        fresh = good.where("__n = 1").drop("__n")
        # a record that was late is known as well, so its repeats are kept once
        before = spark.read.parquet(f"{out}/accepted").where(F.col("batch") < batch).select(*key).unionByName(spark.read.parquet(f"{out}/late").where(F.col("batch") < batch).select(*key)) if batch else None
        new = fresh if before is None else fresh.join(before, key, "left_anti").select(*fresh.columns)
        again = good.where("__n > 1").drop("__n")
        if before is not None:
            again = again.unionByName(fresh.join(before, key, "left_semi").select(*fresh.columns))
        put = {
            "accepted": new.where(~late).drop("reason"),
            "late": new.where(late).drop("reason"),
            "rejected": rows.where("reason is not null").select("line", "reason").unionByName(again.select("line", F.lit("DUPLICATE").alias("reason"))),
        }
        for name, df in put.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def stream_bars(ticks: DataFrame, every: str, late: str, symbol: str, ts: str, price: str, tie: str) -> DataFrame:
    """OHLC bars of a stream; a bar is given out once ticks are `late` past its end."""
    at = F.struct(ts, tie)
    return (
        ticks.withWatermark(ts, late).groupBy(F.col(symbol).alias("symbol"), F.window(ts, every))
        .agg(F.min_by(price, at).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, at).alias("c"), F.count(F.lit(1)).alias("vol"))
        .select("symbol", F.col("window.start").alias("bar_ts"), "o", "h", "l", "c", "vol")
    )


def first_of_key(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first record of each key within `late` of it: the state holds the keys of that time, not all keys ever seen."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def attach_outcomes(predictions: DataFrame, bars_: DataFrame, horizon: str, late: str) -> DataFrame:
    """Each prediction (id, symbol, committed) with each later bar (symbol, bar_ts, c) within the horizon, once; both sides are streams.

    Predictions come with a watermark on committed, as first_of_key gives them; that of the bars is set here. The interval bounds the state of both sides: a prediction is forgotten when no bar of its horizon can come any more.
    """
    p = predictions.alias("p")
    b = bars_.withWatermark("bar_ts", late).alias("b")
    on = (F.col("p.symbol") == F.col("b.symbol")) & (F.col("b.bar_ts") > F.col("p.committed")) & F.expr(f"b.bar_ts <= p.committed + interval {horizon}")
    return p.join(b, on).select("p.id", "p.symbol", "p.committed", "b.bar_ts", "b.c")


def scored(stream: DataFrame, weights: list[float], features: list[str], history: DataFrame, by: list[str]) -> DataFrame:
    """The records with the probability of a frozen model and the columns of a frozen table of history, by keys."""
    from opplens.operators.models import linear, sigmoid

    return stream.join(history, by, "left").withColumn("probability", sigmoid(linear(weights, features)))
