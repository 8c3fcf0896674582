"""Degrees of a growing graph: a streaming aggregation over edges, written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.plans.storage import fresh_dir


def stream_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of a stream of edges (src, dst)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def windowed_edges(edges: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """(start, src, dst, weight): edges counted in tumbling windows; those later than `lateness` are dropped."""
    w = edges.withWatermark(ts, lateness).groupBy(F.window(ts, width), "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return w.select(F.col("window.start").alias("start"), "src", "dst", "weight")


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what is there now; the last row of each key."""
    spark = stream.sparkSession
    out, state = fresh_dir(spark, "stream-out"), fresh_dir(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("nf_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:08d}")

    stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    seen = spark.read.schema(stream.withColumn("nf_batch", F.lit(0)).schema).parquet(f"{out}/*")
    rest = [c for c in stream.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "nf_batch").alias("x")).select(*keys, *(f"x.{c}" for c in rest))
