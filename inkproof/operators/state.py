"""What is done, what is stored, what failed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.records import FINISHED


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; on one machine one of our own if unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unfinished(documents: DataFrame, states: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Without the documents that are completed, escalated or rejected; failed ones are tried again."""
    return documents.join(states.where(F.col("status").isin(*FINISHED)).select(id_col), id_col, "left_anti")


def upsert(old: DataFrame, new: DataFrame, order: str, id_col: str = "document_id") -> DataFrame:
    """One row for each document: the one with the latest ``order``, of ties the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_new")


def mark_failed(states: DataFrame, failed: DataFrame, id_col: str = "document_id") -> DataFrame:
    """The documents in ``failed`` (id, reason) get status failed and the reason in their metadata."""
    reason = failed.select(id_col, F.col("reason").alias("_reason"))
    joined = states.join(reason, id_col, "left")
    hit = F.col("_reason").isNotNull()
    added = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string, string>")), lambda k, v: k != "failure_reason"), F.create_map(F.lit("failure_reason"), F.col("_reason")))
    out = joined.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).withColumn("metadata", F.when(hit, added).otherwise(F.col("metadata")))
    return out.drop("_reason")


def over_limit(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60, order: tuple[str, ...] = ()) -> DataFrame:
    """Add ``window_start``, ``n`` (the request's number in its fixed window) and ``over_limit``."""
    start = F.timestamp_seconds(F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1_000_000 * seconds)) * seconds)
    out = events.withColumn("window_start", start)
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(at, *order))
    return out.withColumn("n", n).withColumn("over_limit", F.col("n") > limit)


def window_counts(events: DataFrame, key: str, at: str, limit: int, length: str = "1 minute") -> DataFrame:
    """``key, window_start, n, over_limit`` for each fixed window; works on streams as well."""
    counted = events.groupBy(F.window(at, length), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("window.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


