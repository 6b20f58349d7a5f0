"""Documents that arrive: each batch is verified and stored; delivering it twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import falsy, key
from .keyed import FirstOfKeys, use_rocksdb

_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: Keys are handed to Python in so many groups. A group's rows of a batch are held by a task.
GROUPS = 4096


def record_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def once(stream: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Each document once, however often and in however many batches it comes."""
    use_rocksdb(stream.sparkSession)
    return stream.dropDuplicates([id_col])


def earlier_invoices(stream: DataFrame, order: tuple[str, ...] = ("received_at", "seq"), id_col: str = "document_id") -> DataFrame:
    """Add ``duplicate_count`` and ``duplicate_ids``: invoices of the same vendor and number in earlier batches, or before in this one.

    The state is a count and three ids for each vendor and number. A batch's rows of one vendor and number are
    ordered by one task, as text: whole rows go along packed, and are unpacked after. Keys go to Python by groups, of which each
    looks up its own keys of the batch.
    """
    use_rocksdb(stream.sparkSession)
    keyless = falsy(F.col("vendor_name")) | falsy(F.col("invoice_number"))
    own = F.when(keyless, F.concat(F.lit("\x02"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).otherwise(F.concat_ws("\x01", key(F.col("vendor_name")), key(F.col("invoice_number"))))
    packed = stream.select(own.alias("key"), keyless.alias("keyless"), F.col(id_col).cast("string").alias("own_id"), *(F.col(c).alias(f"order{k}") for k, c in enumerate(order)), F.to_json(F.struct(*stream.columns), _JSON).alias("packed"))
    packed = packed.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    found = packed.groupBy("group").transformWithState(FirstOfKeys([f"order{k}" for k in range(len(order))]), "packed string, duplicate_count long, duplicate_ids array<string>", "append", "none")
    return found.select(F.from_json("packed", stream.schema, _JSON).alias("_r"), "duplicate_count", "duplicate_ids").select("_r.*", "duplicate_count", "duplicate_ids")


def run(stream: DataFrame, flow: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, id_col: str = "document_id", looked_up: bool = False, order: tuple[str, ...] = ("received_at", "seq")):
    """Start the query. ``flow(batch)`` gives a batch's rows; documents that an earlier batch had are left out.

    ``looked_up``: batches come with what :func:`earlier_invoices` adds. A batch's rows go to a folder of its own
    number, so running it again overwrites its own rows only.
    """
    fresh = once(stream, id_col)
    fresh = earlier_invoices(fresh, order, id_col) if looked_up else fresh

    def handle(batch: DataFrame, number: int) -> None:
        flow(batch).write.mode("overwrite").parquet(f"{store}/rows/batch={number}")

    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_rows(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/rows").drop("batch")
