"""Gates for incoming files: size, type by content, checksum, storage key, envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import sized_files

MAX_BYTES = 25 * 1024 * 1024

# The first bytes of the accepted types, and their file suffixes.
MAGIC = {"application/pdf": "255044462D", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}
SUFFIX = {"application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg"}


def classify(files: DataFrame, max_bytes: int = MAX_BYTES, content: str = "content", length: str | None = None) -> DataFrame:
    """Add ``size_bytes``, ``content_type`` (null if unknown) and ``reject_reason`` (null if accepted; size comes first).

    ``length``: a column with the size, where the source knows it. See :func:`scan` for files in a folder.
    """
    c, sniffed = F.col(content), None
    for kind, magic in MAGIC.items():
        hit = F.startswith(c, F.unhex(F.lit(magic)))
        sniffed = F.when(hit, F.lit(kind)) if sniffed is None else sniffed.when(hit, F.lit(kind))
    size = F.coalesce(F.octet_length(c) if length is None else F.col(length), F.lit(0))
    out = files.withColumn("size_bytes", size).withColumn("content_type", sniffed)
    reason = F.when(F.col("size_bytes") > max_bytes, "too_large").when(F.col("content_type").isNull(), "unsupported_type")
    return out.withColumn("reject_reason", reason)


def scan(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All files of a folder, classified; ``content`` is null, and was never read, where a file is too large."""
    small, large = sized_files(spark, path, max_bytes)
    rejected = large.withColumn("content", F.lit(None).cast("binary"))
    return classify(small, max_bytes, length="length").unionByName(classify(rejected, max_bytes, length="length"))


def envelopes(classified: DataFrame, id_col: str, name_col: str, channel: str = "rest_upload", content: str = "content", received: str | None = None) -> DataFrame:
    """The accepted files' records; the storage key is the checksum with the type's suffix, so a copy is stored once."""
    suffix = F.create_map(*(F.lit(x) for pair in SUFFIX.items() for x in pair))
    checksum = F.sha2(F.col(content), 256)
    return classified.where("reject_reason is null").select(
        F.col(id_col).cast("string").alias("document_id"), F.lit("uploaded").alias("status"), F.lit(channel).alias("source_channel"),
        F.col(name_col).alias("original_filename"), "content_type", "size_bytes",
        F.concat(checksum, F.element_at(suffix, F.col("content_type"))).alias("storage_key"), checksum.alias("checksum_sha256"),
        (F.col(received) if received else F.current_timestamp()).alias("received_at"), F.create_map().cast("map<string, string>").alias("metadata"),
    )


def rejects(classified: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return classified.where("reject_reason is not null").select(F.col(id_col).cast("string").alias("document_id"), F.col(name_col).alias("original_filename"), "size_bytes", "reject_reason")
