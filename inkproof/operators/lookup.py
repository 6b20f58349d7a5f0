"""Lookups across documents: earlier invoices of the same vendor and number, known vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import falsy, key
from .state import stored


def invoice_keys(invoices: DataFrame, order: tuple[str, ...] = ("received_at", "seq"), id_col: str = "document_id", every: bool = False) -> DataFrame:
    """``id, _v, _n`` (vendor and number as they are compared) and the columns of ``order``, of the rows that have both; or of ``every`` row, with ``_keyless``."""
    keyless = falsy(F.col("vendor_name")) | falsy(F.col("invoice_number"))
    rows = invoices.withColumn("_keyless", keyless) if every else invoices.where(~keyless)
    return rows.select(id_col, key(F.col("vendor_name")).alias("_v"), key(F.col("invoice_number")).alias("_n"), *order, *(["_keyless"] if every else []))


def in_ranges(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Key rows dealt out by ranges of (vendor, number, order) and written; ``_at`` tells their range (upper bits) and place in it.

    However many rows share a vendor and number, and whatever they are ordered by, a range is a task's.
    """
    by = ["_v", "_n", "_late", *order]
    spread = rows.withColumn("_copy", F.monotonically_increasing_id())  # rows that repeat may be split
    spread = spread.repartitionByRange(*by, "_copy").sortWithinPartitions(*by, "_copy").drop("_copy")
    return stored(spread.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))


def duplicates(invoices: DataFrame, scope: str = "prior", order: tuple[str, ...] = ("received_at", "seq"), id_col: str = "document_id", earlier: DataFrame | None = None, wanted: DataFrame | None = None, vendors: DataFrame | None = None) -> DataFrame:
    """Add ``duplicate_count`` and ``duplicate_ids`` (the first three in processing order).

    ``prior``: only documents processed before count; ``any``: all others. ``earlier``: rows of
    ``invoice_keys`` that were processed before all of these. Rows without vendor or number match
    nothing. Only ids and keys are dealt out, by ranges; counts and first ids of each range are
    summed up over the ranges of a vendor and number and joined back by both, so an invoice number that
    millions share isn't one task's work. What is found is joined back by id: whole invoices
    are never gathered by their keys. ``wanted``: some of the invoices, to which alone it is joined.
    ``vendors``: also add ``vendor_is_known``, as :func:`known_vendors`; looked up over the keys as well, so that
    whole invoices are shuffled once, by id, and never by their vendors, and aren't sorted.
    """
    if scope not in ("prior", "any"):
        raise ValueError(f"unknown scope: {scope}")
    most, group = 4, ["_v", "_n"]
    mine = invoice_keys(invoices, order, id_col, vendors is not None).withColumn("_late", F.lit(1))
    keys = stored(mine if earlier is None else mine.unionByName(earlier.withColumn("_late", F.lit(0)), allowMissingColumns=True))  # ranges read their rows twice
    spread = in_ranges(keys if vendors is None else keys.where("_keyless is not true").drop("_keyless"), order)
    ranges = spread.groupBy(*group, "_range").agg(F.count("*").alias("_here"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0))).withColumn("_all", F.sum("_here").over(Window.partitionBy(*group)))
    ranges = ranges.where("_all > 1")  # the others have no duplicates
    ranked = spread.join(ranges, [*group, "_range"]).withColumn("_k", F.col("_at") - F.col("_first") + F.col("_before"))
    firsts = ranked.where(F.col("_k") < most).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_k", F.col(id_col).alias("_id")))).alias("_firsts"))
    known = ranges.select(*group, "_range").join(firsts, group)
    counted = F.col("_k") if scope == "prior" else F.col("_all") - 1
    others = F.filter("_firsts", lambda x: x["_k"] < F.col("_k") if scope == "prior" else x["_k"] != F.col("_k"))
    pairs = ranked.where("_late = 1").join(known, [*group, "_range"])
    hits = pairs.select(F.col(id_col).alias("_hit"), counted.alias("duplicate_count"), F.slice(F.transform(others, lambda x: x["_id"]), 1, 3).alias("duplicate_ids")).where("duplicate_count > 0")
    out = invoices if wanted is None else wanted
    if vendors is None:
        out = out.join(hits, F.col(id_col) == F.col("_hit"), "left").drop("_hit")
    else:  # both by the same expression, so that the second finds the rows where they are
        out = out.join(hits.where("_hit is not null").hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_hit")), "left").drop("_hit")
        out = _with_known(out, keys.where("_late = 1").select(id_col, "_v"), vendors, id_col)
    out = out.withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0).cast("long"))).withColumn("duplicate_ids", F.coalesce("duplicate_ids", F.array().cast("array<string>")))
    return out if vendors is None else out.select(*(c for c in out.columns if c != "vendor_is_known"), "vendor_is_known")


def _with_known(invoices: DataFrame, keys: DataFrame, vendors: DataFrame, id_col: str) -> DataFrame:
    """Add ``vendor_is_known`` by what each id has in vendors that the directory lacks; ``keys``: the invoices' id and ``_v``."""
    lacking = keys.join(vendor_keys(vendors).withColumnRenamed("vendor_key", "_v"), "_v", "left_anti")
    unknown = lacking.groupBy(F.col(id_col).alias("_named")).agg(F.collect_set("_v").alias("_unknown"))
    joined = invoices.join(unknown.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_named")), "left")
    name = key(F.col("vendor_name"))
    return joined.withColumn("vendor_is_known", name.isNotNull() & ~F.coalesce(F.array_contains("_unknown", name), F.lit(False))).drop("_named", "_unknown")


def vendor_keys(vendors: DataFrame, name: str = "vendor_name") -> DataFrame:
    return vendors.select(key(F.col(name)).alias("vendor_key")).where("vendor_key is not null").distinct()


def known_vendors(invoices: DataFrame, vendors: DataFrame, name: str = "vendor_name") -> DataFrame:
    """Add ``vendor_is_known``. The directory is broadcast if Spark finds it small, else both are shuffled."""
    known = vendor_keys(vendors, name).withColumn("vendor_is_known", F.lit(True))
    joined = invoices.withColumn("vendor_key", key(F.col("vendor_name"))).join(known, "vendor_key", "left")
    return joined.withColumn("vendor_is_known", F.coalesce("vendor_is_known", F.lit(False))).drop("vendor_key")


def by_vendor(invoices: DataFrame, vendors: DataFrame, known: bool = True, name: str = "vendor_name") -> DataFrame:
    """Only invoices of known (or of unknown) vendors."""
    return invoices.withColumn("vendor_key", key(F.col("vendor_name"))).join(vendor_keys(vendors, name), "vendor_key", "left_semi" if known else "left_anti").drop("vendor_key")
