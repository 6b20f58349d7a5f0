"""Lists, details, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import STATUSES


def with_status(documents: DataFrame, status: str | None) -> DataFrame:
    if status is None:
        return documents
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    return documents.where(F.col("status") == status)


def count(documents: DataFrame, status: str | None = None) -> DataFrame:
    return with_status(documents, status).agg(F.count("*").alias("total"))


def page(documents: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0, id_col: str = "document_id") -> DataFrame:
    """The newest first, ties by id; a page has 1 to 200 rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return with_status(documents, status).orderBy(F.desc("created_at"), id_col).offset(offset).limit(limit)


def seek(documents: DataFrame, status: str | None = None, limit: int = 50, after: tuple | None = None, id_col: str = "document_id") -> DataFrame:
    """The page after the row with ``created_at`` and id ``after``; the first page without it. Pages are those of :func:`page`.

    A page deep in the list costs what the first one costs: no row before it is sorted, and files
    whose rows are all newer are left out by their statistics (``created_at`` is bounded from above).
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    found = with_status(documents, status)
    if after is not None:
        at, last = F.lit(after[0]).cast(dict(documents.dtypes)["created_at"]), F.lit(after[1])
        found = found.where(F.col("created_at") <= at).where((F.col("created_at") < at) | (F.col(id_col) > last))
    return found.orderBy(F.desc("created_at"), id_col).limit(limit)


def token(rows: list, id_col: str = "document_id") -> tuple | None:
    """What :func:`seek` needs to go on after these (collected) rows; None if there are none."""
    return (rows[-1]["created_at"], rows[-1][id_col]) if rows else None


def by_time(documents: DataFrame, path: str, files: int | None = None) -> None:
    """Write documents in files by ranges of time, so that a page needs few of them."""
    ranged = documents.repartitionByRange(files, F.desc("created_at")) if files else documents.repartitionByRange(F.desc("created_at"))
    ranged.sortWithinPartitions(F.desc("created_at")).write.mode("overwrite").parquet(path)


def details(documents: DataFrame, extractions: DataFrame, validations: DataFrame, reviews: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Each document with a struct of what is stored of it, or null."""
    out = documents
    for name, side in (("extraction", extractions), ("validation", validations), ("review", reviews)):
        packed = side.select(F.col(id_col), F.struct(*(c for c in side.columns if c != id_col)).alias(name))
        out = out.join(packed, id_col, "left")
    return out


def listing(documents: DataFrame, extractions: DataFrame, validations: DataFrame, reviews: DataFrame, **paging) -> DataFrame:
    """A page with its details: the page is cut first, and its at most 200 rows are broadcast to the tables."""
    chosen = page(documents, **paging)
    ids = F.broadcast(chosen.select("document_id"))
    near = [t.join(ids, "document_id", "left_semi") for t in (extractions, validations, reviews)]
    return details(chosen, *near)


def one(documents: DataFrame, document_id: str, id_col: str = "document_id") -> DataFrame:
    return documents.where(F.col(id_col) == document_id)


def review_queue(documents: DataFrame, **paging) -> DataFrame:
    return page(documents, "escalated", **paging)
