"""The whole flow over extracted records: lookups, scores, rules, the gate of the review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..operators import confidence, lookup, review, validate
from ..sources.readers import DEFAULT_POLICY
from .shape import settled


def verify(
    invoices: DataFrame,
    vendors: DataFrame | None = None,
    policy: dict[str, dict] | None = None,
    now: str | None = None,
    scope: str | None = "prior",
    strategy: str = "min_gated",
    threshold: float = review.THRESHOLD,
    rules: dict[str, Rule] | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Add lookups, ``confidence``, ``results``, ``counts``, ``overall``, ``needs_review`` and ``status``.

    One lazy plan: the lookups of duplicates and vendors over ids and keys, joined back by id; and projections. The source text is needed by the scores only. A missing directory or
    ``scope=None`` skips its rule; ``scope="given"``: the invoices have ``duplicate_count`` and ``duplicate_ids`` already. ``earlier``: keys of invoices that were processed before these.
    """
    if scope not in (None, "given"):
        df = lookup.duplicates(invoices, scope, earlier=earlier, vendors=vendors)  # before the scores, which keys don't need
    else:
        df = lookup.known_vendors(invoices, vendors) if vendors is not None else invoices
    # First what is measured and decided, once for each row; then what is told of it, which a query that doesn't take it doesn't pay for.
    given = df.columns
    df = confidence.measured(df).withColumn("_overall", confidence.rated(strategy))
    df, results, has = validate.judged(settled(df, "_overall"), DEFAULT_POLICY if policy is None else policy, rules, now, lookup=bool(scope), directory=vendors is not None)
    df = df.withColumns({"counts": validate.counted(has), "overall": validate.worst(has)}).withColumn("needs_review", review.needs_review(threshold, F.col("_overall")))
    df = settled(df, "counts", "overall", "needs_review")
    df = df.withColumns({"scores": confidence.told(), "confidence": confidence.summary(strategy), "results": results, "status": F.when(F.col("needs_review"), "review").otherwise("completed")})
    return df.select(*given, "scores", "confidence", "results", "counts", "overall", "needs_review", "status")
