"""The whole flow of documents, from pages to final states, as stages over stored tables.

A document's status says which stage it needs. A stage reads the documents of its statuses, writes its rows to
its own tables, and only then moves the states on, so that a stage stopped anywhere is run again for
the same documents and replaces its own rows. A document that a stage can't handle is marked as
failed with the reason; the others go on. Finished documents are never read again.

    uploaded -> processing (texts) -> extracted (extractions) -> review | completed (checks) -> completed | escalated | rejected (reviews)

``extractions`` and ``checks`` keep a row for each reading of a document, by (document_id, attempt);
:func:`latest` serves the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confidence, extract, lookup, review, state, texts, validate
from ..operators.store import BUCKETS, Store
from ..sources.readers import DEFAULT_POLICY
from ..sources.records import HEADER_FIELDS
from .verify import verify

ID = "document_id"
#: A stage's outcome: its rows by table, and ``document_id, status, reason`` of each document (a reason: it failed).
Outcome = tuple[dict[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """``run(documents, flow)`` handles the documents whose status is in ``wants``."""

    name: str
    wants: tuple[str, ...]
    run: Callable[[DataFrame, "Flow"], Outcome]


class Flow:
    """Documents in a folder that all executors see, and the stages that they go through."""

    def __init__(self, spark: SparkSession, path: str, stages: list[Stage], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.stages, self.buckets = spark, path.rstrip("/"), stages, buckets
        self.states = self.table("states", (ID,))

    def table(self, name: str, keys: tuple[str, ...] = (ID,)) -> Store:
        return Store(self.spark, f"{self.path}/{name}", keys, self.buckets)

    def submit(self, documents: DataFrame) -> None:
        """Take in documents (``document_id, received_at, seq, content_type, original_filename``) that aren't known yet."""
        wanted = documents.select(ID, F.col("received_at").cast("timestamp").alias("received_at"), F.col("seq").cast("long").alias("seq"), "content_type", "original_filename").where(f"{ID} is not null")
        known = self.states.read(near=wanted)
        new = wanted if known is None else wanted.join(known.select(ID), ID, "left_anti")
        self.states.upsert(state.stored(new.select("*", F.lit("uploaded").alias("status"), F.create_map().cast("map<string, string>").alias("metadata"))))

    def retry_failed(self) -> None:
        """Let failed documents begin anew; failed isn't final."""
        failed = self.states.read().where("status = 'failed'")
        self.states.upsert(state.stored(failed.withColumn("status", F.lit("uploaded")).withColumn("metadata", F.map_filter("metadata", lambda k, v: k != "failure_reason"))))

    def step(self, stage: Stage) -> int:
        """Run one stage over the documents that need it; how many there were."""
        todo = state.stored(self.states.read().where(F.col("status").isin(*stage.wants)))
        n = todo.count()
        if not n:
            return 0
        tables, outcome = stage.run(todo, self)
        outcome = state.stored(outcome.groupBy(ID).agg(F.max("status").alias("_to"), F.max("reason").alias("reason")))
        for name, rows in tables.items():
            self.table(name, (ID, "attempt") if "attempt" in rows.columns else (ID,)).upsert(rows)
        moved = todo.join(outcome, ID, "left").withColumn("reason", F.when(F.col("_to").isNull() & F.col("reason").isNull(), f"{stage.name} gave no result").otherwise(F.col("reason")))
        moved = state.stored(moved.withColumn("status", F.coalesce("_to", "status")))
        failed = moved.where("reason is not null").select(ID, "reason")
        self.states.upsert(state.stored(state.mark_failed(moved.drop("_to", "reason"), failed)))
        return n

    def run(self) -> dict[str, int]:
        """Each stage once, in order; how many documents each had."""
        return {s.name: self.step(s) for s in self.stages}


def latest(rows: DataFrame) -> DataFrame:
    """Of each document the row of its last reading."""
    return rows.groupBy(ID).agg(F.max_by(F.struct(*(c for c in rows.columns if c != ID)), "attempt").alias("_r")).select(ID, "_r.*")


def _done(rows: DataFrame, status: Column | str, reason: Column | None = None) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    reason = F.lit(None).cast("string") if reason is None else reason
    return rows.select(ID, F.when(reason.isNull(), status).alias("status"), reason.alias("reason"))


def read_texts(pages: DataFrame) -> Stage:
    """From ``pages`` (document_id, method, page_number, text): the text by the method its route gives, cleaned and scanned. No text at all is a failure."""

    def run(todo: DataFrame, flow: Flow) -> Outcome:
        mine = pages.join(todo.select(ID), ID, "left_semi")
        by = lambda m: texts.rollup(mine.where(F.col("method") == m), [ID])
        routed = texts.route(todo.select(ID, "content_type"), by("native"), by("ocr"), ID)
        rows = texts.clean(routed, "full_text").select(ID, "method", "ocr_reason", "page_count", "clean_text", "notes", "injection_flags")
        rows = state.stored(rows)
        empty = F.when(F.coalesce(F.col("clean_text"), F.lit("")) == "", F.lit("the document has no text"))
        return {"texts": rows.where(empty.isNull())}, _done(rows, "processing", empty)

    return Stage("texts", ("uploaded",), run)


def ask_model(model: Callable[[], Callable[[str], str]], retries: int = 1, concurrency: int = 8, timeout: float = 120.0) -> Callable[[DataFrame], DataFrame]:
    """Records from a model, asked about each document's text and the ``retry_hint`` if there is one. See :func:`read_records`."""

    def read(rows: DataFrame) -> DataFrame:
        hint = F.col("retry_hint") if "retry_hint" in rows.columns else None
        asked = rows.select(ID, texts.prompt(F.col("clean_text"), hint).alias("prompt"))
        return extract.extract(asked, "prompt", model, (ID,), retries, concurrency, timeout)

    return read


def read_records(read: Callable[[DataFrame], DataFrame]) -> Stage:
    """``read`` takes rows with ``document_id, clean_text`` and gives ``document_id, data, parse_attempts, parse_error, raw_text, call_error``.

    A call that failed is the document's failure; an answer that can't be parsed gives an empty record, and the checks say so.
    """

    def run(todo: DataFrame, flow: Flow) -> Outcome:
        near = flow.table("texts").read(near=todo)
        found = state.stored(read(near.join(todo.select(ID), ID, "left_semi").select(ID, "clean_text")))
        rows = found.where("call_error is null").select(ID, F.lit(1).alias("attempt"), "data", "parse_attempts", "parse_error", "raw_text")
        return {"extractions": rows}, _done(found, "extracted", F.col("call_error"))

    return Stage("extractions", ("processing",), run)


_CHECKED = (ID, "attempt", "confidence", "results", "counts", "overall", "needs_review", "duplicate_count", "duplicate_ids")


def _invoices(flow: Flow, todo: DataFrame) -> DataFrame:
    """The last records of these documents with their texts, as the checks take them."""
    records = latest(flow.table("extractions", (ID, "attempt")).read(near=todo)).select(ID, "attempt", "data.*")
    source = flow.table("texts").read(near=todo).select(ID, F.col("clean_text").alias("source_text"), "injection_flags")
    return todo.select(ID, "received_at", "seq").join(records, ID).join(source, ID)


def check(vendors: DataFrame | None = None, policy: dict | None = None, now: str | None = None, threshold: float = review.THRESHOLD) -> Stage:
    """Scores and rules; invoices of documents that were checked by earlier runs count as processed before."""

    def run(todo: DataFrame, flow: Flow) -> Outcome:
        invoices = state.stored(_invoices(flow, todo))
        before = flow.states.read().where(~F.col("status").isin("uploaded", "processing", "extracted", "failed")).select(ID, "received_at", "seq")
        records = flow.table("extractions", (ID, "attempt")).read()
        earlier = lookup.invoice_keys(latest(records).select(ID, "data.vendor_name", "data.invoice_number").join(before, ID))
        rows = state.stored(verify(invoices, vendors, policy, now, threshold=threshold, earlier=earlier).select(*_CHECKED))
        return {"checks": rows}, _done(rows, F.when(F.col("needs_review"), "review").otherwise("completed"))

    return Stage("checks", ("extracted",), run)


def decide(
    propose: Callable[[DataFrame], DataFrame],
    read: Callable[[DataFrame], DataFrame] | None = None,
    vendors: DataFrame | None = None,
    policy: dict | None = None,
    now: str | None = None,
    max_attempts: int = review.MAX_ATTEMPTS,
) -> Stage:
    """The bounded review. ``propose`` as in :func:`review.review`; ``read`` reads a document again, with ``retry_hint``, and each reading is kept.

    A reading whose call failed gives an empty record, which the next decision is about. What was looked up of other
    documents stays as it was at the first check.
    """

    def run(todo: DataFrame, flow: Flow) -> Outcome:
        checks = latest(flow.table("checks", (ID, "attempt")).read(near=todo)).drop("attempt")
        rows = _invoices(flow, todo).drop("attempt").join(checks, ID)
        kept: dict[str, list[DataFrame]] = {"extractions": [], "checks": []}

        def again(df: DataFrame) -> DataFrame:
            asked = df.select(ID, F.col("source_text").alias("clean_text"), *(c for c in ("retry_hint",) if c in df.columns))
            found = state.stored(read(asked))
            fields = [*HEADER_FIELDS, "line_items"]
            fresh = df.drop(*fields, "confidence", "results", "counts", "overall", "needs_review", "vendor_is_known").join(found.select(ID, "data.*"), ID)
            fresh = confidence.report(fresh)
            fresh = lookup.known_vendors(fresh, vendors) if vendors is not None else fresh
            fresh = validate.validate(fresh, DEFAULT_POLICY if policy is None else policy, None, now, lookup=True, directory=vendors is not None)
            fresh = state.stored(fresh.withColumn("needs_review", review.needs_review()))
            kept["extractions"].append(found.join(df.select(ID, F.col("attempts").alias("attempt")), ID).select(ID, "attempt", "data", "parse_attempts", "parse_error", "raw_text"))
            kept["checks"].append(fresh.withColumn("attempt", F.col("attempts")).select(*_CHECKED))
            return fresh

        done = review.review(rows, propose, again if read else None, max_attempts)
        done = state.stored(done.select(ID, "decision", "reasoning", "attempts", "overridden", "override_reason", "history", "status"))
        tables = {"reviews": done.drop("status")}
        for name, parts in kept.items():
            whole = None
            for p in parts:
                whole = p if whole is None else whole.unionByName(p)
            if whole is not None:
                tables[name] = whole
        return tables, _done(done, F.col("status"))

    return Stage("reviews", ("review",), run)


def results(flow: Flow) -> DataFrame:
    """Each document with its state and, where it has them, its last record, check and decision."""
    out = flow.states.read()
    for name, keys in (("texts", (ID,)), ("extractions", (ID, "attempt")), ("checks", (ID, "attempt")), ("reviews", (ID,))):
        rows = flow.table(name, keys).read()
        if rows is not None:
            rows = latest(rows) if "attempt" in keys else rows
            out = out.join(rows.select(ID, F.struct(*(c for c in rows.columns if c != ID)).alias(name)), ID, "left")
    return out
