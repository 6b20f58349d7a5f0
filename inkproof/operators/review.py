"""Review: which failures could another reading clear, and what may be decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, Rule
from ..plans.shape import settled
from ..sources.records import DECISIONS, STATUS_OF_DECISION
from .extract import strip_fences
from .state import stored

THRESHOLD, MAX_ATTEMPTS = 0.70, 2
_CLASS = "array<struct<rule_id: string, class: string, why: string>>"

# Parts of the reasons by which an override is told.
NO_REPROCESSOR = "another reading was asked for, but no reprocessor is there"
BUDGET, BLOCKED_RETRY, ACCEPTED = "retry budget exhausted", "another reading can't help: all that failed is blocking", "accepted despite blocking failures: "
UNUSABLE = "the decider's answer can't be used"


def needs_review(threshold: float = THRESHOLD, confidence: Column | None = None) -> Column:
    """Low confidence, or any warning or failure."""
    return ((F.col("confidence.overall") if confidence is None else confidence) < threshold) | (F.col("overall") != "pass")


def grounded_fields(fields: Column) -> Column:
    hit = F.filter(fields, lambda f: F.exists(f["signals"], lambda s: F.contains(s, F.lit("grounded_in_source"))))
    return F.transform(hit, lambda f: f["field"])


def no_data(fields: Column) -> Column:
    """No field has any support."""
    return (F.size(fields) > 0) & F.forall(fields, lambda f: f["confidence"] == 0.0)


def classify(df: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Add ``classes``: for each failure or warning whether it is *blocking* or *retryable*, and why; and the two lists of ids.

    A failure of a rule that no reading can clear blocks; so does one whose scored fields were all
    found in the source, as reading again would give the same.
    """
    df = settled(df, "results", "confidence")
    can = F.array(*(F.lit(k) for k, r in (RULES if rules is None else rules).items() if r.retryable)).cast("array<string>")
    fields = F.col("confidence.fields")
    scored, grounded = F.transform(fields, lambda f: f["field"]), grounded_fields(fields)
    bad = F.filter("results", lambda r: r["severity"].isin("fail", "warning"))

    def judge(r: Column) -> Column:
        mine = F.filter(r["fields"], lambda f: F.array_contains(scored, f))
        weak = F.filter(mine, lambda f: ~F.array_contains(grounded, f))
        named = F.when(F.size(weak) > 0, weak).otherwise(r["fields"])
        fixed, faithful = ~F.array_contains(can, r["rule_id"]), (F.size(mine) > 0) & (F.size(weak) == 0)
        why = (
            F.when(fixed, F.lit("the document itself is at fault"))
            .when(faithful, F.concat(F.lit("read as it stands in the source: "), F.array_join(mine, ", ")))
            .otherwise(F.concat(F.lit("absent or not found in the source: "), F.array_join(named, ", ")))
        )
        return F.struct(r["rule_id"].alias("rule_id"), F.when(fixed | faithful, "blocking").otherwise("retryable").alias("class"), why.alias("why"))

    df = settled(df.withColumn("classes", F.transform(bad, judge).cast(_CLASS)), "classes")
    ids = lambda kind: F.transform(F.filter("classes", lambda c: c["class"] == kind), lambda c: c["rule_id"])
    return df.withColumn("blocking", ids("blocking")).withColumn("retryable", ids("retryable"))


def evidence(max_attempts: int = MAX_ATTEMPTS, attempts: str = "attempts") -> Column:
    """The text on which a decider decides."""
    score = lambda f: F.concat(F.lit("- "), f["field"], F.lit(": "), f["confidence"].cast("decimal(6,4)").cast("string"), F.lit(" | "), F.coalesce(f["value"], F.lit("none")), F.lit(" | "), F.array_join(f["signals"], ", "))
    result = lambda r: F.concat(F.lit("["), F.upper(r["severity"]), F.lit("] "), r["rule_id"], F.lit(": "), r["reason"])
    failure = lambda c: F.concat(F.upper(c["class"]), F.lit(" "), c["rule_id"], F.lit(": "), c["why"])
    bad = F.filter("results", lambda r: r["severity"].isin("fail", "warning"))
    lines = F.concat(
        F.array(F.concat(F.lit("Attempt "), F.col(attempts), F.lit(f" of {max_attempts}. Confidence: "), F.col("confidence.overall").cast("decimal(6,4)").cast("string"), F.lit(". Validation: "), F.col("overall"))),
        F.transform("confidence.fields", score),
        F.transform(bad, result),
        F.when(no_data(F.col("confidence.fields")), F.array(F.lit("No field was found at all; this may be no invoice."))).otherwise(F.array().cast("array<string>")),
        F.transform("classes", failure),
        F.when(F.size("classes") == 0, F.array(F.lit("There are no failures."))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(lines, "\n")


def _usable(proposed: Column) -> Column:
    """A decision that isn't known is one to escalate."""
    return F.when(proposed.isin(*DECISIONS), proposed).otherwise("escalate")


def proposals(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``proposed``, ``reasoning``, ``suspicious_fields`` and ``retry_hint`` from a decider's answer.

    An answer that is no JSON object, or lacks a known decision or a reasoning as text, or has a
    field of a wrong kind, is unusable: ``proposed`` is null, and the reasoning says so.
    """
    text = strip_fences(F.col(answer))
    v = F.when(F.startswith(text, F.lit("{")), F.try_parse_json(text))
    df = df.withColumn("_v", v)
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")), F.lit("VOID"))
    value = lambda f, t="string": F.try_variant_get("_v", f"$.{f}", t)
    good = F.coalesce(value("decision").isin(*DECISIONS) & (kind("decision") == "STRING") & (kind("reasoning") == "STRING"), F.lit(False))
    good = good & kind("retry_hint").isin("STRING", "VOID") & kind("suspicious_fields").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    fields = F.coalesce(value("suspicious_fields", "array<string>"), F.array().cast("array<string>"))
    df = df.withColumn("_good", good)
    picked = lambda c: F.when(F.col("_good"), c)
    out = df.withColumn("proposed", picked(value("decision"))).withColumn("reasoning", F.coalesce(picked(value("reasoning")), F.lit(UNUSABLE)))
    return out.withColumn("suspicious_fields", picked(fields)).withColumn("retry_hint", picked(value("retry_hint"))).drop("_v", "_good")


def guard(df: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """From ``proposed`` (null: unusable), ``attempts``, ``has_reprocessor``, ``retryable`` and ``blocking``: ``decision, overridden, override_reason``.

    An unusable proposal escalates without counting as overridden.
    """
    proposed = _usable(F.col("proposed"))
    retry = proposed == "retry"
    reason = (
        F.when(retry & ~F.coalesce(F.col("has_reprocessor"), F.lit(False)), F.lit(NO_REPROCESSOR))
        .when(retry & (F.col("attempts") >= max_attempts), F.concat(F.lit(f"{BUDGET} ("), F.col("attempts"), F.lit(f"/{max_attempts})")))
        .when(retry & (F.size("retryable") == 0), F.lit(BLOCKED_RETRY))
        .when((proposed == "accept") & (F.size("blocking") > 0), F.concat(F.lit(ACCEPTED), F.array_join("blocking", ", ")))
    )
    out = df.withColumn("override_reason", reason).withColumn("overridden", F.col("override_reason").isNotNull())
    return out.withColumn("decision", F.when(F.col("overridden"), "escalate").otherwise(proposed))


def entry() -> Column:
    """The history's entry of one decision."""
    return F.struct(
        F.col("attempts").alias("attempt"), _usable(F.col("proposed")).alias("proposed"), F.col("decision").alias("final"),
        F.when(F.col("proposed").isin(*DECISIONS), F.col("reasoning")).otherwise(F.coalesce("reasoning", F.lit(UNUSABLE))).alias("reasoning"), F.col("overridden").alias("overridden"), F.col("override_reason").alias("override_reason"),
    )


HISTORY = "array<struct<attempt: int, proposed: string, final: string, reasoning: string, overridden: boolean, override_reason: string>>"


def review(df: DataFrame, propose: Callable[[DataFrame], DataFrame], reprocess: Callable[[DataFrame], DataFrame] | None, max_attempts: int = MAX_ATTEMPTS, keep: tuple[str, ...] | None = None, anew: tuple[str, ...] = (), wanted: str | None = None) -> DataFrame:
    """The bounded review of rows with results and confidence.

    ``propose`` adds ``proposed``, ``reasoning`` and ``retry_hint``; ``reprocess`` takes the rows
    to read again and gives them with new data, results and confidence. Each round handles only
    the rows still in retry; the attempt is counted here, whatever the callables do, and after
    ``max_attempts`` rounds nothing is left. Adds ``decision``, ``attempts``, ``history``, ``status``.

    ``keep``: all that the caller takes of the rows' own columns. The others are then written between rounds
    for rows to read again only, and not at all if ``reprocess`` makes them ``anew``. ``wanted``: a column; rows for which it
    is false go along undecided, with the status they came with.
    """
    can = F.lit(reprocess is not None)
    todo = df.withColumn("attempts", F.lit(1)).withColumn("history", F.array().cast(HISTORY))
    todo = todo if "has_reprocessor" in df.columns else todo.withColumn("has_reprocessor", can)
    done = None
    for n in range(1, max_attempts + 1):
        decided = guard(propose(classify(todo)), max_attempts)
        decided = decided.withColumn("history", F.concat("history", F.array(entry())).cast(HISTORY))
        if wanted and n == 1:
            decided = decided.withColumn("decision", F.when(F.col(wanted), F.col("decision")))
        if n < max_attempts:
            decided = stored(decided if keep is None else _narrowed(decided, keep, anew))
        over = decided.where("not decision <=> 'retry'")
        over = over if keep is None else over.select(*keep, *_DECIDED)
        done = over if done is None else done.unionByName(over, allowMissingColumns=True)
        if n == max_attempts or reprocess is None:
            break
        again = decided.where("decision = 'retry'").withColumn("attempts", F.col("attempts") + 1)
        todo = reprocess(again).drop("proposed", "reasoning", "decision", "overridden", "override_reason", "classes", "blocking", "retryable")
    given = [F.col("status")] if wanted and "status" in done.columns else []
    return done.withColumn("status", F.coalesce(final_status(F.col("decision")), *given))


_DECIDED = ("attempts", "history", "decision", "overridden", "override_reason")


def _narrowed(decided: DataFrame, keep: tuple[str, ...], anew: tuple[str, ...]) -> DataFrame:
    """The rows with ``keep`` and what was decided; of the other columns the values of rows to read again."""
    own = (*keep, *_DECIDED)
    rest = [c for c in decided.columns if c not in (*own, *anew, "proposed", "reasoning", "classes", "blocking", "retryable")]
    return decided.select(*own, *(F.when(F.col("decision") == "retry", F.col(c)).alias(c) for c in rest))


def final_status(decision: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in STATUS_OF_DECISION.items() for x in pair)), decision)


def latest(old: DataFrame, new: DataFrame, id_col: str = "document_id") -> DataFrame:
    """The record of the last reading: the new one where there is one."""
    return new.unionByName(old.join(new.select(id_col), id_col, "left_anti"), allowMissingColumns=True)
