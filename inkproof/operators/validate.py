"""The rule engine: runs the enabled rules, applies the policy, sums up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, SEVERITIES, SHARED, Rule, guarded, outcome
from ..functions.scalars import parse_date
from ..plans.shape import apart, built_once, settled
from .state import stored

_BAD = ("fail", "warning")


def _overridden(result: Column, severity: str | None) -> Column:
    if not severity:
        return result
    return F.when(result["severity"].isin(*_BAD), result.withField("severity", F.lit(severity))).otherwise(result)


def results(policy: dict[str, dict], rules: dict[str, Rule] | None = None, extra: dict | None = None) -> Column:
    """The array of results of all enabled rules, in the order of their ids.

    A rule that the policy doesn't name is enabled. ``extra``: parameters for every rule, such as the clock.
    """
    rules, out = RULES if rules is None else rules, []
    for rule_id in sorted(rules):
        own = policy.get(rule_id, {})
        if own.get("enabled", True):
            params = (own.get("params") or {}) | (extra or {})
            make = lambda: _overridden(guarded(rule_id, rules[rule_id], params), own.get("severity"))  # noqa: B023, E731
            given = rules[rule_id] is RULES.get(rule_id)
            out.append(built_once((rule_id, params, own.get("severity")), make) if given else make())
    return F.array(*out)


def shared_parts(policy: dict[str, dict], rules: dict[str, Rule] | None = None) -> dict[str, Column]:
    """By name what the given, enabled rules use more than once (see ``functions.rules.SHARED``)."""
    out: dict[str, Column] = {}
    for rule_id, parts in SHARED.items():
        own = policy.get(rule_id, {})
        if own.get("enabled", True) and (RULES if rules is None else rules).get(rule_id) is RULES[rule_id]:
            for name, build in parts(own.get("params") or {}).items():
                out[name] = built_once(("shared", name), build)
    return out


def judged(invoices: DataFrame, policy: dict[str, dict], rules: dict[str, Rule] | None = None, now: str | None = None, **extra) -> tuple[DataFrame, Column, dict[str, Column]]:
    """The rows with each rule's case in columns ``_case…``, the array of results told from these, and for each severity an array of whether a rule has it.

    The date is parsed once for all rules, and what a rule uses in several of its cases is computed once. Reasons are in the array
    of results alone: whoever doesn't take it pays for the cases only. Own rules without a ``decision`` give their results at once.
    """
    rules, parts = RULES if rules is None else rules, shared_parts(policy, rules)
    date = "_parsed" if "_parsed" in invoices.columns else "_date"  # scores parse it too
    columns = {"_date": parse_date(F.col("invoice_date"))} if date == "_date" else {}
    columns |= {f"_shared{i}": c for i, c in enumerate(parts.values())}
    dated = settled(invoices.withColumns(columns), *columns) if columns else invoices
    extra = extra | {"now": now, "date": date, "shared": {name: f"_shared{i}" for i, name in enumerate(parts)}}
    cases, told, has = {}, [], {s: [] for s in SEVERITIES}
    for i, rule_id in enumerate(sorted(rules)):
        own = policy.get(rule_id, {})
        if not own.get("enabled", True):
            continue
        rule, at, params, severity = rules[rule_id], F.col(f"_case{i}"), (own.get("params") or {}) | extra, own.get("severity")
        if rule.decision is None:
            cases[f"_case{i}"], result, known = _overridden(guarded(rule_id, rule, params), severity), at, None
        else:
            make = lambda: _parts(rule_id, rule, params, severity, at)  # noqa: B023, E731
            cases[f"_case{i}"], result, known = built_once(("parts", i, rule_id, params, severity), make) if rule is RULES.get(rule_id) else make()
        told.append(result)
        for s in SEVERITIES:
            if known is None:
                has[s].append(at["severity"] == s)
            elif s in known:
                has[s].append(at.isin(*(k for k, x in enumerate(known) if x == s)))
    if cases:
        cases["_case_apart"] = apart(date)
    return (settled(dated.withColumns(cases), *cases) if cases else dated), F.array(*told), has


def _parts(rule_id: str, rule: Rule, params: dict, severity: str | None, at: Column) -> tuple[Column, Column, list[str]]:
    """A rule's case, its result by the case in ``at``, and the cases' severities."""
    try:
        made = rule.decision(params).moved(severity)
        return made.case(), made.result(at), made.severities
    except Exception:  # as ``guarded``: a rule that can't be built is skipped
        return F.lit(0), guarded(rule_id, rule, params), ["skipped"]


def counted(has: dict[str, list[Column]]) -> Column:
    """A map of how many rules have each severity."""
    count = lambda s: sum((F.coalesce(c.cast("int"), F.lit(0)) for c in has[s]), F.lit(0))
    return F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), F.array(*map(count, SEVERITIES)))


def worst(has: dict[str, list[Column]]) -> Column:
    """The document's severity: fail, warning or pass."""
    some = lambda s: reduce(lambda a, c: a | c, has[s], F.lit(False))
    return F.when(some("fail"), "fail").when(some("warning"), "warning").otherwise("pass")


def unjudged(df: DataFrame) -> DataFrame:
    """Without the columns of :func:`judged`."""
    return df.drop(*(c for c in df.columns if c == "_date" or c.startswith(("_case", "_shared"))))


def validate(invoices: DataFrame, policy: dict[str, dict], rules: dict[str, Rule] | None = None, now: str | None = None, **extra) -> DataFrame:
    """Add ``results``, ``counts`` (of all four severities) and ``overall``. See :func:`judged`."""
    df, results, has = judged(invoices, policy, rules, now, **extra)
    return unjudged(df.withColumns({"results": results, "counts": counted(has), "overall": worst(has)}))


def faulty_rules(invoices: DataFrame, policy: dict[str, dict], rules: dict[str, Rule], extra: dict | None = None) -> set[str]:
    """Of these rules those that stop a job over these rows, found by halves; an error of the rows themselves is raised.

    Each try computes the rows anew: give them stored, if they cost much.
    """

    def fails(ids: list[str]) -> bool:
        try:
            own = results(policy, {i: rules[i] for i in ids}, extra) if ids else F.lit(1)
            invoices.select(own.alias("results")).write.format("noop").mode("overwrite").save()
            return False
        except Exception:
            if not ids:
                raise
            return True

    def search(ids: list[str]) -> set[str]:
        if not ids or not fails(ids):
            return set()
        return set(ids) if len(ids) == 1 else search(ids[: len(ids) // 2]) | search(ids[len(ids) // 2 :])

    fails([])
    return search(sorted(rules))


def quarantined(rules: dict[str, Rule], faulty: set[str]) -> dict[str, Rule]:
    """The rules, with the faulty ones skipped with confidence 0 for every row."""
    skipped = lambda rule_id: Rule(lambda params: outcome(rule_id, "skipped", "The rule raised while it ran.", (), 0.0), rules[rule_id].retryable)
    return {k: skipped(k) if k in faulty else r for k, r in rules.items()}


def validate_isolated(invoices: DataFrame, policy: dict[str, dict], rules: dict[str, Rule] | None = None, now: str | None = None, **extra) -> DataFrame:
    """As :func:`validate`, and written; rules of one's own that raise while they run are found and skipped.

    Without a fault this is one pass. After one, the rows are written, so that what they are made of isn't computed
    again, and the rules that aren't given here run apart over them, by halves, until the faulty ones are known; all
    others have their results.
    """
    rules = RULES if rules is None else rules
    try:
        return stored(validate(invoices, policy, rules, now, **extra))
    except Exception:
        own = {k: r for k, r in rules.items() if r is not RULES.get(k)}
        kept = stored(invoices.withColumn("_date", parse_date(F.col("invoice_date"))))
        bad = faulty_rules(kept, policy, own, extra | {"now": now, "date": "_date"})
        if not bad:
            raise
        return stored(validate(kept.drop("_date"), policy, quarantined(rules, bad), now, **extra))


def summarise(df: DataFrame) -> DataFrame:
    told = F.col("results")["severity"]
    count = lambda s: F.size("results") - F.size(F.array_remove(told, s))
    each = F.array(*map(count, SEVERITIES))
    df = df.withColumn("counts", F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), each))
    has = lambda s: F.array_contains(told, s)
    return df.withColumn("overall", F.when(has("fail"), "fail").when(has("warning"), "warning").otherwise("pass"))


def long_form(validated: DataFrame, id_col: str = "document_id", only: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document and rule; ``only``: just these severities."""
    rows = validated.select(id_col, F.explode("results").alias("r")).select(id_col, "r.*")
    return rows.where(F.col("severity").isin(*only)) if only else rows


def apply_policy(rows: DataFrame, policy_table: DataFrame) -> DataFrame:
    """The policy's switches and severities on finished long results, by a join (see ``policy_table``)."""
    p = policy_table.select("rule_id", F.col("enabled").alias("_on"), F.col("severity").alias("_to"))
    joined = rows.join(F.broadcast(p), "rule_id", "left").where(F.coalesce("_on", F.lit(True)))
    return joined.withColumn("severity", F.when(F.col("severity").isin(*_BAD) & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("severity"))).drop("_on", "_to")


def failures(validated: DataFrame) -> DataFrame:
    return validated.withColumn("failures", F.filter("results", lambda r: r["severity"] == "fail"))


def counts_by_severity(validated: DataFrame, id_col: str = "document_id") -> DataFrame:
    return long_form(validated, id_col).groupBy(id_col).pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)
