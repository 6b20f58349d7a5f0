"""How far each field is supported, and what that says of the document."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import grounded_number, grounded_text, iso_currency, money, parse_date, present
from ..plans.shape import built_once, settled

# The fields' weights, in the order of the scores; the fields without which nothing can be trusted.
WEIGHTS = {"invoice_number": 0.20, "invoice_date": 0.15, "vendor_name": 0.15, "currency": 0.05, "subtotal": 0.10, "tax_amount": 0.10, "total": 0.20, "line_items": 0.05}
CRITICAL = ("invoice_number", "vendor_name", "total")
STRATEGIES = ("arithmetic", "geometric", "min_gated")
TOLERANCE, FLOOR = 0.01, 1e-6

# The names of the signals.
ABSENT, PRESENT = "absent", "present(+0.50)"
GROUNDED, NOT_FOUND = "grounded_in_source(+0.30)", "not_found_in_source(+0.00)"
NO_RULE, VALID, INVALID = "no_format_rule(+0.20)", "format_valid(+0.20)", "format_invalid(-0.20)"
COHERENT, MISMATCH = "arithmetic_coherent(+0.10)", "arithmetic_mismatch(x0.5)"

SCORE = "struct<field: string, value: string, confidence: double, signals: array<string>>"


def _score(field: str, value: Column, confidence: Column, signals: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence"), signals.alias("signals"))


def _confidence(there: Column, grounded: Column, valid: Column | None) -> Column:
    form = F.lit(0.2) if valid is None else F.when(valid, 0.2).otherwise(-0.2)
    return F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.when(grounded, 0.3).otherwise(0.0) + form))).otherwise(0.0)


def _signals(there: Column, grounded: Column, valid: Column | None) -> Column:
    form = F.lit(NO_RULE) if valid is None else F.when(valid, VALID).otherwise(INVALID)
    return F.when(there, F.array(F.lit(PRESENT), F.when(grounded, GROUNDED).otherwise(NOT_FOUND), form)).otherwise(F.array(F.lit(ABSENT)))


def field_score(field: str, kind: str, source: str = "source_text", valid: Column | None = None, low: Column | None = None) -> Column:
    """0 if absent; else 0.5, 0.3 more if grounded in the source, and 0.2 more or less for its form."""
    value = F.col(field)
    there, grounded = present(value, kind), (grounded_text if kind == "text" else grounded_number)(value, F.col(source), low)
    return _score(field, value if kind == "text" else money(value), _confidence(there, grounded, valid), _signals(there, grounded, valid))


def _items_confidence(there: Column, priced: Column, n: Column) -> Column:
    return F.when(there, F.round(F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.6) * priced / n), 4)).otherwise(0.0)


def _items_signals(there: Column, priced: Column, n: Column) -> Column:
    return F.when(there, F.array(F.concat(F.lit("count="), n), F.concat(F.lit("with_amount="), priced, F.lit("/"), n))).otherwise(F.array(F.lit(ABSENT)))


def items_score(items: str = "line_items") -> Column:
    """0 without items; else 0.4, and 0.6 more by the share of items with an amount."""
    c = F.col(items)
    n, priced, there = F.size(c), F.size(F.filter(c, lambda x: x["amount"].isNotNull())), present(c, "array")
    return _score("line_items", F.when(there, F.concat(n, F.lit(" item(s)"))), _items_confidence(there, priced, n), _items_signals(there, priced, n))


def coherent() -> Column:
    """Whether subtotal, tax and total agree; null if one is missing."""
    off = F.abs(F.col("subtotal") + F.col("tax_amount") - F.coalesce(F.col("discount"), F.lit(0.0)) - F.col("total"))
    return off <= TOLERANCE


#: The scored fields' kinds, where they aren't texts.
_NUMBERS = ("subtotal", "tax_amount", "total")


def measured(df: DataFrame, source: str = "source_text") -> DataFrame:
    """Add what the scores are made of, computed once: ``_there…``, ``_found…``, ``_valid…`` and ``_sure…`` (the confidence) of each field, ``_agree``, ``_priced`` and ``_parsed``, the date."""
    df = settled(df.withColumn("_low", F.lower(source)).withColumn("_parsed", parse_date(F.col("invoice_date"))).withColumn("_agree", coherent()), "_low", "_parsed", "_agree")

    def facts() -> dict[str, Column]:
        out = {}
        for i, f in enumerate(WEIGHTS):
            kind = _kind(f)
            out[f"_there{i}"] = present(F.col(f), kind)
            if kind != "array":
                out[f"_found{i}"] = out[f"_there{i}"] & (grounded_text if kind == "text" else grounded_number)(F.col(f), F.col(source), F.col("_low"))
        dated, coded = ("_valid%d" % list(WEIGHTS).index(f) for f in ("invoice_date", "currency"))
        return out | {dated: F.col("_parsed").isNotNull(), coded: iso_currency(F.col("currency")), "_priced": F.size(F.filter("line_items", lambda x: x["amount"].isNotNull()))}

    columns = built_once(("facts", source), facts)
    df = settled(df.withColumns(columns).drop("_low"), *columns)
    sure = built_once(("sure",), lambda: {f"_sure{i}": _sure(i, f) for i, f in enumerate(WEIGHTS)})
    return settled(df.withColumns(sure), *sure)


def _kind(field: str) -> str:
    return "number" if field in _NUMBERS else "array" if field == "line_items" else "text"


def _formed(i: int, field: str) -> Column | None:
    return F.col(f"_valid{i}") if field in ("invoice_date", "currency") else None


def _sure(i: int, field: str) -> Column:
    """The confidence in a field, from what was measured."""
    there = F.col(f"_there{i}")
    if field == "line_items":
        return _items_confidence(there, F.col("_priced"), F.size(field))
    first, agree = _confidence(there, F.col(f"_found{i}"), _formed(i, field)), F.col("_agree")
    return F.when(agree, F.round(F.least(F.lit(1.0), first + 0.10), 4)).when(~agree, F.round(first * 0.5, 4)).otherwise(first) if field in _NUMBERS else first


def _told(i: int, field: str) -> Column:
    """The score of a field, from what was measured."""
    there, value, agree = F.col(f"_there{i}"), F.col(field), F.col("_agree")
    if field == "line_items":
        n = F.size(value)
        return _score(field, F.when(there, F.concat(n, F.lit(" item(s)"))), F.col(f"_sure{i}"), _items_signals(there, F.col("_priced"), n))
    signals = _signals(there, F.col(f"_found{i}"), _formed(i, field))
    if field in _NUMBERS:
        more = lambda x: F.concat(signals, F.array(F.lit(x)))
        signals = F.when(agree, more(COHERENT)).when(~agree, more(MISMATCH)).otherwise(signals)
    return _score(field, money(value) if field in _NUMBERS else value, F.col(f"_sure{i}"), signals)


_MEASURES = ("_parsed", "_there", "_found", "_valid", "_sure", "_agree", "_priced")


def unmeasured(df: DataFrame) -> DataFrame:
    """Without the columns of :func:`measured`."""
    return df.drop(*(c for c in df.columns if c.startswith(_MEASURES)))


def told() -> Column:
    """The array with one score for each field in fixed order, of measured rows; values and signals are made here alone."""
    return built_once(("told",), lambda: F.array(*(_told(i, f) for i, f in enumerate(WEIGHTS))))


def scores(df: DataFrame, source: str = "source_text") -> DataFrame:
    """Add ``scores``, an array with one score for each field in fixed order."""
    return unmeasured(measured(df, source).withColumn("scores", told()))


def _weight(weights: dict[str, float], field: Column) -> Column:
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))) if weights else None
    return F.coalesce(F.element_at(table, field), F.lit(1.0)) if table is not None else F.lit(1.0)


def _sum(scores: Column, value) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, s: a + value(s))


def _exact(scores: Column, value) -> Column:
    """A sum of decimals, as a double: the order of the fields can't change it."""
    return F.aggregate(scores, F.lit(0).cast("decimal(38,10)"), lambda a, s: (a + value(s)).cast("decimal(38,10)")).cast("double")


def _written_out(sure: list[Column], weights: dict[str, float], critical: tuple[str, ...], fields: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Mean, geometric mean and the weakest critical score of scores of known fields. Sums of decimals are sums of whole numbers: weights of four digits, scores of six."""
    exact = [int(Decimal(repr(float(weights.get(f, 1.0)))).quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10_000) for f in fields]
    total, zero = sum(exact) / 10_000, F.lit(0.0)
    if total <= 0:
        mean = geometric = zero
    else:
        whole = lambda c: (c.cast("decimal(10,6)") * F.lit(1_000_000)).cast("bigint")
        mean = reduce(lambda a, x: a + x, (whole(c) * F.lit(w) for c, w in zip(sure, exact))).cast("double") / F.lit(1e10) / F.lit(total)
        logs = reduce(lambda a, x: a + x, (F.lit(float(weights.get(f, 1.0))) * F.ln(F.greatest(c, F.lit(FLOOR))) for f, c in zip(fields, sure)), zero)
        geometric = F.exp(logs / F.lit(total))
    least = [c for f, c in zip(fields, sure) if f in critical]
    return mean, geometric, F.least(*least, *least[:1]) if least else F.lit(None).cast("double")


def overall(strategy: str | Column, weights: dict[str, float] = WEIGHTS, critical: tuple[str, ...] = CRITICAL, column: str = "scores", fields: tuple[str, ...] | None = None, sure: list[Column] | None = None) -> Column:
    """The document's confidence by a strategy's name, or by a column of names; an unknown name is an error.

    ``fields``: the scores' fields in their order, if they are known; the sums are written out then, not looped over. ``sure``: their confidences, if they are columns of their own.
    """
    s = F.col(column)
    total = _exact(s, lambda x: _weight(weights, x["field"]).cast("decimal(10,4)"))
    mean = F.when(total > 0, _exact(s, lambda x: _weight(weights, x["field"]).cast("decimal(10,4)") * x["confidence"].cast("decimal(10,6)")) / total).otherwise(0.0)
    logs = _sum(s, lambda x: _weight(weights, x["field"]) * F.ln(F.greatest(x["confidence"], F.lit(FLOOR))))
    geometric = F.when(total > 0, F.exp(logs / total)).otherwise(0.0)
    weakest = F.array_min(F.transform(F.filter(s, lambda x: x["field"].isin(*critical)), lambda x: x["confidence"]))
    if fields is not None:
        mean, geometric, weakest = _written_out(sure or [F.get(s, F.lit(i))["confidence"] for i in range(len(fields))], weights, critical, fields)
    by = {"arithmetic": mean, "geometric": geometric, "min_gated": F.least(mean, F.coalesce(weakest, mean))}
    if isinstance(strategy, str):
        if strategy not in by:
            raise ValueError(f"unknown strategy: {strategy}; there are {', '.join(STRATEGIES)}")
        chosen = by[strategy]
    else:
        chosen = F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce(strategy, F.lit("null")))).cast("double")
        for name, value in by.items():
            chosen = F.when(strategy == name, value).otherwise(chosen)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), chosen)), 4)


def rated(strategy: str = "min_gated", weights: dict[str, float] = WEIGHTS, critical: tuple[str, ...] = CRITICAL) -> Column:
    """The document's confidence, of measured rows."""
    sure = lambda: [F.col(f"_sure{i}") for i in range(len(WEIGHTS))]
    return built_once(("overall", strategy, weights, critical), lambda: overall(strategy, weights, critical, fields=tuple(WEIGHTS), sure=sure()))


def summary(strategy: str = "min_gated", critical: tuple[str, ...] = CRITICAL, rating: str = "_overall") -> Column:
    """The struct of strategy, overall, fields and critical fields, of measured rows with their ``rating``."""
    return F.struct(F.lit(strategy).alias("strategy"), F.col(rating).alias("overall"), told().alias("fields"), F.array(*map(F.lit, sorted(critical))).alias("critical_fields"))


def report(df: DataFrame, strategy: str = "min_gated", weights: dict[str, float] = WEIGHTS, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Add ``scores`` and ``confidence``, a struct of strategy, overall, fields and critical fields."""
    df = settled(measured(df).withColumn("_overall", rated(strategy, weights, critical)), "_overall")
    return unmeasured(df.withColumns({"scores": told(), "confidence": summary(strategy, critical)})).drop("_overall")


def band(c: Column) -> Column:
    return F.when(c >= 0.7, "green").when(c >= 0.4, "amber").when(c.isNotNull(), "red")


def percent(c: Column) -> Column:
    return F.coalesce(F.round(c * 100).cast("int").cast("string"), F.lit("—"))
