"""The business rules: each turns an invoice's columns into one result, as a native expression.

A result is a struct of rule_id, severity (pass, warning, fail or skipped), reason, confidence,
suggested_fix and fields. A rule that lacks its inputs is *skipped*, which isn't a pass. Every
rule gives a result for every row, whatever is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import blank, falsy, iso_currency, key, money, parse_date, six_digits, strip, whole_days

RESULT = "struct<rule_id: string, severity: string, reason: string, confidence: double, suggested_fix: string, fields: array<string>>"
SEVERITIES = ("pass", "warning", "fail", "skipped")


@dataclass(frozen=True)
class Rule:
    """``build(params)`` gives the result column; ``retryable``: reading the document again might clear a failure.

    The rules given here have a result for any value. A rule whose ``build`` raises is skipped with
    confidence 0; a Python rule (see ``python_rule``) is guarded row by row as well.
    """

    build: Callable[[dict], Column]
    retryable: bool = False
    #: The same result in two parts, its case and what is told of each case, so that texts nobody asks for aren't made.
    decision: Callable[[dict], "Decision"] | None = None


def outcome(rule_id: str, severity: str, reason: Column | str, fields=(), confidence: float = 1.0, fix: Column | str | None = None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = fields if isinstance(fields, Column) else F.array(*map(F.lit, fields)).cast("array<string>")
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), text(reason).alias("reason"),
        F.lit(float(confidence)).alias("confidence"), text(fix).cast("string").alias("suggested_fix"), names.alias("fields"),
    )


def guarded(rule_id: str, rule: Rule, params: dict) -> Column:
    """The rule's result; the fault of a rule that can't be built must not stop the others."""
    try:
        return rule.build(params)
    except Exception as e:
        return outcome(rule_id, "skipped", f"The rule raised {type(e).__name__}.", (), 0.0)


@dataclass(frozen=True)
class Decision:
    """The first case whose condition holds: (condition, severity, reason, fields[, confidence, fix]); ``otherwise`` is without a condition."""

    rule_id: str
    cases: list[tuple]
    otherwise: tuple

    @property
    def severities(self) -> list[str]:
        """Of each case, in order."""
        return [c[1] for c in self.cases] + [self.otherwise[0]]

    def moved(self, severity: str | None) -> "Decision":
        """With this severity in place of warning and fail."""
        to = lambda s: severity if severity and s in ("fail", "warning") else s
        return Decision(self.rule_id, [(c, to(s), *rest) for c, s, *rest in self.cases], (to(self.otherwise[0]), *self.otherwise[1:]))

    def _chain(self, conditions: list[Column], values: list[Column]) -> Column:
        chain = None
        for condition, value in zip(conditions, values):
            chain = F.when(condition, value) if chain is None else chain.when(condition, value)
        return values[-1] if chain is None else chain.otherwise(values[-1])

    def case(self) -> Column:
        """The number of the case, from 0."""
        return self._chain([c[0] for c in self.cases], [F.lit(i) for i in range(len(self.cases) + 1)])

    def result(self, case: Column | None = None) -> Column:
        """The rule's result, by its conditions or by the ``case`` computed before."""
        made = [outcome(self.rule_id, *rest) for _, *rest in self.cases] + [outcome(self.rule_id, *self.otherwise)]
        return self._chain([c[0] if case is None else case == i for i, c in enumerate(self.cases)], made)


def decide(rule_id: str, cases: list[tuple], otherwise: tuple) -> Column:
    """The result of a :class:`Decision`."""
    return Decision(rule_id, cases, otherwise).result()


def _say(template: str, *values: Column) -> Column:
    """The template with each {} replaced; a null value shows as a dash."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        out += [F.coalesce(v.cast("string"), F.lit("-")), F.lit(p)]
    return F.concat(*out)


# The rates that are standard by default, and the usual form of an invoice number.
STANDARD_RATES = (0, 5, 8, 12, 18, 20, 28)
NUMBER_FORM = r"^[A-Za-z0-9][A-Za-z0-9\-_/.]*$"

_items = lambda: F.coalesce(F.col("line_items"), F.array().cast("array<struct<description: string, quantity: double, unit_price: double, amount: double>>"))
_no_items = lambda: F.size(_items()) == 0
_zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))


def invoice_total_arithmetic(params: dict) -> Decision:
    me, all_four = "invoice_total_arithmetic", ("subtotal", "tax_amount", "discount", "total")
    subtotal, total = F.col("subtotal"), F.col("total")
    expected = subtotal + _zero("tax_amount") - _zero("discount")
    off = F.abs(expected - total)
    return Decision(
        me,
        [
            (subtotal.isNull() | total.isNull(), "skipped", "Subtotal or total is missing.", ("subtotal", "total")),
            (off <= params.get("tolerance", 0.01), "pass", _say("The parts add up to {}.", money(total)), all_four),
        ],
        ("fail", _say("The parts add up to {}, the total says {}: {} apart.", money(expected), money(total), money(off)), all_four, 1.0, _say("Correct the total to {} or read the amounts again.", money(expected))),
    )


def _part(params: dict, name: str, build: Callable[[], Column]) -> Column:
    """What a rule uses in several cases: built here or, if ``params`` name a column for it, computed before."""
    column = (params.get("shared") or {}).get(name)
    return F.col(column) if column else build()


def _amounts(params: dict) -> dict[str, Callable[[], Column]]:
    exact = "decimal(38,4)"
    total = lambda: F.aggregate(_items(), F.lit(0).cast(exact), lambda a, x: F.try_add(a, x["amount"].try_cast(exact)).try_cast(exact)).cast("double")
    return {"lacking": lambda: F.size(F.filter(_items(), lambda x: x["amount"].isNull())), "items_total": total}


def subtotal_matches_line_items(params: dict) -> Decision:
    me, both, subtotal = "subtotal_matches_line_items", ("line_items", "subtotal"), F.col("subtotal")
    lacking, total = (_part(params, *p) for p in _amounts(params).items())
    return Decision(
        me,
        [
            (subtotal.isNull(), "skipped", "There is no subtotal.", ("subtotal",)),
            (_no_items(), "skipped", "There are no line items.", ("line_items",)),
            (lacking > 0, "warning", _say("{} of {} line items lack an amount.", lacking, F.size(_items())), both, 1.0, "Read the line items again or complete them by hand."),
            (total.isNull(), "skipped", "The amounts of the line items can't be added.", both, 0.0),
            (F.abs(total - subtotal) <= params.get("tolerance", 0.01), "pass", _say("The line items add up to the subtotal {}.", money(total)), both),
        ],
        ("fail", _say("The line items add up to {}, the subtotal says {}.", money(total), money(subtotal)), both, 1.0, "Look for a line that was missed or read twice."),
    )


def _lines(params: dict) -> dict[str, Callable[[], Column]]:
    """How many items are complete, and the numbered ones that aren't consistent; null if all are."""
    tolerance = params.get("tolerance", 0.01)
    numbered = lambda: F.transform(_items(), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    complete = lambda x: x["quantity"].isNotNull() & x["unit_price"].isNotNull() & x["amount"].isNotNull()
    off = lambda x: F.abs(x["quantity"] * x["unit_price"] - x["amount"]) > tolerance
    bad = lambda: F.when(F.exists(_items(), off), F.filter(numbered(), lambda r: off(r["x"])))
    return {"full": lambda: F.size(F.filter(_items(), complete)), f"bad_lines {tolerance!r}": bad}


def line_item_amount_consistency(params: dict) -> Decision:
    me, fields = "line_item_amount_consistency", ("line_items",)
    full, bad = (_part(params, *p) for p in _lines(params).items())
    told = F.transform(bad, lambda r: _say("line {} ({}): {} x {} is not {}", r["n"], r["x"]["description"], six_digits(r["x"]["quantity"]), money(r["x"]["unit_price"]), money(r["x"]["amount"])))
    return Decision(
        me,
        [
            (_no_items(), "skipped", "There are no line items.", fields),
            (full == 0, "skipped", "No line item has quantity, price and amount.", fields),
            (bad.isNull(), "pass", _say("All {} complete line items are consistent.", full), fields),
        ],
        ("fail", _say("{} of {} line items are inconsistent: {}.", F.size(bad), full, F.array_join(told, "; ")), fields, 1.0, "Read these lines again; shifted columns are the usual cause."),
    )


def tax_percentage_plausible(params: dict) -> Decision:
    me, both = "tax_percentage_plausible", ("tax_amount", "subtotal")
    subtotal, tax = F.col("subtotal"), F.col("tax_amount")
    percent = tax / subtotal * 100
    near = reduce(lambda a, r: a | (F.abs(percent - F.lit(float(r))) <= params.get("rate_tolerance", 0.6)), params.get("known_rates", STANDARD_RATES), F.lit(False))
    shown = F.round(percent, 1)
    return Decision(
        me,
        [
            (subtotal.isNull() | tax.isNull(), "skipped", "Subtotal or tax is missing.", ("subtotal", "tax_amount")),
            (subtotal <= 0, "skipped", "The subtotal isn't positive.", ("subtotal",)),
            (percent > params.get("max_percent", 30.0), "fail", _say("A tax rate of {} % is implausible.", shown), both, 1.0, "A rate may have been read as an amount, or an amount as a rate."),
            (near, "pass", _say("The tax rate of {} % is a standard one.", shown), both),
        ],
        ("warning", _say("The tax rate of {} % is no standard one.", shown), both, 0.6, "Confirm the rate of the jurisdiction."),
    )


def _date(params: dict) -> Column:
    """The invoice's date, parsed here or, if ``params`` name a column for it, before."""
    return F.col(params["date"]) if params.get("date") else parse_date(F.col("invoice_date"))


def date_format_valid(params: dict) -> Decision:
    me, fields, raw = "date_format_valid", ("invoice_date",), F.col("invoice_date")
    return Decision(
        me,
        [
            (falsy(raw), "skipped", "There is no invoice date.", fields),
            (_date(params).isNull(), "fail", _say("'{}' is no date in a known form.", raw), fields, 1.0, "Write it like 2024-12-31."),
        ],
        ("pass", _say("'{}' is a date.", raw), fields),
    )


def _now(params: dict) -> Column:
    return F.lit(params["now"]).cast("timestamp_ntz") if params.get("now") else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def future_date(params: dict) -> Decision:
    me, fields, parsed = "future_date", ("invoice_date",), _date(params)
    ahead = whole_days(parsed, _now(params))
    return Decision(
        me,
        [
            (parsed.isNull(), "skipped", "There is no readable invoice date.", fields),
            (ahead > params.get("grace_days", 1), "fail", _say("The date lies {} days ahead.", ahead), fields, 1.0, "Confirm the date with the vendor before payment."),
        ],
        ("pass", "The date isn't in the future.", fields),
    )


def stale_date(params: dict) -> Decision:
    me, fields, parsed, most = "stale_date", ("invoice_date",), _date(params), params.get("max_age_days", 365)
    age = whole_days(_now(params), parsed)
    return Decision(
        me,
        [
            (parsed.isNull(), "skipped", "There is no readable invoice date.", fields),
            (age > most, "warning", _say(f"The invoice is {{}} days old; {most} are usual at most.", age), fields, 1.0, "It may be late or sent again."),
        ],
        ("pass", _say("The invoice is {} days old.", age), fields),
    )


def duplicate_invoice(params: dict) -> Column:
    """Needs ``duplicate_count`` and ``duplicate_ids`` from the lookup; without one (``lookup`` false) it is skipped."""
    me, both = "duplicate_invoice", ("vendor_name", "invoice_number")
    if not params.get("lookup", True):
        return Decision(me, [], ("skipped", "No lookup of other invoices is set up.", ("invoice_number",)))
    return Decision(
        me,
        [
            (falsy(F.col("vendor_name")) | falsy(F.col("invoice_number")), "skipped", "Vendor or number is missing.", both),
            (F.coalesce(F.col("duplicate_count"), F.lit(0)) == 0, "pass", "No other invoice has this vendor and number.", both),
        ],
        ("fail", _say("{} other invoice(s) have this vendor and number: {}.", F.col("duplicate_count"), F.array_join("duplicate_ids", ", ")), both, 1.0, "Hold the payment until someone has compared them."),
    )


def _repeated(keys: Column) -> Column:
    """``at, n, key`` of each key that an array of (key, at) has more than once, by first place: sorted, then cut where the key changes.

    Arrays of one element hold what several lambdas use, so that it is computed once.
    """
    changes = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~x["key"].eqNullSafe(F.get(s, i - 1)["key"]), i)), lambda i: i.isNotNull())
    cut = F.transform(F.array(F.sort_array(keys)), lambda s: F.struct(s.alias("s"), changes(s).alias("first")))
    run = lambda c, i, k: F.struct(c["s"][i]["at"].alias("at"), (F.coalesce(F.get(c["first"], k + 1), F.size(c["s"])) - i).alias("n"), c["s"][i]["key"].alias("key"))
    runs = F.transform(cut, lambda c: F.transform(c["first"], lambda i, k: run(c, i, k)))[0]
    return F.sort_array(F.filter(runs, lambda r: r["n"] > 1))


def _twice(params: dict) -> dict[str, Callable[[], Column]]:
    """Items whose hashes all differ do so themselves, those of the numbers alone first; the others are sorted and compared."""
    keyed = lambda x: F.struct(key(F.coalesce(x["description"], F.lit("None"))).alias("d"), x["quantity"].alias("q"), x["unit_price"].alias("p"), x["amount"].alias("a"))
    found = lambda: _repeated(F.transform(_items(), lambda x, i: F.struct(keyed(x).alias("key"), i.alias("at"))))
    repeat = lambda hashed: F.size(F.array_distinct(F.transform(_items(), hashed))) < F.size(_items())
    numbers = lambda x: (x["quantity"], x["unit_price"], x["amount"])
    named = lambda x: F.xxhash64(key(F.coalesce(x["description"], F.lit("None"))), *numbers(x))
    return {"twice": lambda: F.when(repeat(lambda x: F.xxhash64(*numbers(x))), F.when(repeat(named), found()))}


def duplicate_line_items(params: dict) -> Decision:
    me, fields = "duplicate_line_items", ("line_items",)
    [twice] = (_part(params, *p) for p in _twice(params).items())
    told = F.transform(F.slice(twice, 1, 3), lambda r: _say("'{}' x{}", r["key"]["d"], r["n"]))
    return Decision(
        me,
        [
            (F.size(_items()) < 2, "skipped", "There are fewer than two line items.", fields),
            (twice.isNull() | (F.size(twice) == 0), "pass", _say("All {} line items differ.", F.size(_items())), fields),
        ],
        ("warning", _say("{} line item(s) occur more than once: {}.", F.size(twice), F.array_join(told, "; ")), fields, 1.0, "Compare with the document's table."),
    )


def mandatory_fields(params: dict) -> Decision:
    me, needed = "mandatory_fields", params.get("required", ("invoice_number", "invoice_date", "vendor_name", "total"))
    texts = {"invoice_number", "invoice_date", "vendor_name", "vendor_tax_id", "currency"}
    lacks = lambda f: blank(F.col(f)) if f in texts else _no_items() if f == "line_items" else F.col(f).isNull()
    missing = F.filter(F.array(*(F.when(lacks(f), F.lit(f)) for f in needed)), lambda x: x.isNotNull())
    return Decision(
        me,
        [(~reduce(lambda a, f: a | lacks(f), needed, F.lit(False)), "pass", f"All {len(needed)} required fields are there.", needed)],
        ("fail", _say("Missing: {}.", F.array_join(missing, ", ")), missing, 1.0, "Read the document again or key the fields in."),
    )


def invoice_number_format(params: dict) -> Decision:
    me, fields, raw = "invoice_number_format", ("invoice_number",), F.col("invoice_number")
    text, least, most = strip(raw), params.get("min_length", 3), params.get("max_length", 40)
    return Decision(
        me,
        [
            (falsy(raw), "skipped", "There is no invoice number.", fields),
            (~F.length(text).between(least, most), "warning", _say(f"'{{}}' has {{}} characters; {least} to {most} are usual.", text, F.length(text)), fields, 1.0, "Compare with the document's head."),
            (~text.rlike(params.get("pattern", NUMBER_FORM)), "warning", _say("'{}' has unusual characters.", text), fields, 1.0, "A label or sentence may have been read."),
        ],
        ("pass", _say("'{}' is well formed.", text), fields),
    )


def currency_valid(params: dict) -> Decision:
    me, fields, raw = "currency_valid", ("currency",), F.col("currency")
    code, allowed = F.upper(strip(raw)), params.get("allowed")
    cases = [
        (falsy(raw), "warning", "There is no currency.", fields, 1.0, "Ask, or take the vendor's usual one."),
        (~iso_currency(raw), "fail", _say("'{}' is no three-letter code.", raw), fields, 1.0, "Write symbols as codes, such as USD for $."),
    ]
    if allowed:
        cases.append((~code.isin(*allowed), "warning", _say("{} isn't among the accepted currencies.", code), fields, 1.0, "Confirm that this vendor may bill in it."))
    return Decision(me, cases, ("pass", _say("{} is a valid code.", code), fields))


# The known forms of tax ids, in the order in which they are tried.
TAX_ID_FORMS = (
    ("GSTIN", "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"),
    ("EU VAT", "^[A-Z]{2}[0-9A-Z]{8,12}$"),
    ("US EIN", "^[0-9]{2}-[0-9]{7}$"),
)


def vendor_tax_id_format(params: dict) -> Decision:
    me, fields, raw = "vendor_tax_id_format", ("vendor_tax_id",), F.col("vendor_tax_id")
    text = F.replace(F.upper(strip(raw)), F.lit(" "), F.lit(""))
    known = [(text.rlike(p), "pass", f"The tax id is a {name}.", fields) for name, p in TAX_ID_FORMS]
    return Decision(
        me,
        [(falsy(raw), "skipped", "There is no tax id.", fields), *known],
        ("warning", _say("'{}' is no tax id in a known form.", text), fields, 1.0, "Compare with the vendor's record."),
    )


def _quantities(params: dict) -> dict[str, Callable[[], Column]]:
    """The numbered quantities that are out of range; null if none is."""
    zero_too = not params.get("allow_zero", False)
    wrong = lambda q: q <= 0 if zero_too else q < 0
    numbered = lambda: F.transform(_items(), lambda x, i: F.struct((i + 1).alias("n"), x["quantity"].alias("q")))
    return {f"bad_quantities {zero_too}": lambda: F.when(F.exists(_items(), lambda x: wrong(x["quantity"])), F.filter(numbered(), lambda r: wrong(r["q"])))}


def negative_quantity(params: dict) -> Decision:
    me, fields = "negative_quantity", ("line_items",)
    [bad] = (_part(params, *p) for p in _quantities(params).items())
    told = F.transform(bad, lambda r: _say("line {}: {}", r["n"], six_digits(r["q"])))
    return Decision(
        me,
        [(_no_items(), "skipped", "There are no line items.", fields), (bad.isNull(), "pass", "No quantity is out of range.", fields)],
        ("fail", _say("{} quantities are out of range: {}.", F.size(bad), F.array_join(told, ", ")), fields, 1.0, "It may be a credit note, or a sign was misread."),
    )


def negative_amount(params: dict) -> Decision:
    me, names = "negative_amount", ("subtotal", "tax_amount", "total", "discount")
    pick = lambda condition: F.filter(F.array(*(F.when(condition(F.col(n)), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    checked, bad = pick(lambda c: c.isNotNull()), pick(lambda c: c < 0)
    return Decision(
        me,
        [
            (reduce(lambda a, n: a & F.col(n).isNull(), names, F.lit(True)), "skipped", "There are no amounts.", ("total",)),
            (~reduce(lambda a, n: a | F.coalesce(F.col(n) < 0, F.lit(False)), names, F.lit(False)), "pass", _say("None of {} amounts is negative.", reduce(lambda a, n: a + F.col(n).isNotNull().cast("int"), names, F.lit(0))), checked),
        ],
        ("fail", _say("Negative: {}.", F.array_join(bad, ", ")), bad, 1.0, "It may be a credit note."),
    )


def zero_total(params: dict) -> Decision:
    me, fields, total = "zero_total", ("total",), F.col("total")
    return Decision(
        me,
        [
            (total.isNull(), "skipped", "There is no total.", fields),
            (total == 0, "warning", "The total is zero.", fields, 1.0, "Such invoices are rare; compare with the document."),
        ],
        ("pass", _say("The total is {}.", money(total)), fields),
    )


def prompt_injection_detected(params: dict) -> Decision:
    me, flags = "prompt_injection_detected", F.coalesce(F.col("injection_flags"), F.array().cast("array<string>"))
    return Decision(
        me,
        [(F.size(flags) == 0, "pass", "No pattern of manipulation was found.")],
        ("fail", _say("Patterns of manipulation: {}.", F.array_join(flags, ", ")), ("vendor_name", "total"), 1.0, "Don't trust the values; compare them with the document."),
    )


def vendor_known(params: dict) -> Column:
    """Needs ``vendor_is_known`` from the lookup; without a directory (``directory`` false) it is skipped."""
    me, fields, vendor = "vendor_known", ("vendor_name",), F.col("vendor_name")
    if not params.get("directory", True):
        return Decision(me, [], ("skipped", "No vendor directory is set up.", fields))
    return Decision(
        me,
        [
            (falsy(vendor), "skipped", "There is no vendor.", fields),
            (F.coalesce(F.col("vendor_is_known"), F.lit(False)), "pass", _say("'{}' is a known vendor.", vendor), fields),
        ],
        ("warning", _say("'{}' isn't in the vendor directory.", vendor), fields, 1.0, "Add the vendor, or check how the name was read."),
    )


def _given(decision: Callable[[dict], Decision], retryable: bool = False) -> Rule:
    return Rule(lambda params: decision(params).result(), retryable, decision)


RULES: dict[str, Rule] = {
    "invoice_total_arithmetic": _given(invoice_total_arithmetic, True),
    "subtotal_matches_line_items": _given(subtotal_matches_line_items, True),
    "line_item_amount_consistency": _given(line_item_amount_consistency, True),
    "tax_percentage_plausible": _given(tax_percentage_plausible, True),
    "date_format_valid": _given(date_format_valid, True),
    "future_date": _given(future_date),
    "stale_date": _given(stale_date),
    "duplicate_invoice": _given(duplicate_invoice),
    "duplicate_line_items": _given(duplicate_line_items),
    "mandatory_fields": _given(mandatory_fields, True),
    "invoice_number_format": _given(invoice_number_format, True),
    "currency_valid": _given(currency_valid, True),
    "vendor_tax_id_format": _given(vendor_tax_id_format, True),
    "negative_quantity": _given(negative_quantity, True),
    "negative_amount": _given(negative_amount, True),
    "zero_total": _given(zero_total),
    "prompt_injection_detected": _given(prompt_injection_detected),
    "vendor_known": _given(vendor_known),
}


#: What rules use in several cases, by rule: from its parameters the parts by name, a name telling all that a part depends on.
SHARED: dict[str, Callable[[dict], dict[str, Callable[[], Column]]]] = {
    "subtotal_matches_line_items": _amounts,
    "line_item_amount_consistency": _lines,
    "duplicate_line_items": _twice,
    "negative_quantity": _quantities,
}


def register(rules: dict[str, Rule], rule_id: str, rule: Rule) -> dict[str, Rule]:
    """The rules and one more; an id that is taken is an error."""
    if rule_id in rules:
        raise ValueError(f"duplicate rule id: {rule_id}")
    return rules | {rule_id: rule}


def python_rule(rule_id: str, evaluate: Callable, inputs: list[str], retryable: bool = False) -> Rule:
    """A rule written in Python: ``evaluate(row dict, params)`` returns (severity, reason, fields); if it raises, the result is skipped with confidence 0."""

    def build(params: dict) -> Column:
        @F.udf(returnType=RESULT, useArrow=True)  # rows come and go in Arrow batches; each is guarded by itself
        def run(row):
            try:
                severity, reason, fields = evaluate(row if isinstance(row, dict) else row.asDict(recursive=True), params)
                return rule_id, severity, reason, 1.0, None, list(fields)
            except Exception as e:  # the rule's own fault must not stop the others
                return rule_id, "skipped", f"The rule raised {type(e).__name__}.", 0.0, None, []

        return run(F.struct(*inputs))

    return Rule(build, retryable)
