"""The registered queries in ANSI SQL (DuckDB), written from the operators' definitions."""

from __future__ import annotations

import re

from .operators.confidence import CRITICAL, WEIGHTS
from .operators.review import ACCEPTED, BLOCKED_RETRY, BUDGET, NO_REPROCESSOR, UNUSABLE
from .operators.texts import GUIDE, INJECTIONS, SPOOFS
from .sources.views import NOW, text_of

_TEXT = ("invoice_number", "invoice_date", "vendor_name", "vendor_tax_id", "currency")
_AMOUNTS = ("subtotal", "tax_amount", "discount", "total")
_RETRYABLE = (
    "currency_valid", "date_format_valid", "invoice_number_format", "invoice_total_arithmetic", "line_item_amount_consistency", "mandatory_fields",
    "negative_amount", "negative_quantity", "subtotal_matches_line_items", "tax_percentage_plausible", "vendor_tax_id_format",
)


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)


def _view(name: str) -> tuple[str, str]:
    return name, text_of(name, "ansi")


def _falsy(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


_DATES = "['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d', '%d %b %Y', '%d %B %Y', '%b %d, %Y', '%B %d, %Y']"
_PARSED = f"try_strptime(trim(invoice_date), {_DATES})"
_KNOWN = "coalesce(lower(trim(vendor_name)) IN (SELECT lower(trim(s_name)) FROM supplier), false)"
_KEYLESS = f"({_falsy('vendor_name')} OR {_falsy('invoice_number')})"
_PRIOR = "PARTITION BY lower(trim(vendor_name)), lower(trim(invoice_number)) ORDER BY received_at, seq"

INV = (
    "inv",
    f"""SELECT *, {_PARSED} AS parsed, {_KNOWN} AS known,
    CASE WHEN {_KEYLESS} THEN 0 ELSE count(*) OVER ({_PRIOR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS n_prior FROM invoices""",
)

_DAYS = f"floor((epoch_us(parsed) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0)"
_AGE = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(parsed)) / 86400000000.0)"
_FULL = "[x for x in line_items if x.quantity IS NOT NULL AND x.unit_price IS NOT NULL AND x.amount IS NOT NULL]"
_OFF = "[x for x in line_items if x.quantity IS NOT NULL AND x.unit_price IS NOT NULL AND x.amount IS NOT NULL AND abs(x.quantity * x.unit_price - x.amount) > 0.01]"
_ITEM_KEYS = "[{'d': lower(trim(coalesce(x.description, 'None'))), 'q': x.quantity, 'p': x.unit_price, 'a': x.amount} for x in line_items]"
_PCT = "(tax_amount / subtotal * 100)"
_NEAR = " OR ".join(f"abs({_PCT} - {r}) <= 0.6" for r in (0, 5, 8, 12, 18, 20, 28))
_TAX = "replace(upper(trim(vendor_tax_id)), ' ', '')"
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {_blank(f) if f != 'total' else 'total IS NULL'} THEN '{f}' END" for f in ("invoice_number", "invoice_date", "vendor_name", "total")) + "], lambda x: x IS NOT NULL)"


def _names(condition: str) -> str:
    each = ", ".join(f"CASE WHEN {n} {condition} THEN '{n}' END" for n in ("subtotal", "tax_amount", "total", "discount"))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


def _case(*pairs: tuple[str, str], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {last} END"


def _rule(cases: list[tuple[str, str, str]], last: tuple[str, str], confidence: str = "1.0") -> tuple[str, str, str]:
    """Severity, fields (a comma-joined text) and confidence."""
    quote = lambda f: f if f.startswith("(") else f"'{f}'"
    return _case(*((c, f"'{s}'") for c, s, _ in cases), last=f"'{last[0]}'"), _case(*((c, quote(f)) for c, _, f in cases), last=quote(last[1])), confidence


_UNADDED = "len([x for x in line_items if TRY_CAST(x.amount AS DECIMAL(38,4)) IS NULL]) > 0"
_ITEMLESS = ("len(line_items) = 0", "skipped", "line_items")
RULES = {
    "currency_valid": _rule(
        [(_falsy("currency"), "warning", "currency"), ("NOT regexp_matches(upper(trim(currency)), '^[A-Z]{3}$')", "fail", "currency"), ("upper(trim(currency)) NOT IN ('USD','EUR','GBP','INR','AUD','CAD','SGD','JPY')", "warning", "currency")],
        ("pass", "currency"),
    ),
    "date_format_valid": _rule([(_falsy("invoice_date"), "skipped", "invoice_date"), ("parsed IS NULL", "fail", "invoice_date")], ("pass", "invoice_date")),
    "duplicate_invoice": _rule([(_KEYLESS, "skipped", "vendor_name,invoice_number"), ("n_prior = 0", "pass", "vendor_name,invoice_number")], ("fail", "vendor_name,invoice_number")),
    "duplicate_line_items": _rule([("len(line_items) < 2", "skipped", "line_items"), (f"len(list_distinct({_ITEM_KEYS})) = len(line_items)", "pass", "line_items")], ("warning", "line_items")),
    "future_date": _rule([("parsed IS NULL", "skipped", "invoice_date"), (f"{_DAYS} > 1", "fail", "invoice_date")], ("pass", "invoice_date")),
    "invoice_number_format": _rule(
        [(_falsy("invoice_number"), "skipped", "invoice_number"), ("length(trim(invoice_number)) NOT BETWEEN 3 AND 40", "warning", "invoice_number"), (r"NOT regexp_matches(trim(invoice_number), '^[A-Za-z0-9][A-Za-z0-9\-_/.]*$')", "warning", "invoice_number")],
        ("pass", "invoice_number"),
    ),
    "invoice_total_arithmetic": _rule(
        [("subtotal IS NULL OR total IS NULL", "skipped", "subtotal,total"), ("abs(subtotal + coalesce(tax_amount, 0.0::DOUBLE) - coalesce(discount, 0.0::DOUBLE) - total) <= 0.01", "pass", "subtotal,tax_amount,discount,total")],
        ("fail", "subtotal,tax_amount,discount,total"),
    ),
    "line_item_amount_consistency": _rule([_ITEMLESS, (f"len({_FULL}) = 0", "skipped", "line_items"), (f"len({_OFF}) = 0", "pass", "line_items")], ("fail", "line_items")),
    "mandatory_fields": _rule([(f"len({_MISSING}) = 0", "pass", "invoice_number,invoice_date,vendor_name,total")], ("fail", f"(array_to_string({_MISSING}, ','))")),
    "negative_amount": _rule(
        [(f"len({_names('IS NOT NULL')}) = 0", "skipped", "total"), (f"len({_names('< 0')}) = 0", "pass", f"(array_to_string({_names('IS NOT NULL')}, ','))")],
        ("fail", f"(array_to_string({_names('< 0')}, ','))"),
    ),
    "negative_quantity": _rule([_ITEMLESS, ("len([x for x in line_items if x.quantity <= 0]) = 0", "pass", "line_items")], ("fail", "line_items")),
    "prompt_injection_detected": _rule([("len(injection_flags) = 0", "pass", "")], ("fail", "vendor_name,total")),
    "stale_date": _rule([("parsed IS NULL", "skipped", "invoice_date"), (f"{_AGE} > 365", "warning", "invoice_date")], ("pass", "invoice_date")),
    "subtotal_matches_line_items": _rule(
        [
            ("subtotal IS NULL", "skipped", "subtotal"),
            _ITEMLESS,
            ("len([x for x in line_items if x.amount IS NULL]) > 0", "warning", "line_items,subtotal"),
            (_UNADDED, "skipped", "line_items,subtotal"),
            ("abs(CAST(list_sum([TRY_CAST(x.amount AS DECIMAL(38,4)) for x in line_items]) AS DOUBLE) - subtotal) <= 0.01", "pass", "line_items,subtotal"),
        ],
        ("fail", "line_items,subtotal"),
        f"CASE WHEN subtotal IS NOT NULL AND len([x for x in line_items if x.amount IS NULL]) = 0 AND {_UNADDED} THEN 0.0 ELSE 1.0 END",
    ),
    "tax_percentage_plausible": _rule(
        [("subtotal IS NULL OR tax_amount IS NULL", "skipped", "subtotal,tax_amount"), ("subtotal <= 0", "skipped", "subtotal"), (f"{_PCT} > 30", "fail", "tax_amount,subtotal"), (_NEAR, "pass", "tax_amount,subtotal")],
        ("warning", "tax_amount,subtotal"),
        f"CASE WHEN subtotal IS NULL OR tax_amount IS NULL OR subtotal <= 0 OR {_PCT} > 30 OR {_NEAR} THEN 1.0 ELSE 0.6 END",
    ),
    "vendor_known": _rule([(_falsy("vendor_name"), "skipped", "vendor_name"), ("known", "pass", "vendor_name")], ("warning", "vendor_name")),
    "vendor_tax_id_format": _rule(
        [
            (_falsy("vendor_tax_id"), "skipped", "vendor_tax_id"),
            (f"regexp_matches({_TAX}, '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') OR regexp_matches({_TAX}, '^[A-Z]{{2}}[0-9A-Z]{{8,12}}$') OR regexp_matches({_TAX}, '^[0-9]{{2}}-[0-9]{{7}}$')", "pass", "vendor_tax_id"),
        ],
        ("warning", "vendor_tax_id"),
    ),
    "zero_total": _rule([("total IS NULL", "skipped", "total"), ("total = 0", "warning", "total")], ("pass", "total")),
}


def _long(name: str, source: str) -> tuple[str, str]:
    parts = [f"SELECT document_id, '{r}' AS rule_id, {s} AS severity, CAST({c} AS DOUBLE) AS confidence, {f} AS fields FROM {source}" for r, (s, f, c) in RULES.items()]
    return name, " UNION ALL ".join(parts)


def _sum_up(name: str, long: str) -> tuple[str, str]:
    counts = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("pass", "warning", "fail", "skipped"))
    return name, f"SELECT document_id, CASE WHEN bool_or(severity = 'fail') THEN 'fail' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'pass' END AS overall, {counts} FROM {long} GROUP BY document_id"


def _grounded(f: str) -> str:
    if f in _TEXT:
        return f"coalesce(NOT {_blank(f)} AND NOT {_falsy('source_text')} AND contains(lower(source_text), lower(trim({f}))), false)"
    forms = f"contains(lower(source_text), printf('%g', {f})) OR contains(lower(source_text), printf('%.2f', {f})) OR ({f} = floor({f}) AND contains(lower(source_text), CAST(CAST({f} AS BIGINT) AS VARCHAR)))"
    return f"coalesce({f} IS NOT NULL AND NOT {_falsy('source_text')} AND ({forms}), false)"


_VALID = {"invoice_date": f"({_PARSED} IS NOT NULL)", "currency": "coalesce(regexp_matches(upper(trim(currency)), '^[A-Z]{3}$'), false)"}
_COHERENT = "(abs(subtotal + tax_amount - coalesce(discount, 0.0::DOUBLE) - total) <= 0.01)"
_PRICED = "len([x for x in line_items if x.amount IS NOT NULL])"


def _score(f: str) -> tuple[str, str]:
    """Confidence and joined signals of a field."""
    if f == "line_items":
        return (
            f"CASE WHEN len(line_items) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.4::DOUBLE + 0.6::DOUBLE * {_PRICED} / len(line_items)), 4) END",
            f"CASE WHEN len(line_items) = 0 THEN 'absent' ELSE concat('count=', len(line_items), ',with_amount=', {_PRICED}, '/', len(line_items)) END",
        )
    absent = _blank(f) if f in _TEXT else f"{f} IS NULL"
    form, told = ("0.2::DOUBLE", "'no_format_rule(+0.20)'") if f not in _VALID else (f"CASE WHEN {_VALID[f]} THEN 0.2::DOUBLE ELSE -0.2::DOUBLE END", f"CASE WHEN {_VALID[f]} THEN 'format_valid(+0.20)' ELSE 'format_invalid(-0.20)' END")
    c = f"CASE WHEN {absent} THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN {_grounded(f)} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + ({form}))) END"
    s = f"CASE WHEN {absent} THEN 'absent' ELSE concat('present(+0.50),', CASE WHEN {_grounded(f)} THEN 'grounded_in_source(+0.30)' ELSE 'not_found_in_source(+0.00)' END, ',', {told}) END"
    if f in ("subtotal", "tax_amount", "total"):
        c = f"CASE WHEN {_COHERENT} THEN round(least(1.0::DOUBLE, ({c}) + 0.1::DOUBLE), 4) WHEN NOT {_COHERENT} THEN round(({c}) * 0.5::DOUBLE, 4) ELSE ({c}) END"
        s = f"concat({s}, CASE WHEN {_COHERENT} THEN ',arithmetic_coherent(+0.10)' WHEN NOT {_COHERENT} THEN ',arithmetic_mismatch(x0.5)' ELSE '' END)"
    return c, s


def _scores(name: str, source: str) -> tuple[str, str]:
    parts = [f"SELECT document_id, '{f}' AS field, {w}::DOUBLE AS w, {_score(f)[0]} AS confidence, {_score(f)[1]} AS signals FROM {source}" for f, w in WEIGHTS.items()]
    return name, " UNION ALL ".join(parts)


_CRIT = ", ".join(f"'{f}'" for f in CRITICAL)
_MEAN = "CAST(sum(CAST(w AS DECIMAL(10,4)) * CAST(confidence AS DECIMAL(10,6))) AS DOUBLE) / CAST(sum(CAST(w AS DECIMAL(10,4))) AS DOUBLE)"
_STRATEGY = {
    "arithmetic": f"CAST(round(CAST({_MEAN} AS DECIMAL(18,8)), 4) AS DOUBLE)",
    "geometric": "round(exp(sum(w * ln(greatest(confidence, 1e-6))) / sum(w)), 4)",
    "min_gated": f"CAST(round(CAST(least({_MEAN}, min(confidence) FILTER (field IN ({_CRIT}))) AS DECIMAL(18,8)), 4) AS DOUBLE)",
}


def _conf(name: str, scores: str, strategy: str = "min_gated") -> tuple[str, str]:
    return name, f"SELECT document_id, {_STRATEGY[strategy]} AS overall FROM {scores} GROUP BY document_id"


def _classes(name: str, long: str, scores: str) -> tuple[str, str]:
    retry = ", ".join(f"'{r}'" for r in _RETRYABLE)
    scored = ", ".join(f"'{f}'" for f in WEIGHTS)
    return name, f"""
    SELECT l.document_id, l.rule_id,
      CASE WHEN l.rule_id NOT IN ({retry}) THEN 'blocking'
           WHEN len(list_filter(string_split(l.fields, ','), lambda f: f IN ({scored}))) > 0
            AND len(list_filter(string_split(l.fields, ','), lambda f: f IN ({scored}) AND NOT list_contains(g.names, f))) = 0 THEN 'blocking'
           ELSE 'retryable' END AS class
    FROM {long} l JOIN (SELECT document_id, coalesce(list(field) FILTER (contains(signals, 'grounded_in_source')), []) AS names FROM {scores} GROUP BY document_id) g USING (document_id)
    WHERE l.severity IN ('fail', 'warning')"""


def _chain(p: str, source: str) -> list[tuple[str, str]]:
    return [_long(f"{p}long", source), _sum_up(f"{p}sums", f"{p}long"), _scores(f"{p}scores", source), _conf(f"{p}conf", f"{p}scores"), _classes(f"{p}cls", f"{p}long", f"{p}scores")]


_BASE = (_view("invoices"), INV)
_EXTREMES = (_view("invoices"), ("extremes", text_of("extremes", "ansi")), (INV[0], INV[1].replace("FROM invoices", "FROM extremes")))
_LONG = (*_BASE, _long("long", "inv"))
_SUMS = (*_LONG, _sum_up("sums", "long"))
_SCORES = (_view("invoices"), _scores("scores", "invoices"))
_ALL = (*_BASE, *_chain("", "inv"))
_NEEDS = "(c.overall < 0.7 OR s.overall <> 'pass')"
_GATED = (*_ALL, ("gated", f"SELECT s.*, c.overall AS confidence, {_NEEDS} AS needs_review FROM sums s JOIN conf c USING (document_id)"))
_PROPOSALS = ("proposals", text_of("proposals", "ansi"))


def _guard(name: str, source: str, attempt: int) -> tuple[str, str]:
    """From document_id, proposed, has_reprocessor, n_retryable and blocking (a joined text or null)."""
    made = f"coalesce(proposed, 'escalate')"
    why = _case(
        (f"{made} = 'retry' AND NOT has_reprocessor", f"'{NO_REPROCESSOR}'"),
        (f"{made} = 'retry' AND {attempt} >= 2", f"'{BUDGET} ({attempt}/2)'"),
        (f"{made} = 'retry' AND n_retryable = 0", "'" + BLOCKED_RETRY.replace("'", "''") + "'"),
        (f"{made} = 'accept' AND blocking IS NOT NULL", f"concat('{ACCEPTED}', blocking)"),
        last="NULL",
    )
    return name, f"SELECT *, CASE WHEN override_reason IS NOT NULL THEN 'escalate' ELSE {made} END AS decision, override_reason IS NOT NULL AS overridden FROM (SELECT *, {why} AS override_reason FROM {source})"


def _marked(p: str) -> tuple[str, str]:
    return f"{p}marks", f"SELECT document_id, count(*) FILTER (class = 'retryable') AS n_retryable, string_agg(rule_id, ', ' ORDER BY rule_id) FILTER (class = 'blocking') AS blocking FROM {p}cls GROUP BY document_id"


_FIRST = (
    *_GATED, _PROPOSALS, _marked(""),
    ("ask1", "SELECT p.document_id, p.proposed_1 AS proposed, p.proposed_2, p.has_reprocessor, g.needs_review, coalesce(m.n_retryable, 0) AS n_retryable, m.blocking FROM proposals p JOIN gated g USING (document_id) LEFT JOIN marks m USING (document_id)"),
    _guard("got1", "ask1", 1),
)
_AGAIN = f"SELECT * REPLACE (CASE WHEN {_falsy('vendor_name')} THEN 'Recovered Vendor' ELSE vendor_name END AS vendor_name, CASE WHEN {_falsy('vendor_name')} THEN false ELSE known END AS known) FROM inv WHERE document_id IN (SELECT document_id FROM got1 WHERE needs_review AND decision = 'retry')"
_LOOP = (
    *_FIRST, ("inv2", _AGAIN), *_chain("b", "inv2"), _marked("b"),
    ("ask2", "SELECT g.document_id, g.proposed_2 AS proposed, g.has_reprocessor, coalesce(m.n_retryable, 0) AS n_retryable, m.blocking FROM got1 g LEFT JOIN bmarks m USING (document_id) WHERE g.needs_review AND g.decision = 'retry'"),
    _guard("got2", "ask2", 2),
    ("finals", "SELECT document_id, decision, 1 AS attempts, overridden, override_reason FROM got1 WHERE needs_review AND decision <> 'retry' UNION ALL SELECT document_id, decision, 2, overridden, override_reason FROM got2"),
)
_STATUS = "CASE decision WHEN 'accept' THEN 'completed' WHEN 'reject' THEN 'rejected' ELSE 'escalated' END"

_STORES = (*_GATED, _view("documents_state"))
_FLAT = "d.document_id, d.status, d.original_filename, d.created_at, i.invoice_number, i.total, g.overall, CASE WHEN g.needs_review THEN 'escalate' END AS decision FROM {} d LEFT JOIN inv i USING (document_id) LEFT JOIN gated g USING (document_id)"

_NORMAL = r"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


def _sanitised(text: str) -> tuple[list[tuple[str, str]], str]:
    """CTEs from messy_text to the last step, and the notes."""
    steps = [("s0", rf"SELECT *, {text} AS before, regexp_replace({text}, '[^\PC\n\t]', '', 'g') AS t0 FROM messy_text")]
    notes = ["CASE WHEN t0 <> before THEN 'normalized_unicode_and_stripped_control_chars' END"]
    for i, p in enumerate(SPOOFS):
        steps.append((f"s{i + 1}", f"SELECT *, regexp_replace(t{i}, '(?i){p}', '[removed-delimiter]', 'g') AS t{i + 1} FROM s{i}"))
        notes.append(f"CASE WHEN regexp_matches(t{i}, '(?i){p}') THEN 'neutralized_delimiter_spoof' END")
    return steps, f"array_to_string(list_filter([{', '.join(notes)}], lambda x: x IS NOT NULL), ',')"


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t3, '(?i{'m' if p.startswith('^') else ''}){p}') THEN '{label}' END" for label, p in INJECTIONS) + "], lambda x: x IS NOT NULL)"
_SCANNED = (_view("messy_text"), *_sanitised(_NORMAL)[0], ("flagged", f"SELECT doc_id, source, {_FLAGS} AS flags FROM s3"))

_PAGES = (
    _view("page_text"),
    ("rolled", "SELECT doc_id, method, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text, sum(length(text)) AS total_chars, count(*) AS page_count FROM page_text GROUP BY doc_id, method"),
)


def _fenced(c: str) -> str:
    t = f"trim({c}, E' \\n\\t\\r')"
    inside = f"regexp_replace(split_part(substr({t}, 4), '```', 1), '^json', '')"
    return f"trim(CASE WHEN starts_with({t}, '```') THEN {inside} ELSE {t} END, E' \\n\\t\\r`')"


def _usable(c: str) -> str:
    return f"(json_valid({_fenced(c)}) AND starts_with({_fenced(c)}, '{{'))"


def _typed(names: list[str]) -> tuple[tuple[str, str], ...]:
    text = _case(*((_usable(c), _fenced(c)) for c in names), last="NULL")
    number = _case(*((_usable(c), str(i + 1)) for i, c in enumerate(names)), last=str(len(names)))
    kind = lambda f: f"json_type(j, '$.{f}')"
    text_of_ = lambda f: f"CASE WHEN {kind(f)} = 'VARCHAR' THEN json_extract_string(j, '$.{f}') END"
    return (
        _view("invoices"), ("responses", text_of("responses", "ansi")), ("picked", f"SELECT document_id, {text} AS j, {number} AS parse_attempts FROM responses"),
        ("typed", f"""SELECT document_id, {text_of_('invoice_number')} AS invoice_number, {text_of_('currency')} AS currency, TRY_CAST(json_extract_string(j, '$.total') AS DOUBLE) AS total, parse_attempts,
            CASE WHEN j IS NULL THEN 'no JSON object in any answer' WHEN coalesce({kind('total')}, 'NULL') <> 'NULL' AND TRY_CAST(json_extract_string(j, '$.total') AS DOUBLE) IS NULL THEN 'ValidationError: 1 field(s)' END AS parse_error FROM picked"""),
    )


def _xml(c: str) -> str:
    out = f"CAST({c} AS VARCHAR)"
    for mark, name in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&quot;"), ("chr(13)", "&#13;"), ("chr(10)", "&#10;")):
        out = f"replace({out}, {mark}, '{name}')"
    return f"coalesce({out}, '')"


def _tag(name: str, value: str) -> str:
    return f"'<{name}>' || {value} || '</{name}>'"


_XML_ITEM = _tag("lineItem", " || ".join(_tag(f, _xml(f"x.{f}")) for f in ("description", "quantity", "unit_price", "amount")))
_XML = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<invoice documentId="' || """ + _xml("document_id") + """ || '">' || """ + " || ".join(_tag(f, _xml(f)) for f in (*_TEXT, *_AMOUNTS)) + " || " + _tag("lineItems", f"array_to_string([{_XML_ITEM} for x in line_items], '')") + " || '</invoice>'"

_ANSWERS = (
    _view("invoices"), ("answers", text_of("answers", "ansi")), ("cleaned", f"SELECT document_id, {_fenced('answer')} AS t FROM answers"),
    ("read", "SELECT document_id, CASE WHEN starts_with(t, '{') AND json_valid(t) THEN t END AS j FROM cleaned"),
    ("kept", """SELECT *, coalesce(json_type(j, '$.decision') = 'VARCHAR' AND json_extract_string(j, '$.decision') IN ('accept', 'retry', 'escalate', 'reject') AND json_type(j, '$.reasoning') = 'VARCHAR'
        AND coalesce(json_type(j, '$.retry_hint'), 'NULL') IN ('VARCHAR', 'NULL') AND coalesce(json_type(j, '$.suspicious_fields'), 'NULL') IN ('ARRAY', 'NULL'), false) AS good FROM read"""),
)

_MEDIA = "(VALUES ('csv', 'text/csv', '.csv'), ('json', 'application/json', '.json'), ('xlsx', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', '.xlsx'), ('xml', 'application/xml', '.xml')) f(format, media_type, extension)"
_SNIFF = "CASE WHEN starts_with(hex(content), '255044462D') THEN 'application/pdf' WHEN starts_with(hex(content), '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(hex(content), 'FFD8FF') THEN 'image/jpeg' END"
_FILES = (_view("files"), ("sniffed", f"SELECT CAST(page_id AS VARCHAR) AS document_id, original_filename, octet_length(content) AS size_bytes, sha256(content) AS sum, {_SNIFF} AS content_type FROM files"))
_HEADER = ", ".join((*_TEXT, *_AMOUNTS))
_DAY = "time_bucket(INTERVAL '1 day', ts)"
_DOC_STATE = (_view("documents_state"),)


#: The flow of the documents: pages, texts, recorded answers, checks, and the review with a second reading.
_ITEM = "[{'description': 'goods', 'quantity': 1.0::DOUBLE, 'unit_price': subtotal, 'amount': subtotal}]"
_UNREAD = "d.seq % 20 = 0"  # neither answer of the first reading can be parsed


def _record(name: str, docs: str, unread: str) -> tuple[str, str]:
    fields = ", ".join(f"CASE WHEN {unread} THEN NULL ELSE i.{f} END AS {f}" for f in (*_TEXT, *_AMOUNTS))
    return name, f"SELECT *, CASE WHEN empty THEN [] ELSE {_ITEM} END AS line_items FROM (SELECT d.document_id, d.seq, d.received_at, d.source_text, d.injection_flags, {unread} AS empty, {fields} FROM {docs} d LEFT JOIN invoices i ON i.document_id = d.document_id)"


_FLOW = (
    _view("invoices"), _view("page_text"), _view("doc_pages"), _view("documents_state"),
    ("rolled", "SELECT document_id, method, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text, sum(length(text)) AS total_chars, count(*) AS page_count FROM doc_pages GROUP BY document_id, method"),
    ("d", "SELECT document_id, CAST(document_id AS BIGINT) AS seq, created_at AS received_at FROM documents_state"),
    ("messy_text", """SELECT d.*, d.document_id AS doc_id, CASE WHEN d.seq % 6 > 1 AND coalesce(n.total_chars / n.page_count >= 50, false) THEN 'native' ELSE 'ocr' END AS method,
        coalesce(CASE WHEN d.seq % 6 > 1 AND coalesce(n.total_chars / n.page_count >= 50, false) THEN n.full_text ELSE o.full_text END, '') AS text
        FROM d LEFT JOIN rolled n ON n.document_id = d.document_id AND n.method = 'native' LEFT JOIN rolled o ON o.document_id = d.document_id AND o.method = 'ocr'"""),
    *_sanitised(_NORMAL)[0],
    ("texts", f"SELECT document_id, seq, received_at, method, t3 AS source_text, {_FLAGS} AS injection_flags FROM s3 WHERE t3 <> ''"),
    ("asked", "SELECT * FROM texts WHERE seq % 31 <> 0"),
    _record("docinv", "asked", _UNREAD), (INV[0], INV[1].replace("FROM invoices", "FROM docinv")), *_chain("", "inv"),
    ("gated", f"SELECT s.*, c.overall AS confidence, {_NEEDS} AS needs_review FROM sums s JOIN conf c USING (document_id)"), _marked(""),
    ("ask1", """SELECT d.document_id, d.seq, CASE d.seq % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'retry' WHEN 2 THEN 'escalate' WHEN 3 THEN 'reject' END AS proposed, true AS has_reprocessor, coalesce(m.n_retryable, 0) AS n_retryable, m.blocking
        FROM asked d JOIN gated g USING (document_id) LEFT JOIN marks m USING (document_id) WHERE g.needs_review"""),
    _guard("got1", "ask1", 1),
    _record("reread", "(SELECT * FROM asked WHERE document_id IN (SELECT document_id FROM got1 WHERE decision = 'retry'))", "false"),
    ("inv2", f"SELECT r.*, {_PARSED.replace('invoice_date', 'r.invoice_date')} AS parsed, {_KNOWN.replace('vendor_name', 'r.vendor_name')} AS known, f.n_prior FROM reread r JOIN inv f USING (document_id)"), *_chain("b", "inv2"), _marked("b"),
    ("ask2", "SELECT g.document_id, CASE g.seq % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'retry' ELSE 'escalate' END AS proposed, g.has_reprocessor, coalesce(m.n_retryable, 0) AS n_retryable, m.blocking FROM got1 g LEFT JOIN bmarks m USING (document_id) WHERE g.decision = 'retry'"),
    _guard("got2", "ask2", 2),
    ("finals", "SELECT document_id, decision FROM got1 WHERE decision <> 'retry' UNION ALL SELECT document_id, decision FROM got2"),
    ("bgated", f"SELECT s.*, c.overall AS confidence, {_NEEDS} AS needs_review FROM bsums s JOIN bconf c USING (document_id)"),
)


def oracle_sql() -> dict[str, str]:
    q = {
        "ingest_sniff": _with(*_FILES) + " SELECT document_id, 'uploaded' AS status, 'rest_upload' AS source_channel, original_filename, content_type, size_bytes, sum || CASE content_type WHEN 'application/pdf' THEN '.pdf' WHEN 'image/png' THEN '.png' ELSE '.jpg' END AS storage_key, sum AS checksum_sha256 FROM sniffed WHERE size_bytes <= 2000 AND content_type IS NOT NULL",
        "ingest_reject": _with(*_FILES) + " SELECT document_id, original_filename, size_bytes, CASE WHEN size_bytes > 2000 THEN 'too_large' ELSE 'unsupported_type' END AS reject_reason FROM sniffed WHERE size_bytes > 2000 OR content_type IS NULL",
        "page_rollup": _with(*_PAGES) + " SELECT *, total_chars / page_count >= 50 AS sufficient FROM rolled",
        "text_route": _with(*_PAGES, ("d", "SELECT DISTINCT doc_id, content_type FROM page_text"), ("n", "SELECT * FROM rolled WHERE method = 'native'"), ("o", "SELECT * FROM rolled WHERE method = 'ocr'"),
            ("r", "SELECT d.doc_id, d.content_type, n.total_chars AS nc, n.page_count AS np, NOT d.content_type IN ('image/png', 'image/jpeg') AND coalesce(n.total_chars / n.page_count >= 50, false) AS native, n.full_text AS nt, o.full_text AS ot, o.total_chars AS oc, o.page_count AS op FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)"))
            + " SELECT doc_id, CASE WHEN native THEN 'native' ELSE 'ocr' END AS method, coalesce(CASE WHEN native THEN nt ELSE ot END, '') AS full_text, coalesce(CASE WHEN native THEN nc ELSE oc END, 0) AS total_chars, coalesce(CASE WHEN native THEN np ELSE op END, 0) AS page_count, CASE WHEN content_type IN ('image/png', 'image/jpeg') THEN 'input is an image without a text layer' WHEN NOT native THEN concat('native text has ', coalesce(nc, 0), ' chars on ', coalesce(np, 0), ' page(s), under 50 a page') END AS ocr_reason FROM r",
        "text_normalize": _with(_view("messy_text")) + f" SELECT doc_id, {_NORMAL} AS text FROM messy_text",
        "text_sanitize": _with(_view("messy_text"), *_sanitised("text")[0]) + f" SELECT doc_id, t3 AS clean_text, {_sanitised('text')[1]} AS notes FROM s3",
        "injection_scan": _with(*_SCANNED) + " SELECT doc_id, array_to_string(flags, ',') AS flags FROM flagged",
        "injection_by_source": _with(*_SCANNED) + " SELECT source, flag, count(*) AS n FROM (SELECT source, unnest(flags) AS flag FROM flagged) GROUP BY source, flag",
        "prompt_build": _with(_view("messy_text")) + " SELECT doc_id, sha256(concat('" + GUIDE.replace("'", "''") + "\n\nFill them in from this document.\n\n=== DOCUMENT TEXT START ===\n', " + _NORMAL + ", '\n=== DOCUMENT TEXT END ===\n', CASE WHEN doc_id % 5 = 1 THEN '\n=== REVIEW GUIDANCE ===\nvendor is at the top\n' ELSE '' END)) AS prompt_sha256 FROM messy_text",
        "extract_parse": _with(*_typed(["response_1"])) + " SELECT document_id, invoice_number, currency, total, 0 AS n_items FROM typed",
        "extract_salvage": _with(*_typed(["response_1"])) + " SELECT document_id, invoice_number, currency, total, parse_error FROM typed WHERE parse_error IS NOT NULL",
        "extract_attempts": _with(*_typed(["response_1", "response_2"])) + " SELECT document_id, invoice_number, currency, total, parse_attempts, parse_error FROM typed",
        "presence": _with(_view("invoices")) + f" SELECT document_id, NOT {_blank('invoice_number')} AS invoice_number, NOT {_blank('vendor_name')} AS vendor_name, total IS NOT NULL AS total, len(line_items) > 0 AS line_items FROM invoices",
        "grounding": _with(_view("invoices")) + " SELECT document_id, " + ", ".join(f"{_grounded(f)} AS {f}" for f in ("invoice_number", "invoice_date", "vendor_name", "currency", "subtotal", "tax_amount", "total")) + " FROM invoices",
        "date_parse": _with(_view("invoices")) + f" SELECT document_id, CAST(CAST({_PARSED} AS DATE) AS VARCHAR) AS parsed FROM invoices",
        "currency_shape": _with(_view("invoices")) + f" SELECT document_id, {_VALID['currency']} AS is_iso FROM invoices",
        "field_scores": _with(*_SCORES) + " SELECT document_id, field, round(confidence, 4) AS confidence, signals FROM scores",
        "line_item_score": _with(_view("invoices")) + f" SELECT document_id, {_score('line_items')[0]} AS confidence FROM invoices",
        "coherence": _with(_view("invoices")) + f" SELECT document_id, CASE WHEN {_COHERENT} THEN 'yes' WHEN NOT {_COHERENT} THEN 'no' ELSE 'unknown' END AS coherent FROM invoices",
        "conf_by_strategy": _with(*_SCORES, *(_conf(f"c{i}", "scores", s) for i, s in enumerate(_STRATEGY)))
            + " SELECT strategy, count(*) AS n, count(*) FILTER (overall < 0.7) AS n_low, max(overall) AS highest FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS strategy, overall FROM c{i}" for i, s in enumerate(_STRATEGY)) + ") GROUP BY strategy",
        "conf_report": _with(*_SCORES, _conf("c", "scores")) + " SELECT document_id, 'min_gated' AS strategy, overall, 8 AS n_fields, 'invoice_number,total,vendor_name' AS critical_fields FROM c",
        "validation_report": _with(*_SUMS) + " SELECT * FROM sums",
        "validation_counts": _with(*_SUMS) + ' SELECT document_id, n_pass AS "pass", n_warning AS warning, n_fail AS fail, n_skipped AS skipped FROM sums',
        "validation_long": _with(*_LONG) + " SELECT * FROM long",
        "validation_extremes": _with(*_EXTREMES, _long("long", "inv")) + " SELECT *, true AS reasoned FROM long",
        "score_extremes": _with(*_EXTREMES) + " SELECT document_id, field, v IS NOT NULL AS sure, v IS NOT NULL AS valued FROM (" + " UNION ALL ".join(f"SELECT document_id, '{f}' AS field, {f} AS v FROM inv" for f in ("subtotal", "tax_amount", "total")) + ")",
        "validation_failures": _with(*_LONG) + " SELECT document_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (severity = 'fail'), '') AS failures FROM long GROUP BY document_id",
        "custom_rule": _with(_view("invoices"), ("long", "SELECT document_id, CASE WHEN len(line_items) <= 5 THEN 'pass' ELSE 'warning' END AS severity FROM invoices UNION ALL SELECT document_id, " + RULES["zero_total"][0] + " FROM invoices"), _sum_up("sums", "long")) + " SELECT * FROM sums",
        "rule_isolation": _with(*_SUMS) + " SELECT document_id, overall, n_pass, n_warning, n_fail, n_skipped + 1 AS n_skipped FROM sums",
        "duplicates_prior": _with(*_BASE, ("k", f"SELECT document_id, received_at, seq, CASE WHEN {_KEYLESS} THEN document_id || '!' ELSE lower(trim(vendor_name)) END AS v, CASE WHEN {_KEYLESS} THEN document_id ELSE lower(trim(invoice_number)) END AS n FROM inv"), ("r", "SELECT *, row_number() OVER w AS rn, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM k WINDOW w AS (PARTITION BY v, n ORDER BY received_at, seq)"))
            + " SELECT r.document_id, r.c AS duplicate_count, coalesce((SELECT string_agg(o.document_id, ',' ORDER BY o.rn) FROM r o WHERE o.v = r.v AND o.n = r.n AND o.rn <= 3 AND o.rn < r.rn), '') AS duplicate_ids FROM r",
        "duplicates_any": _with(*_BASE, ("k", f"SELECT document_id, received_at, seq, CASE WHEN {_KEYLESS} THEN document_id || '!' ELSE lower(trim(vendor_name)) END AS v, CASE WHEN {_KEYLESS} THEN document_id ELSE lower(trim(invoice_number)) END AS n FROM inv"), ("r", "SELECT *, row_number() OVER (PARTITION BY v, n ORDER BY received_at, seq) AS rn, count(*) OVER (PARTITION BY v, n) - 1 AS c FROM k"))
            + " SELECT r.document_id, r.c AS duplicate_count, coalesce((SELECT array_to_string(list_slice(list(o.document_id ORDER BY o.rn), 1, 3), ',') FROM r o WHERE o.v = r.v AND o.n = r.n AND o.rn <> r.rn), '') AS duplicate_ids FROM r",
        "vendor_semi": _with(*_BASE) + " SELECT document_id, vendor_name FROM inv WHERE known",
        "vendor_anti": _with(*_BASE) + " SELECT document_id, vendor_name FROM inv WHERE NOT known",
        "review_gate": _with(*_GATED) + " SELECT document_id, confidence, overall, needs_review FROM gated",
        "failure_classes": _with(*_ALL) + " SELECT document_id, rule_id, class FROM cls",
        "no_data_signal": _with(*_SCORES) + " SELECT document_id, max(confidence) = 0 AS no_data FROM scores GROUP BY document_id",
        "review_evidence": _with(*_ALL) + " SELECT d.document_id, 8 AS n_scores, count(c.rule_id) AS n_results, count(c.rule_id) FILTER (c.class = 'blocking') AS n_blocking, count(c.rule_id) FILTER (c.class = 'retryable') AS n_retryable FROM inv d LEFT JOIN cls c USING (document_id) GROUP BY d.document_id",
        "guardrails": _with(*_FIRST) + " SELECT document_id, decision, overridden, override_reason FROM got1",
        "review_loop": _with(*_LOOP) + " SELECT * FROM finals",
        "review_history": _with(*_LOOP) + " SELECT document_id, 1 AS attempt, coalesce(proposed, 'escalate') AS proposed, decision AS final, overridden FROM got1 WHERE needs_review UNION ALL SELECT document_id, 2, coalesce(proposed, 'escalate'), decision, overridden FROM got2",
        "final_status": _with(*_LOOP) + f" SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM finals UNION ALL SELECT 'completed' FROM gated WHERE NOT needs_review) GROUP BY status",
        "resume_guard": _with(*_DOC_STATE) + " SELECT document_id, status FROM documents_state WHERE status NOT IN ('completed', 'escalated', 'rejected')",
        "upsert_latest": _with(*_DOC_STATE) + " SELECT document_id, CASE WHEN CAST(document_id AS BIGINT) % 3 = 0 THEN 'completed' ELSE status END AS status, created_at + CASE WHEN CAST(document_id AS BIGINT) % 3 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END AS run_at FROM documents_state",
        "mark_failed": _with(*_DOC_STATE) + " SELECT document_id, status, 'rest' AS source, failure_reason FROM documents_state",
        "verify": _with(*_GATED) + " SELECT document_id, overall, confidence, needs_review, CASE WHEN needs_review THEN 'review' ELSE 'completed' END AS status, n_fail, n_warning FROM gated",
        "stream_verify": _with(*_GATED) + " SELECT document_id, overall, confidence, needs_review, CASE WHEN needs_review THEN 'review' ELSE 'completed' END AS status FROM gated",
        "process_documents": _with(*_FLOW) + f""" SELECT d.document_id, CASE WHEN t.document_id IS NULL OR a.document_id IS NULL THEN 'failed' WHEN f.decision IS NULL THEN 'completed' ELSE {_STATUS} END AS status,
            CASE WHEN t.document_id IS NULL THEN 'the document has no text' WHEN a.document_id IS NULL THEN 'TimeoutError: no answer' END AS failure_reason, t.method,
            CASE WHEN b.document_id IS NULL THEN i.vendor_name ELSE r.vendor_name END AS vendor_name, CASE WHEN b.document_id IS NULL THEN i.total ELSE r.total END AS total, CASE WHEN i.document_id IS NULL THEN NULL WHEN b.document_id IS NULL THEN 1 ELSE 2 END AS attempt,
            coalesce(b.confidence, g.confidence) AS confidence, coalesce(b.overall, g.overall) AS validation, f.decision
            FROM d LEFT JOIN texts t USING (document_id) LEFT JOIN asked a USING (document_id) LEFT JOIN inv i USING (document_id) LEFT JOIN gated g USING (document_id) LEFT JOIN bgated b USING (document_id) LEFT JOIN inv2 r USING (document_id) LEFT JOIN finals f USING (document_id)""",
        "reading_history": _with(*_FLOW) + """ SELECT g.document_id, 1 AS attempt, i.invoice_number, CASE WHEN i.empty THEN 'no JSON object in any answer' END AS parse_error, g.overall, g.needs_review FROM gated g JOIN inv i USING (document_id)
            UNION ALL SELECT g.document_id, 2, i.invoice_number, NULL, g.overall, g.needs_review FROM bgated g JOIN inv2 i USING (document_id)""",
        "rate_window": f"SELECT user_id, {_DAY} AS window_start, count(*) AS n, count(*) > 4 AS over_limit FROM events GROUP BY user_id, {_DAY}",
        "stream_rate": f"SELECT user_id, {_DAY} AS window_start, count(*) AS n, count(*) > 4 AS over_limit FROM events GROUP BY user_id, {_DAY}",
        "stream_rejected": f"SELECT event_id, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS n FROM events) WHERE n > 4",
        "rate_rejected": f"SELECT event_id, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS n FROM events) WHERE n > 4",
        "doc_list": _with(*_STORES, ("chosen", "SELECT * FROM documents_state WHERE status = 'completed' ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 3")) + " SELECT " + _FLAT.format("chosen"),
        "doc_seek": _with(*_DOC_STATE) + " SELECT document_id, status, created_at FROM documents_state WHERE status = 'completed' ORDER BY created_at DESC, document_id LIMIT 7 OFFSET 14",
        "ingest_files": "WITH f AS (SELECT page_id % 7 AS part, CAST(sum(octet_length(encode(coalesce(html, ''))) + 1) AS BIGINT) AS size_bytes FROM pages WHERE page_id % 7 < 5 GROUP BY ALL), m AS (SELECT list_sort(list(size_bytes))[3] AS most FROM f) SELECT part, size_bytes, CASE WHEN size_bytes > most THEN 'too_large' ELSE 'unsupported_type' END AS reject_reason, size_bytes > most AS unread FROM f, m",
        "doc_detail": _with(*_STORES) + " SELECT " + _FLAT.format("documents_state"),
        "doc_count": _with(*_DOC_STATE) + " SELECT count(*) AS total FROM documents_state WHERE status = 'completed'",
        "review_queue": _with(*_DOC_STATE) + " SELECT document_id, status FROM documents_state WHERE status = 'escalated' ORDER BY created_at DESC, document_id LIMIT 15",
        "confidence_band": _with(*_SCORES, _conf("c", "scores")) + " SELECT CASE WHEN overall >= 0.7 THEN 'green' WHEN overall >= 0.4 THEN 'amber' ELSE 'red' END AS band, CAST(CAST(round(overall * 100) AS INT) AS VARCHAR) AS percent, count(*) AS n FROM c GROUP BY ALL",
        "export_csv": _with(_view("invoices")) + f" SELECT document_id, {_HEADER}, x.description AS line_description, x.quantity AS line_quantity, x.unit_price AS line_unit_price, x.amount AS line_amount FROM (SELECT *, unnest(CASE WHEN len(line_items) = 0 THEN [NULL] ELSE line_items END) AS x FROM invoices)",
        "export_json": _with(_view("invoices")) + " SELECT document_id, invoice_number, total, line_items[1].amount AS first_amount, discount IS NULL AS null_discount FROM invoices",
        "export_xml": _with(_view("invoices")) + f" SELECT document_id, {_XML} AS xml FROM invoices",
        "proposal_parse": _with(*_ANSWERS) + f" SELECT document_id, CASE WHEN good THEN json_extract_string(j, '$.decision') END AS proposed, CASE WHEN good THEN json_extract_string(j, '$.reasoning') ELSE '{UNUSABLE.replace(chr(39), chr(39) * 2)}' END AS reasoning, CASE WHEN good THEN coalesce(array_to_string(CAST(json_extract(j, '$.suspicious_fields') AS VARCHAR[]), ','), '') END AS suspicious_fields, CASE WHEN good THEN json_extract_string(j, '$.retry_hint') END AS retry_hint FROM kept",
        "latest_records": _with(*_LOOP) + " SELECT b.document_id, i.vendor_name, b.overall FROM bsums b JOIN inv2 i USING (document_id) UNION ALL SELECT s.document_id, i.vendor_name, s.overall FROM sums s JOIN inv i USING (document_id) WHERE s.document_id NOT IN (SELECT document_id FROM inv2)",
        "batch_infer": _with(("t", f"SELECT doc_id, coalesce({_NORMAL}, '') AS t FROM documents")) + " SELECT CAST(doc_id AS VARCHAR) AS document_id, trim(substr(t, 1, 20), E' \\n') AS vendor_name, CAST(length(t) AS DOUBLE) AS total, CASE WHEN length(t) % 3 = 0 THEN 2 ELSE 1 END AS parse_attempts, CAST(NULL AS VARCHAR) AS parse_error FROM t",
        "source_files": "SELECT sum(octet_length(encode(coalesce(html, ''))) + 1) AS total_bytes, sum(octet_length(encode(coalesce(html, ''))) + 1) AS read_bytes FROM pages",
        "source_vendors": "SELECT trim(s_name) AS vendor_name FROM supplier WHERE s_suppkey % 7 <> 0",
        "source_table": "SELECT doc_id, source FROM documents WHERE lang = 'en'",
        "doc_lookup": _with(*_DOC_STATE) + " SELECT document_id, status, original_filename FROM documents_state WHERE document_id = '7'",
        "export_field_value": _with(_view("invoices")) + " SELECT document_id, field, value FROM (" + " UNION ALL ".join(f"SELECT document_id, '{f}' AS field, {f if f in _TEXT else f'CAST(CAST({f} AS DECIMAL(38,2)) AS VARCHAR)'} AS value FROM invoices" for f in (*_TEXT, *_AMOUNTS)) + ")",
        "export_line_items": _with(_view("invoices")) + " SELECT document_id, line_number, x.description, x.quantity, x.unit_price, x.amount FROM (SELECT document_id, unnest(line_items) AS x, unnest(range(1, len(line_items) + 1)) AS line_number FROM invoices)",
        "export_evidence": _with(*_SCORES) + " SELECT document_id, field, round(confidence, 4) AS confidence, replace(signals, ',', '; ') AS signals FROM scores",
        "export_name": _with(*_DOC_STATE) + r" SELECT document_id, coalesce(nullif(regexp_replace(original_filename, '\.[^.]*$', ''), ''), document_id) || '.csv' AS name FROM documents_state",
        "export_requests": _with(_view("invoices"), ("asked", "SELECT document_id, CASE seq % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'xml' WHEN 3 THEN 'xlsx' ELSE 'docx' END AS format FROM invoices")) + f" SELECT document_id, asked.format, media_type, extension FROM asked LEFT JOIN {_MEDIA} USING (format)",
        "export_files": _with(_view("invoices"), ("asked", "SELECT *, CASE seq % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'xml' WHEN 3 THEN 'xlsx' ELSE 'docx' END AS format FROM invoices"),
            ("n", f"SELECT document_id, format, 'inv.' || (seq % 900) AS stem, CASE WHEN format = 'xml' THEN octet_length(encode({_XML})) END AS bytes, min(document_id) OVER (PARTITION BY seq % 900, format) AS first FROM asked"))
            + " SELECT CASE WHEN format IN ('docx', 'xlsx') THEN document_id WHEN document_id = first THEN stem || '.' || format ELSE stem || '-' || document_id || '.' || format END AS name, bytes, CASE format WHEN 'docx' THEN 'unknown format: docx' WHEN 'xlsx' THEN 'a workbook isn''t one text' END AS reason FROM n",
        "export_context": _with(*_GATED) + " SELECT g.document_id, i.total, g.overall, CASE WHEN needs_review THEN 'escalate' END AS decision, CASE WHEN needs_review THEN 'gate' END AS reasoning FROM gated g JOIN inv i USING (document_id)",
    }
    own = {"zero_total": None, "stale_date": "fail", "tax_percentage_plausible": "warning"}
    moved = " ".join(f"WHEN rule_id = '{r}' AND severity IN ('fail', 'warning') THEN '{s}'" for r, s in own.items() if s)
    q["policy_effects"] = q["severity_override"] = _with(*_LONG_DEFAULT) + f" SELECT rule_id, severity, count(*) AS n FROM (SELECT rule_id, CASE {moved} ELSE severity END AS severity FROM long WHERE rule_id <> 'zero_total') GROUP BY ALL"
    for rule_id, (severity, fields, sure) in RULES.items():
        q[f"rule_{rule_id}"] = _with(*_BASE) + f" SELECT document_id, {severity} AS severity, CAST({sure} AS DOUBLE) AS confidence, {fields} AS fields FROM inv"
    for s in _STRATEGY:
        q[f"conf_{s}"] = _with(*_SCORES, _conf("c", "scores", s)) + " SELECT document_id, overall FROM c"
    return {k: re.sub(r"[ ]+\n", "\n", v) for k, v in q.items()}


#: Without a policy any three-letter currency passes.
_LONG_DEFAULT = (*_BASE, ("with_policy", _long("long", "inv")[1]), ("long", "SELECT w.document_id, w.rule_id, CASE WHEN w.rule_id = 'currency_valid' AND w.severity = 'warning' AND i.currency <> '' THEN 'pass' ELSE w.severity END AS severity FROM with_policy w JOIN inv i USING (document_id)"))
