"""From page texts to clean text: roll-up, routing, normalising, sanitising, scanning, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shape import settled

LEAST_PER_PAGE = 50

# The characters that end a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Markers that imitate the prompt's frame.
SPOOFS = (
    r"={2,}\s*document\s+text\s+(start|end)\s*={2,}",
    r"={2,}\s*(system|user|assistant|instruction)s?\s*={2,}",
    r"```+\s*(system|instruction)",
)
REMOVED = "[removed-delimiter]"

# The patterns of manipulation and their labels, in the order of report.
INJECTIONS = (
    ("override_instruction", r"ignore\s+(all\s+)?(previous|above|prior|earlier)\s+(instructions?|prompts?|context)"),
    ("disregard_instruction", r"disregard\s+(the\s+)?(above|previous|prior|system)"),
    ("forget_instruction", r"forget\s+(everything|all|your\s+instructions?)"),
    ("role_reassignment", r"you\s+are\s+now\s+(a|an)\b"),
    ("new_instruction", r"new\s+(instructions?|rules?|task)\s*:"),
    ("role_marker", r"^\s*(system|assistant|user)\s*:"),
    ("field_override_command", r"\bset\s+\w+\s+to\s+"),
    ("prompt_reference", r"(system\s+prompt|your\s+instructions?|the\s+prompt)"),
)

GUIDE = """Fields to fill in:
- invoice_number: what the document calls its invoice number.
- invoice_date: the date of issue, as it is written.
- vendor_name: the company that issues the invoice, not the customer.
- vendor_tax_id: the issuing company's tax registration number.
- currency: a three-letter code; turn symbols into codes.
- subtotal: the amount before tax and discount.
- tax_amount: the amount of tax, not its rate.
- discount: the whole discount, as a positive number.
- total: the amount to pay.
- line_items: one entry for each row of the invoice's table."""


def rollup(pages: DataFrame, keys: list[str], page: str = "page_number", text: str = "text") -> DataFrame:
    """Per key ``full_text`` (pages in order, a blank line between), ``total_chars`` and ``page_count``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("full_text"),
        F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("total_chars"),
        F.count("*").alias("page_count"),
    )


def sufficient(least: int = LEAST_PER_PAGE) -> Column:
    return F.coalesce((F.col("page_count") > 0) & (F.col("total_chars") / F.col("page_count") >= least), F.lit(False))


def route(documents: DataFrame, native: DataFrame, ocr: DataFrame, id_col: str, least: int = LEAST_PER_PAGE) -> DataFrame:
    """The text of each document: images and sparse native texts by OCR, with the reason; else native.

    ``documents`` has id and content_type; the others are roll-ups with the id.
    """
    n = native.select(id_col, F.col("full_text").alias("n_text"), F.col("total_chars").alias("n_chars"), F.col("page_count").alias("n_pages"))
    o = ocr.select(id_col, F.col("full_text").alias("o_text"), F.col("total_chars").alias("o_chars"), F.col("page_count").alias("o_pages"))
    image = F.col("content_type").isin("image/png", "image/jpeg")
    chars, pages = F.coalesce("n_chars", F.lit(0)), F.coalesce("n_pages", F.lit(0))
    enough = (pages > 0) & (chars / F.when(pages > 0, pages) >= least)
    sparse = F.concat(F.lit("native text has "), chars, F.lit(" chars on "), pages, F.lit(f" page(s), under {least} a page"))
    by_native = ~image & F.coalesce(enough, F.lit(False))
    pick = lambda a, b: F.when(by_native, F.col(a)).otherwise(F.col(b))
    joined = documents.select(id_col, "content_type").join(n, id_col, "left").join(o, id_col, "left")
    return joined.select(
        id_col, F.when(by_native, "native").otherwise("ocr").alias("method"), F.coalesce(pick("n_text", "o_text"), F.lit("")).alias("full_text"),
        F.coalesce(pick("n_chars", "o_chars"), F.lit(0)).alias("total_chars"), F.coalesce(pick("n_pages", "o_pages"), F.lit(0)).alias("page_count"),
        F.when(image, "input is an image without a text layer").when(~by_native, sparse).alias("ocr_reason"),
    )


def normalise(text: Column) -> Column:
    """Lines with white space collapsed; empty ones go."""
    lines = F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def compose(text: Column) -> Column:
    """Unicode's compatibility composition; Spark has no function for it. ASCII texts come back as they are."""
    import pandas as pd

    def nfkc(texts):
        import unicodedata

        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    nfkc.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(nfkc, "string")(text)


def sanitise(df: DataFrame, text: str = "text", composed: bool = True) -> DataFrame:
    """Add ``clean_text`` and ``notes``: composed, without control characters, with imitated frames removed."""
    plain = F.regexp_replace(compose(F.col(text)) if composed else F.col(text), r"[\p{C}&&[^\n\t]]", "")
    out, notes = settled(df.withColumn("clean_text", plain), "clean_text"), [F.when(F.col("_plain") != F.col(text), F.lit("normalized_unicode_and_stripped_control_chars"))]
    out = settled(out.withColumn("_plain", F.col("clean_text")), "_plain")
    step = F.col("_plain")
    for p in SPOOFS:
        pattern = f"(?iU){p}"
        notes.append(F.when(step.rlike(pattern), F.lit("neutralized_delimiter_spoof")))
        step = F.regexp_replace(step, pattern, F.lit(REMOVED))
    out = out.withColumn("clean_text", step)
    return out.withColumn("notes", F.filter(F.array(*notes), lambda x: x.isNotNull())).drop("_plain")


def scan(text: Column) -> Column:
    """The labels of the patterns that occur, in order."""
    found = [F.when(text.rlike(f"(?iU{'md' if p.startswith('^') else ''}){p}"), F.lit(label)) for label, p in INJECTIONS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def prompt(text: Column, hint: Column | None = None) -> Column:
    """Guide, framed text and, if there is a hint, the guidance of a review."""
    body = F.concat(F.lit(GUIDE + "\n\nFill them in from this document.\n\n=== DOCUMENT TEXT START ===\n"), F.coalesce(text, F.lit("")), F.lit("\n=== DOCUMENT TEXT END ===\n"))
    if hint is None:
        return body
    guidance = F.when(hint.isNotNull() & (hint != ""), F.concat(F.lit("\n=== REVIEW GUIDANCE ===\n"), hint, F.lit("\n"))).otherwise("")
    return F.concat(body, guidance)


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Normalise, sanitise, scan: adds ``clean_text``, ``notes`` and ``injection_flags``."""
    out = sanitise(settled(df.withColumn("_normal", normalise(F.col(text))), "_normal"), "_normal").drop("_normal")
    out = settled(out, "clean_text")
    return out.withColumn("injection_flags", scan(F.col("clean_text")))
