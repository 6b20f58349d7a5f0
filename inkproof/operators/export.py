"""Exports: rows for accounting, JSON and XML documents, the three sheets of a workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money
from ..sources.records import HEADER_FIELDS, TEXT_FIELDS

# The formats, their media types and file suffixes.
FORMATS = {
    "csv": ("text/csv", ".csv"),
    "json": ("application/json", ".json"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"),
    "xml": ("application/xml", ".xml"),
}

def context(extractions: DataFrame, validations: DataFrame, reviews: DataFrame, documents: DataFrame | None = None, id_col: str = "document_id") -> DataFrame:
    """What an export needs: the extraction, and validation and review if there are any."""
    out = extractions.join(validations, id_col, "left").join(reviews.select(id_col, "decision", "reasoning"), id_col, "left")
    return out if documents is None else out.join(documents.select(id_col, "original_filename"), id_col)

def unexported(documents: DataFrame, extractions: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Documents without an extraction can't be exported."""
    return documents.join(extractions.select(id_col), id_col, "left_anti")

def csv_rows(df: DataFrame, id_col: str = "document_id") -> DataFrame:
    """A row for each line item with the header repeated, or one with empty item columns."""
    items = df.select(id_col, *HEADER_FIELDS, F.posexplode_outer("line_items").alias("line_number", "x"))
    return items.select(id_col, *HEADER_FIELDS, *(F.col(f"x.{f}").alias(f"line_{f}") for f in ("description", "quantity", "unit_price", "amount")))

def json_text(df: DataFrame, with_evidence: bool = False, id_col: str = "document_id") -> DataFrame:
    """``json``: id and data, nulls included; with the evidence if wanted."""
    return df.select(id_col, json_text_of(id_col, with_evidence).alias("json"))

def json_text_of(id_col: str = "document_id", with_evidence: bool = False) -> Column:
    parts = [F.col(id_col).alias("document_id"), F.struct(*HEADER_FIELDS, "line_items").alias("data")]
    if with_evidence:
        parts += [F.col("confidence"), F.struct("overall", "results", "counts").alias("validation"), F.struct("decision", "reasoning").alias("review")]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

def _number(c: Column) -> Column:
    """As a double is usually written, without an exponent up to 1e15."""
    wide = F.regexp_replace(c.try_cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(c).between(1e7, 1e15), wide).otherwise(c.cast("string"))

def _xml_value(c: Column) -> Column:
    """A value's text in an element, on one line; null is empty."""
    out = c
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return F.coalesce(out, F.lit(""))

def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

def xml_text(df: DataFrame, id_col: str = "document_id") -> DataFrame:
    """``xml``: the declaration and, on a line of its own, an invoice element with the id as attribute; null is an empty element."""
    return df.select(id_col, xml_of(id_col).alias("xml"))

def xml_of(id_col: str = "document_id") -> Column:
    header = [_element(f, _xml_value(F.col(f) if f in TEXT_FIELDS else _number(F.col(f)))) for f in HEADER_FIELDS]
    item = lambda x: _element("lineItem", F.concat(_element("description", _xml_value(x["description"])), *(_element(f, _xml_value(_number(x[f]))) for f in ("quantity", "unit_price", "amount"))))
    items = F.coalesce(F.array_join(F.transform("line_items", item), ""), F.lit(""))
    root = F.concat(F.lit('<invoice documentId="'), _xml_value(F.col(id_col).cast("string")), F.lit('">'), *header, _element("lineItems", items), F.lit("</invoice>"))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), root)

def field_values(df: DataFrame, id_col: str = "document_id") -> DataFrame:
    """``field, value`` for each header field."""
    pairs = [F.struct(F.lit(f).alias("field"), (F.col(f) if f in TEXT_FIELDS else money(F.col(f))).alias("value")) for f in HEADER_FIELDS]
    return df.select(id_col, F.explode(F.array(*pairs)).alias("p")).select(id_col, "p.field", "p.value")

def line_items(df: DataFrame, id_col: str = "document_id") -> DataFrame:
    return df.select(id_col, F.posexplode("line_items").alias("line_number", "x")).select(id_col, (F.col("line_number") + 1).alias("line_number"), "x.*")

def evidence(df: DataFrame, id_col: str = "document_id") -> DataFrame:
    """``field, confidence, signals`` (joined) for each scored field."""
    rows = df.select(id_col, F.explode("confidence.fields").alias("f"))
    return rows.select(id_col, "f.field", "f.confidence", F.array_join("f.signals", "; ").alias("signals"))

def output_name(filename: Column, document_id: Column, extension: Column) -> Column:
    """The source's name without its last suffix, or the id, and the format's suffix."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), document_id), extension)

def formats(spark) -> DataFrame:
    return spark.createDataFrame([(k, m, x) for k, (m, x) in FORMATS.items()], "format string, media_type string, extension string")

def requests(asked: DataFrame, spark) -> tuple[DataFrame, DataFrame]:
    """Requests (document_id, format) with media type and suffix, and those for unknown formats."""
    known = F.broadcast(formats(spark))
    return asked.join(known, "format"), asked.join(known, "format", "left_anti")

def csv_text(id_col: str = "document_id") -> Column:
    """One document's rows as the text of a CSV file with a header."""
    items = ("description", "quantity", "unit_price", "amount")
    names = ",".join((*HEADER_FIELDS, *(f"line_{f}" for f in items)))
    number = lambda c: c.cast("string")
    head = [F.col(f) if f in TEXT_FIELDS else number(F.col(f)) for f in HEADER_FIELDS]
    line = lambda x: F.concat_ws(",", *(_csv_value(c) for c in (*head, x["description"], *(number(x[f]) for f in items[1:]))))
    empty = F.concat_ws(",", *map(_csv_value, head), F.lit(",,,"))
    rows = F.when(F.size(F.coalesce("line_items", F.array().cast("array<struct<description: string, quantity: double, unit_price: double, amount: double>>"))) > 0, F.transform("line_items", line)).otherwise(F.array(empty))
    return F.concat(F.lit(names + "\n"), F.array_join(rows, "\n"), F.lit("\n"))

def _csv_value(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line's end."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike("[,\"\r\n]"), quoted).otherwise(c), F.lit(""))

def named_documents(asked: DataFrame, documents: DataFrame, spark, id_col: str = "document_id", filename: str = "original_filename") -> tuple[DataFrame, DataFrame]:
    """What :func:`sources.named.write_named` takes: ``name, content`` of each request (document_id, format), and the requests that can't be met with the reason.

    All formats are made in one pass. A name is that of the source with the format's suffix. Of requests whose names are the same the one
    with the smallest id has it, the others get their id before the suffix; a request that comes twice is written once. Characters that
    would lead elsewhere become ``_``. A workbook's bytes aren't built, so that format is one that can't be met.
    """
    known = F.broadcast(formats(spark))
    why = F.when(F.col("media_type").isNull(), F.concat(F.lit("unknown format: "), F.coalesce("format", F.lit("none")))).when(F.col("format") == "xlsx", "a workbook isn't one text").when(F.col("_there").isNull(), "no such document")
    there = documents.select(id_col, filename).withColumn("_there", F.lit(True))
    wanted = there.join(asked.select(id_col, "format").distinct().join(known, "format", "left"), id_col, "right").withColumn("_why", why)
    content = F.when(F.col("format") == "csv", csv_text(id_col)).when(F.col("format") == "json", json_text_of(id_col)).when(F.col("format") == "xml", xml_of(id_col))
    safe = lambda c: F.regexp_replace(c, r"[/\\\x00-\x1f]|^\.+|^_", "_")
    key = F.col(id_col).cast("string")
    good = wanted.where("_why is null").select(id_col, "format", safe(output_name(F.col(filename), key, F.col("extension"))).alias("name"), "extension")
    first = good.groupBy("name").agg(F.min(id_col).alias("_first")).withColumnRenamed("name", "_name")
    other = F.concat(F.expr("substr(name, 1, length(name) - length(extension))"), F.lit("-"), safe(key), F.col("extension"))
    # Names are found over ids alone; the documents come to them last, so that no content is shuffled, and none is sorted.
    told = good.join(first, F.col("name") == F.col("_name")).select(id_col, "format", F.when(F.col(id_col) == F.col("_first"), F.col("name")).otherwise(other).alias("name"))
    named = documents.join(told.hint("shuffle_hash"), id_col).select("name", content.alias("content"))
    return named, wanted.where("_why is not null").select(id_col, "format", F.col("_why").alias("reason"))

def write(df: DataFrame, format_id: str, path: str, with_evidence: bool = False) -> None:
    """Write all given documents in one format; an unknown one is an error. A workbook is three folders of rows."""
    if format_id not in FORMATS:
        raise ValueError(f"unknown format: {format_id}; there are {', '.join(sorted(FORMATS))}")
    if format_id == "csv":
        csv_rows(df).drop("document_id").write.csv(path, header=True)
    elif format_id == "json":
        json_text(df, with_evidence).select("json").write.text(path)
    elif format_id == "xml":
        xml_text(df).select(F.replace("xml", F.lit("\n"), F.lit("")).alias("value")).write.text(path)  # only the declaration ends a line
    else:
        sheets = {"fields": field_values(df), "line_items": line_items(df)} | ({"evidence": evidence(df)} if with_evidence else {})
        for name, rows in sheets.items():
            rows.write.csv(f"{path}/{name}", header=True)
