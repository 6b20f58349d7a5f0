"""What is read or dealt out: hot keys, sizes before content, deep pages, named files, faulty rules."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkproof.functions.rules import RULES, Rule, decide
from inkproof.operators import export, ingest, listing, lookup, validate
from inkproof.sources import named, readers
from inkproof.sources.readers import DEFAULT_POLICY


def test_a_hot_vendor_and_number_is_many_tasks(spark):
    """A third of the rows share vendor, number and day; the order may be of any type."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("document_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("V"), F.col("id") % 500)).alias("vendor_name"),
        F.when(F.col("id") % 3 == 0, "H-1").otherwise(F.concat(F.lit("N"), F.col("id") % 7)).alias("invoice_number"), F.lit("2024-01-01").alias("received_at"), "id",
    ).withColumnRenamed("id", "seq")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task's
    rows = lookup.in_ranges(lookup.invoice_keys(df).withColumn("_late", F.lit(1)).repartition(6), ("received_at", "seq"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())
    assert len(sizes) >= 3 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    got = {r.document_id: (r.duplicate_count, r.duplicate_ids) for r in lookup.duplicates(df).collect()}
    assert len(got) == n and got["0"] == (0, []) and got["6"] == (2, ["0", "3"])
    assert all(got[str(i)] == (i // 3, ["0", "3", "6"]) for i in range(9, n, 3))
    both = {r.document_id: (r.duplicate_count, r.duplicate_ids) for r in lookup.duplicates(df, "any").collect()}
    assert both["3"] == (999, ["0", "6", "9"]) and both["2997"] == (999, ["0", "3", "6"])


def test_size_is_gated_before_content_is_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "in/odd").write_bytes(b"text")
    with open(tmp_path / "in/huge", "wb") as f:
        f.truncate(3 << 30)  # takes no room on disk, and no row could hold it
    small, large = readers.sized_files(spark, f"{tmp_path}/in", 1000)
    plan = small._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(length,1000)" in plan and [r.length for r in large.collect()] == [3 << 30]
    got = {os.path.basename(r.path): (r.size_bytes, r.content_type, r.reject_reason) for r in ingest.scan(spark, f"{tmp_path}/in", 1000).collect()}
    assert got == {"good": (10, "application/pdf", None), "odd": (4, None, "unsupported_type"), "huge": (3 << 30, None, "too_large")}


def test_deep_pages(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(f"{i:04d}", "completed" if i % 3 else "failed", at + timedelta(minutes=i // 4)) for i in range(900)]
    listing.by_time(spark.createDataFrame(rows, "document_id string, status string, created_at timestamp"), f"{tmp_path}/d", 9)
    docs, after = spark.read.parquet(f"{tmp_path}/d"), None
    for k in range(12):
        page = listing.seek(docs, "completed", 40, after).collect()
        assert page == listing.page(docs, "completed", 40, 40 * k).collect(), k
        after = listing.token(page)
    plan = listing.seek(docs, "completed", 40, after)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(created_at," in plan and "TakeOrderedAndProject" in plan
    assert listing.token([]) is None and listing.seek(docs, "completed", 40, (at - timedelta(days=1), "")).count() == 0


INVOICES = "document_id string, original_filename string, invoice_number string, invoice_date string, vendor_name string, vendor_tax_id string, currency string, subtotal double, tax_amount double, discount double, total double, line_items array<struct<description: string, quantity: double, unit_price: double, amount: double>>"


def invoice(i, name, number="N-1", items=((("a, \"b\"", 1.0, 2.5, 2.5), (None, None, None, None)))):
    return (i, name, number, None, "Acme", None, "EUR", 2.5, None, None, 2.5, list(items))


def test_named_files_of_mixed_formats(spark, tmp_path):
    docs = spark.createDataFrame([invoice("1", "one.pdf"), invoice("2", "one.PDF", "N\n2", ()), invoice("3", None), invoice("4", "../up/x.pdf"), invoice("5", ".hidden")], INVOICES)
    asked = [("1", "csv"), ("1", "csv"), ("1", "xml"), ("2", "csv"), ("3", "json"), ("4", "xml"), ("5", "json"), ("1", "docx"), ("2", "xlsx"), ("9", "csv"), ("1", None)]
    good, bad = export.named_documents(spark.createDataFrame(asked, "document_id string, format string").repartition(3), docs, spark)
    named.write_named(good, f"{tmp_path}/out")
    files = {f: (tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out")}
    assert set(files) == {"one.csv", "one.xml", "one-2.csv", "3.json", "__up_x.xml", "5.json"}
    head = "invoice_number,invoice_date,vendor_name,vendor_tax_id,currency,subtotal,tax_amount,discount,total,line_description,line_quantity,line_unit_price,line_amount\n"
    assert files["one.csv"] == head + 'N-1,,Acme,,EUR,2.5,,,2.5,"a, ""b""",1.0,2.5,2.5\nN-1,,Acme,,EUR,2.5,,,2.5,,,,\n'
    assert files["one-2.csv"] == head + '"N\n2",,Acme,,EUR,2.5,,,2.5,,,,\n'
    assert '"invoice_date":null' in files["3.json"] and files["one.xml"].startswith('<?xml version="1.0"')
    assert sorted((r.document_id, r.format, r.reason) for r in bad.collect() if r.format) == [("1", "docx", "unknown format: docx"), ("2", "xlsx", "a workbook isn't one text"), ("9", "csv", "no such document")]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="lost"):
        named.write_named(rows, f"{tmp_path}/out")
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith("_drafts")] == []
    named.write_named(spark.range(3).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("y").alias("content")), f"{tmp_path}/out")
    assert sorted(f for f in os.listdir(tmp_path / "out") if not f.startswith("_drafts")) == ["f0", "f1", "f2"]


def test_an_attempt_that_does_not_count_leaves_no_file(tmp_path):
    """Two attempts of a task: the first is lost after it wrote; only the second one's files get their names."""
    import pyarrow as pa

    w = named.NamedWriter(str(tmp_path))
    rows = lambda x: iter([pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [x, None]})])
    w.write(rows(b"lost"))
    w.commit([w.write(rows(b"kept")), None])
    assert {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path)} == {"a": b"kept", "b": b""}


def test_rules_that_raise_while_they_run(spark):
    def broken(at):
        def build(params):
            stop = F.when(F.col("total") == at, F.raise_error(F.lit("broken")).cast("string")).otherwise("pass")
            return decide(f"broken_{at:g}", [(stop == "pass", "fail", "Bad.", ("total",))], ("pass", "Good.", ()))

        return Rule(build, True)

    df = spark.createDataFrame([(str(i), float(i)) for i in range(20)], "document_id string, total double").withColumn("invoice_date", F.lit("2024-01-01"))
    rules = {"zero_total": RULES["zero_total"], "broken_7": broken(7), "broken_99": broken(99), "broken_3": broken(3)}
    got = validate.validate_isolated(df, DEFAULT_POLICY, rules).collect()
    for r in got:
        told = {x.rule_id: (x.severity, x.confidence) for x in r.results}
        assert told == {"broken_3": ("skipped", 0.0), "broken_7": ("skipped", 0.0), "broken_99": ("fail", 1.0), "zero_total": ("warning" if r.total == 0 else "pass", 1.0)}
    assert len(got) == 20
    with pytest.raises(Exception, match="source"):  # the rows' own fault is no rule's
        validate.validate_isolated(df.withColumn("total", F.raise_error(F.lit("source")).cast("double")), DEFAULT_POLICY, rules)


def test_items_of_a_long_document_are_compared_by_sorting(spark):
    """Twenty thousand items take seconds; of repeated ones the first three in the document's order are told."""
    n, shape = 20_000, "array<struct<description: string, quantity: double, unit_price: double, amount: double>>"
    item = "named_struct('description', case when i in (7, 9000) then ' Late' when i in (5, 6, 19000) then 'early' when i % 9999 = 3 then null else concat('x', i) end, 'quantity', 1D, 'unit_price', if(i = 8, double('NaN'), 2D), 'amount', cast(null as double))"
    docs = spark.range(1).selectExpr(f"cast(transform(sequence(0, {n - 1}), i -> {item}) as {shape}) as line_items")
    docs = docs.union(docs.selectExpr("slice(line_items, 10, 8000)")).union(docs.selectExpr("cast(array() as " + shape + ")"))
    began = time.time()
    got = docs.select(RULES["duplicate_line_items"].build({}).alias("r")).select("r.*").collect()
    assert time.time() - began < 30
    assert [x.severity for x in got] == ["warning", "pass", "skipped"]
    told = [got[0].reason.lower().find(t) for t in ("'none' x2", "'early' x3", "'late' x2")]
    assert -1 < told[0] < told[1] < told[2]


def test_many_named_files_are_dealt_out_to_folders(spark, tmp_path):
    """Tasks move and list; drafts that no task's row tells of are left out, a name that comes again is replaced."""
    out, name = f"{tmp_path}/out", F.concat(F.lit("f"), "id", F.lit(".txt")).alias("name")
    named.write_named(spark.range(300).repartition(3).select(name, F.lit("first").alias("content")), out, 16)
    named.write_named(spark.range(200, 400).repartition(2).select(name, F.lit("second time").alias("content")), out, 16)
    got = {r["name"]: r["length"] for r in named.listing(spark, out, 16).collect()}
    assert got == {f"f{i}.txt": 5 if i < 200 else 11 for i in range(400)} and len(os.listdir(out)) == 16
    w = named.NamedWriter(out, 16)
    import pyarrow as pa

    full = list(w.drafts(iter([pa.RecordBatch.from_pydict({"name": list("abcde"), "content": [b"x"] * 5})]), 2))
    assert [f.count for f in full] == [2, 2, 1]
    w.move(full[0].folder)
    w.move(full[0].folder)
    w.commit(full[1:])
    assert named.listing(spark, out, 16).where("length = 1").count() == 5 and not [f for f in os.listdir(out) if f.startswith("_drafts")]


def test_keys_are_looked_up_before_the_scores_and_read_once(spark, monkeypatch):
    """The lookup's plan has no scores in it, and ranges are made of a stored table."""
    from inkproof.plans.verify import verify

    seen, ranges = [], lookup.in_ranges
    monkeypatch.setattr(lookup, "in_ranges", lambda rows, order: (seen.append((rows.columns, rows.inputFiles())), ranges(rows, order))[1])
    items = "array(named_struct('description', 'a', 'quantity', -1D, 'unit_price', 2D, 'amount', 3D), named_struct('description', 'A ', 'quantity', -1D, 'unit_price', 2D, 'amount', 3D))"
    df = spark.range(2).selectExpr("cast(id as string) as document_id", "id as seq", "id as received_at", "'N-1' as invoice_number", "'2024-01-01' as invoice_date", "'Acme' as vendor_name", "string(null) as vendor_tax_id", "'EUR' as currency", "6D as subtotal", "0D as tax_amount", "0D as discount", "6D as total", f"{items} as line_items", "array('') as injection_flags", "'N-1' as source_text")
    made = []
    given = lookup.duplicates
    monkeypatch.setattr(lookup, "duplicates", lambda rows, *a, **k: (made.append(rows.columns), given(rows, *a, **k))[1])
    got = verify(df, now="2024-02-01 00:00:00").orderBy("document_id").collect()
    assert "scores" not in made[0] and seen[0][1] and [r.duplicate_count for r in got] == [0, 1]
    told = {r.rule_id: r.severity for r in got[1].results}
    assert (told["duplicate_invoice"], told["duplicate_line_items"], told["negative_quantity"], told["line_item_amount_consistency"], told["subtotal_matches_line_items"]) == ("fail", "warning", "fail", "fail", "pass")


def test_parts_that_rules_share_follow_the_parameters(spark):
    """A rule under other parameters doesn't take what was computed for the policy's."""
    assert set(RULES) >= set(validate.SHARED)
    df = spark.range(1).selectExpr("'x' as document_id", "'2024-01-01' as invoice_date", "array(named_struct('description', 'a', 'quantity', 0D, 'unit_price', 2D, 'amount', 0.5D)) as line_items")
    rules = {"negative_quantity": RULES["negative_quantity"], "line_item_amount_consistency": RULES["line_item_amount_consistency"], "lenient": Rule(lambda p: RULES["negative_quantity"].build(p | {"allow_zero": True}))}
    got = validate.validate(df, {"line_item_amount_consistency": {"params": {"tolerance": 1.0}}}, rules).first().results
    assert [r.severity for r in got] == ["pass", "pass", "fail"]


def test_texts_are_made_only_for_who_takes_them(spark):
    """Gates and counts pay for the rules' cases and the scores' numbers, not for reasons, values and signals."""
    from inkproof.plans.verify import verify

    items = "array(named_struct('description', 'a', 'quantity', 1D, 'unit_price', 6D, 'amount', 6D))"
    df = spark.range(1).selectExpr("cast(id as string) as document_id", "id as seq", "id as received_at", "'N-1' as invoice_number", "'2024-01-01' as invoice_date", "'　Acme ' as vendor_name", "string(null) as vendor_tax_id", "'EUR' as currency", "6D as subtotal", "0D as tax_amount", "0D as discount", "6D as total", f"{items} as line_items", "array('x') as injection_flags", "'N-1 acme' as source_text")
    done = verify(df, now="2024-02-01 00:00:00", scope=None)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    lean = done.select("document_id", "confidence.overall", F.col("overall").alias("checks"), "counts", "needs_review")
    assert not [t for t in ("The parts add up", "Patterns of manipulation", "not_found_in_source") if t in plan(lean)]
    assert "The parts add up" in plan(done) and "not_found_in_source" in plan(done)
    got, told = lean.first(), done.first()
    assert (got.overall, got.checks, got.counts, got.needs_review) == (told.confidence.overall, told.overall, told.counts, told.needs_review)
    severities = [r.severity for r in told.results]
    assert told.counts == {s: severities.count(s) for s in ("pass", "warning", "fail", "skipped")} and told.overall == "fail" and len(severities) == 18
    assert [f.signals[1] for f in told.confidence.fields if f.field == "vendor_name"] == ["grounded_in_source(+0.30)"]


def test_no_layer_of_checks_is_too_large_to_be_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes for good."""
    from inkproof.plans.verify import verify

    df = spark.createDataFrame([invoice("1", "one.pdf")], INVOICES).withColumns({"source_text": F.lit("x"), "injection_flags": F.array().cast("array<string>"), "duplicate_count": F.lit(0), "duplicate_ids": F.array().cast("array<string>")})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = verify(df, None, now="2024-06-01 00:00:00", scope="given").select("document_id", "counts", "overall", "needs_review")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
        found = debug.codegenStringSeq(plan)
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000, sizes


def test_dates_are_read_as_by_all_patterns_in_turn(spark):
    from inkproof.functions.scalars import DATE_PATTERNS, parse_date, strip

    texts = ["05/01/2024", "31/01/2024", "01/31/2024", "13/13/2024", "0005/01/2024", "2024/1/5", "2024-01-05", "5-1-2024", "12024-1-1", "+12024-1-1", "2024-1-0005", "007/012/2024", "5 Jan 2024", "5 January 2024", "January 5, 2024", "Jan  5, 2024", "May 5, 2024", "May 5 2024", "Smarch 5, 2024", "1/2-2024", "2024-1-1\n", "soon", "", None]
    c = F.regexp_replace(strip(F.col("t")), r"(?U)\s+", " ")
    every = F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in DATE_PATTERNS)).cast("timestamp_ntz")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", every.cast("string").alias("want"), parse_date(F.col("t")).cast("string").alias("got")).collect()
    assert [r.t for r in got if r.want != r.got] == [] and sum(r.got is not None for r in got) >= 12


def test_rows_are_computed_twice_at_most_to_isolate_rules(spark):
    """Once until a rule stops the job, and once more to be written; tries read what was written."""
    def broken(at):
        stop = F.when(F.col("total") == at, F.raise_error(F.lit("broken")).cast("string")).otherwise("pass")
        return Rule(lambda params: decide(f"broken_{at}", [(stop == "pass", "pass", "Good.", ())], ("fail", "Bad.", ())))

    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    df = spark.range(1).select(F.lit("1").alias("document_id"), F.lit(3.0).alias("total"), F.lit("2024-01-01").alias("invoice_date"))
    df = df.mapInArrow(count, df.schema)
    rules = {f"broken_{k}": broken(k) for k in (3, 5, 7, 9)} | {"zero_total": RULES["zero_total"]}
    [r] = validate.validate_isolated(df, DEFAULT_POLICY, rules).collect()
    assert {x.rule_id: x.severity for x in r.results} == {"broken_3": "skipped", "broken_5": "pass", "broken_7": "pass", "broken_9": "pass", "zero_total": "pass"}
    assert computed.value <= 2


def test_invoices_of_documents_alone(spark):
    """Orders that no document has go before line items are joined and grouped; the invoices are the same."""
    from inkproof.sources.views import view

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the given tables aren't here")
    near, every = view(spark, d, "invoices", ("documents", "doc_id")), view(spark, d, "invoices")
    ids = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"))
    want = every.join(ids, "document_id", "left_semi").select(every.columns).collect()
    assert sorted(near.collect()) == sorted(want) and 0 < len(want) < every.count()
    for name in ("doc_answers", "doc_pages"):
        assert sorted(map(repr, view(spark, d, name, ("documents", "doc_id")).collect())) == sorted(map(repr, view(spark, d, name).collect()))
    looked = lookup.duplicates(every, wanted=near).select("document_id", "duplicate_count", "duplicate_ids")
    assert sorted(looked.collect()) == sorted(lookup.duplicates(every).join(ids, "document_id", "left_semi").select(looked.columns).collect())


def test_a_review_writes_its_rows_once_a_round(spark, monkeypatch):
    from inkproof import catalogue
    from inkproof.operators import review

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the given tables aren't here")
    written = []
    monkeypatch.setattr(review, "stored", lambda df: written.append(df) or df)
    catalogue._reviewed(spark, "/root/testdata/sf0.001")
    assert len(written) == 1  # two rounds, of which the last is the caller's


def test_whole_invoices_are_shuffled_once(spark):
    """Duplicates and vendors are looked up over the keys alone, with the same results; null and repeated ids and names included."""
    from datetime import datetime as at

    from inkproof.plans.verify import verify

    names = ["Acme", " acme ", "Other", None, "", "  ", "Gone", "ÄCME"]
    rows = [(None if i % 13 == 0 else str(i % 40), names[i % 8], f"N{i % 3}" if i % 5 else None, at(2024, 1, 1 + i % 20), i) for i in range(60)]
    df = spark.createDataFrame(rows, "document_id string, vendor_name string, invoice_number string, received_at timestamp, seq long")
    vendors = spark.createDataFrame([("ACME",), (None,), (" ",), ("äcme",)], "vendor_name string")
    for scope in ("prior", "any"):
        want = lookup.known_vendors(lookup.duplicates(df, scope), vendors)
        got = lookup.duplicates(df, scope, vendors=vendors)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the given tables aren't here")
    from inkproof.operators.state import stored
    from inkproof.sources.views import view

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    checked = verify(stored(view(spark, d, "invoices")), spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_name as vendor_name"))
    plan = checked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in plan.split("\n\n") if ") Exchange\n" in x and "line_items" in x]) == 1


def test_a_review_writes_what_is_read_again_alone(spark, monkeypatch):
    """Decided rows are written with the columns that are taken; rows that need no review go along."""
    from inkproof.operators import review, state

    written, real = [], state.stored
    monkeypatch.setattr(review, "stored", lambda df: written.append(real(df)) or written[-1])
    kind = "array<struct<rule_id: string, severity: string, confidence: double, reason: string, fields: array<string>, suggestion: string>>"
    fields = "struct<overall: double, fields: array<struct<field: string, confidence: double, value: string, signals: array<string>>>>"
    bad = [("sum", "warning", 1.0, "no", ["total"], None)]
    rows = [(str(i), f"v{i}", "x" * 100, bad if i % 4 else [], (0.5, [("total", 0.1, "1", [])]), i % 4 > 0, "review" if i % 4 else "completed") for i in range(20)]
    df = spark.createDataFrame(rows, f"document_id string, vendor string, source string, results {kind}, confidence {fields}, need boolean, status string")
    monkeypatch.setattr(review, "RULES", {"sum": Rule(None, True)})

    def propose(rows):
        return rows.withColumn("proposed", F.when(F.expr("document_id % 4 = 1 and attempts = 1"), "retry").otherwise("accept")).withColumn("reasoning", F.lit("r"))

    def again(rows):
        assert "source" in rows.columns and "results" not in rows.columns
        return rows.withColumns({"vendor": F.upper("vendor"), "results": F.array().cast(kind), "confidence": F.lit(None).cast(fields)})

    got = {r.document_id: r for r in review.review(df, propose, again, keep=("document_id", "vendor", "status"), anew=("results", "confidence"), wanted="need").collect()}
    assert len(got) == 20
    for i in range(20):
        r = got[str(i)]
        want = (None, 1, "completed") if i % 4 == 0 else ("accept", 2 if i % 4 == 1 else 1, "completed")
        assert (r.decision, r.attempts, r.status, r.vendor) == (*want, f"V{i}" if i % 4 == 1 else f"v{i}")
    [first] = written
    assert not {"results", "confidence", "classes"} & set(first.columns)
    assert {r.document_id for r in first.where("source is not null").collect()} == {str(i) for i in range(1, 20, 4)}


def test_exports_write_and_sort_no_more_than_they_take(spark, monkeypatch):
    from inkproof import catalogue

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the given tables aren't here")
    written, given, real = [], [], catalogue.state.stored
    monkeypatch.setattr(catalogue.state, "stored", lambda df: written.append(df.columns) or real(df))
    monkeypatch.setattr(catalogue.named, "write_named", lambda rows, path, folders: given.append(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    catalogue.queries()["export_files"](spark, d)
    plan = given[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not {"source_text", "injection_flags"} & set(written[0]) and "line_items" in written[0]
    assert not [x for x in plan.split("\n\n") if ") Sort\n" in x and "line_items" in x]
