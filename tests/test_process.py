"""The flow of documents: failures routed, stopped runs resumed, nothing finished done twice, every reading kept."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkproof.plans import process

NOW = "2024-06-01 00:00:00"
TEXT = "Acme Ltd\nInvoice Number: INV-{0}\nDate: 2024-05-0{0}\nEUR\nSubtotal: 100\nTax: 0\nTotal: {1}\nto be paid within thirty days of this date"


def test_flow(spark, tmp_path):
    log, broken = str(tmp_path / "asked"), tmp_path / "broken"
    broken.touch()

    def model():
        import json

        def answer(n, total=100.0):
            item = {"description": "work", "quantity": 1, "unit_price": 100, "amount": 100}
            return json.dumps({"invoice_number": f"INV-{n}", "invoice_date": f"2024-05-0{n}", "vendor_name": "Acme Ltd", "currency": "EUR", "subtotal": 100, "tax_amount": 0, "discount": 0, "total": total, "line_items": [item]})

        def ask(prompt):
            n = prompt.split("INV-")[1][0]
            with open(log, "a") as f:
                f.write(n + ("!" if "REVIEW GUIDANCE" in prompt else "") + "\n")
            if n == "3" and broken.exists():
                raise ConnectionError("refused")
            if n == "4":  # reads a wrong total, and the right one when told where to look
                return answer(4, 100.0 if "REVIEW GUIDANCE" in prompt else 900.0)
            return answer(n)

        return ask

    def propose(df):
        first = F.when((F.col("attempts") == 1) & (F.size("retryable") > 0), "retry").otherwise("accept")
        return df.withColumn("proposed", first).withColumn("reasoning", F.lit("x")).withColumn("retry_hint", F.lit("the total is at the bottom"))

    docs = spark.createDataFrame([(str(i), datetime(2024, 5, i), i, "application/pdf", f"{i}.pdf") for i in range(1, 6)] + [("6", datetime(2024, 5, 6), 6, "application/pdf", "6.pdf"), (None, None, None, None, None)], "document_id string, received_at timestamp, seq long, content_type string, original_filename string")
    pages = spark.createDataFrame([(str(i), "native", 1, TEXT.format(i if i < 5 else 1, 100)) for i in range(1, 6)] + [("6", "native", 1, None)], "document_id string, method string, page_number int, text string")
    vendors = spark.createDataFrame([("Acme Ltd",)], "vendor_name string")
    read, wrong = process.ask_model(model, retries=0), [True]

    def stopped(todo, flow):
        if wrong[0]:
            raise RuntimeError("the driver was lost")
        return checks.run(todo, flow)

    checks = process.check(vendors, now=NOW)
    stages = [process.read_texts(pages), process.read_records(read), process.Stage("checks", checks.wants, stopped), process.decide(propose, read, vendors, now=NOW)]
    flow = process.Flow(spark, f"{tmp_path}/flow", stages, buckets=2)
    flow.submit(docs)
    with pytest.raises(RuntimeError):
        flow.run()
    status = lambda: {r.document_id: (r.status, (r.metadata or {}).get("failure_reason")) for r in flow.states.read().collect()}
    failed = {"3": ("failed", "ConnectionError: refused"), "6": ("failed", "the document has no text")}
    assert status() == failed | {i: ("extracted", None) for i in "1245"}
    wrong[0] = False
    flow = process.Flow(spark, f"{tmp_path}/flow", stages, buckets=2)
    flow.submit(docs)  # again: nothing is taken in twice
    assert flow.run() == {"texts": 0, "extractions": 0, "checks": 4, "reviews": 2}
    assert sorted(open(log).read().split()) == ["1", "2", "3", "4", "4!"]  # 5 has the prompt of 1
    assert status() == failed | {"1": ("completed", None), "2": ("completed", None), "4": ("completed", None), "5": ("escalated", None)}

    records = {(r.document_id, r.attempt): r.total for r in flow.table("extractions", ("document_id", "attempt")).read().select("document_id", "attempt", "data.total").collect()}
    assert records == {("1", 1): 100.0, ("2", 1): 100.0, ("4", 1): 900.0, ("5", 1): 100.0, ("4", 2): 100.0}
    got = {r.document_id: r for r in process.results(flow).collect()}
    assert got["4"].extractions.data.total == 100.0 and got["4"].checks.overall == "pass" and got["4"].reviews.attempts == 2 and got["1"].reviews is None
    assert got["5"].checks.duplicate_ids == ["1"] and got["5"].reviews.overridden and got["6"].texts is None

    broken.unlink()
    flow.retry_failed()
    assert flow.run() == {"texts": 2, "extractions": 1, "checks": 1, "reviews": 0}
    assert status()["3"] == ("completed", None) and status()["6"][0] == "failed"
    assert open(log).read().split().count("3") == 2 and len(open(log).read().split()) == 6
    assert flow.run() == dict.fromkeys(("texts", "extractions", "checks", "reviews"), 0)
