"""The model port: concurrent calls, faults and timeouts as rows, equal prompts asked once."""

import time

from pyspark.sql import functions as F

from inkproof.operators import extract


def test_calls_run_at_the_same_time():
    took = {}
    for k in (1, 8):
        began = time.monotonic()
        got = extract.ask_all(lambda p: time.sleep(0.1) or p.upper(), [f"p{i}" for i in range(24)], k, 5)
        took[k] = time.monotonic() - began
        assert got == [(f"P{i}", None) for i in range(24)]
    assert took[8] < took[1] / 4
    assert extract.ask_all(None, [], 4, 5) == []


def test_faults_and_timeouts_stay_with_their_prompts():
    def ask(p):
        if p % 5 == 0:
            raise ValueError(f"no {p}")
        if p % 7 == 0:
            time.sleep(60)
        return str(p)

    began = time.monotonic()
    got = extract.ask_all(ask, list(range(1, 40)), 3, 0.3)
    assert time.monotonic() - began < 5
    for p, (answer, error) in zip(range(1, 40), got):
        assert (answer, error) == ((None, f"ValueError: no {p}") if p % 5 == 0 else (None, "TimeoutError: no answer within 0.3 s") if p % 7 == 0 else (str(p), None))


def test_rows_without_ids_and_equal_prompts(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model():
        def ask(p):
            with open(log, "a") as f:
                f.write(p + "\n")
            if p == "bad":
                raise RuntimeError("broken")
            return '{"total": 1}' if p.startswith("good") else "no" if not p.endswith(extract.FIRMER) else '{"total": 2}'

        return ask

    rows = [("1", "good"), ("1", "good again"), (None, "good"), (None, "late"), (None, "bad"), ("2", None), ("3", "bad")] + [("4", "good")] * 40
    df = spark.createDataFrame(rows, "document_id string, prompt string").repartition(4)
    got = extract.extract(df, "prompt", model, retries=1).select("document_id", "data.total", "call_error", "parse_attempts").collect()
    counted = {}
    for r in got:
        counted[tuple(r)] = counted.get(tuple(r), 0) + 1
    assert counted == {("1", 1.0, None, 1): 2, (None, 1.0, None, 1): 1, (None, 2.0, None, 2): 1, (None, 2.0, None, 2): 1, (None, 2.0, None, 2): 1, ("2", None, None, 2): 1, ("3", 2.0, None, 2): 1, ("4", 1.0, None, 1): 40} | {(None, 2.0, None, 2): 2}
    asked = open(log).read().replace(extract.FIRMER, " AGAIN").splitlines()
    assert sorted(asked) == ["bad", "bad AGAIN", "good", "good again", "late", "late AGAIN"]


def test_a_failing_model_gives_all_rows(spark):
    def model():
        def ask(p):
            if int(p.split()[0]) % 5 == 0:
                raise ConnectionError("refused")
            return '{"total": 3}'

        return ask

    df = spark.range(50).select(F.col("id").cast("string").alias("document_id"), F.concat("id", F.lit(" prompt")).alias("prompt"))
    got = {r.document_id: (r.call_error, r.data.total) for r in extract.extract(df, "prompt", model, retries=2).collect()}
    assert got == {str(i): (("ConnectionError: refused", None) if i % 5 == 0 else (None, 3.0)) for i in range(50)}


def test_prompts_are_made_once_and_shuffled_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(30).select(F.col("id").cast("string").alias("document_id"), F.concat(F.col("id") % 20, F.lit(" prompt")).alias("prompt")).mapInArrow(count, "document_id string, prompt string")
    got = extract.extract(df, "prompt", lambda: lambda p: '{"total": 4}' if p.endswith(extract.FIRMER) or p < "15" else "no", retries=1)
    assert sorted((int(r.document_id), r.data.total, r.parse_attempts) for r in got.collect()) == [(i, 4.0, 1 if f"{i % 20} prompt" < "15" else 2) for i in range(30)]
    assert made.value == 30


def test_many_quick_answers_take_time_by_their_number():
    took = {}
    for n in (4_000, 16_000):
        began = time.monotonic()
        assert extract.ask_all(lambda p: p.upper(), ["a"] * n, 8, 60) == [("A", None)] * n
        took[n] = time.monotonic() - began
    assert took[16_000] < 8 * took[4_000] + 0.5, took
