"""From a model's answers to a typed record."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import AMOUNT_FIELDS, LINE_ITEM, TEXT_FIELDS

FIRMER = "\n\nYour last answer was no valid JSON. Return one valid JSON object only, without prose or code fences."


def ask_all(ask: Callable[[str], str], prompts: list[str], concurrency: int, timeout: float) -> list[tuple[str | None, str | None]]:
    """For each prompt the answer and null, or null and what went wrong. At most ``concurrency`` calls run at a time.

    A call that takes longer than ``timeout`` seconds is given up: its thread is left to itself, and another takes its place.
    """
    todo, done, began = queue.SimpleQueue(), queue.SimpleQueue(), {}
    found: list[tuple[str | None, str | None] | None] = [None] * len(prompts)
    for k in range(len(prompts)):
        todo.put(k)

    def work() -> None:
        while True:
            try:
                k = todo.get_nowait()
            except queue.Empty:
                return
            began[k] = time.monotonic()
            try:
                got = (ask(prompts[k]), None)
            except Exception as e:  # one call's fault must not stop the others
                got = (None, f"{type(e).__name__}: {e}"[:500])
            began.pop(k, None)  # only running calls are looked at, however many answers wait
            done.put((k, got))
            if found[k] is not None:  # given up meanwhile: another thread has taken this one's place
                return

    start = lambda: threading.Thread(target=work, daemon=True).start()
    for _ in range(min(concurrency, len(prompts))):
        start()
    left = len(prompts)
    while left:
        try:
            k, got = done.get(timeout=min(0.05, timeout))
            if found[k] is None:
                found[k], left = got, left - 1
        except queue.Empty:
            pass
        for k, at in list(began.items()):
            if found[k] is not None:
                began.pop(k, None)
            elif time.monotonic() - at > timeout:
                found[k], left = (None, f"TimeoutError: no answer within {timeout:g} s"), left - 1
                start()
    return found


def asked(rows: DataFrame, prompt: str, model: Callable[[], Callable[[str], str]], out: str, error: str, concurrency: int = 8, timeout: float = 120.0, more: str = "") -> DataFrame:
    """The rows with the model's answer to each prompt, followed by ``more``, and why there is none. Nothing is shuffled."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = model()
        for b in batches:
            got = ask_all(ask, [p + more for p in b.column(names.index(prompt)).to_pylist()], concurrency, timeout)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*names, out, error])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in [*rows.dtypes, (out, "string"), (error, "string")]))


def prompts(df: DataFrame, prompt: str, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows' columns ``keep`` with a digest of their prompt in ``_mine``, and ``_digest, _prompt`` of each prompt that differs; null prompts aren't among these.

    Prompts are made once and written, and shuffled once, by their digests; the rows read their digests alone.
    """
    from .state import stored

    rows = stored(df.select(*dict.fromkeys((*keep, prompt)), F.col(prompt).alias("_prompt"), F.sha2(F.col(prompt), 256).alias("_mine")))
    each = rows.where("_prompt is not null").groupBy(F.col("_mine").alias("_digest")).agg(F.first("_prompt").alias("_prompt"))
    return rows.select(*keep, "_mine"), each


def infer(
    df: DataFrame, prompt: str, model: Callable[[], Callable[[str], str]], out: str = "response", keep: tuple[str, ...] = ("document_id",), error: str = "call_error", concurrency: int = 8, timeout: float = 120.0
) -> DataFrame:
    """The columns ``keep``, the model's answer to each row's prompt, and in ``error`` why there is none.

    ``model()`` is called once for each task and gives the function to ask, of which ``concurrency``
    calls run at a time. A call that raises or isn't answered in ``timeout`` seconds gives a null
    answer and an error, and no other row suffers. Equal prompts are asked once, wherever they
    are: prompts are gathered by a digest, and answers joined back by it. A null prompt isn't asked.
    """
    rows, each = prompts(df, prompt, keep)
    answers = asked(each, "_prompt", model, out, error, concurrency, timeout).drop("_prompt")
    return rows.join(answers, F.col("_mine") == F.col("_digest"), "left").select(*keep, out, error)


def strip_fences(text: Column) -> Column:
    """Without white space, a code fence around the text, and the fence's language mark."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    inside = F.substring_index(F.substr(t, F.lit(4)), "```", 1)
    inside = F.regexp_replace(inside, "^json", "")
    return F.regexp_replace(F.when(F.startswith(t, F.lit("```")), inside).otherwise(t), r"(?U)^[\s`]+|[\s`]+$", "")


def first_usable(responses: list[str]) -> tuple[Column, Column]:
    """The first of the answers that is a JSON object, stripped of fences, and its number; null if none is."""
    cleaned = F.array(*(strip_fences(F.col(c)) for c in responses))
    numbered = F.transform(cleaned, lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    good = F.filter(numbered, lambda r: F.startswith(F.coalesce(r["t"], F.lit("")), F.lit("{")) & F.try_parse_json(r["t"]).isNotNull())
    best = F.try_element_at(good, F.lit(1))
    return best["t"], best["n"]


def typed(df: DataFrame, responses: list[str], keep: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """``data`` (the record, with what is valid), ``parse_attempts``, ``parse_error`` and ``raw_text``.

    Numbers written as text are read; values of a wrong kind become null and are counted in the
    error; unknown keys are left out. Without a usable answer the record is empty.
    """
    text, attempt = first_usable(responses)
    df = df.withColumn("_text", text).withColumn("_n", attempt).withColumn("_v", F.try_parse_json("_text"))
    raw = lambda f, kind: F.try_variant_get("_v", f"$.{f}", kind)
    code = F.schema_of_variant
    is_text = lambda f: F.coalesce(code(F.variant_get("_v", f"$.{f}", "variant")) == "STRING", F.lit(False))
    given = lambda f: F.coalesce(code(F.variant_get("_v", f"$.{f}", "variant")) != "VOID", F.lit(False))
    texts = {f: F.when(is_text(f), raw(f, "string")) for f in TEXT_FIELDS}
    numbers = {f: raw(f, "double") for f in AMOUNT_FIELDS}
    items = F.from_json(F.try_variant_get("_v", "$.line_items", "string"), f"array<struct<description: string, quantity: string, unit_price: string, amount: string>>")
    lines = F.transform(F.coalesce(items, F.array().cast("array<struct<description: string, quantity: string, unit_price: string, amount: string>>")), lambda x: F.struct(x["description"].alias("description"), *(x[n].try_cast("double").alias(n) for n in ("quantity", "unit_price", "amount"))))
    data = F.struct(*(v.alias(f) for f, v in {**texts, **numbers}.items()), lines.cast(f"array<{LINE_ITEM}>").alias("line_items"))
    wrong = sum((F.when(given(f) & v.isNull(), 1).otherwise(0) for f, v in {**texts, **numbers}.items()), F.lit(0))
    last = F.coalesce(*(F.col(c) for c in reversed(responses)))
    out = df.withColumn("_wrong", wrong)
    error = F.when(F.col("_n").isNull(), F.lit("no JSON object in any answer")).when(F.col("_wrong") > 0, F.concat(F.lit("ValidationError: "), F.col("_wrong"), F.lit(" field(s)")))
    picked = F.element_at(F.array(*(F.col(c) for c in responses)), F.coalesce("_n", F.lit(len(responses))))
    return out.select(*keep, data.alias("data"), F.coalesce("_n", F.lit(len(responses))).alias("parse_attempts"), error.alias("parse_error"), F.coalesce(picked, last).alias("raw_text"))


def extract(df: DataFrame, prompt: str, model: Callable[[], Callable[[str], str]], keep: tuple[str, ...] = ("document_id",), retries: int = 1, concurrency: int = 8, timeout: float = 120.0) -> DataFrame:
    """Ask, and ask up to ``retries`` times more, in firmer words, only where no answer so far can be read.

    As :func:`typed`, and ``call_error``: of a row without a usable answer, why its last call gave none (null if it gave one).
    Rows are told apart by themselves, so ids may be null or repeat.
    """
    from .state import stored

    names, done = ["response_1"], None
    rows, each = prompts(df, prompt, keep)
    told = stored(asked(each, "_prompt", model, "response_1", "call_error", concurrency, timeout))
    for n in range(2, retries + 2):
        usable = first_usable(names)[1].isNotNull()
        good = told.where(usable).drop("_prompt")
        done = good if done is None else done.unionByName(good, allowMissingColumns=True)
        # Prompts differ already, and so they do with firmer words.
        told = stored(asked(told.where(~usable).drop("call_error"), "_prompt", model, f"response_{n}", "call_error", concurrency, timeout, FIRMER))
        names.append(f"response_{n}")
    told = told.drop("_prompt")
    every = told if done is None else done.unionByName(told, allowMissingColumns=True)
    every = rows.join(every, F.col("_mine") == F.col("_digest"), "left")
    every = every.withColumn("call_error", F.when(first_usable(names)[1].isNull(), F.col("call_error")))
    return typed(every, names, (*keep, "call_error"))
