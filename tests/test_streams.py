"""Streams over several batches: redelivery, duplicates across batches, and windows that expire."""

from datetime import datetime

from pyspark.sql import functions as F

from inkproof.streaming import arrivals, rates

SCHEMA = "document_id string, vendor_name string, invoice_number string, received_at timestamp, seq long"


def batch(spark, path, *rows):
    spark.createDataFrame([(i, v, n, datetime(2024, 1, day), int(i)) for i, v, n, day in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def found(rows):
    return rows.select("document_id", "duplicate_count", "duplicate_ids")


def test_duplicates_across_batches_and_a_batch_that_comes_again(spark, tmp_path):
    def arrive():
        stream = arrivals.record_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)
        q = arrivals.run(stream, found, f"{tmp_path}/store", f"{tmp_path}/checkpoint", looked_up=True)
        q.awaitTermination()
        return {r.document_id: (r.duplicate_count, r.duplicate_ids) for r in arrivals.stored_rows(spark, f"{tmp_path}/store").collect()}, q

    batch(spark, f"{tmp_path}/in", ("1", "Acme", "A-1", 1), ("2", " ACME ", "a-1", 2), ("3", None, "A-1", 3))
    batch(spark, f"{tmp_path}/in", ("4", "acme", "A-1", 4), ("2", "Acme", "A-1", 5), ("5", "Other", "A-1", 1))
    want = {"1": (0, []), "2": (1, ["1"]), "3": (0, []), "4": (2, ["1", "2"]), "5": (0, [])}
    assert arrive()[0] == want
    batch(spark, f"{tmp_path}/in", ("4", "acme", "A-1", 4), ("6", "acme", "A-1", 6), ("7", "acme", "A-1", 6))
    got, q = arrive()
    assert got == want | {"6": (3, ["1", "2", "4"]), "7": (4, ["1", "2", "4"])}
    assert len(list((tmp_path / "store/rows").glob("batch=*"))) == 3 and [p.name for p in (tmp_path / "store").iterdir()] == ["rows"]
    # State: a row for each id and one for each key, whatever number of rows has it.
    assert sorted(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == [2, 7]


def test_a_batch_run_twice_overwrites_itself(spark, tmp_path):
    """As after a crash between a batch's write and its commit."""
    batch(spark, f"{tmp_path}/in", ("1", "Acme", "A-1", 1))
    batch(spark, f"{tmp_path}/in", ("2", "Acme", "A-1", 2))
    for number in (None, 1, 0):
        if number is not None:  # the commit of this batch is lost, and of all after it
            for k in range(number, 2):
                for name in (f"{k}", f".{k}.crc"):
                    (tmp_path / "checkpoint/commits" / name).unlink(missing_ok=True)
        stream = arrivals.record_stream(spark, f"{tmp_path}/in", SCHEMA, 1)
        arrivals.run(stream, found, f"{tmp_path}/store", f"{tmp_path}/checkpoint", looked_up=True).awaitTermination()
        assert sorted(tuple(r) for r in arrivals.stored_rows(spark, f"{tmp_path}/store").collect()) == [("1", 0, []), ("2", 1, ["1"])]
        if number == 1:
            break


def test_a_later_batch_reads_what_an_early_one_reads(spark, tmp_path):
    """However many batches came before, a batch reads its own file and the state of its own keys."""
    for k in range(12):
        batch(spark, f"{tmp_path}/in", *[(str(10 * k + i), f"V{k % 3}", f"N{i}", 1) for i in range(4)])
    stream = arrivals.record_stream(spark, f"{tmp_path}/in", SCHEMA, 1)
    q = arrivals.run(stream, found, f"{tmp_path}/store", f"{tmp_path}/checkpoint", looked_up=True)
    q.awaitTermination()
    read = [[s["customMetrics"].get("rocksdbGetCount", 0) for s in p["stateOperators"]] for p in q.recentProgress if p["numInputRows"]]
    assert len(read) == 12 and read[-1] == read[3]
    assert arrivals.stored_rows(spark, f"{tmp_path}/store").where("duplicate_count = 3").count() == 12


def test_requests_are_numbered_as_they_arrive(spark, tmp_path):
    """Numbers go on over batches; a window's state goes when the watermark passes its end, and what comes later is left out."""
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([("u", "10:00:05"), ("u", "10:00:50"), ("v", "10:00:50")], [("u", "10:00:55"), (None, "10:00:59"), ("u", "10:01:00")], [("u", "10:00:20")], [("u", "10:30:00")], [("u", "10:00:30"), ("u", "10:30:01")], [("v", "11:00:00")], [("v", "11:00:01")]):
        spark.createDataFrame([(u, datetime.fromisoformat(f"2024-01-01 {t}")) for u, t in rows], "user string, at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = arrivals.record_stream(spark, path, "user string, at timestamp", 1)
    q = rates.numbered(stream, "user", "at", 2).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user, r.t): (r.n, r.over_limit, r.w) for r in spark.read.parquet(out).select("user", F.date_format("at", "HH:mm:ss").alias("t"), "n", "over_limit", F.date_format("window_start", "HH:mm").alias("w")).collect()}
    assert got == {
        ("u", "10:00:05"): (1, False, "10:00"), ("u", "10:00:50"): (2, False, "10:00"), ("v", "10:00:50"): (1, False, "10:00"), ("u", "10:00:55"): (3, True, "10:00"), (None, "10:00:59"): (1, False, "10:00"), ("u", "10:01:00"): (1, False, "10:01"),
        ("u", "10:00:20"): (4, True, "10:00"), ("u", "10:30:00"): (1, False, "10:30"), ("u", "10:30:01"): (2, False, "10:30"), ("v", "11:00:00"): (1, False, "11:00"), ("v", "11:00:01"): (2, False, "11:00"),
    }
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 4  # the open window and its timer


def test_windows_expire(spark, tmp_path):
    """Append mode: a window comes out once when the watermark has passed it; what comes later still is left out, and no state stays."""
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for times in (["10:00:05", "10:00:50", "10:01:10"], ["10:10:00"], ["10:10:10"], ["10:00:30", "10:10:20"], ["10:30:00"], ["10:31:00"]):
        spark.createDataFrame([("u", datetime.fromisoformat(f"2024-01-01 {t}")) for t in times], "user string, at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = arrivals.record_stream(spark, path, "user string, at timestamp", 1)
    q = rates.counts(stream, "user", "at", 1).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.w, r.n, r.over_limit) for r in spark.read.parquet(out).select(F.date_format("window_start", "HH:mm").alias("w"), "n", "over_limit").collect())
    assert got == [("10:00", 2, True), ("10:01", 1, False), ("10:10", 3, True)]
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 2


def test_a_key_costs_one_read_and_one_write_of_state():
    """Rows go through as they are, without a frame for each key; nulls come first among invoices, last among requests."""
    from pyspark.sql import Row

    from inkproof.streaming.keyed import FirstOfKey, NumberInWindow

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    first = FirstOfKey(["order0"])
    first.seen = State()
    row = lambda i, at: Row(keyless=False, own_id=i, order0=at, packed=f"p{i}")
    got = [tuple(r) for r in first.handleInputRows(("k",), iter([row("2", 5), row("1", None)]), None)]
    got += [tuple(r) for r in first.handleInputRows(("k",), iter([row("4", 7), row("3", 6)]), None)]
    assert got == [("p1", 0, []), ("p2", 1, ["1"]), ("p3", 2, ["1", "2"]), ("p4", 3, ["1", "2", "3"])]
    assert first.seen.calls == 4 and first.seen.value == (4, ["1", "2", "3"])

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

    number = NumberInWindow(["user", "_window"], ["user", "at", "_window"], "at", ["e"], 1, 60)
    number.count, number.handle = State(), Handle()
    for want in ([("u", 1, 60, 1, False), ("u", 1, 60, 2, True)], [("u", 1, 60, 3, True), ("u", 1, 60, 4, True)]):
        assert [tuple(r) for r in number.handleInputRows(("u", 60), iter([Row(at=1, e=None), Row(at=1, e=2)]), Timers())] == want
    assert number.count.calls == 4 and Handle.timers == [120_000]


def test_keys_go_through_python_by_groups(spark, tmp_path):
    """Rows of several keys are handled in one call, each key by one read and one write of its own state."""
    from pyspark.sql import Row

    from inkproof.streaming.keyed import FirstOfKeys

    class Entries:
        values, calls = {}, []

        def getValue(self, key):
            self.calls.append(("get", *key))
            return self.values.get(key)

        def updateValue(self, key, value):
            self.calls.append(("put", *key))
            self.values[key] = value

    keys = FirstOfKeys(["order0"])
    keys.entries = Entries()
    row = lambda k, i, at, keyless=False: Row(key=k, keyless=keyless, own_id=i, order0=at, packed=f"p{i}")
    got = [tuple(r) for r in keys.handleInputRows((7,), iter([row("b", "2", 5), row("a", "1", 9), row("b", "3", 4), row("\x02x", "4", 1, True)]), None)]
    assert got == [("p4", 0, []), ("p1", 0, []), ("p3", 0, []), ("p2", 1, ["3"])]
    assert [tuple(r) for r in keys.handleInputRows((7,), iter([row("b", "5", 1)]), None)] == [("p5", 2, ["3", "2"])]
    assert Entries.calls == [(c, k) for k in ("a", "b", "b") for c in ("get", "put")]

    n = 300  # more rows than groups that they meet, so that some share one
    arrivals_in = [(str(i), f"V{i % 150}", "N", 1 + i // 150) for i in range(n)]
    batch(spark, f"{tmp_path}/in", *arrivals_in[:200])
    batch(spark, f"{tmp_path}/in", *arrivals_in[200:])
    real, arrivals.GROUPS = arrivals.GROUPS, 5
    try:
        stream = arrivals.record_stream(spark, f"{tmp_path}/in", SCHEMA, 1)
        q = arrivals.run(stream, found, f"{tmp_path}/store", f"{tmp_path}/checkpoint", looked_up=True)
        q.awaitTermination()
    finally:
        arrivals.GROUPS = real
    got = {r.document_id: (r.duplicate_count, r.duplicate_ids) for r in arrivals.stored_rows(spark, f"{tmp_path}/store").collect()}
    assert got == {str(i): (i // 150, [str(i - 150)] if i >= 150 else []) for i in range(n)}
    assert sorted(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == [150, 300]
