"""Sessions whose events arrive out of order, one file a micro-batch; counts over restarts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rasterlab.streaming import jobs as J, sessions as Z

T0 = datetime(2024, 5, 1, 12, 0, 0)


def events(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = T0 + timedelta(seconds=r.choice([r.randrange(0, 9000), 60 * r.randrange(150)]))
        rows.append((f"s{r.randrange(4)}", i, t, r.choice(["upload", "upload", "retake", "skip", "predict"]), "research", r.choice(["onion", "onion", "garlic"]),
                     r.choice(["A", "A", "", "B"]), r.choice([["a.jpg"], ["a.jpg", "b.png"], ["x.gif"], None])))
    return rows


def applied_in_order(rows, at):
    """(session, event, outcome, step) of the machine on each session's events in order."""
    out = []
    for name in sorted({r[0] for r in rows}):
        pending = [Z._event(at[r[1]], r[1], r[2], r[3], r[4], r[5], r[6], r[7], None) for r in rows if r[0] == name]
        for x in pending:
            x.generated = f"P{x.ts:%y%m%d}-{x.event_id:06x}"
        _, left, got = Z.released((name,), None, pending, 1e12)
        assert not left
        out += [(name, g[1], g[4], g[9]) for g in got if g[1] is not None]
    return sorted(out)


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    rows = events(3)
    d = spark.createDataFrame(rows, Z.EVENT_SCHEMA)
    at = {r.event_id: r.at for r in d.select("event_id", (F.unix_micros("ts") / 1e6).alias("at")).collect()}
    # arrival: up to 40 minutes late, five events a file, every file a micro-batch of its own
    r = random.Random(5)
    arrival = sorted(rows, key=lambda e: e[2] + timedelta(minutes=r.randrange(40)))
    src = str(tmp_path / "in")
    Z.closing(spark).limit(0).write.parquet(src)
    for i in range(0, len(arrival), 5):
        spark.createDataFrame(arrival[i:i + 5], Z.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(Z.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = J.run_until_closed(Z.ordered_sessions(stream), str(tmp_path / "out"), lambda: Z.closing(spark).write.mode("append").parquet(src)).collect()
    got = sorted((x.session_id, x.event_id, x.outcome, x.step) for x in out if x.event_id is not None)
    assert got == applied_in_order(rows, at)
    assert len({x[2] for x in got}) > 5
    assert any(x.outcome == "expired" for x in out)
    assert not [x for x in out if x.session_id == Z.CLOSING]


def test_events_wait_for_the_watermark():
    first, second = Z._event(100, 2, T0, "predict", "research", "onion", "A", None, "P"), Z._event(50, 1, T0, "upload", "research", "onion", "A", ["a.jpg"], "P")
    s, left, out = Z.released(("k",), None, [first, second], 60)
    assert [x[4] for x in out] == ["accepted"] and left == [first] and s.step == 1
    s, left, out = Z.released(("k",), s, left, 100)
    assert [x[4] for x in out] == ["finished"] and not left and s is None
    s, left, out = Z.released(("k",), None, [second], 1e6)  # nothing else comes: it runs out
    assert [x[4] for x in out] == ["accepted", "expired"] and s is None
    again = Z._event(50 + 3600, 3, T0, "upload", "research", "onion", "A", ["a.jpg"], "P")
    _, _, out = Z.released(("k",), None, [again, second], 3700)
    assert [x[4] for x in out] == ["accepted", "expired", "accepted"]


def test_counts_after_a_run_without_new_data(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("crop string, pred_label int").parquet(src)
        return {(r.crop, r.n) for r in J.running_counts(stream, out, ("crop",)).collect()}

    def add(*crops):
        spark.createDataFrame([(c, 1) for c in crops], "crop string, pred_label int").coalesce(1).write.mode("append").parquet(src)
    add("onion", "onion", "garlic")
    assert run() == {("onion", 2), ("garlic", 1)}
    add("onion")
    assert run() == {("onion", 3), ("garlic", 1)}
    assert run() == {("onion", 3), ("garlic", 1)}


def test_output_columns_are_typed_not_guessed():
    import pandas as pd

    from rasterlab.streaming import sessions as Z
    ts = pd.Timestamp("2024-01-05 03:04:05.123456")
    rows = [("s", 2 ** 53 + 1, ts, "upload", "accepted", "research", "onion", "S", ["V1"], 1, False),
            ("s", None, None, "timer", "expired", "research", "onion", "S", [], 1, False)]
    got = Z._frame(rows)
    assert [str(t) for t in got.dtypes[["event_id", "ts", "step", "all_captured"]]] == ["Int64", "datetime64[us]", "int32", "bool"]
    assert got["event_id"][0] == 2 ** 53 + 1 and got["event_id"].isna()[1]
    assert got["ts"][0] == ts and got["ts"].isna()[1] and got["captured"][0] == ["V1"]
