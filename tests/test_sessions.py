"""Capture sessions: the state machine, the stream around it, late results."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest

from rasterlab.streaming import jobs as J, sessions as Z

T0 = datetime(2024, 5, 1, 12, 0, 0)


def ev(action, minute=0, dataset="research", crop="onion", code="S001", files=("a.jpg",), n=1):
    return SimpleNamespace(action=action, at=T0.timestamp() + 60 * minute, generated=f"P240501-{n:06x}", dataset=dataset, crop=crop,
                           sample_code=code, files=list(files), event_id=n)


def play(*events):
    s, out = None, []
    for e in events:
        s, o = Z.advance(s, e)
        out.append(o)
    return s, out


def test_full_scan():
    s, out = play(ev("upload"), ev("skip"), ev("predict"))
    assert out == ["accepted", "skipped", "finished"] and s is None


def test_two_files_at_once_and_overflow():
    s, out = play(ev("upload", files=["a.jpg", "b.PNG"]), ev("upload"))
    assert out == ["accepted", "complete"] and s.captured == ["V1", "VISIBLE"]
    assert play(ev("upload", files=["a.jpg"] * 3))[1] == ["too_many_files"]


def test_required_step_cannot_be_skipped():
    s, out = play(ev("upload"), ev("retake", files=["x.gif"]), ev("skip"))
    assert out == ["accepted", "bad_file", "step_required"] and s.captured == []


def test_bad_file_keeps_earlier_ones():
    s, out = play(ev("upload", files=["a.jpg", "b.gif"]))
    assert out == ["bad_file"] and s.captured == ["V1"]


def test_dataset_and_crop_are_pinned():
    _, out = play(ev("upload"), ev("upload", dataset="public"), ev("upload", crop="garlic"), ev("predict", dataset="public"))
    assert out == ["accepted", "other_dataset", "other_crop", "other_dataset"]


def test_each_upload_renames():
    s, _ = play(ev("upload"), ev("upload", code="S002"))
    assert s.code == "S002"


def test_codes():
    assert play(ev("upload", code=" "))[1] == ["code_required"]
    assert play(ev("upload", code="x" * 33))[1] == ["code_too_long"]
    s, out = play(ev("upload", dataset="public", crop="garlic", code=""))
    assert out == ["accepted"] and s.code.startswith("P240501-") and s.crop == "onion"
    assert play(ev("upload", crop="leek"))[1] == ["bad_crop"]


def test_retake_after_skip_takes_the_uv_frame():
    s, out = play(ev("upload"), ev("skip"), ev("retake"))
    assert out[-1] == "accepted" and s.captured == ["VISIBLE"] and s.step == 2
    assert Z.advance(s, ev("predict"))[1] == "no_uv"


def test_retake_without_session_or_photo():
    assert play(ev("retake"))[1] == ["accepted"]
    assert play(ev("upload", files=["a.gif"]), ev("retake"))[1] == ["bad_file", "nothing_to_retake"]


def test_expiry_counts_from_creation():
    _, out = play(ev("upload"), ev("retake", 29), ev("skip", 31))
    assert out == ["accepted", "accepted", "no_session"]
    assert play(ev("upload"), ev("skip", 30))[1] == ["accepted", "skipped"]


@pytest.fixture()
def stream_of(spark, tmp_path):
    def make(batches, schema):
        src = str(tmp_path / "in")
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    return make


def row(session, n, action, minute, files=("a.jpg",)):
    return (session, n, T0 + timedelta(minutes=minute), action, "research", "onion", "S1", list(files))


def test_stream_keeps_state_between_batches(spark, tmp_path, stream_of):
    batches = [[row("a", 1, "upload", 0), row("b", 2, "upload", 1)], [row("a", 3, "skip", 2)],
               [row("a", 4, "predict", 3), row("b", 5, "skip", 40)], [row("c", 6, "upload", 300)],
               [row("c", 7, "skip", 301)]]
    out = J.run_to_files(Z.capture_sessions(stream_of(batches, Z.EVENT_SCHEMA), "10 minutes"), str(tmp_path / "out"))
    got = {r["event_id"]: r["outcome"] for r in out.where("event_id is not null").collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "skipped", 4: "finished", 5: "no_session", 6: "accepted", 7: "skipped"}
    done = out.where("outcome = 'finished'").first()
    assert list(done["captured"]) == ["V1"] and done["sample_code"] == "S1"


def test_timer_ends_idle_sessions(spark, tmp_path, stream_of):
    batches = [[row("a", 1, "upload", 0)], [row("b", 2, "upload", 200)], [row("b", 3, "skip", 201)]]
    out = J.run_to_files(Z.capture_sessions(stream_of(batches, Z.EVENT_SCHEMA), "10 minutes"), str(tmp_path / "out"))
    assert [r["session_id"] for r in out.where("outcome = 'expired'").collect()][:1] == ["a"]


def test_late_results_set_and_clear(spark, tmp_path, stream_of):
    first = spark.createDataFrame([(1, None, None), (2, 1, T0), (3, 0, T0)],
                                  "id bigint, compactdry_truth int, truth_recorded_at timestamp")
    schema = "id bigint, compactdry_truth int, patched_at timestamp"
    patches = stream_of([[(1, 1, T0)], [(2, None, T0 + timedelta(days=1)), (1, 0, T0 + timedelta(days=2))]], schema)
    out = J.upsert_truth(patches, first, str(tmp_path / "t")).collect()
    got = {r["id"]: (r["compactdry_truth"], r["truth_recorded_at"] is not None) for r in out}
    assert got == {1: (0, True), 2: (None, False), 3: (0, True)}
    log = spark.read.parquet(str(tmp_path / "t/data"))
    again = J.compacted(first, log, str(tmp_path / "snapshot"))
    assert {r["id"]: r["compactdry_truth"] for r in again.collect()} == {1: 0, 2: None, 3: 0}


def test_counts_follow_the_stream(spark, tmp_path, stream_of):
    s = stream_of([[("onion", 1), ("onion", 0)], [("garlic", None), ("onion", 1)]], "crop string, pred_label int")
    got = {(r[0], r[1]): r[2] for r in J.running_counts(s, str(tmp_path / "c")).collect()}
    assert got == {("onion", 1): 2, ("onion", 0): 1, ("garlic", None): 1}


def test_append_once(spark, tmp_path, stream_of):
    s = stream_of([[(1, "research", None)], [(2, "public", "onion")]], "id int, dataset string, crop string")
    got = J.append_scans(s, str(tmp_path / "a")).orderBy("id").select("id", "dataset", "crop").collect()
    assert [tuple(r) for r in got] == [(1, "research", "onion"), (2, "public", "onion")]


def test_bounded_join_releases_unmatched(spark, tmp_path, stream_of):
    a = stream_of([[(1, T0), (2, T0)], [(3, T0 + timedelta(days=30))], [(4, T0 + timedelta(days=60))]],
                  "id bigint, captured_at timestamp")
    src = str(tmp_path / "truth")
    for b in ([(1, 1, T0 + timedelta(days=1))], [(3, 0, T0 + timedelta(days=31))], [(9, 0, T0 + timedelta(days=61))]):
        spark.createDataFrame(b, "truth_id bigint, truth int, recorded_at timestamp").coalesce(1).write.mode(
            "append").parquet(src)
    t = spark.readStream.schema("truth_id bigint, truth int, recorded_at timestamp").option(
        "maxFilesPerTrigger", 1).parquet(src)
    out = J.run_to_files(J.joined_truth(a, t, "5 DAYS", "1 hour"), str(tmp_path / "j")).select("id", "truth").collect()
    got = {r[0]: r[1] for r in out}
    assert got[1] == 1 and got[3] == 0 and got.get(2, "held") is None


@pytest.mark.parametrize("zone", ["Asia/Bangkok", "America/New_York"])
def test_expiry_in_every_session_zone(spark, tmp_path, stream_of, zone):
    own = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        batches = [[row("a", 1, "upload", 0)], [row("b", 2, "upload", 200)], [row("b", 3, "skip", 201)], [row("c", 4, "upload", 202)]]
        out = J.run_to_files(Z.capture_sessions(stream_of(batches, Z.EVENT_SCHEMA), "10 minutes"), str(tmp_path / "out"))
        got = [tuple(r) for r in out.select("session_id", "outcome").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
    assert sorted(got) == [("a", "accepted"), ("a", "expired"), ("b", "accepted"), ("b", "skipped"), ("c", "accepted")]
