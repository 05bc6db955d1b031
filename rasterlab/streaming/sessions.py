"""Capture sessions as keyed state.

A session collects photos step by step and ends with a scan. Its dataset and
crop are fixed when it is created; it lives thirty minutes from then, however
busy it is.
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterlab import params as P
from rasterlab.functions.scalar import generated_code

EVENT_SCHEMA = ("session_id string, event_id bigint, ts timestamp, action string, dataset string, crop string, "
                "sample_code string, files array<string>")
OUTPUT_SCHEMA = ("session_id string, event_id bigint, ts timestamp, action string, outcome string, dataset string, "
                 "crop string, sample_code string, captured array<string>, step int, all_captured boolean")
STATE_SCHEMA = "created double, dataset string, crop string, code string, step int, captured array<string>"
PENDING = ["at", "event_id", "ts", "action", "dataset", "crop", "sample_code", "files", "generated"]
ORDERED_STATE = STATE_SCHEMA + ", pending array<string>"  # waiting events as JSON

CLOSING = "\x00end"  # session of the event that ends a stream

KIND = {name: kind for name, kind, _ in P.CAPTURE_STEPS}


@dataclass
class Session:
    created: float
    dataset: str
    crop: str
    code: str
    step: int = 0
    captured: list = field(default_factory=list)


def _extension(name: str) -> str:
    return ("." + name.rsplit(".", 1)[1].lower()) if "." in name else ""


@dataclass
class Upload:
    """What an upload or retake asks for."""
    crop: str
    code: str
    files: list
    retake: bool


# Rules in order: the first that holds names the outcome. These come before a session is opened or touched,
UPLOAD_RULES = [
    ("bad_crop", lambda e, u: u.crop not in P.CROPS),
    ("code_required", lambda e, u: not u.code and e.dataset == "research"),
    ("code_too_long", lambda e, u: len(u.code) > P.CODE_MAX_CHARS),
    ("no_files", lambda e, u: not u.files),
]
# these once it is open, before its code is renamed,
OPEN_RULES = [
    ("other_dataset", lambda s, e, u: s.dataset != e.dataset),
    ("other_crop", lambda s, e, u: s.crop != u.crop),
]
# these before its steps move (``left`` steps are open),
STEP_RULES = [
    ("nothing_to_retake", lambda s, u, left: u.retake and not s.captured),
    ("complete", lambda s, u, left: left <= 0),
    ("too_many_files", lambda s, u, left: len(u.files) > left),
]
# and these are for the other actions of an open session.
SKIP_RULES = [
    ("complete", lambda s, steps: s.step >= len(steps)),
    ("step_required", lambda s, steps: steps[s.step][2]),
]
PREDICT_RULES = [
    ("other_dataset", lambda s, e: s.dataset != e.dataset),
    ("no_uv", lambda s, e: not any(KIND[c] == "uv" for c in s.captured)),
]


def _first(rules, *facts) -> str | None:
    return next((outcome for outcome, holds in rules if holds(*facts)), None)


def advance(s: Session | None, e, steps=tuple(P.CAPTURE_STEPS)) -> tuple[Session | None, str]:
    """The session after one event, and the event's outcome.

    ``e.at`` is the event's time in seconds since the epoch, ``e.generated`` the code for an event without one.
    """
    if s is not None and e.at - s.created > P.SESSION_TTL_SECONDS:
        s = None
    if e.action in ("upload", "retake"):
        return _capture(s, e, steps)
    if s is None:
        return None, "no_session"
    if e.action == "skip":
        refused = _first(SKIP_RULES, s, steps)
        s.step += refused is None
        return s, refused or "skipped"
    refused = _first(PREDICT_RULES, s, e)
    return (s, refused) if refused else (None, "finished")


def _capture(s, e, steps):
    u = Upload("onion" if e.dataset == "public" else (e.crop or "onion").strip(), (e.sample_code or "").strip(),
               [] if e.files is None else list(e.files), e.action == "retake" and s is not None)
    if refused := _first(UPLOAD_RULES, e, u):
        return s, refused
    code = u.code or e.generated
    s = s or Session(e.at, e.dataset, u.crop, code)
    if refused := _first(OPEN_RULES, s, e, u):
        return s, refused
    s.code = code  # every upload renames the session
    back = int(u.retake and bool(s.captured))
    refused = _first(STEP_RULES, s, u, len(steps) - max(0, s.step - back))
    if back:
        s.captured.pop()
        s.step = max(0, s.step - 1)
    if refused:
        return s, refused
    good = list(takewhile(lambda f: _extension(f) in P.UPLOAD_EXTENSIONS, u.files))  # files before a bad one stay in
    s.captured += [name for name, _, _ in steps[s.step:s.step + len(good)]]
    s.step += len(good)
    return s, "accepted" if len(good) == len(u.files) else "bad_file"


def _rows(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        _, dataset, crop, code, step, captured = state.get
        state.remove()
        yield pd.DataFrame([(key[0], None, None, "timer", "expired", dataset, crop, code, list(captured), step, False)],
                           columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]).astype({"event_id": "Int64"})
        return
    s = Session(*state.get) if state.exists else None
    if s is not None:
        s.captured = list(s.captured)
    # one session's events of one micro-batch, put in order
    batch = pd.concat(list(pdfs)).sort_values(["at", "event_id"])
    out = []
    for e in batch.itertuples(index=False):
        before = s
        s, outcome = advance(s, e)
        seen = before if outcome == "finished" else s
        done = seen is not None and seen.step >= len(P.CAPTURE_STEPS)
        out.append((key[0], e.event_id, e.ts, e.action, outcome, seen.dataset if seen else e.dataset,
                    seen.crop if seen else e.crop, seen.code if seen else e.sample_code,
                    list(seen.captured) if seen else [], seen.step if seen else 0, bool(done)))
    if s is None:
        if state.exists:
            state.remove()
    else:
        state.update((s.created, s.dataset, s.crop, s.code, s.step, s.captured))
        ends = int((s.created + P.SESSION_TTL_SECONDS) * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")])


def _expired(key, s: Session) -> tuple:
    return key[0], None, None, "timer", "expired", s.dataset, s.crop, s.code, list(s.captured), s.step, False


def _outcome(key, e, before: Session | None, s: Session | None, outcome: str) -> tuple:
    seen = before if outcome == "finished" else s
    done = seen is not None and seen.step >= len(P.CAPTURE_STEPS)
    return (key[0], e.event_id, e.ts, e.action, outcome, seen.dataset if seen else e.dataset, seen.crop if seen else e.crop,
            seen.code if seen else e.sample_code, list(seen.captured) if seen else [], seen.step if seen else 0, bool(done))


def released(key, s: Session | None, pending: list, watermark: float) -> tuple[Session | None, list, list[tuple]]:
    """The session after all pending events up to the watermark, in order of time and id; the events still
    pending; and a row per event and per session that ran out."""
    pending = sorted(pending, key=lambda e: (e.at, e.event_id is None, e.event_id or 0))
    due = [e for e in pending if e.at <= watermark]
    out = []
    for e in due:
        if s is not None and e.at - s.created > P.SESSION_TTL_SECONDS:
            out.append(_expired(key, s))
            s = None
        before = s
        s, outcome = advance(s, e)
        out.append(_outcome(key, e, before, s, outcome))
    if s is not None and s.created + P.SESSION_TTL_SECONDS < watermark:
        out.append(_expired(key, s))
        s = None
    return s, pending[len(due):], out


def _ordered_rows(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    s = None if held is None or held[0] is None else Session(*held[:5], list(held[5]))
    pending = [] if held is None else [_event(*json.loads(x)) for x in held[6]]
    if not state.hasTimedOut:
        pending += [_event(*r) for pdf in pdfs for r in pdf[PENDING].itertuples(index=False)]
    watermark = state.getCurrentWatermarkMs()
    s, pending, out = released(key, s, pending, watermark / 1000)
    if s is None and not pending:
        if state.exists:
            state.remove()
    else:
        own = (None, None, None, None, None, None) if s is None else (s.created, s.dataset, s.crop, s.code, s.step, s.captured)
        state.update((*own, [json.dumps([str(v) if n == "ts" else v for n, v in vars(e).items()]) for e in pending]))
        ends = [] if s is None else [s.created + P.SESSION_TTL_SECONDS]
        soon = min([e.at for e in pending[:1]] + ends)
        state.setTimeoutTimestamp(max(int(soon * 1000), watermark) + 1)
    if out:
        yield _frame(out)


OUTPUT = [c.split() for c in OUTPUT_SCHEMA.split(", ")]
DTYPES = {"bigint": "Int64", "timestamp": "datetime64[us]", "int": "int32", "boolean": "bool"}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Output rows by column, types given: pandas takes far longer to find them out, and there is a frame per session."""
    return pd.DataFrame({name: pd.array(list(v), dtype=DTYPES.get(kind, object)) for (name, kind), v in zip(OUTPUT, zip(*rows))}, copy=False)


def _event(at, event_id, ts, action, dataset, crop, sample_code, files, generated) -> SimpleNamespace:
    known = event_id is not None and event_id == event_id
    return SimpleNamespace(at=float(at), event_id=int(event_id) if known else None, ts=pd.Timestamp(ts), action=action, dataset=dataset, crop=crop,
                           sample_code=sample_code, files=None if files is None else [str(f) for f in files], generated=generated)


def ordered_sessions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """As ``capture_sessions``, with events applied in the order of their times across micro-batches.

    Events wait in the session's state until the watermark has passed them, so one that arrives up to ``delay``
    late takes its place; later ones are dropped by the stream. What waits per session is what arrives within ``delay``.
    A session that runs out gives an ``expired`` row, also when a later event begins the next one. The last ``delay`` of a stream that ends is
    released by an event with a later time (``closing``). Events without a time are never released.
    """
    timed = events.where("ts IS NOT NULL").withWatermark("ts", delay).withColumns({
        "at": F.unix_micros("ts") / 1e6, "generated": generated_code(F.col("ts"), F.col("event_id"))})
    return (timed.groupBy("session_id")
            .applyInPandasWithState(_ordered_rows, OUTPUT_SCHEMA, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)
            .where(F.col("session_id") != CLOSING))


def closing(spark, ts: str = "2200-01-01 00:00:00") -> DataFrame:
    """One event that ends a stream of events."""
    row = spark.range(1).select(F.lit(CLOSING).alias("session_id"), F.lit(None).cast("bigint").alias("event_id"),
                                F.lit(ts).cast("timestamp").alias("ts"), F.lit("predict").alias("action"))
    return row.selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (x.split(" ", 1) for x in EVENT_SCHEMA.split(", ")[4:])])


def capture_sessions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One outcome row per event. ``finished`` rows are completed scans,
    ``expired`` rows come from the timer, the rest are steps and rejects.

    ``events`` is a stream with ``EVENT_SCHEMA``. A session's share of one
    micro-batch is put in order inside its task, so limit the batch with the
    source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``. Times are
    compared as seconds since the epoch, whatever the session's time zone.
    """
    timed = events.withWatermark("ts", delay).withColumns({  # the same in every session time zone
        "at": F.unix_micros("ts") / 1e6, "generated": generated_code(F.col("ts"), F.col("event_id"))})
    return (timed.groupBy("session_id")
            .applyInPandasWithState(_rows, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))
