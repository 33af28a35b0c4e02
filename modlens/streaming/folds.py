"""Rules that depend on order, as folds over one key's records, in batch and in a stream.

A fold is a function (state, record) -> (state, outputs) on plain dicts. run_batch() applies it to each key's records in
their order over sorted partitions; run_stream() is the same fold over arriving records, its state kept by Spark. A key is a
user, an instruction hash, a node or an account epoch, and holds that one's history only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Fold = Callable[[dict, dict], tuple[dict, list[dict]]]


def run_batch(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """The fold over each key's records in their order, null first.

    Records are dealt by key and sorted where they lie, which spills, and go through in Arrow batches: a task holds one
    batch, the state of one key and what the batch made, however many records a key has. Records are dicts of plain
    values, None for null. Ties in `order` are in no stated order. There are as many tasks as the session shuffles into, not
    as few as it has cores, so that a task sorts its share of that number, however large the input.
    """
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = {}, object()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r[key] != now:
                    state, now = {}, r[key]
                state, rows = fold(state, r)
                out += rows
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=made)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def run_stream(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """Records of a key that arrive in one batch are put in order; those of later batches are taken as they come."""
    names = [f.split()[0] for f in schema.split(",")]

    def each(_key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for r in rows.to_dict("records"):
            state, made = fold(state, r)
            out += made
        held.update((json.dumps(state, default=str),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(each, schema, "state string", "append", GroupStateTimeout.NoTimeout)


# --- enforcement of a user's jobs -----------------------------------------------------------------------------------


def enforce(state: dict, job: dict, limit: int = 3, window: int = 10, disable_limit: int = 5, rule: str = "r1", escalate: bool = True) -> tuple[dict, list[dict]]:
    """Warning, escalation and disabling, a job at a time in the order of ids.

    job: id, user_id, eligible, violation, run_mode, role, user_status, disposition ('', immediate_disable or notice_only); counts, if
    there, says whether a violation may count. The warning
    looks at the last `window` eligible jobs after the rule was set; it fires once and is armed again when the window
    falls below the limit. Escalation follows the first warning of an async user. A disable needs disable_limit counted
    violations of an active user, or a category that disables at once; a notice-only category never disables.
    """
    s = {"armed": True, "recent": [], "count": 0, "escalated": False, "rule": rule} | state
    if s["rule"] != rule:
        s |= {"rule": rule, "recent": [], "armed": True}
    actions: list[str] = []
    if job["eligible"]:
        bad = bool(job["violation"])
        s["recent"] = [*s["recent"], [job["id"], bad]][-window:]
        if bad and job["role"] == "user" and job["disposition"] != "notice_only" and job.get("counts", True):
            s["count"] += 1
        if sum(b for _, b in s["recent"]) < limit:
            s["armed"] = True
        elif s["armed"] and bad:
            s["armed"] = False
            actions.append("warning")
            if escalate and job["run_mode"] == "async" and not s["escalated"]:
                s["escalated"] = True
                actions.append("escalation")
        may = bad and job["role"] == "user" and job.get("user_status", "active") == "active" and job["disposition"] != "notice_only"
        if may and (s["count"] >= disable_limit or job["disposition"] == "immediate_disable"):
            actions.append("disable")
    return s, [{"user_id": job["user_id"], "job_id": job["id"], "action": a, "counted": s["count"]} for a in actions]


#: Rows of a user's whole history: a job's verdict, a later round's, and what administrators and the sender of account actions do.
JOB, REAUDIT, RESET, SENT, RESET_DONE = range(5)


def enforce_all(state: dict, r: dict, limit: int = 3, window: int = 10, disable_limit: int = 5) -> tuple[dict, list[dict]]:
    """Enforcement with what changes it later, a row at a time in the order of (at, tag, id).

    r: tag, at, id, user_id, ok, and for jobs and their later rounds the job's fields as enforce() has them, with created (its time). Outputs have
    user_id, tag, id, action, counted:
    - a later round (REAUDIT) clears a job's violation: it counts no more in the window, and if it had counted towards a disable, and its job
      came after the last reset, the count goes down once (uncounted). `ok` says that it is the first round that clears the job.
    - a disable waits until it is sent (SENT), one at a time; sent, it takes effect (disabled) if `ok`, else its outcome is unknown.
    - a reset (RESET) is refused while a sent disable is unknown or another reset runs; else it cancels a disable that waits.
      When it is done (RESET_DONE) the user is active (enabled), the count 0, and jobs up to then count no more.
    """
    s = {"reset_at": None, "disable": "", "resetting": False, "off": False, "count": 0, "recent": [], "armed": True} | state
    acts: list[str] = []
    counts = s["reset_at"] is None or r["created"] is not None and r["created"] > s["reset_at"]
    if r["tag"] == JOB:
        s, made = enforce(s, r | {"counts": counts, "user_status": "disabled" if s["off"] else r["user_status"]}, limit=limit, window=window, disable_limit=disable_limit)
        acts = [o["action"] for o in made if o["action"] != "disable" or not s["disable"]]
        if "disable" in acts:
            s["disable"] = "waits"
    elif r["tag"] == REAUDIT:
        if r["ok"] and r["eligible"]:
            s["recent"] = [[i, bad and i != r["id"]] for i, bad in s["recent"]]
            if sum(b for _, b in s["recent"]) < limit:
                s["armed"] = True
            if r["violation"] and r["role"] == "user" and r["disposition"] != "notice_only" and counts:
                s["count"] = max(0, s["count"] - 1)
                acts = ["uncounted"]
    elif r["tag"] == RESET:
        if s["disable"] == "unknown" or s["resetting"]:
            acts = ["refused"]
        else:
            acts = ["cancelled", "reset"] if s["disable"] == "waits" else ["reset"]
            s |= {"disable": "", "resetting": True}
    elif r["tag"] == SENT:
        if s["disable"] == "waits":
            acts = ["disabled"] if r["ok"] else ["unknown"]
            s |= {"disable": "", "off": True} if r["ok"] else {"disable": "unknown"}
        elif s["disable"] == "unknown" and r["ok"]:
            acts = ["disabled"]
            s |= {"disable": "", "off": True}
    elif s["resetting"]:
        acts = ["enabled"]
        s |= {"resetting": False, "count": 0, "reset_at": r["at"], "off": False}
    return s, [{"user_id": r["user_id"], "tag": r["tag"], "id": r["id"], "action": a, "counted": s["count"]} for a in acts]


# --- count-once marks and breakers of an instruction hash ------------------------------------------------------------


def break_circuit(state: dict, mark: dict, users_to_trip: int = 2) -> tuple[dict, list[dict]]:
    """One violation of a hash by a user: repeated, countable or suppressed; the second user trips the breaker.

    mark: hash_key, user_id, job_id, event ('' for a violation, or trust, untrust or confirm by an operator). A tripped or
    trusted hash suppresses what comes; a confirmed one counts and never trips.
    """
    s = {"users": [], "status": ""} | state
    if mark["event"]:
        s["status"] = {"trust": "trusted", "confirm": "confirmed", "untrust": ""}[mark["event"]]
        return s, []
    if mark["user_id"] in s["users"]:
        outcome = "repeated"
    else:
        s["users"] = [*s["users"], mark["user_id"]]
        trips = not s["status"] and len(s["users"]) >= users_to_trip
        if trips:
            s["status"] = "tripped"
        outcome = "suppressed" if s["status"] in ("tripped", "trusted") else "countable"
    return s, [{"hash_key": mark["hash_key"], "user_id": mark["user_id"], "job_id": mark["job_id"], "outcome": outcome, "status": s["status"], "users": len(s["users"])}]


# --- calls for one text that run at the same time ---------------------------------------------------------------------


def join_flights(state: dict, r: dict) -> tuple[dict, list[dict]]:
    """Whether a target's evaluation joins one that runs (inflight), and the job whose it is.

    r: id (job), place, at, ends (when its job ends), reuse_after. A flight can be joined until the job that started it ends, by requests
    always and by a repeated audit if the flight started at reuse_after or later; else that one starts a flight in its place. The
    end of any job that started a flight takes the present one away.
    """
    s = {"flight": None, "ends": []} | state
    if any(e <= r["at"] for e in s["ends"]):
        s |= {"flight": None, "ends": [e for e in s["ends"] if e > r["at"]]}
    joins = s["flight"] is not None and (r["reuse_after"] is None or s["flight"][1] >= r["reuse_after"])
    if not joins:
        s |= {"flight": [r["id"], r["at"]], "ends": [*s["ends"], r["ends"]]}
    return s, [{"job_id": r["id"], "target_order": r["place"], "scored_by": s["flight"][0], "inflight": joins}]


# --- notices of a user ------------------------------------------------------------------------------------------------


def throttle(state: dict, notice: dict, gap_s: int = 3600) -> tuple[dict, list[dict]]:
    """A notice goes out if none went out within the gap; it tells how many were held back since."""
    at = notice["at_s"]
    if "sent" in state and at - state["sent"] < gap_s:
        s = state | {"held": state.get("held", 0) + 1}
        return s, [{"user_id": notice["user_id"], "id": notice["id"], "sent": False, "held_back": s["held"]}]
    held = state.get("held", 0)
    return {"sent": at, "held": 0}, [{"user_id": notice["user_id"], "id": notice["id"], "sent": True, "held_back": held}]


# --- health of a scoring node -----------------------------------------------------------------------------------------

MISCONFIGURED = frozenset(("invalid_model", "node_unavailable", "credential_binding_unavailable", "audit_node_recursion"))


#: Stages whose failures are the node's.
HEALTH_STAGES = frozenset(("config", "model_request", "response_parse"))


def node_health(state: dict, call: dict) -> tuple[dict, list[dict]]:
    """healthy, degraded after one failure, cooldown after two in a row or a rate limit, misconfigured by its own fault.

    call: model_id, at_s, latency_ms, error ('' if it succeeded), stage, retryable, retry_after_s. A failure of another
    stage than HEALTH_STAGES says nothing of the node. The first call after a cooldown is a probe of a half open node. The latency is smoothed: a
    fifth of the new value and four fifths of the old.
    """
    s = {"health": "unknown", "fails": 0, "opened": 0, "until": None, "latency": None, "calls": 0} | state
    s["calls"] += 1
    if call["error"] and call.get("stage", "model_request") not in HEALTH_STAGES:
        return s, []
    if s["health"] == "cooldown" and s["until"] is not None and call["at_s"] >= s["until"]:
        s["health"] = "half_open"  # its cooldown is over: this call is the probe
    if call["latency_ms"] and call["latency_ms"] > 0:
        s["latency"] = float(call["latency_ms"]) if s["latency"] is None else 0.2 * call["latency_ms"] + 0.8 * s["latency"]
    error = call["error"]
    if not error:
        s |= {"health": "healthy", "fails": 0, "opened": 0, "until": None}
    elif error in MISCONFIGURED or error == "upstream_http_error" and not call["retryable"]:
        s |= {"health": "misconfigured", "until": None}
    else:
        s["fails"] += 1
        limited = error == "rate_limited"
        if limited or s["fails"] >= 2:
            s["opened"] += 1
            wait = (call["retry_after_s"] or 30) if limited else min(300, 15 * 2 ** (s["opened"] - 1))
            s |= {"health": "cooldown", "until": int(call["at_s"] + wait)}
        else:
            s["health"] = "degraded"
    return s, [{"model_id": call["model_id"], "at_s": call["at_s"], "health": s["health"], "cooldown_until": s["until"], "latency_ewma": s["latency"], "calls": s["calls"], "error": error}]


# --- weekly windows of an account ---------------------------------------------------------------------------------------

WEEK_S, ADVANCE_S, TOLERANCE_S = 7 * 86400, 7 * 86400 - 3600, 60


def detect_reset(state: dict, sample: dict, advance_s: int = ADVANCE_S) -> tuple[dict, list[dict]]:
    """Whether a sample of an account's weekly window shows a reset.

    sample: epoch, now_s, fetched_s, reset_s (0 if absent), used, upstream. A sample that is off by more than a minute or
    isn't newer than the last is refused. The first sample, and one of another upstream account, only sets the baseline. A
    later reset time counts as a reset when the old edge has passed, or before it if the window was used; an unused
    window drifts. Without a reset time, an unused window past its edge has ended: the event is sent at once and the next
    window only sets the baseline.
    """
    s = {"base": None, "used": None, "fetched": None, "awaiting": False, "upstream": None, "epoch": sample["epoch"]} | state
    if s["epoch"] != sample["epoch"]:
        s = {"base": None, "used": None, "fetched": None, "awaiting": False, "upstream": None, "epoch": sample["epoch"]}
    now, reset, event, at, rule = sample["now_s"], sample["reset_s"], None, None, ""

    def done() -> tuple[dict, list[dict]]:
        return s, [{"epoch": sample["epoch"], "fetched_s": sample["fetched_s"], "rule": rule, "event_key": event, "reset_at_s": at, "baseline_s": s["base"]}]

    if sample["used"] < 0 or abs(now - sample["fetched_s"]) > TOLERANCE_S or s["fetched"] is not None and sample["fetched_s"] <= s["fetched"]:
        rule = "refused"
        return done()
    other = bool(sample["upstream"] and s["upstream"] and sample["upstream"] != s["upstream"])
    s["upstream"] = sample["upstream"] or s["upstream"]
    if other or s["base"] is None:
        s |= {"base": None, "awaiting": False}
    base = s["base"]
    key = f"automatic:{sample['epoch']}:{base}"
    if reset > now:
        ahead = None if base is None else reset - base
        if base is None:
            rule = "first"
        elif s["awaiting"]:
            rule, s["awaiting"] = "awaited", False
        elif ahead > advance_s and now >= base:
            rule, event, at = "natural", key, max(base, reset - WEEK_S)
        elif ahead > advance_s and (s["used"] or 0) > 0:
            rule, event, at = "early", key, sample["fetched_s"]
        elif ahead > advance_s:
            rule = "drift"
        else:
            rule = "back" if ahead < -advance_s else "same"
        s["base"] = reset
    elif reset > 0:
        rule = "not_switched"
    elif base is not None and not s["awaiting"] and now >= base and sample["used"] == 0:
        rule, event, at = "ended", key, base
        s["awaiting"] = True
    else:
        rule = "no_reset_time"
    s |= {"used": sample["used"], "fetched": sample["fetched_s"]}
    return done()


# --- token bucket of a connection -----------------------------------------------------------------------------------------


def token_bucket(state: dict, request: dict, burst: float = 40, rate: float = 20) -> tuple[dict, list[dict]]:
    left = min(burst, state.get("left", burst) + rate * max(0.0, request["at_s"] - state.get("at", request["at_s"])))
    ok = left >= 1
    return {"left": left - ok, "at": request["at_s"]}, [{"connection": request["connection"], "id": request["id"], "allowed": ok}]


def moving(fold: Fold, **settings) -> Fold:
    """The fold with other settings than its defaults."""
    return partial(fold, **settings)
