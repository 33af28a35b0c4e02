"""Admission of requests: which ones go on with a turn that is known, and which start a job.

The turn table maps a turn key (API key and fingerprint) to its job, state and verdict; the response table maps the id of
a reply to the turn key it was made for. An entry lives for `ttl` after its last use: a look-up that finds it prolongs it.
Requests of one API key depend on each other in their order, those of different keys don't, so both forms here deal by
API key: admitted() over sorted partitions, admitted_stream() with Spark's map states, which end by themselves.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from modlens.streaming import folds

#: How long an entry lives, in microseconds.
TTL = 30 * 60 * 1_000_000
LOG = "user_id long, at long, tag int, id long, turn string, continuation boolean, previous string, mode string, status string, decision string"
ADMITTED = "user_id long, id long, kind string, job_id long, error string, turn string"
REQUEST, VERDICT, REPLY = 0, 1, 2


class Table:
    """Entries by key, for ttl after their last use. Uses come in the order of time, so the oldest entry is the first."""

    def __init__(self, ttl: int):
        self.ttl, self.held = ttl, OrderedDict()

    def find(self, key: str, at: int) -> tuple | None:
        while self.held:
            oldest = next(iter(self.held))
            if at - self.held[oldest][-1] < self.ttl:
                break
            del self.held[oldest]
        return self.held.get(key)

    def put(self, key: str, entry: tuple) -> None:
        self.held[key] = entry
        self.held.move_to_end(key)


class Kept:
    """The same over a map state. Spark drops entries that weren't written for a while; the time in an entry decides whether it counts."""

    def __init__(self, state, ttl: int):
        self.state, self.ttl = state, ttl

    def find(self, key: str, at: int) -> tuple | None:
        entry = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return entry if entry is not None and at - entry[-1] < self.ttl else None

    def put(self, key: str, entry: tuple) -> None:
        self.state.updateValue((key,), entry)


def bound(entry: tuple, mode: str) -> tuple[str, str | None]:
    """What a request gets whose turn has a job already."""
    _, status, decision, _ = entry
    if status == "done":
        kind = {"block": "block", "review": "flag"}.get(decision, "allow")
        return kind, "third_party_audit_blocked" if kind == "block" else None
    return ("allow" if mode == "async" else "wait"), None


def admit(turns: Any, replies: Any, jobs: Any, r: dict) -> dict | None:
    """Takes one row of the log and gives what a request gets; None for verdicts and replies.

    A continuation looks for the turn of the reply that it names, or else its own; one that finds none is taken as a first
    request. A first request whose turn is known gets what that has, else it starts a job. A verdict counts for a request that
    started one. A reply is entered for its request's own turn, whatever turn that was bound to.
    """
    at, own = r["at"], r["turn"]
    if r["tag"] == VERDICT:
        if jobs.find(str(r["id"]), at):
            turns.put(own, (r["id"], r["status"], r["decision"], at))
        return None
    if r["tag"] == REPLY:
        replies.put(f"r{r['id']}", (own, at))
        return None
    tried = []
    if r["continuation"]:
        told = replies.find(r["previous"], at) if r["previous"] else None
        if told:
            replies.put(r["previous"], (told[0], at))
        tried.append(told[0] if told else own)
    for key in [*tried, own]:
        entry = turns.find(key, at)
        if entry:
            turns.put(key, (*entry[:-1], at))
            kind, error = bound(entry, r["mode"])
            return {"user_id": r["user_id"], "id": r["id"], "kind": kind, "job_id": entry[0], "error": error, "turn": key}
    turns.put(own, (r["id"], "queued", "", at))
    jobs.put(str(r["id"]), (at,))
    return {"user_id": r["user_id"], "id": r["id"], "kind": "new", "job_id": r["id"], "error": None, "turn": own}


def admitted(log: DataFrame, ttl: int = TTL) -> DataFrame:
    """user_id, id, kind (new, allow, flag, block, wait), job_id, error, turn (the key it was found under) of each request of the log.

    log has the columns of LOG: requests, verdicts and replies by tag, in the order of (at, tag, id) within an API key (user_id). A key's
    rows pass through one task in their order, which holds the entries that are alive. A job whose verdict takes longer than ttl is
    forgotten, as is its turn. Rows without id are left out.
    """

    def step(state: dict, r: dict) -> tuple[dict, list[dict]]:
        if not state:
            state = {"turns": Table(ttl), "replies": Table(ttl), "jobs": Table(ttl)}
        made = admit(state["turns"], state["replies"], state["jobs"], r)
        return state, [made] if made else []

    return folds.run_batch(log.where("id IS NOT NULL"), "user_id", ["at", "tag", "id"], step, ADMITTED)


class Admission(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Spark's own clock runs from the last write; twice the time leaves room for rows that come late
        clock = 2 * self.ttl // 1000
        self.turns = Kept(handle.getMapState("turns", "k string", "job long, status string, decision string, at long", clock), self.ttl)
        self.replies = Kept(handle.getMapState("replies", "k string", "turn string, at long", clock), self.ttl)
        self.jobs = Kept(handle.getMapState("jobs", "k string", "at long", clock), self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["at", "tag", "id"], kind="stable")
        made = [admit(self.turns, self.replies, self.jobs, {k: None if pd.isna(v) else v for k, v in r.items()}) for r in log.to_dict("records")]
        yield pd.DataFrame([m for m in made if m], columns=[f.split()[0] for f in ADMITTED.split(", ")])

    def close(self) -> None:
        pass


def admitted_stream(log: DataFrame, ttl: int = TTL) -> DataFrame:
    """The same over a stream of the log, whose micro-batches come in the order of time. The session must keep states in RocksDB
    (spark.sql.streaming.stateStore.providerClass); a query that shall end by itself needs spark.sql.streaming.noDataMicroBatches.enabled = false."""
    return log.where("id IS NOT NULL").groupBy("user_id").transformWithStateInPandas(Admission(ttl), ADMITTED, "Append", "ProcessingTime")


def event_log(events: DataFrame) -> DataFrame:
    """A log out of the events: each is a request of its user; views get no reply, clicks and errors go on with an earlier turn.

    Clicks name the reply of event `back` (an id, from whoever prepares the events). A verdict takes a tenth of a second for each
    cent of the value, and a day for every seventh cent.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    base = events.select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), F.lit(":f"), (k % 3).cast("string")).alias("turn"),
        F.col("event_type").isin("click", "error").alias("continuation"), F.when(F.col("event_type") == "click", F.concat(F.lit("r"), F.col("back").cast("string"))).alias("previous"),
        F.when(F.col("value") < 20, "blocking").otherwise("async").alias("mode"), "event_type", "value",
    )
    none = F.lit(None).cast("string")
    cents = F.floor(F.col("value") * 100).cast("long")
    requests = base.select("user_id", "at", F.lit(REQUEST).alias("tag"), "id", "turn", "continuation", "previous", "mode", none.alias("status"), none.alias("decision"))
    decided = F.when(cents % 10 == 0, "block").when(cents % 10 < 3, "review").otherwise("pass")
    after = F.when(cents % 7 == 0, F.lit(86_400_000_000)).otherwise(cents * 100_000)
    verdicts = base.select("user_id", (F.col("at") + after).alias("at"), F.lit(VERDICT).alias("tag"), "id", "turn", "continuation", "previous", "mode", F.when(cents % 11 == 0, "failed").otherwise("done").alias("status"), F.when(cents % 11 == 0, "").otherwise(decided).alias("decision"))
    replies = base.where("event_type <> 'view'").select("user_id", (F.col("at") + 30_000_000).alias("at"), F.lit(REPLY).alias("tag"), "id", "turn", "continuation", "previous", "mode", none.alias("status"), none.alias("decision"))
    return requests.unionByName(verdicts).unionByName(replies)
