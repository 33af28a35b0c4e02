"""Filters built from optional parameters. What is not given puts no predicate into the plan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS, STATUSES, RUN_KINDS, MODES = {"pass", "review", "block"}, {"queued", "processing", "retry", "done", "failed", "skipped"}, {"request", "reaudit"}, {"async", "blocking"}


def all_of(df: DataFrame, parts: Sequence[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def between(column: str, since=None, until=None) -> list[Column]:
    """since <= column < until, each if given."""
    out = [F.col(column) >= F.lit(since).cast("timestamp_ntz")] if since is not None else []
    return out + ([F.col(column) < F.lit(until).cast("timestamp_ntz")] if until is not None else [])


@dataclass(frozen=True)
class JobFilter:
    ids: tuple[int, ...] = ()
    user_id: int | None = None
    client: str | None = None
    status: str | None = None
    decision: str | None = None
    run_kind: str | None = None
    mode: str | None = None
    category: str | None = None
    api_key_id: int | None = None
    group_id: int | None = None
    platform: str | None = None
    request_id: str | None = None
    model: str | None = None
    since: str | None = None
    until: str | None = None

    def check(self) -> JobFilter:
        """Raises ValueError for a value outside its set, an empty range, or a category that isn't R and two digits."""
        for value, known in ((self.decision, DECISIONS), (self.status, STATUSES), (self.run_kind, RUN_KINDS), (self.mode, MODES)):
            if value is not None and value not in known:
                raise ValueError(f"unknown value: {value}")
        if self.category is not None and not re.fullmatch(r"R\d{2}", self.category):
            raise ValueError(f"not a category: {self.category}")
        if self.since is not None and self.until is not None and self.since >= self.until:
            raise ValueError("empty range")
        return self

    def columns(self) -> list[Column]:
        pairs = (("user_id", self.user_id), ("client_fingerprint", self.client), ("status", self.status), ("decision", self.decision), ("run_kind", self.run_kind), ("run_mode", self.mode),
                 ("api_key_id", self.api_key_id), ("group_id", self.group_id), ("platform", self.platform), ("request_id", self.request_id), ("model", self.model))
        out = [F.col(c) == v for c, v in pairs if v is not None]
        if self.ids:
            out.append(F.col("id").isin(*self.ids))
        if self.category is not None:
            out.append(F.arrays_overlap("trigger_categories", F.array(F.lit(self.category))))
        return out + between("created_at", self.since, self.until)

    def apply(self, jobs: DataFrame) -> DataFrame:
        return all_of(jobs, self.check().columns())


def action_filter(actions: DataFrame, user_id: int | None = None, execution: Sequence[str] = (), notification: Sequence[str] = (), since=None, until=None) -> DataFrame:
    parts = [F.col("user_id") == user_id] if user_id is not None else []
    parts += [F.col("execution_status").isin(*execution)] if execution else []
    parts += [F.col("notification_status").isin(*notification)] if notification else []
    return all_of(actions, parts + between("requested_at", since, until))


def keyword_or_id(keyword: str, texts: Sequence[str], ids: Sequence[str]) -> list[Column]:
    """A keyword matches a text anywhere, whatever the case; % and _ keep their meaning. A positive number matches ids too."""
    keyword = keyword.strip()
    if not keyword:
        return []
    hits = [F.coalesce(F.col(t), F.lit("")).ilike(f"%{keyword}%") for t in texts]
    if keyword.isdigit() and int(keyword) > 0:
        hits += [F.col(i) == int(keyword) for i in ids]
    return [reduce(lambda a, b: a | b, hits)]


def text_search(texts: DataFrame, query: str) -> DataFrame:
    """Texts whose hash starts with the query or whose text holds it."""
    return texts.where(F.col("hash_key").cast("string").like(f"{query}%") | F.col("text").ilike(f"%{query}%")) if query else texts


def split_query(box: str) -> dict:
    """What a search box asks for: #42 a job, other text a request."""
    box = box.strip()
    if m := re.fullmatch(r"#(\d+)", box):
        return {"job_id": int(m[1])}
    return {"request_id": box} if box else {}
