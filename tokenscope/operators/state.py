"""Decisions that depend on earlier decisions: limits, budgets, breakers.

Each is a small pure class with one step(row) method. ``replay`` runs it in batch: rows are dealt by key and
sorted within tasks, and streamed through the state, so a key's rows are never held together. The same classes
run in Structured Streaming (tokenscope.streaming.stateful).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class SlidingLimit:
    """At most most admitted calls in the closed window of the last seconds; refused calls take no place."""

    def __init__(self, most: int = 10, seconds: float = 1.0) -> None:
        self.most, self.seconds, self.admitted = most, seconds, deque()

    def step(self, ts: float, amount: int = 1) -> str:
        while self.admitted and self.admitted[0] < ts - self.seconds:
            self.admitted.popleft()
        if len(self.admitted) >= self.most:
            return "reject"
        self.admitted.append(ts)
        return "allow"


class TokenBucket:
    """Refilled continuously with capacity per interval, up to the capacity."""

    def __init__(self, capacity: float, interval: float) -> None:
        self.capacity, self.rate, self.tokens, self.last = float(capacity), capacity / interval, float(capacity), None

    def refill(self, ts: float) -> None:
        if self.last is not None and ts > self.last:
            self.tokens = min(self.capacity, self.tokens + (ts - self.last) * self.rate)
        self.last = ts if self.last is None else max(self.last, ts)

    def step(self, ts: float, amount: int = 1) -> str:
        self.refill(ts)
        if self.tokens < amount:
            return "reject"
        self.tokens -= amount
        return "allow"


def month_of(ts: float) -> int:
    """Months since 0000-01 (UTC) of a number of seconds, by the civil calendar's days."""
    days = int(ts // 86_400) + 719_468
    era = days // 146_097
    doe = days - era * 146_097
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    shifted = (5 * (doe - (365 * yoe + yoe // 4 - yoe // 100)) + 2) // 153
    return (yoe + era * 400) * 12 + shifted + 2


class TeamBudget:
    """A bucket of the daily limit that is also filled at each UTC midnight, and a month's sum of what it let through."""

    def __init__(self, daily: int) -> None:
        self.daily, self.bucket, self.day, self.month, self.used = daily, TokenBucket(daily, 86_400), None, None, 0

    def roll(self, ts: float) -> None:
        day, month = int(ts // 86_400), month_of(ts)
        if day != self.day:
            self.day, self.bucket = day, TokenBucket(self.daily, 86_400)
        if month != self.month:
            self.month, self.used = month, 0

    def step(self, ts: float, amount: int = 1) -> str:
        self.roll(ts)
        if self.bucket.step(ts, amount) == "reject":
            return "reject"
        self.used += amount
        return "allow"


class ProjectBudget:
    """A month's limit; an amount that would pass it is refused and not added."""

    def __init__(self, monthly: int) -> None:
        self.monthly, self.month, self.used = monthly, None, 0

    def step(self, ts: float, amount: int = 1) -> str:
        month = month_of(ts)
        if month != self.month:
            self.month, self.used = month, 0
        if self.monthly > 0 and self.used + amount > self.monthly:
            return "reject"
        self.used += amount
        return "allow"


class TwoLevelBudget:
    """Team and projects under one key: a project that is out refuses before the team pays; alerts from alert_pct of the team's month on."""

    def __init__(self, daily: int, monthly: int, project_monthly: int, alert_pct: float = 80) -> None:
        self.team, self.monthly, self.project_monthly, self.alert_pct, self.projects = TeamBudget(daily), monthly, project_monthly, alert_pct, {}

    def step(self, ts: float, amount: int = 1, project: str = "") -> str:
        own = self.projects.setdefault(project, ProjectBudget(self.project_monthly))
        month = month_of(ts)
        used = own.used if own.month == month else 0
        if self.project_monthly > 0 and used + amount > self.project_monthly:
            return "reject_project"
        if self.team.step(ts, amount) == "reject":
            return "reject_team"
        own.step(ts, amount)
        return "allow_alert" if self.monthly > 0 and self.team.used / self.monthly * 100 >= self.alert_pct else "allow"


class CircuitBreaker:
    """Open after threshold failures in a row; half-open after the cooldown; closed again by three successes, open again by a failure."""

    def __init__(self, threshold: int = 5, cooldown: float = 30.0, successes: int = 3) -> None:
        self.threshold, self.cooldown, self.needed = threshold, cooldown, successes
        self.state, self.failures, self.successes, self.opened = "closed", 0, 0, 0.0

    def step(self, ts: float, failed: bool) -> str:
        if self.state == "open":
            if ts - self.opened < self.cooldown:
                return "open"
            self.state, self.successes = "half_open", 0
        if failed:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state, self.opened, self.failures = "open", ts, 0
        else:
            self.failures = 0
            if self.state == "half_open":
                self.successes += 1
                if self.successes >= self.needed:
                    self.state = "closed"
        return self.state


def replay(df: DataFrame, key: str | list[str], order: list[str], make: Callable[[object], object], args: list[str], out: list[str], kinds: str) -> DataFrame:
    """Columns out of df and decision: the result of make(key).step(*args) for each row, in order; several key columns make a tuple.

    Rows of a key meet in one task, as each decision needs the one before, but they pass one by one.
    """

    keys = [key] if isinstance(key, str) else key

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for part in parts:
            decisions = []
            for k, *values in zip(zip(*(part[c] for c in keys)), *(part[a] for a in args)):
                if k != now:
                    now, state = k, make(k if len(k) > 1 else k[0])
                decisions.append(state.step(*values))
            yield part[out].assign(decision=decisions)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, decision string")
