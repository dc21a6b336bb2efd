"""Reduction schedules: how many tasks combine partial results, stage by stage."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

# With more shuffle partitions than this, the default schedule has a stage of
# about their square root before the last single task.
WIDE_SESSION = 64


@dataclass(frozen=True)
class Spread:
    """Move rows or partial results to ``parts`` partitions; combine nothing."""

    parts: int


@dataclass(frozen=True)
class Merge:
    """Combine partial results in exactly ``tasks`` tasks."""

    tasks: int


@dataclass(frozen=True)
class AdaptiveMerge:
    """Combine partial results in as many tasks as adaptive execution finds
    fit for their size: at most ``groups``, or the session's shuffle partitions."""

    groups: int | None = None


@dataclass(frozen=True)
class Schedule:
    """``spread`` moves raw rows before the first stage; ``stages`` follow it."""

    spread: tuple[Spread, ...]
    stages: tuple[Spread | Merge | AdaptiveMerge, ...]


ENTRY = re.compile(r"(s|auto)?([1-9][0-9]*)?")


def _entry(item):
    kind, digits = (ENTRY.fullmatch(str(item).strip()) or ENTRY.match("")).groups()
    if kind == "auto":
        return AdaptiveMerge(int(digits) if digits else None)
    if not digits:
        raise ValueError(f"bad schedule entry {item!r}")
    return Spread(int(digits)) if kind else Merge(int(digits))


def default_entries(shuffle_partitions: int) -> tuple:
    """One adaptive stage, then the last task; in between, where the session is
    set up for big data, a stage that keeps the last task's share small."""
    if shuffle_partitions <= WIDE_SESSION:
        return ("auto", 1)
    return ("auto", f"auto{math.isqrt(shuffle_partitions)}", 1)


def parse_schedule(schedule=None, shuffle_partitions: int = 200) -> Schedule:
    """A schedule such as ``250``, ``"250,1"`` or ``("s100", 100, 1)``.

    A number is a stage of that many tasks; ``auto`` leaves their number to
    adaptive execution and ``auto90`` does so up to 90; ``s100`` spreads over
    100 partitions without combining. The last entry must be 1. ``None`` is
    right for a few partitions as well as for some hundred thousand.
    """
    if schedule is None:
        schedule = default_entries(shuffle_partitions)
    elif isinstance(schedule, str):
        schedule = schedule.split(",")
    elif isinstance(schedule, int):
        schedule = (schedule,)
    entries = [_entry(item) for item in schedule]
    if not entries or entries[-1] != Merge(1):
        raise ValueError("the last entry of a schedule must be 1")
    lead = 0
    while isinstance(entries[lead], Spread):
        lead += 1
    return Schedule(tuple(entries[:lead]), tuple(entries[lead:]))
