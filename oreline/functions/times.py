"""Time arguments of reports and states."""

from __future__ import annotations

import datetime as dt
import re

UNITS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400, "w": 604_800}


def duration_seconds(text: str) -> int | None:
    """Seconds of ``Ns``, ``Nm``, ``Nh``, ``Nd`` or ``Nw``; None for anything else."""
    m = re.fullmatch(r"(\d+)([smhdw])", text)
    return int(m[1]) * UNITS[m[2]] if m else None


def time_argument(text: str | None, now: dt.datetime, end: bool = True) -> dt.datetime | None:
    """The instant (UTC) that a report's argument names: ``now``, ``Nd``, ``Nh`` or ``Nm`` ago, a day (its last millisecond, or its first where ``end`` is false),
    or an ISO time; None for nothing and for what is none of these."""
    if not text:
        return None
    if text == "now":
        return now
    if m := re.fullmatch(r"(\d+)([dhm])", text):
        return now - dt.timedelta(seconds=int(m[1]) * UNITS[m[2]])
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return at.replace(hour=23, minute=59, second=59, microsecond=999_000, tzinfo=dt.UTC) if end else at.replace(tzinfo=dt.UTC)
    return at.astimezone(dt.UTC) if at.tzinfo else at.replace(tzinfo=dt.UTC)
