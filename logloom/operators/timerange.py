"""Time ranges: presets, shifting, bounds. Pure driver-side date arithmetic on naive UTC datetimes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

# --- fixed values -------------------------------------------------------------------------------
PRESET_LENGTH = {"30m": timedelta(minutes=30), "1h": timedelta(hours=1), "4h": timedelta(hours=4),
                 "6h": timedelta(hours=6), "1d": timedelta(days=1)}
SHIFT_LENGTH = {**PRESET_LENGTH, "today": timedelta(days=1), "week": timedelta(days=7)}
LIVE_LENGTH = {**PRESET_LENGTH, "today": timedelta(days=1), "week": timedelta(days=7),
               "all": timedelta(days=365), "now": timedelta(minutes=5)}
DEFAULT_LENGTH = timedelta(days=1)
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TimeRange:
    """Either a preset name or absolute bounds, of which one may be open."""

    preset: str | None = None
    start: datetime | None = None
    end: datetime | None = None

    @property
    def absolute(self) -> bool:
        return self.start is not None or self.end is not None


def resolve_preset(name: str | None, as_of: datetime) -> tuple[datetime | None, datetime | None]:
    """Bounds of a preset; ``all`` has none. An unknown name means the last day."""
    if name == "all":
        return None, None
    if name == "now":
        return as_of, None
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == "today":
        return midnight, None
    if name == "week":
        return midnight - timedelta(days=midnight.weekday()), None
    return as_of - PRESET_LENGTH.get(name or "", DEFAULT_LENGTH), None


def resolve(rng: TimeRange, as_of: datetime) -> tuple[datetime | None, datetime | None]:
    return (rng.start, rng.end) if rng.absolute else resolve_preset(rng.preset, as_of)


def resolve_live_preset(name: str | None, as_of: datetime) -> datetime:
    """Exclusive lower bound of a live view."""
    return as_of - LIVE_LENGTH.get(name or "", DEFAULT_LENGTH)


def shift_range(rng: TimeRange, direction: str, as_of: datetime) -> TimeRange:
    """Move a range by its own length; a move that would end after ``as_of`` is refused."""
    if rng.start is not None and rng.end is not None:
        length = rng.end - rng.start
    else:
        length = SHIFT_LENGTH.get(rng.preset or "", DEFAULT_LENGTH)
    start, end = resolve(rng, as_of)
    end = end or as_of
    start = start or end - length
    step = length if direction == "forward" else -length
    if end + step > as_of:
        return rng
    return TimeRange(start=start + step, end=end + step)
