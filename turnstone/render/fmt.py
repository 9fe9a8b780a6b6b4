"""Numbers, durations and paths as text (survey 2.11). Halves round up, as in the source of the data."""

from __future__ import annotations

import math
import os
import re
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

DASH = "—"


def _whole(x: float) -> int:
    return math.floor(x + 0.5)


def _fixed(x: float, digits: int) -> str:
    """The exact binary value, halves away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def number(x: float | None) -> str:
    return DASH if x is None else ("-" if x < 0 else "") + f"{abs(_whole(x)):,}"


def compact(x: float) -> str:
    sign, x = ("-" if x < 0 else ""), abs(x)
    return sign + (str(_whole(x)) if x < 1000 else f"{_fixed(x / 1e3, 1)}k" if x < 1e6 else f"{_fixed(x / 1e6, 1)}M")


def cost(x: float | None, priced: bool = True) -> str:
    if x is None or not priced:
        return DASH
    return f"{'-' if x < 0 else ''}${_fixed(abs(x), 4 if 0 < abs(x) < 0.01 else 2)}"


def signed(x: float | None, shown=number) -> str:
    return DASH if x is None else ("+" if x > 0 else "-" if x < 0 else "") + shown(abs(x))


def percent(share: float | None) -> str:
    return DASH if share is None else f"{'+' if share > 0 else ''}{_fixed(share * 100, 1)}%"


def bar(share: float, width: int = 8) -> str:
    """The bar is clamped, the number isn't."""
    full = _whole(min(1.0, max(0.0, share)) * width)
    return "█" * full + "░" * (width - full) + f" {_whole(share * 100)}%"


def duration(ms: float) -> str:
    """1h2m3s, without leading parts that are 0."""
    s = _whole(ms / 1000)
    h, m, s = s // 3600, s % 3600 // 60, s % 60
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"


def padded_duration(ms: float) -> str:
    s = _whole(ms / 1000)
    h, m, s = s // 3600, s % 3600 // 60, s % 60
    return f"{h}h {m:02d}m" if h else f"{m}m {s:02d}s" if m else f"{s}s"


def tenths(ms: float) -> str:
    """8.3s, 2m 5.0s."""
    s = ms / 1000
    return f"{_fixed(s, 1)}s" if s < 60 else f"{int(s // 60)}m {_fixed(s % 60, 1)}s"


def moment(t: datetime | None) -> str:
    return DASH if t is None else t.strftime("%Y-%m-%d %H:%M")


def path(p: str | None, most: int = 40) -> str:
    p = p or ""
    home = os.path.expanduser("~")
    if p == home or p.startswith(home + "/"):
        p = "~" + p[len(home) :]
    parts = p.split("/")
    return p if len(p) <= most or len(parts) <= 3 else f"{parts[0]}/…/{'/'.join(parts[-2:])}"


def words(name: str) -> str:
    return re.sub("([A-Z])", r" \1", name).lower()


def short(name: str) -> str:
    return name[:8]
