"""Progress of runs as log lines, as text or as JSON."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from typing import TextIO

FORMATS = ("text", "json")


def reporter(kind: str = "text", out: TextIO | None = None, clock=lambda: datetime.now(UTC)) -> Callable[[dict], None]:
    """A progress callback for runs. Each event is a line: its time, phase and action, then its other fields."""

    def tell(event: dict) -> None:
        at = clock().isoformat(timespec="milliseconds")
        if kind == "json":
            line = json.dumps({"time": at, "level": "error" if event.get("action") == "failed" else "info"} | event, default=str)
        else:
            more = " ".join(f"{k}={v}" for k, v in event.items() if k not in ("phase", "action"))
            line = f"{at} {event.get('phase', '')} {event.get('action', '')} {more}".rstrip()
        print(line, file=out or sys.stderr, flush=True)

    return tell
