"""Spans of a run as JSON lines, one a file and one of the whole run, in the fields that trace collectors know."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import TextIO

ENDS = ("committed", "failed", "done")


def tracer(out: TextIO, then: Callable[[dict], None] | None = None, clock: Callable[[], int] = time.time_ns) -> Callable[[dict], None]:
    """A progress callback that writes a span when what it times has ended, and hands each event on to `then`.

    The run's span begins with the callback. A file that starts and never ends has no span; the run's then says how many."""
    trace, root, began = uuid.uuid4().hex, uuid.uuid4().hex[:16], clock()
    open_: dict[str, tuple[str, int]] = {}

    def write(name: str, span: str, parent: str | None, start: int, ok: bool, attributes: dict) -> None:
        line = {"traceId": trace, "spanId": span, "parentSpanId": parent, "name": name, "startTimeUnixNano": start, "endTimeUnixNano": clock(), "status": "OK" if ok else "ERROR", "attributes": attributes}
        print(json.dumps(line, default=str), file=out, flush=True)

    def tell(event: dict) -> None:
        phase, action, path = event.get("phase"), event.get("action"), event.get("path", "")
        more = {k: v for k, v in event.items() if k not in ("phase", "action")}
        if action == "start":
            open_[path] = (uuid.uuid4().hex[:16], clock())
        elif phase == "run" and action == "done":
            write("run", root, None, began, not event.get("failed"), more | {"unended": len(open_)})
        elif action in ENDS:
            span, start = open_.pop(path, (uuid.uuid4().hex[:16], began))
            write(str(phase), span, root, start, action != "failed", more)
        if then:
            then(event)

    return tell
