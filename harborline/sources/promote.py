"""Complete files from companions (API fetches, queue batches): staged, then promoted in an order that survives crashes."""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

from ..plans.manifest import SUFFIX
from .stores import Locked


def slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._]+", "-", str(text)).strip("-") or "x"


def staged_name(source: str, start: str, end: str, stamp: str, compress: bool = False) -> str:
    return f"{'-'.join(slug(x) for x in (source, start, end, stamp))}.ndjson" + (".gz" if compress else "")


def write_staged(folder: str | Path, name: str, lines: Iterable[str]) -> Path:
    """A whole file in the staging folder; nothing is left of one that fails."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    temporary = path.with_name(name + ".tmp")
    try:
        with (gzip.open(temporary, "wt", encoding="utf-8") if name.endswith(".gz") else open(temporary, "w", encoding="utf-8")) as out:
            for line in lines:
                out.write(line + "\n")
        os.replace(temporary, path)
    except BaseException:
        temporary.unlink(missing_ok=True)
        raise
    return path


@contextmanager
def source_lock(folder: str | Path, source: str):
    """One writer for each source, by a folder that only one can make."""
    path = Path(folder, f".{slug(source)}.lock")
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        path.mkdir()
    except FileExistsError as e:
        raise Locked(f"{source} is being worked on; remove {path} if it is not") from e
    try:
        yield
    finally:
        path.rmdir()


def promote(staged: Path, inbox: str | Path, manifest: str | None) -> Path:
    """Sidecar first, data last: a watcher that sees the data finds its manifest."""
    target = Path(inbox, staged.name)
    target.parent.mkdir(parents=True, exist_ok=True)
    if manifest is not None:
        side = staged.with_name(staged.name + SUFFIX + ".tmp")
        side.write_text(manifest)
        os.replace(side, str(target) + SUFFIX)
    os.replace(staged, target)
    return target
