"""Fetching one file over HTTP to the driver's side; what it lands is then read by Spark."""

from __future__ import annotations

import os
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

AGENT = "larder/1.0"
DUMP_CHUNK, IMAGE_CHUNK = 1 << 20, 1 << 16  # bytes


def fetch_file(url: str, path: str, chunk: int = DUMP_CHUNK, timeout: float = 60.0, keep: bool = False, progress: Callable[[int, int | None, float], None] | None = None, every: float = 2.0) -> bool:
    """Whether the file was fetched; with keep, one that is there already is left.

    An HTTP error or a body shorter than announced raises OSError and leaves no file: the body lands beside and is renamed at its end.
    progress gets (bytes so far, bytes announced or None, bytes a second) about each `every` seconds and once at the end.
    """
    target = Path(path)
    if keep and target.exists():
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{os.getpid()}.part")
    began = told = time.monotonic()
    done = 0
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer, part.open("wb") as out:
            announced = int(answer.headers["Content-Length"]) if answer.headers["Content-Length"] else None
            while body := answer.read(chunk):
                done += out.write(body)
                if progress and time.monotonic() - told >= every:
                    told = time.monotonic()
                    progress(done, announced, done / (told - began))
        if announced is not None and done < announced:
            raise OSError(f"{url}: {done} of {announced} bytes")
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)
    if progress:
        progress(done, announced, done / max(time.monotonic() - began, 1e-9))
    return True
