"""Requests that survive a failed attempt."""

from __future__ import annotations

import time
import urllib.request


def fetch(request: str | urllib.request.Request, timeout: float | None = None, tries: int = 3) -> str:
    """The reply's text. Failed attempts are repeated after 1, 2, ... seconds."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout or None) as reply:
                return reply.read().decode("utf-8")
        except OSError:
            if attempt + 1 == tries:
                raise
            time.sleep(2**attempt)
    raise ValueError("no attempt was allowed")
