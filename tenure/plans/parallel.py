"""Independent small jobs side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any


def together(*calls: Callable[[], Any]) -> list[Any]:
    """The results of calls that each run Spark jobs and need nothing of each other; the first error is raised."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]
