"""Spans of found values: their joining and digest."""

from __future__ import annotations

import hashlib


def joined(found: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed. found: (start, number of kind, end)."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
