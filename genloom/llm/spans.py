"""Spans as text: kind:start:end in code points, end exclusive, ordered by start and then by kind."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def digest(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
