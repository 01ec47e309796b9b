"""Host ranges of the ON clause: cluster[[001-004]], lists with commas, exclusions after ; or :, half-open --."""

from __future__ import annotations

import re

_RANGE = re.compile(r"(\d+)(?:(-+)(\d+))?\Z")


def expand(pattern: str) -> list[str]:
    """The hosts that a pattern names, in order. Several bracket pairs multiply."""
    head, bracket, rest = pattern.partition("[[")
    if not bracket:
        return [pattern]
    inside, bracket, tail = rest.partition("]]")
    if not bracket:
        raise ValueError(f"[[ is not closed in {pattern}")
    members: dict[str, None] = {}
    for mark, part in re.findall(r"(^|[,;:!])([^,;:!]*)", inside):
        m = _RANGE.match(part)
        if not m:
            raise ValueError(f"{part!r} is no number or range in {pattern}")
        low, dash, high = m[1], m[2] or "-", m[3] or m[1]
        width = len(low) if len(low) == len(high) else 0
        for x in range(int(low), int(high) + (len(dash) == 1)):
            name = str(x).zfill(width)
            if mark in (";", ":"):
                members.pop(name, None)
            else:
                members[name] = None
    return [head + x + y for x in members for y in expand(tail)]
