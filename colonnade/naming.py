"""Accessor names of columns."""

from __future__ import annotations

import keyword
import re


def sanitize(name: str | None, reserved: frozenset[str] = frozenset()) -> str | None:
    """Attribute spelling of a column name; None where nothing is left of it."""
    if name is None:
        return None
    base = re.sub(r"[^a-z0-9_]+", "_", str(name).lower()).strip("_")
    if not base:
        return None
    if base[0].isdigit():
        base = f"c{base}"
    if re.fullmatch(r".*__\d+", base):
        base += "_"
    if keyword.iskeyword(base) or base in reserved:
        base += "_"
    return base


def accessors(names: list[str | None], reserved: frozenset[str] = frozenset()) -> dict[str, int]:
    """Spelling -> position. Later duplicates at position i read ``base__i``; unnamed ones ``col{i}_``."""
    found: dict[str, int] = {}
    for i, name in enumerate(names):
        base = sanitize(name, reserved)
        if base is None:
            found[f"col{i}_"] = i
            continue
        if base in found:
            found[f"{base}__{i}"] = i
        else:
            found[base] = i
    return found


def unique_names(names: list[str]) -> list[str]:
    """Repeated names become x, x2, x3."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        spelled = name if seen[name] == 1 else f"{name}{seen[name]}"
        while seen[name] > 1 and spelled in out:
            seen[name] += 1
            spelled = f"{name}{seen[name]}"
        out.append(spelled)
    return out
