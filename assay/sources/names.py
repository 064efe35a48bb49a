"""Column names from headers."""

from __future__ import annotations

import re


def sanitize(header: str | None) -> str:
    """Lower-case, words joined by single underscores, nothing but letters, digits and underscores; never empty and never
    with a digit first."""
    name = re.sub(r"[\s\-.]+", "_", (header or "").strip().lower())
    name = re.sub(r"_+", "_", re.sub(r"[^\w]", "", name)).strip("_")
    if not name:
        return "col"
    return f"col_{name}" if name[0].isdigit() else name


def unique(names: list[str]) -> list[str]:
    """Repeated names get _1, _2 and so on, past any that are taken."""
    taken = set(names)
    out: list[str] = []
    for n in names:
        new, i = n, 0
        while new in out or (i and new in taken):
            i += 1
            new = f"{n}_{i}"
        out.append(new)
    return out


def column_names(headers: list[str | None]) -> list[str]:
    return unique([sanitize(h) for h in headers])
