"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, or ``base`` with a number, so that it clashes with no column whatever its case."""
    taken = {c.lower() for c in columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}{i}"
    return name
