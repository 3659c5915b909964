"""Names of helper columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable


def spare(columns: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with underscores put before it until no column has it; case doesn't tell names apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
