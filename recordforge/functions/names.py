"""Column names that a table does not have."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name, numbered where the table has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"{name}{k or ''}").lower() not in taken) for name in wanted]
