"""Column names that do not clash with a table's own."""

from __future__ import annotations


def free(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be new among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
