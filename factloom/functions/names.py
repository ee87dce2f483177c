"""Names for helper columns beside columns of the caller's, whatever they are called."""

from __future__ import annotations


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores in front until no column has it in any case."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
