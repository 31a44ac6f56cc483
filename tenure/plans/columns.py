"""Names of columns as they are, whatever characters they hold."""

from __future__ import annotations


def quoted(name: str) -> str:
    """The name as a reference to one column: a dot in it does not reach into a struct."""
    return "`" + name.replace("`", "``") + "`"
