"""Parts of the expressions by which models are found in a class's text."""

from __future__ import annotations

STRING, DOUBLE = "\"'", '"'
GAP = r"\s*"


def verbs(words) -> str:
    return "(" + "|".join(words) + ")"


def any_of(names) -> str:
    return names[0] if len(names) == 1 else "(?:" + "|".join(names) + ")"


def argument(head: str, value: str) -> str:
    return f"{head}{GAP}\\({GAP}{value}"


def setting(name: str, text: str, sign: str = "=") -> str:
    """name = "text"."""
    return f"{name}{GAP}{sign}{GAP}{text}"
