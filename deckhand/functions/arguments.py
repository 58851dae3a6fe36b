"""Arguments as callers send them, made into values."""

from __future__ import annotations

from typing import Any

#: Fixed values.
TRUE = ("true", "1", "yes", "on")
NOTHING = ("null", "None")


def boolean(value: Any) -> bool:
    """Words for true in any case of letters; any other word is false; other values as Python sees them."""
    return value.lower() in TRUE if isinstance(value, str) else bool(value)


def sanitized(value: Any) -> Any:
    """The same with "true", "false", "null" and "None" as values, in lists and objects too."""
    if isinstance(value, dict):
        return {k: sanitized(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [sanitized(v) for v in value]
    if isinstance(value, str):
        return {"true": True, "false": False}.get(value.lower(), None if value in NOTHING else value)
    return value
