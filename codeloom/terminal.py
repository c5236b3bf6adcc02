"""Answers as text for a terminal: names in colour, nested values indented."""

from __future__ import annotations

from collections.abc import Iterator

NAME, PATH, GOOD, BAD, OFF = "\x1b[36m", "\x1b[1m", "\x1b[32m", "\x1b[31m", "\x1b[0m"
_STATES = {"READY": GOOD, "Added": GOOD, "STALE": BAD, "CORRUPT": BAD, "CONFIG": BAD, "NOT_INITIALIZED": BAD, "Removed": BAD}


def _shown(value: object, key: str, color: bool) -> str:
    text = f"{value:.3f}" if isinstance(value, float) else "-" if value is None else str(value)
    paint = _STATES.get(text) or (PATH if key in ("path", "file") else None)
    return f"{paint}{text}{OFF}" if color and paint else text


def lines(value: object, color: bool = True, depth: int = 0, key: str = "") -> Iterator[str]:
    """One line for each plain value; the fields of a table row share one line."""
    pad = "  " * depth
    if isinstance(value, dict):
        if depth and all(not isinstance(v, dict | list) for v in value.values()):
            yield pad + "  ".join(_shown(v, k, color) for k, v in value.items() if v is not None)
            return
        for k, v in value.items():
            name = f"{NAME}{k}{OFF}" if color else k
            if isinstance(v, dict | list) and v:
                yield f"{pad}{name}:"
                yield from lines(v, color, depth + 1, k)
            else:
                yield f"{pad}{name}: {'none' if isinstance(v, dict | list) else _shown(v, k, color)}"
    elif isinstance(value, list):
        for v in value:
            yield from lines(v, color, max(depth, 1), key)
    else:
        yield from (pad + line for line in _shown(value, key, color).split("\n"))
