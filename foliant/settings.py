"""Numbers from environment variables, within stated bounds."""

from __future__ import annotations

import math
import os


class SettingError(ValueError):
    """A variable that is no number or out of bounds; its message names it."""


def bounded_float(name: str, default: float, least: float | None = None, most: float | None = None) -> float:
    return _bounded(name, default, float, least, most)


def bounded_int(name: str, default: int, least: int | None = None, most: int | None = None, allowed: set[int] | None = None) -> int:
    value = _bounded(name, default, int, least, most)
    if allowed is not None and value not in allowed:
        raise SettingError(f"{name} must be one of {sorted(allowed)}")
    return value


def _bounded(name, default, kind, least, most):  # noqa: ANN001, ANN202
    """The variable's value, or the default where it is unset; both must keep the bounds."""
    raw = os.environ.get(name)
    try:
        value = kind(default if raw is None else raw)
    except (TypeError, ValueError, OverflowError):
        raise SettingError(f"{name}={raw!r} is no {kind.__name__}") from None
    if not math.isfinite(value):
        raise SettingError(f"{name} must be finite")
    if least is not None and value < least:
        raise SettingError(f"{name} must be at least {least}")
    if most is not None and value > most:
        raise SettingError(f"{name} must be at most {most}")
    return value
