"""Layer colours of drawings; a missing colour is in no layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rgb(color: str) -> tuple[Column, Column, Column]:
    return F.col(f"{color}.r"), F.col(f"{color}.g"), F.col(f"{color}.b")


def is_green(color: str = "color") -> Column:
    r, g, b = _rgb(color)
    return F.coalesce((r < 0.4) & (g > 0.3) & (b < 0.2) & (g > r) & (g > b), F.lit(False))


def is_strict_green(color: str = "color") -> Column:
    r, g, b = _rgb(color)
    return F.coalesce((r < 0.15) & (g > 0.3) & (g < 0.85) & (b < 0.15), F.lit(False))


def is_red(color: str = "color") -> Column:
    r, g, b = _rgb(color)
    return F.coalesce((r > 0.85) & (g < 0.15) & (b < 0.15), F.lit(False))


def is_magenta(color: str = "color") -> Column:
    r, g, b = _rgb(color)
    return F.coalesce((r > 0.85) & (g < 0.15) & (b > 0.85), F.lit(False))


def is_route(color: str = "color") -> Column:
    return is_red(color) | is_magenta(color)


def layer_of(color: str = "color", strict: bool = False) -> Column:
    return F.when(is_strict_green(color) if strict else is_green(color), "green").when(is_red(color) if strict else is_route(color), "route")


def ink_mask(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Green ink of a rendered pixel, 0 to 255."""
    return (F.col(g) > 80) & (F.col(r) < 120) & (F.col(b) < 120)
