"""Accessibility levels and the policies by which extractors drop symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = {"NotApplicable": 0, "Private": 1, "ProtectedAndInternal": 2, "Protected": 3, "Internal": 4, "ProtectedOrInternal": 5, "Public": 6}
_FACT_LEVELS = ("Public", "Private", "Protected", "Internal")


def level(name: Column) -> Column:
    ranked = F.when(F.lit(False), F.lit(0))
    for text, number in LEVELS.items():
        ranked = ranked.when(name == text, F.lit(number))
    return ranked


def type_visible(declared: Column, least: str) -> Column:
    """Types and enum members: at least the minimum, or not applicable."""
    return (level(declared) >= LEVELS[least]) | (level(declared) == 0)


def member_visible(declared: Column, explicit_interface: Column, least: str) -> Column:
    """Members: dropped when below the minimum, unless they implement an interface explicitly."""
    return (level(declared) >= LEVELS[least]) | explicit_interface


def text_symbols_visible(least: str) -> bool:
    """JSON, CSS, HTML and Razor directives: nothing at all without a real minimum."""
    return least != "NotApplicable" and LEVELS[least] <= LEVELS["Public"]


def manifest_visible(least: str, declared: str = "Public") -> bool:
    """XML, project files, manifests and XAML; XAML events are private."""
    return LEVELS[declared] >= LEVELS[least]


def fact_visible(declared: Column, least: str) -> Column:
    """Facts of analyzers: unknown levels count as public, and no minimum lets all pass."""
    if least == "NotApplicable":
        return F.lit(True)
    return F.when(declared.isin(*_FACT_LEVELS), level(declared)).otherwise(LEVELS["Public"]) >= LEVELS[least]
