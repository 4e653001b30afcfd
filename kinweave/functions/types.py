"""Internal types from the names that sources use, and their shading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .type_names import BITS, NO_TYPE, PRIMARY, SECONDARY, SHADED


def _table(groups: Mapping[str, list[str]]) -> dict[str, str]:
    return {name: kind for kind, names in groups.items() for name in names}


def _lookup(table: Mapping[str, str], x: Column) -> Column:
    """The value of a constant map; null if there is none."""
    return F.element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), x)


def internal(names: Column, detail: Column | None = None) -> Column:
    """Sorted internal types of an array of names; a detail that is known goes first. No type if none is known."""
    table = _table(SECONDARY) | _table(PRIMARY)
    found = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: _lookup(table, n)), lambda t: t.isNotNull())
    found = F.array_sort(F.array_distinct(found))
    if detail is not None:
        own = _lookup(table, detail)
        found = F.when(own.isNotNull(), F.array(own)).otherwise(found)
    return F.when(F.size(found) == 0, F.array(F.lit(NO_TYPE))).otherwise(found)


def shade_one(x: Column) -> Column:
    return F.coalesce(_lookup(SHADED, x), x)


def shade(types: Column) -> Column:
    """Sorted types as they are compared."""
    return F.array_sort(F.array_distinct(F.transform(types, shade_one)))


def mask(types: Column) -> Column:
    """Bits of the shaded types."""
    table = F.create_map(*(F.lit(x) for pair in BITS.items() for x in pair))
    return F.aggregate(shade(types), F.lit(0), lambda m, t: m.bitwiseOR(F.coalesce(F.element_at(table, t), F.lit(0))))


def settle(types: Column, default: str = "Settlement") -> Column:
    """A default type where there is none."""
    return F.when(types.isNull() | F.array_contains(types, NO_TYPE), F.array(F.lit(default))).otherwise(types)
