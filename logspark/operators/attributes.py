"""The attribute bag: array<struct<key, value>> in order of first appearance.

A map would lose the order that inference depends on, so the array is the stored form and the
lower-case lookup map is derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.base import let

BAG = "array<struct<key:string,value:string>>"


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), value.cast("string").alias("value"))


def empty_bag() -> Column:
    return F.array().cast(BAG)


def dedup(bag: Column) -> Column:
    """One entry per key: place of the first, value of the last."""

    def rebuild(b: Column) -> Column:
        once = F.array_distinct(F.transform(b, lambda p: p["key"]))
        rebuilt = F.transform(
            once, lambda k: pair(k, F.element_at(F.filter(b, lambda p: p["key"] == k), -1)["value"]))
        return F.when(F.size(once) == F.size(b), b).otherwise(rebuilt)

    return let(bag, rebuild)


def lowered(bag: Column) -> Column:
    return F.transform(bag, lambda p: pair(F.lower(p["key"]), p["value"]))


def as_map(bag: Column) -> Column:
    """MAP of a bag whose keys are unique."""
    return F.map_from_entries(bag)


def get(lower_map: Column, key: str) -> Column:
    return F.try_element_at(lower_map, F.lit(key.lower()))


def first_of(lower_map: Column, names: list[str]) -> Column:
    """Value of the first name the bag holds with a value."""
    return F.coalesce(*[get(lower_map, n) for n in names])
