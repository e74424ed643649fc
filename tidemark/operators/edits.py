"""Edits of the columns of events. Each takes and gives columns, so that they fuse into one projection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import COLUMNS, no_texts


def values_of(properties: Column, name: str) -> Column:
    """The values of a property; an empty array if it is absent."""
    return F.coalesce(properties[name], no_texts())


def any_value(properties: Column, name: str, default: str | None = None) -> Column:
    """One value of a property: the least, so that the choice doesn't depend on chance."""
    return F.coalesce(F.array_min(values_of(properties, name)), F.lit(default))


def set_property(properties: Column, name: str, values: Column) -> Column:
    """With a property's values replaced; none removes it."""
    rest = delete_property(properties, name)
    tidy = F.array_sort(F.array_distinct(F.filter(F.coalesce(values, no_texts()), lambda v: v.isNotNull())))
    return F.when(F.size(tidy) > 0, F.map_concat(rest, F.create_map(F.lit(name), tidy))).otherwise(rest)


def delete_property(properties: Column, name: str) -> Column:
    return F.map_filter(properties, lambda k, _: k != name)


def copy_properties(properties: Column, targets: Mapping[str, Iterable[str]], drop: Iterable[str] = ()) -> Column:
    """Values of each source property added to those of its targets; ``drop`` names properties to remove."""
    sources: dict[str, list[str]] = {}
    for source, names in targets.items():
        for name in names:
            sources.setdefault(name, []).append(source)
    if not sources:
        return properties
    gone = sorted({*sources, *drop})
    pairs = []
    for name, own in sorted(sources.items()):
        every = F.concat(values_of(properties, name), *[values_of(properties, s) for s in own])
        pairs += [F.lit(name), F.array_sort(F.array_distinct(every))]
    rest = F.map_filter(properties, lambda k, _: ~k.isin(*gone))
    return F.map_filter(F.map_concat(rest, F.create_map(*pairs)), lambda _, v: F.size(v) > 0)


def move_properties(properties: Column, targets: Mapping[str, Iterable[str]]) -> Column:
    """As copy, and the sources are removed unless they are targets too."""
    kept = {n for names in targets.values() for n in names}
    return copy_properties(properties, targets, [s for s in targets if s not in kept])


def set_attachment(attachments: Column, name: str, value: Column, id: Column | None = None) -> Column:
    """With an attachment replaced; its id is the SHA-1 of its text unless given. A null text removes it."""
    rest = F.map_filter(attachments, lambda k, _: k != name)
    one = F.create_map(F.lit(name), F.create_map(F.coalesce(id, F.sha1(value.cast("binary"))) if id is not None else F.sha1(value.cast("binary")), value))
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, one))


def add_parents(parents: Column, more: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(parents, no_texts()), F.coalesce(more, no_texts())))


def set_foreign(attributes: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for pair in sorted(attributes.items()) for x in pair]
    return F.create_map(*pairs).cast(COLUMNS["foreign_attribs"])


def select_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns that exist, in the named order."""
    return df.select(*[n for n in names if n in df.columns])
