"""The content hash of events, as one native expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands between the hashed objects; no UTF-8 text holds these bytes.
SEPARATOR = "X'FFFFFFFF'"
FUNCTIONS = {"sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5}


def objects_of(properties: Column, names: Column) -> Column:
    """``name:value`` of every value of the named properties, distinct and in the order of their bytes."""
    values = F.flatten(
        F.transform(
            names,
            lambda n: F.transform(
                F.coalesce(F.try_element_at(properties, n), F.array().cast("array<string>")), lambda v: F.concat(n, F.lit(":"), v)
            ),
        )
    )
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def digest(source: Column, event_type: Column, objects: Column, function: str = "sha1") -> Column:
    """The hash of a source, a type and sorted ``name:value`` texts, in hexadecimal digits."""
    joined = F.aggregate(
        F.transform(objects, lambda o: o.cast("binary")),
        F.lit(None).cast("binary"),
        lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.expr(SEPARATOR), x)),
    )
    head = F.concat(source, F.lit("\n"), event_type, F.lit("\n")).cast("binary")
    return FUNCTIONS[function](F.concat(head, F.coalesce(joined, F.expr("X''"))))


def sticky_hash(
    hashed: Mapping[str, Sequence[str]], source: Column, event_type: Column, properties: Column, function: str = "sha1"
) -> Column:
    """The hash over the hashed properties of each event. ``hashed`` has their names by event type; an event of
    another type is hashed by its source and type alone. Null source or type gives null."""
    if hashed:
        pairs = [x for name, own in sorted(hashed.items()) for x in (F.lit(name), F.array(*map(F.lit, sorted(own))).cast("array<string>"))]
        names = F.coalesce(F.try_element_at(F.create_map(*pairs), event_type), F.array().cast("array<string>"))
    else:
        names = F.array().cast("array<string>")
    return digest(source, event_type, objects_of(properties, names), function)
