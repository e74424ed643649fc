"""Templates compiled to column expressions.

``[[property]]`` and ``[[formatter:argument,…]]`` are replaced by values; ``{…}`` is a scope that vanishes when a
placeholder directly in it is empty. The template is parsed once, on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.functions.datatypes import DataType

if TYPE_CHECKING:
    from tidemark.ontology.model import EventType

# Properties and arguments that each formatter takes; None stands for one or more.
FORMATTERS: dict[str, tuple[int | None, int | None]] = {
    "time_span": (2, 2),
    "date_time": (1, 2),
    "duration": (2, 2),
    "merge": (None, None),
    "attachment": (0, 1),
    "boolean_string_choice": (1, 3),
    "boolean_on_off": (1, 1),
    "boolean_is_is_not": (1, 1),
    "empty": (1, 2),
    "unless_empty": (None, None),
    "url": (1, 2),
}
# How times are written by accuracy.
ACCURACIES = {
    "year": "yyyy",
    "month": "MMMM yyyy",
    "date": "EEEE, MMMM dd yyyy",
    "hour": "EEEE, MMMM dd yyyy 'at' HH'h'",
    "minute": "EEEE, MMMM dd yyyy 'at' HH:mm'h'",
    "second": "EEEE, MMMM dd yyyy 'at' HH:mm:ss'h'",
    "millisecond": "EEEE, MMMM dd yyyy 'at' HH:mm:ss.SSS'h'",
    "microsecond": "EEEE, MMMM dd yyyy 'at' HH:mm:ss.SSSSSS'h'",
}
TIMES, BOOLEANS = ("time_span", "duration", "date_time"), ("boolean_string_choice", "boolean_on_off", "boolean_is_is_not")
BOLD, PLAIN = "\x1b[1m\x1b[37m", "\x1b[0m"
_PART = re.compile(r"\[\[([^\]]*)\]\]|([{}])|((?:(?!\[\[[^\]]*\]\])[^{}])+)", re.S)


@dataclass(frozen=True)
class Placeholder:
    formatter: str | None
    arguments: tuple[str, ...]

    @property
    def properties(self) -> tuple[str, ...]:
        if self.formatter is None:
            return self.arguments[:1]
        if self.formatter == "merge":
            return self.arguments
        if self.formatter == "unless_empty":
            return self.arguments[:-1]
        return self.arguments[: FORMATTERS.get(self.formatter, (0, 0))[0]]


@dataclass
class Scope:
    parts: list[str | Placeholder | Scope] = field(default_factory=list)

    def placeholders(self) -> Iterator[Placeholder]:
        for part in self.parts:
            if isinstance(part, Placeholder):
                yield part
            elif isinstance(part, Scope):
                yield from part.placeholders()

    def scopes(self, depth: int = 0) -> Iterator[tuple[int, Scope]]:
        yield depth, self
        for part in self.parts:
            if isinstance(part, Scope):
                yield from part.scopes(depth + 1)


def parse(text: str) -> Scope:
    """The template as a tree; unbalanced brackets are an error."""
    stack = [Scope()]
    for inside, bracket, plain in _PART.findall(text):
        if bracket == "{":
            stack[-1].parts.append(new := Scope())
            stack.append(new)
        elif bracket == "}":
            stack.pop()
            if not stack:
                raise ValueError("unbalanced brackets")
        elif plain:
            stack[-1].parts.append(plain)
        else:
            name, colon, rest = inside.partition(":")
            arguments = tuple((rest if colon else inside).split(","))
            stack[-1].parts.append(Placeholder(name if colon else None, () if arguments == ("",) and colon else arguments))
    if len(stack) > 1:
        raise ValueError("unbalanced brackets")
    return stack[0]


def property_names(text: str) -> list[str]:
    return sorted({name for p in parse(text).placeholders() for name in p.properties})


def errors(text: str, event_type: EventType, kinds: Mapping[str, DataType], allowed: list[str] | None = None) -> Iterator[str]:
    """What is wrong with a template; ``allowed`` restricts the properties it may use."""
    try:
        tree = parse(text)
    except ValueError as e:
        yield str(e)
        return
    known = set(event_type.by_name) & (set(allowed) if allowed is not None else set(event_type.by_name))
    for p in tree.placeholders():
        if p.formatter is not None and p.formatter not in FORMATTERS:
            yield f"unknown formatter {p.formatter}"
            continue
        count = FORMATTERS.get(p.formatter, (1, None))[1]
        if count is not None and len(p.arguments) != count:
            yield f"{p.formatter} takes {count} arguments, not {len(p.arguments)}"
            continue
        if p.formatter in ("merge", "unless_empty") and len(p.arguments) < (1 if p.formatter == "merge" else 2):
            yield f"{p.formatter} lacks arguments"
        for name in p.properties:
            if name not in known:
                yield f"no property {name!r} for this template"
            elif p.formatter in TIMES and kinds.get(name, DataType("datetime")).family != "datetime":
                yield f"{p.formatter} needs a datetime, not {name}"
            elif p.formatter in BOOLEANS and kinds.get(name, DataType("boolean")).family != "boolean":
                yield f"{p.formatter} needs a boolean, not {name}"
        if p.formatter == "date_time" and p.arguments[1] not in ACCURACIES:
            yield f"unknown accuracy {p.arguments[1]}"
        if p.formatter == "attachment" and event_type.attachment(p.arguments[0]) is None:
            yield f"no attachment {p.arguments[0]}"


def listed(values: Column, colored: bool = False) -> Column:
    """``a``, ``a and b``, ``a, b and c``; empty for none."""
    shown = F.transform(values, lambda v: F.when(v == "", v).otherwise(F.concat(F.lit(BOLD), v, F.lit(PLAIN)))) if colored else values

    def joined(v: Column) -> Column:
        head = F.array_join(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(1))), ", ")
        several = F.concat(head, F.lit(" and "), F.try_element_at(v, F.lit(-1)))
        return F.when(F.array_join(v, "") == "", "").when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(several)

    return let(shown, joined)


def duration(start: Column, end: Column) -> Column:
    """The calendar time between two timestamps in words, from the greatest unit that is needed to reach the minutes.

    Without minutes only seconds are written, whatever else has passed. A negative time counts as its amount.
    """
    second = 1_000_000

    def whole_months(t: Column) -> Column:
        a, b = t["a"], t["b"]
        rough = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return let(rough, lambda m: F.when(a + F.make_interval(F.lit(0), m) > b, m - 1).otherwise(m))

    def parts(t: Column) -> Column:
        def of(m: Column) -> Column:
            rest = F.unix_micros(t["b"]) - F.unix_micros(t["a"] + F.make_interval(F.lit(0), m))
            return F.struct(m.cast("bigint").alias("months"), rest.alias("rest"))

        return let(whole_months(t), of)

    def words(x: Column) -> Column:
        rest, months = x["rest"], x["months"]

        def unit(size: int, whole: int | None) -> Column:
            n = F.floor(rest / (size * second))
            return n if whole is None else n % whole

        steps = [(unit(3_600, 24), "hours"), (unit(86_400, None), "days"), (months % 12, "months"), (F.floor(months / 12), "years")]
        tail = F.concat(unit(60, 60).cast("string"), F.lit(" minutes and "), unit(1, 60).cast("string"), F.lit(" seconds"))
        out, so_far, needed = tail, tail, F.lit(True)
        for value, name in steps:
            so_far = F.concat(value.cast("string"), F.lit(f" {name}, "), so_far)
            needed = needed & (value > 0)
            out = F.when(needed, so_far).otherwise(out)
        short = F.concat(unit(1, 60).cast("string"), F.lit("."), (rest % second).cast("string"), F.lit(" seconds"))
        return F.when(unit(60, 60) > 0, out).otherwise(short)

    ordered = F.struct(F.least(start, end).alias("a"), F.greatest(start, end).alias("b"))
    return let(let(ordered, parts), words)


def in_utc(value: Column) -> Column:
    """The time that a canonical text names, as it is in UTC whatever the session's zone; null for other texts."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(value).cast("timestamp_ntz"))


def degrees(value: Column, positive: str, negative: str) -> Column:
    whole = value.cast("int")
    minutes = ((value - whole) * 60).cast("int")
    seconds = ((value - whole - minutes / 60) * 3600).cast("int")
    return F.concat(whole.cast("string"), F.lit("°"), minutes.cast("string"), F.lit("′"), seconds.cast("string"), F.when(whole > 0, f" {positive}″").otherwise(f" {negative}″"))


def point(value: Column) -> Column:
    """A place in degrees, minutes and seconds; what is none stays."""
    parts = F.split(value, ",")
    lat, lon = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    return F.coalesce(F.concat(degrees(lat, "N", "S"), F.lit(" "), degrees(lon, "E", "W")), value)


Values = Callable[[str], Column]


class Template:
    """A template for events of one type. ``kinds`` has the data types of its properties."""

    def __init__(self, text: str, kinds: Mapping[str, DataType], strict: bool = False) -> None:
        self.text, self.tree, self.kinds, self.strict = text, parse(text), kinds, strict

    def column(self, values: Values, attachments: Values, capitalize: bool = True, colored: bool = False) -> Column:
        """The text for each row. ``values`` gives the array of a property, ``attachments`` that of an attachment.

        Values are written in sorted order. What isn't valid for its formatter is written as it is, or is an error
        in a strict template.
        """
        text = self._scope(self.tree, lambda n: F.array_sort(F.coalesce(values(n), F.array().cast("array<string>"))), attachments, colored)
        if not capitalize:
            return text

        def raised(t: Column) -> Column:
            skip = F.when(t.startswith(BOLD), len(BOLD)).otherwise(0) if colored else F.lit(0)
            return F.concat(F.substr(t, F.lit(1), skip), F.upper(F.substr(t, skip + 1, F.lit(1))), F.substr(t, skip + 2))

        return let(text, raised)

    def _scope(self, scope: Scope, values: Values, attachments: Values, colored: bool) -> Column:
        own = {i: self._placeholder(p, values, attachments, colored) for i, p in enumerate(scope.parts) if isinstance(p, Placeholder)}
        if not own:
            return self._joined(scope, {}, values, attachments, colored)
        order = {i: n for n, i in enumerate(own)}

        def whole(shown: Column) -> Column:
            text = self._joined(scope, {i: shown[n] for i, n in order.items()}, values, attachments, colored)
            return F.when(F.exists(shown, lambda x: x == ""), "").otherwise(text)

        return let(F.array(*own.values()), whole)

    def _joined(self, scope: Scope, own: Mapping[int, Column], values: Values, attachments: Values, colored: bool) -> Column:
        parts = [
            own[i] if i in own else F.lit(p) if isinstance(p, str) else self._scope(p, values, attachments, colored)
            for i, p in enumerate(scope.parts)
        ]
        return F.concat(F.lit(""), *parts)

    def _or_error(self, value: Column, raw: Column, what: str) -> Column:
        if not self.strict:
            return F.coalesce(value, raw)
        return F.coalesce(value, F.raise_error(F.concat(F.lit(f"invalid {what}: "), raw)).cast("string"))

    def _placeholder(self, p: Placeholder, values: Values, attachments: Values, colored: bool) -> Column:
        f, args = p.formatter, p.arguments
        if f == "empty":
            return listed(F.when(F.size(values(args[0])) == 0, F.array(F.lit(args[1]))).otherwise(F.array().cast("array<string>")), colored)
        if f == "unless_empty":
            some = reduce(Column.__or__, [F.size(values(n)) > 0 for n in p.properties])
            return listed(F.when(some, F.array(F.lit(args[-1]))).otherwise(F.array().cast("array<string>")), colored)
        if f == "attachment":
            texts = F.transform(F.coalesce(attachments(args[0]), F.array().cast("array<string>")), lambda v: F.concat(F.lit("\n\n"), v, F.lit("\n\n")))
            return listed(texts, colored)
        if f == "merge":
            return listed(F.concat(*[values(n) for n in args]), colored)
        if f in ("time_span", "duration"):
            # the least value of either property, as texts
            both = F.array(*[F.array_min(values(n)) for n in args])
            return let(both, lambda raw: self._span(f, raw, colored))
        return listed(F.transform(values(args[0]), lambda v: self._value(f, args, v)), colored)

    def _span(self, f: str, raw: Column, colored: bool) -> Column:
        times = [in_utc(raw[i]).cast("timestamp") for i in (0, 1)]
        if f == "duration":
            text, plain = duration(*times), F.concat(F.lit("the time that passed between "), raw[0], F.lit(" and "), raw[1])
        else:
            iso = [
                F.concat(
                    F.date_format(t, "yyyy-MM-dd HH:mm:ss"),
                    F.when(F.unix_micros(t) % 1_000_000 != 0, F.date_format(t, ".SSSSSS")).otherwise(""),
                    F.lit("+00:00"),
                )
                for t in times
            ]
            text = F.concat(F.lit("between "), iso[0], F.lit(" and "), iso[1])
            plain = F.concat(F.lit("between "), raw[0], F.lit(" and "), raw[1])
        shown = F.when(raw[0].isNull() | raw[1].isNull(), "").otherwise(self._or_error(text, plain, f))
        return F.concat(F.lit(BOLD), shown, F.lit(PLAIN)) if colored else shown

    def _value(self, f: str | None, args: tuple[str, ...], v: Column) -> Column:
        if f == "date_time":
            return self._or_error(F.date_format(in_utc(v), ACCURACIES[args[1]]), v, "time")
        if f == "url":
            return F.concat(F.lit(f"{args[1]} ("), v, F.lit(")"))
        if f in BOOLEANS:
            yes, no = {"boolean_on_off": ("on", "off"), "boolean_is_is_not": ("is", "is not")}.get(f) or args[1:]
            either = F.lit(f"{yes} or {no}")
            chosen = F.when(v == "true", yes).when(v == "false", no)
            return F.coalesce(chosen, either) if not self.strict else self._or_error(chosen, v, "boolean")
        kind = self.kinds.get(args[0])
        if kind is not None and kind.is_floating:
            number = v.try_cast("double")
            return self._or_error(F.when(number.isNotNull(), F.format_string("%f", number)), v, "number")
        if kind is not None and kind.text == "geo:point":
            return point(v)
        return v


def collapsed(spark: SparkSession, text: str, event_type: EventType, kinds: Mapping[str, DataType], names: Mapping[str, tuple[str, str]]) -> list[tuple[set, set, str]]:
    """How a template degrades when values are left out, from the deepest scope to the whole: the properties left out
    in each step, the attachments left out, and the text. ``names`` has the display names of object types.

    Values are stood for by ``some …`` and ``one or more …``. Mandatory properties are never left out.
    """
    tree = parse(text)
    stand_in = {}
    for p in event_type.properties:
        one, many = names.get(p.object_type, (p.object_type, p.object_type))
        stand_in[p.name] = f"one or more {many}" if p.multivalued else f"some {one}"
    files = {a.name: f"zero or more '{a.name}' attachments" for a in event_type.attachments}
    mandatory = set(event_type.mandatory_properties)
    steps: list[tuple[set, set]] = []
    for _, scope in sorted(tree.scopes(), key=lambda x: -x[0]):
        for part in scope.parts:
            if not isinstance(part, Placeholder):
                continue
            if part.formatter == "attachment":
                steps.append((set(), set(part.arguments)))
            elif part.formatter in ("merge", "unless_empty", "empty"):
                if not mandatory & set(part.properties):
                    steps.append((set(part.properties), set()))
            else:
                steps += [({n}, set()) for n in part.properties if n not in mandatory]
    states, done = [(set(), set(), dict(stand_in), dict(files))], []
    for props, atts in steps:
        _, _, p, a = states[-1]
        p2, a2 = {k: v for k, v in p.items() if k not in props}, {k: v for k, v in a.items() if k not in atts}
        if p2 != p or a2 != a:
            states.append((props & set(p), atts & set(a), p2, a2))
            done.append((props, atts))
    rows = [(i, {k: [v] for k, v in p.items()}, {k: [v] for k, v in a.items()}) for i, (_, _, p, a) in enumerate(states)]
    df = spark.createDataFrame(rows, "i int, p map<string,array<string>>, a map<string,array<string>>")
    shown = df.select("i", Template(text, kinds).column(lambda n: F.col("p")[n], lambda n: F.col("a")[n]).alias("t")).orderBy("i").collect()
    return [(s[0], s[1], r["t"]) for s, r in zip(states, shown)]
