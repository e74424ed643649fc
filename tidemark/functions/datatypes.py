"""Data types of values: their Spark types, how a value is normalized, and when it is valid; all as column expressions.

A value is a string in the canonical form of its type. ``normalize`` gives that form, or null where there is none;
``valid`` is true for values in canonical form. Null and empty strings are never valid.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.binding import let

# Integers by bytes.
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "bigint": 64}
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
#: Forms of times that are read besides those that Spark casts.
TIME_FORMATS = (
    "yyyy/M/d[ H:mm[:ss]]", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss", "yyyyMMdd",
    "d MMM yyyy[ H:mm[:ss]][ xx]", "d MMM yyyy h:mm[:ss] a", "MMM d yyyy[ H:mm[:ss]][ xx]", "MMM d yyyy h:mm[:ss] a", "MMM d H:mm:ss yyyy", "yyyy MMM d[ H:mm[:ss]]",
    "d.M.yyyy[ H:mm[:ss]]", "M/d/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "d-MMM-yyyy[ H:mm[:ss]]",
)
# What is taken out of a written time, or written in one way, before it is read.
TIME_WORDS = (
    (r"(?i)\b(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?\b[.,]?", ""), (r"(?i)\b(gmt|utc|at|of|the)\b", ""), (r"(?i)(\d)(st|nd|rd|th)\b", "$1"), (r"(?i)(\d)\s*([ap])\.?m\.?(\s|$)", "$1 $2m"),
    (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1"), (r",", " "), (r"\s+", " "),
)
CURRENCY = (19, 4)


def format_time(ts: Column) -> Column:
    """A timestamp as the canonical text; the session's zone must be UTC."""
    return F.date_format(ts, TIME_FORMAT)


@dataclass(frozen=True)
class DataType:
    """A data type by its definition, such as ``number:int:signed`` or ``string:10:lc:u``."""

    text: str

    def __str__(self) -> str:
        return self.text

    @cached_property
    def parts(self) -> list[str]:
        return self.text.split(":")

    @property
    def family(self) -> str:
        return self.parts[0]

    @property
    def kind(self) -> str:
        return self.parts[1] if len(self.parts) > 1 else ""

    @property
    def is_floating(self) -> bool:
        return self.family == "number" and self.kind in ("float", "double")

    @property
    def is_signed(self) -> bool:
        return self.parts[-1] == "signed" or self.kind == "currency"

    @property
    def digits(self) -> tuple[int, int]:
        """Digits in all and after the point, of decimals."""
        return CURRENCY if self.kind == "currency" else (int(self.parts[2]), int(self.parts[3]))

    @property
    def choices(self) -> list[str]:
        return self.parts[1:]

    @property
    def bounds(self) -> tuple[int, int]:
        bits = INTEGER_BITS[self.kind]
        if not self.is_signed:
            return 0, 2**bits - 1
        return (-(2 ** (bits - 1)) if bits != 24 else -(2**23 - 1)), 2 ** (bits - 1) - 1

    def definition_errors(self) -> list[str]:
        """What is wrong with the definition; empty if nothing is."""
        t, wrong = self.text, [f"{self.text} is no data type"]
        if t in ("datetime", "sequence", "boolean", "uuid", "file", "geo:point", "ip:v4", "ip:v6", "number:currency"):
            return []
        if self.family == "enum":
            return [] if len(self.parts) > 1 else wrong
        if self.family == "number":
            if re.fullmatch(rf"number:({'|'.join(INTEGER_BITS)}|float|double)(:signed)?", t):
                return []
            if not re.fullmatch(r"number:decimal:\d+:\d+(:signed)?", t):
                return wrong
            total, after = self.digits
            return [] if 1 <= total <= 38 and total > after else [f"{t} needs 1 to 38 digits, and more than after the point"]
        if self.family == "hex":
            found = re.fullmatch(r"hex:(\d+)(?::(\d+):(.+))?", t, re.S)
            if not found:
                return wrong
            size, group = int(found[1]), found[2]
            if size == 0 or (group is not None and (int(group) == 0 or size % int(group))):
                return [f"{t} needs a length that its groups divide"]
            return []
        known = {"string": r"string:\d+:(mc|lc|uc)(:[ru]+)?", "base64": r"base64:\d+", "uri": r"uri:."}
        return [] if self.family in known and re.fullmatch(known[self.family], t, re.S) else wrong

    def is_upgrade_of(self, old: DataType) -> bool:
        """Equal, or an enumeration with more choices at its end."""
        if self.text == old.text:
            return True
        return self.family == old.family == "enum" and self.choices[: len(old.choices)] == old.choices

    @cached_property
    def spark_type(self) -> T.DataType:
        if self.family == "datetime":
            return T.TimestampType()
        if self.family == "sequence":
            return T.DecimalType(20, 0)
        if self.family == "boolean":
            return T.BooleanType()
        if self.family != "number":
            return T.StringType()
        if self.is_floating:
            return T.FloatType() if self.kind == "float" else T.DoubleType()
        if self.kind in ("decimal", "currency"):
            return T.DecimalType(*self.digits)
        low, high = self.bounds
        for bits, kind in ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType())):
            if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
                return kind
        return T.DecimalType(20, 0)

    def order(self, value: Column) -> Column:
        """What values of the type are ordered by: numbers by size, times as the texts they are."""
        return value if self.family == "datetime" else self.typed(value)

    def typed(self, value: Column) -> Column:
        """A canonical value in its Spark type, null where it isn't one."""
        if self.family == "datetime":
            return F.try_to_timestamp(value)
        return value.try_cast(self.spark_type) if not isinstance(self.spark_type, T.StringType) else value

    # -- normalization

    def normalize(self, value: Column) -> Column:
        value = F.nullif(value, F.lit(""))
        by_family = {
            "datetime": self._time, "sequence": self._integer, "number": self._number, "hex": F.lower, "uuid": F.lower,
            "ip": self._address, "geo": self._point, "string": self._string, "base64": self._base64,
        }
        if self.family == "boolean":
            return F.when(value.isNotNull(), F.when(value.isin("true", "True"), "true").otherwise("false"))
        return by_family.get(self.family, lambda v: v)(value)

    @staticmethod
    def _time(value: Column) -> Column:
        """Times as Spark reads them, and written ones: month names, weekdays, numbers with a suffix, am and pm; of two
        numbers with slashes the first is the month."""
        text = F.trim(value)
        plain = text
        for pattern, shown in TIME_WORDS:
            plain = F.regexp_replace(plain, pattern, shown)
        # month names begin with a capital, and am and pm are capitals
        plain = F.regexp_replace(F.initcap(F.trim(plain)), r" Am$", " AM")
        plain = F.regexp_replace(F.regexp_replace(plain, r" Pm$", " PM"), r"(\d)t(\d)", "$1T$2")
        return let(plain, lambda p: format_time(F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(p, F.lit(f)) for f in TIME_FORMATS])))

    @staticmethod
    def _integer(value: Column) -> Column:
        text = F.trim(value)
        return F.when(text.rlike(r"^[+-]?\d{1,38}\z"), text.try_cast("decimal(38,0)").cast("string"))

    def _number(self, value: Column) -> Column:
        text = F.trim(value)
        if self.is_floating:
            return F.format_string("%E", text.try_cast("double")) if self.kind == "double" else F.format_string("%E", text.try_cast("float").cast("double"))
        if self.kind in ("decimal", "currency"):
            return text.try_cast(f"decimal(38,{self.digits[1]})").cast("string")
        return self._integer(value)

    @staticmethod
    def _point(value: Column) -> Column:
        parts = F.split(value, ",")
        lat, lon = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
        text = F.format_string("%.6f,%.6f", lat, lon)
        return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), text)

    def _string(self, value: Column) -> Column:
        size, case = int(self.parts[1]), self.parts[2]
        out = {"lc": F.lower, "uc": F.upper}.get(case, lambda v: v)(value)
        return out if size == 0 else F.when(F.length(out) <= size, out)

    @staticmethod
    def _base64(value: Column) -> Column:
        bare = F.regexp_replace(value, r"=+\z", "")
        full = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
        return F.when((F.length(bare) % 4 != 1) & F.try_to_binary(full, F.lit("base64")).isNotNull(), full)

    def _address(self, value: Column) -> Column:
        text = F.lower(F.trim(value))
        octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
        if self.kind == "v4":
            return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}\z"), F.regexp_replace(text, r"\b0+(\d)", "$1"))
        # a dotted tail as two groups, then the gap filled with groups of zeros
        tail = F.split(F.regexp_extract(text, r":([0-9.]+)\z", 1), r"\.")
        pair = [
            F.lpad(F.lower(F.hex(tail[i].try_cast("int") * 256 + tail[i + 1].try_cast("int"))), 4, "0") for i in (0, 2)
        ]
        plain = F.when(
            text.rlike(rf":{octet}(\.{octet}){{3}}\z"), F.concat(F.regexp_replace(text, r"[0-9.]+\z", ""), F.concat_ws(":", *pair))
        ).otherwise(text)
        halves = F.split(plain, "::")

        def groups(part: Column) -> Column:
            return F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != "")

        left, right = groups(F.try_element_at(halves, F.lit(1))), groups(F.try_element_at(halves, F.lit(2)))
        missing = F.lit(8) - F.size(left) - F.size(right)
        filled = F.concat(left, F.when(missing > 0, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), right)
        shaped = F.when(F.size(halves) == 2, missing > 0).otherwise((F.size(halves) == 1) & (missing == 0))
        good = shaped & F.forall(filled, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        return F.when(good, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ":"))

    # -- validation

    def valid(self, value: Column) -> Column:
        return F.coalesce((value != "") & self._holds(value), F.lit(False))

    def _holds(self, value: Column) -> Column:
        f = self.family
        if f == "datetime":
            year = value.substr(1, 4).try_cast("int")
            return value.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):\d{2}:\d{2}\.\d{6}Z\z") & (year >= 1583)
        if f == "sequence":
            return value.rlike(r"^(0|[1-9]\d{0,19})\z") & (value.try_cast("decimal(38,0)") <= F.lit(str(2**64 - 1)).cast("decimal(38,0)"))
        if f == "boolean":
            return value.isin("true", "false")
        if f == "number":
            return self._holds_number(value)
        if f == "hex":
            return value.rlike(self._hex_pattern())
        if f == "uuid":
            return value.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
        if f == "geo":
            parts = F.split(value, ",")
            lat, lon = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
            return value.rlike(r"^-?\d{1,2}\.\d{6},-?\d{1,3}\.\d{6}\z") & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
        if f == "string":
            return self._holds_string(value)
        if f == "base64":
            raw = F.try_to_binary(value, F.lit("base64"))
            size = int(self.parts[1])
            return raw.isNotNull() & (F.lit(True) if size == 0 else F.octet_length(raw) <= size)
        if f == "enum":
            return value.isin(*self.choices)
        if f == "ip" and self.kind == "v4":
            octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
            return value.rlike(rf"^{octet}(\.{octet}){{3}}\z")
        if f == "ip":
            return value.rlike(r"^[0-9a-f]{4}(:[0-9a-f]{4}){7}\z")
        return F.lit(True)  # uri, file

    def _holds_number(self, value: Column) -> Column:
        sign = "-?" if self.is_signed else ""
        if self.is_floating:
            return value.rlike(rf"^{sign}\d\.\d{{6}}E[+-]\d{{2,3}}\z") & value.try_cast("double").isNotNull()
        if self.kind in ("decimal", "currency"):
            total, after = self.digits
            form = rf"^{sign}(0|[1-9]\d{{0,{total - after - 1}}})" + (rf"\.\d{{{after}}}\z" if after else r"\z")
            return value.rlike(form)
        low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in self.bounds)
        number = value.try_cast("decimal(38,0)")
        return value.rlike(rf"^(0|{sign}[1-9]\d{{0,19}})\z") & (number >= low) & (number <= high)

    def _hex_pattern(self) -> str:
        size = int(self.parts[1])
        if len(self.parts) == 2:
            return rf"^[0-9a-f]{{{2 * size}}}\z"
        group, mark = int(self.parts[2]), re.escape(":".join(self.parts[3:]) or ":")
        one = rf"[0-9a-f]{{{2 * group}}}"
        return rf"^{one}({mark}{one}){{{size // group - 1}}}\z"

    def _holds_string(self, value: Column) -> Column:
        size, case = int(self.parts[1]), self.parts[2]
        flags = self.parts[3] if len(self.parts) > 3 else ""
        out = F.lit(True)
        if size:
            out &= F.length(value) <= size
        if case in ("lc", "uc"):
            out &= value == (F.lower(value) if case == "lc" else F.upper(value))
        if "u" not in flags:
            out &= value.rlike(r"^[\x00-\xFF]*\z")
        return out
