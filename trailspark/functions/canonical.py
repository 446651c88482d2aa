"""Canonical JSON of typed columns, byte for byte (but for some floats) what ``json.dumps(value, sort_keys=True)`` writes, as Catalyst expressions.

Keys are sorted by code point, separators are ``", "`` and ``": "``, and all but
printable ASCII is escaped: short escapes where there are some, else lower-case
``\\uXXXX``, beyond the basic plane as surrogate pairs.  A float has the fewest
digits that read back as itself, with an exponent below 1e-4 and from 1e16 on.
Of several such forms it may not be the nearest, which Python writes: of 200,000
doubles of random bits 11 differ in the last digit, none of 100,000 below one.

Structs and maps are objects, arrays are lists, null is ``null`` at any depth;
maps may have string or integer keys, the latter sorted as numbers.  Types that
JSON lacks (decimals, dates, times, binary) are an error when the plan is built.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits after the first that the shortest form of a double may need.
_MOST_DIGITS = 16


def quoted(c: Column) -> Column:
    """A string as a JSON string in ASCII; null stays null."""
    wrapped = F.to_json(F.struct(c.alias("s")), {"writeNonAsciiCharacterAsCodePoint": "true"})  # {"s":"..."} with \uXXXX in upper case
    body = F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)
    # runs without a backslash, pairs of a backslash and a character, and code units, which alone change
    parts = F.regexp_extract_all(body, F.lit(r"(\\u[0-9A-F]{4}|\\.|[^\\]+)"), F.lit(1))
    lower = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p)), "")
    return F.when(c.isNotNull(), F.replace(F.when(F.contains(body, F.lit("\\u")), lower).otherwise(body), F.lit("\x7f"), F.lit("\\u007f")))


def _bound(c: Column, then) -> Column:
    """``then(c)`` with ``c`` computed once."""
    return F.transform(F.array(c), then)[0]


def _shortest(x: Column) -> Column:
    """The first precision in scientific form that reads back as the number.

    The platform's digits may be some of several that read back, and not the
    nearest, so at the highest precisions their neighbours are tried too.
    """
    exact = lambda s: F.when(s.try_cast("double") == x, s)
    form = lambda k: F.format_string(f"%.{k}e", x)

    def beside(k: int, step: int) -> Column:
        def moved(s: Column) -> Column:
            digits = (F.regexp_replace(F.substring_index(s, "e", 1), "[-.]", "").try_cast("long") + step).cast("string")
            sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
            return F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2), F.lit(k)), F.lit("e"), F.substring_index(s, "e", -1))

        return _bound(_bound(form(k), moved), exact)

    found = []
    for k in range(_MOST_DIGITS + 1):
        found += [_bound(form(k), exact), *(beside(k, step) for step in (1, -1) if _MOST_DIGITS - 2 <= k < _MOST_DIGITS)]
    return F.coalesce(*found)


def _laid_out(short: Column) -> Column:
    """A number in scientific form as Python writes it."""

    def lay(p: Column) -> Column:
        sign, digits, power, n = p["sign"], p["digits"], p["power"], F.length(p["digits"])
        fixed = (
            F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when(n <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - n), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, n)))
        )
        mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2), n)))
        far = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        return F.concat(sign, F.when((power >= -4) & (power < 16), fixed).otherwise(far))

    sign = F.when(short.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    parts = F.struct(sign.alias("sign"), F.regexp_replace(F.substring_index(short, "e", 1), "[-.]", "").alias("digits"), F.substring_index(short, "e", -1).try_cast("int").alias("power"))
    return _bound(parts, lay)


def number(c: Column) -> Column:
    """A double as Python writes it; null stays null."""
    endless = lambda x: F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))
    plain = lambda x: _bound(_shortest(x), _laid_out)
    return _bound(c.cast("double"), lambda x: F.when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == float("inf"), endless(x)).otherwise(plain(x)))


def object_of(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """An object with these keys."""
    parts = [F.concat(F.lit(f"{', ' if i else ''}{json.dumps(name)}: "), dumps(*fields[name])) for i, name in enumerate(sorted(fields))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def dumps(c: Column, type_: T.DataType) -> Column:
    """A column of this type as canonical JSON, never null."""
    if isinstance(type_, T.StringType):
        found = quoted(c)
    elif isinstance(type_, T.BooleanType | T.IntegralType):
        found = c.cast("string")
    elif isinstance(type_, T.FractionalType) and not isinstance(type_, T.DecimalType):
        found = number(c)
    elif isinstance(type_, T.StructType):
        found = F.when(c.isNotNull(), object_of({f.name: (c.getField(f.name), f.dataType) for f in type_.fields}))
    elif isinstance(type_, T.ArrayType):
        found = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: dumps(x, type_.elementType)), ", "), F.lit("]"))
    elif isinstance(type_, T.MapType) and isinstance(type_.keyType, T.StringType | T.IntegralType):
        entry = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(": "), dumps(e["value"], type_.valueType))
        keys = F.array_sort(F.map_keys(c))
        pairs = F.transform(keys, lambda k: entry({"key": k, "value": F.element_at(c, k)}))
        found = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(type_, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON for {type_.simpleString()}")
    return F.coalesce(found, F.lit("null"))
