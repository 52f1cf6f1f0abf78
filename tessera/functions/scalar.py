"""Scalar functions with the reference semantics where Spark's own differ; all are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# predicates


def distinct_from(a, b) -> Column:
    return ~_c(a).eqNullSafe(_c(b))


def between(x, low, high, low_open: bool = False, high_open: bool = False) -> Column:
    x = _c(x)
    return (x > _c(low) if low_open else x >= _c(low)) & (x < _c(high) if high_open else x <= _c(high))


def in_list(x, values: list) -> Column:
    """Three-valued IN: NULL if nothing matches and a NULL is among the values or x is NULL."""
    known = [v for v in values if v is not None]
    hit = _c(x).isin(known) if known else F.when(_c(x).isNotNull(), F.lit(False))
    return hit if len(known) == len(values) else F.when(hit, F.lit(True))


def constant_or_null(c, *args) -> Column:
    present = F.lit(True)
    for a in args:
        present = present & _c(a).isNotNull()
    return F.when(present, _c(c))


def like(x, pattern: str) -> Column:
    """LIKE without an escape character."""
    return _c(x).like(pattern.replace("\\", "\\\\"))


def prefix(x, needle: str) -> Column:
    return _c(x).startswith(needle)


def suffix(x, needle: str) -> Column:
    return _c(x).endswith(needle)


def contains(x, needle: str) -> Column:
    return _c(x).contains(needle)


# arithmetic


def divide(a, b) -> Column:
    """Double division; by zero gives infinity or NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    by_zero = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def int_divide(a, b) -> Column:
    """Truncating integer division; by zero is an error."""
    return F.call_function("div", _c(a), _c(b))


def modulus(a, b) -> Column:
    return _c(a) % _c(b)


def round_half_up(x, n: int = 0) -> Column:
    """Half away from zero, on the scaled double as the reference does it."""
    scale = 10.0**n
    return F.round(_c(x).cast("double") * scale) / scale


def to_int(x) -> Column:
    """Double to integer, half to even."""
    return F.rint(_c(x)).cast("int")


def decimal_to_int(x) -> Column:
    """Decimal to integer, half away from zero."""
    return F.round(_c(x), 0).cast("int")


# strings


def substring(x, start: int, length: int | None = None) -> Column:
    """1-based; negative from the end; offset 0 uses up one character of the length."""
    x = _c(x)
    if start == 0:
        return x if length is None else F.left(x, F.lit(max(length - 1, 0)))
    return F.substr(x, F.lit(start)) if length is None else F.substr(x, F.lit(start), F.lit(length))


def strlen(x) -> Column:
    return F.octet_length(_c(x)).cast("bigint")


def length(x) -> Column:
    return F.char_length(_c(x)).cast("bigint")


def concat(*xs) -> Column:
    """NULL counts as the empty string."""
    return F.concat_ws("", *[_c(x).cast("string") for x in xs])


def concat_op(*xs) -> Column:
    """The || operator: NULL if any part is."""
    return F.concat(*[_c(x) for x in xs])


#: Characters whose full upper case is longer than themselves, and what the simple mapping makes of them.
_LONG = [chr(c) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1]
_SIMPLE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG]
#: Unassigned places that hold such characters while the others are mapped.
_PLACES = "".join(chr(0xF000 + i) for i in range(len(_LONG)))


def upper(x) -> Column:
    """Upper case character by character: ``ß`` gives ``ẞ``, ligatures stay, no string grows."""
    held = F.translate(_c(x), "".join(_LONG), _PLACES)
    return F.when(_c(x).rlike("[" + "".join(_LONG) + "]"), F.translate(F.upper(held), _PLACES, "".join(_SIMPLE))).otherwise(F.upper(_c(x)))


def lower(x) -> Column:
    """Lower case character by character: ``İ`` gives ``i``, a last ``Σ`` gives ``σ``."""
    return F.lower(F.translate(_c(x), "İΣ", "iσ"))


def group_count(pattern: str) -> int:
    """Capturing groups of a pattern in the engine's own (Java, RE2) syntax: opening parentheses outside classes,
    quotes and escapes that are followed by no ``?``, or by a name."""
    n, i, in_class = 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] == "Q":
                i = pattern.find("\\E", i)
                if i < 0:
                    break
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "(" and not in_class:
            more = pattern[i + 1 : i + 4]
            n += not more.startswith("?") or more.startswith("?P<") or (more.startswith("?<") and more[2:3] not in ("=", "!"))
        i += 1
    return n


def regexp_replace_first(x, pattern: str, replacement: str) -> Column:
    r"""Replace the first match only; ``\1`` to ``\9`` refer to groups."""
    import re

    groups = group_count(pattern)
    out, i = "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement) and replacement[i + 1].isdigit():
            d = int(replacement[i + 1])
            out += f"${d + 2}"
            i += 2
            continue
        out += "\\$" if c == "$" else "\\\\" if c == "\\" else c
        i += 1
    shifted = re.sub(r"(?<!\\)\\(\d)", lambda m: f"\\{int(m[1]) + 2}", pattern)
    return F.regexp_replace(_c(x), rf"^([\s\S]*?)({shifted})([\s\S]*)$", "$1" + out + f"${groups + 3}")


# dates and times


def date_part(unit: str, x) -> Column:
    x = _c(x)
    simple = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "week": F.weekofyear, "doy": F.dayofyear}
    if unit in simple:
        return simple[unit](x).cast("bigint")
    if unit == "second":
        return F.second(x).cast("bigint")
    us = F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(60_000_000))
    if unit == "microsecond":
        return us
    if unit == "millisecond":
        return F.floor(us / 1000).cast("bigint")
    raise ValueError(f"unknown unit {unit}")


def date_trunc(unit: str, x) -> Column:
    return F.date_trunc(unit, _c(x).cast("timestamp")).cast("timestamp_ntz")


def date_minus(a, b) -> Column:
    return F.datediff(_c(a), _c(b)).cast("bigint")


def date_plus(a, days) -> Column:
    return F.date_add(_c(a), _c(days).cast("int"))


# structures


def row(*xs) -> Column:
    return F.struct(*[_c(x).alias(f"v{i}") for i, x in enumerate(xs)])


def struct_pack(**fields) -> Column:
    return F.struct(*[_c(x).alias(k) for k, x in fields.items()])


def positive(x) -> Column:
    """Unary plus: its argument."""
    return _c(x)


def negate(x) -> Column:
    """Unary minus; the smallest integer of a type has no opposite and is an error."""
    return -_c(x)


def absolute(x) -> Column:
    """Absolute value; of the smallest integer of a type it is an error."""
    return F.abs(_c(x))


def date_diff(unit: str, start, end) -> Column:
    """Boundaries of ``unit`` between two dates or timestamps (weeks: whole ones)."""
    a, b = _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz")
    months = lambda x: F.year(x) * 12 + F.month(x)
    if unit == "year":
        out = F.year(b) - F.year(a)
    elif unit == "quarter":
        out = (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))
    elif unit == "month":
        out = months(b) - months(a)
    elif unit == "week":
        out = F.call_function("div", F.datediff(b, a), F.lit(7))  # whole weeks
    elif unit == "day":
        out = F.datediff(b, a)
    else:
        size = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}[unit]
        us = lambda x: F.floor(F.unix_micros(x.cast("timestamp")) / F.lit(size))
        out = us(b) - us(a)
    return out.cast("bigint")


def strptime(x, form: str) -> Column:
    """Text to a timestamp by ``%`` directives; text that does not fit is an error."""
    known = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh"}
    for k, v in known.items():
        form = form.replace(k, v)
    return F.to_timestamp_ntz(_c(x), F.lit(form))


# casts


def to_decimal(x, precision: int, scale: int) -> Column:
    """Numbers to a decimal, half away from zero; out of range is an error."""
    return _c(x).cast(f"decimal({precision},{scale})")


def decimal_to(x, kind: str) -> Column:
    """Decimal to an integer type, half away from zero; out of range is an error."""
    return F.round(_c(x), 0).cast(kind)


def to_precision(x, unit: str) -> Column:
    """A timestamp rounded to milliseconds or seconds, halves up."""
    size = F.lit({"millisecond": 1000, "second": 1_000_000}[unit])
    us = F.unix_micros(_c(x).cast("timestamp")) + F.call_function("div", size, F.lit(2))
    return F.timestamp_micros(us - F.pmod(us, size)).cast("timestamp_ntz")


def error(message) -> Column:
    return F.raise_error(_c(message) if isinstance(message, Column) else F.lit(message))
