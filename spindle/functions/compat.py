"""SQLite-flavoured functions: as Columns here, as SQL text for the rewriter (the *_sql functions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime codes and the date_format patterns that give the same.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS"}
_UNITS = {"day": "DAY", "month": "MONTH", "year": "YEAR", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND"}


def total(x: Column) -> Column:
    """Sum as a double; 0.0 where there is nothing to sum."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def mul(x: Column) -> Column:
    """Product of the values that are not null; null where there are none."""
    return F.product(x)


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB pattern: * ? and [sets], case-sensitive, for the whole value."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + inner[1:] if inner.startswith("^") else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def glob_sql(pattern: str) -> str:
    return literal(glob_regex(pattern))


def date_sql(args: list[str], raw: list[str | None]) -> str:
    """date(x, modifier, ...): args as SQL, raw as the strings that literals stand for. Month ends are clamped."""
    if not args or raw[0] == "now":
        out = "current_date()"
    else:
        out = f"CAST({args[0]} AS DATE)"
    for modifier in raw[1:]:
        if modifier is None:
            raise ValueError("a date modifier must be a literal")
        words = modifier.lower().split()
        m = re.fullmatch(r"([+-]?\s*\d+)\s*([a-z]+)", " ".join(words))
        if words[:2] == ["start", "of"] and words[2:] in (["month"], ["year"]):
            out = f"trunc({out}, '{words[2].upper()}')"
        elif words[:2] == ["start", "of"] and words[2:] == ["day"]:
            continue
        elif m and (unit := _UNITS.get(m[2].rstrip("s"))):
            step = f"({out} + INTERVAL '{m[1].replace(' ', '').lstrip('+')}' {unit})"
            out = f"CAST({step} AS DATE)"
        else:
            raise ValueError(f"date modifier {modifier!r} is not known")
    return out


def strftime_sql(form: str, arg: str) -> str:
    """strftime(format, x) as date_format pieces."""
    out, plain = [], ""
    value = f"CAST({arg} AS TIMESTAMP)"
    for m in re.finditer(r"%(.)|([^%]+)", form, re.S):
        code = m[1]
        if code is None or code == "%":
            plain += m[2] if code is None else "%"
            continue
        if plain:
            out.append(literal(plain))
            plain = ""
        if code in STRFTIME:
            out.append(f"date_format({value}, '{STRFTIME[code]}')")
        elif code == "w":
            out.append(f"CAST(dayofweek({value}) - 1 AS STRING)")
        elif code == "s":
            out.append(f"CAST(unix_timestamp({value}) AS STRING)")
        else:
            raise ValueError(f"strftime code %{code} is not known")
    if plain or not out:
        out.append(literal(plain))
    return out[0] if len(out) == 1 else "concat(" + ", ".join(out) + ")"


def total_sql(arg: str) -> str:
    return f"coalesce(sum(CAST({arg} AS DOUBLE)), CAST(0 AS DOUBLE))"


def mul_sql(arg: str) -> str:
    """A product by partial aggregates (SQL has no product): sign, zeros and the sum of logarithms, rounded to 14 digits of it."""
    x = f"CAST({arg} AS DOUBLE)"
    size = f"exp(sum(ln(abs(nullif({x}, 0D)))))"
    digits = f"CAST(13 - floor(log10({size})) AS INT)"
    rounded = f"CASE WHEN {size} BETWEEN 1e-5 AND 1e13 THEN bround({size} * pow(10D, {digits})) / pow(10D, {digits}) ELSE {size} END"
    sign = f"CASE WHEN sum(CASE WHEN {x} < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1D ELSE 1D END"
    return f"CASE WHEN count({x}) = 0 THEN NULL WHEN sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) > 0 THEN 0D ELSE {sign} * ({rounded}) END"
