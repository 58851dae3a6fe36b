"""Conditions as columns. Null stands for an empty string and, in comparisons of numbers, for 0.

Comparison ignores case unless asked otherwise. Patterns are Java's; they are checked on the driver, so
that a bad one fails before any task starts, or matches nothing where that is the rule.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The names of all conditions.
CONDITIONS = (
    "equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "regex", "not_empty", "is_empty",
    "has_formatting", "no_formatting", "greater_than", "less_than", "greater_equal", "less_equal", "in_list", "not_in_list",
)
ORDER = {"greater_than": operator.gt, "less_than": operator.lt, "greater_equal": operator.ge, "less_equal": operator.le}
#: What counts as a number: digits with an optional sign, fraction and exponent.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
FORMATTING_KEYS = ("bold", "italic", "underline", "highlight", "strikethrough", "color", "font_size", "hyperlink")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def folded(c: Column, case_sensitive: bool) -> Column:
    return text(c) if case_sensitive else F.lower(text(c))


def fold(value: Any, case_sensitive: bool) -> str:
    plain = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return plain if case_sensitive else plain.lower()


def numeric(c: Column, kind: str) -> Column:
    """The value as a double, null where it isn't a number."""
    if kind == "string":
        return F.when(c.rlike(NUMBER), F.trim(c)).try_cast("double")
    return c.try_cast("double")


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def same(c: Column, kind: str, value: Any, case_sensitive: bool) -> Column:
    """Equality. A column of numbers equals a number, or text that is one, by value: 1.5E7 is 15000000, and 5.0 is "5"."""
    if kind.startswith(NUMBERS):
        if isinstance(value, bool) or (isinstance(value, str) and not re.match(NUMBER, value)):
            return F.lit(False)
        if value is not None:
            exact = F.lit(value if isinstance(value, int) else float(value))
            return F.coalesce(c == exact, F.lit(False))
    return folded(c, case_sensitive) == fold(value, case_sensitive)


def valid_pattern(pattern: str) -> bool:
    """Whether Java takes it as a pattern."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "PatternSyntaxException":
            return False
        raise
    except CapturedException as e:
        if "near index" in str(e):
            return False
        raise
    return True


def matches(c: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """A search; a bad pattern matches nothing."""
    whole = pattern if case_sensitive else f"(?iu){pattern}"
    return text(c).rlike(whole) if valid_pattern(whole) else F.lit(False)


def is_empty(c: Column, kind: str) -> Column:
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    if kind == "string":
        return F.trim(text(c)) == ""
    return c.isNull()


def has_formatting(c: Column, kind: str, criteria: dict | None) -> Column:
    """Any of the known keys of a struct that is set, or each of the criteria: True, False or a value."""

    def truth(key: str) -> Column:
        if f"{key}:" not in kind:
            return F.lit(False)
        x = c[key]
        plain = text(x.cast("string"))
        return x.isNotNull() & ~plain.isin("", "false", "0", "0.0", "[]")

    if not kind.startswith("struct"):
        return F.lit(False)
    if not criteria:
        return functools.reduce(operator.or_, map(truth, FORMATTING_KEYS))
    parts = [truth(k) if v is True else ~truth(k) if v is False else (text(c[k]) == str(v) if f"{k}:" in kind else F.lit(False)) for k, v in criteria.items()]
    return functools.reduce(operator.and_, parts)


def condition(c: Column, kind: str, name: str, value: Any = None, case_sensitive: bool = False, criteria: dict | None = None) -> Column:
    """The condition ``name`` on a column of the simple type ``kind``; never null."""
    if name not in CONDITIONS:
        raise ValueError(f"unknown condition: {name}")
    if name.startswith("not_") and name != "not_empty":
        positive = {"not_in_list": "in_list"}.get(name, name[4:])
        if name == "not_in_list" and not isinstance(value, (list, tuple)):
            return F.lit(True)
        return ~condition(c, kind, positive, value, case_sensitive)
    if name == "no_formatting":
        return ~has_formatting(c, kind, criteria)
    if name == "has_formatting":
        return has_formatting(c, kind, criteria)
    if name in ORDER:
        try:
            limit = float(value or 0)
        except (TypeError, ValueError):
            return F.lit(False)
        number = F.when(c.isNull(), F.lit(0.0)).otherwise(numeric(c, kind))
        return F.coalesce(ORDER[name](number, F.lit(limit)), F.lit(False))
    if name == "is_empty":
        return is_empty(c, kind)
    if name == "not_empty":
        return ~is_empty(c, kind)
    if name == "regex":
        return matches(c, fold(value, True), case_sensitive)
    if name == "in_list":
        if not isinstance(value, (list, tuple)):
            return F.lit(False)
        return combined([same(c, kind, v, case_sensitive) for v in value], "OR") if value else F.lit(False)
    if name == "equals":
        return same(c, kind, value, case_sensitive)
    x, v = folded(c, case_sensitive), fold(value, case_sensitive)
    return {"contains": x.contains(v), "starts_with": x.startswith(v), "ends_with": x.endswith(v)}[name]


def combined(parts: list[Column], logic: str = "AND") -> Column:
    """All or any of the parts; without parts everything passes."""
    if logic not in ("AND", "OR"):
        raise ValueError(f"filter logic is AND or OR, not {logic}")
    return functools.reduce(operator.and_ if logic == "AND" else operator.or_, parts) if parts else F.lit(True)
