"""Specifications: what to filter, group, sort and page, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from deckhand.functions.aggregates import OPERATIONS
from deckhand.functions.predicates import CONDITIONS


def _one_of(value: str, known: tuple, what: str) -> str:
    if value not in known:
        raise ValueError(f"unknown {what}: {value!r}; known are {', '.join(known)}")
    return value


def _only(given: dict, known: tuple, what: str) -> dict:
    if not isinstance(given, dict):
        raise ValueError(f"{what} must be an object")
    if more := set(given) - set(known):
        raise ValueError(f"unknown keys in {what}: {', '.join(sorted(more))}")
    return given


@dataclass(frozen=True)
class Filter:
    field: str
    condition: str
    value: Any = None
    formatting_criteria: dict | None = None
    case_sensitive: bool = False

    def __post_init__(self):
        _one_of(self.condition, CONDITIONS, "condition")


@dataclass(frozen=True)
class Aggregation:
    field: str
    operation: str
    output_field: str
    separator: str = ", "

    def __post_init__(self):
        _one_of(self.operation, OPERATIONS, "operation")


@dataclass(frozen=True)
class Grouping:
    fields: tuple[str, ...]
    aggregations: tuple[Aggregation, ...] = ()


@dataclass(frozen=True)
class Sort:
    field: str
    order: str = "asc"

    def __post_init__(self):
        _one_of(self.order, ("asc", "desc"), "sort order")


@dataclass(frozen=True)
class Spec:
    """filters, grouping, sorting and paging, always in this order."""

    filters: tuple[Filter, ...] = ()
    filter_logic: str = "AND"
    grouping: Grouping | None = None
    sorting: tuple[Sort, ...] = field(default=())
    limit: int | None = None
    offset: int = 0

    def __post_init__(self):
        _one_of(self.filter_logic, ("AND", "OR"), "filter logic")
        if (self.limit is not None and self.limit < 0) or self.offset < 0:
            raise ValueError("limit and offset can't be negative")

    @staticmethod
    def of(given: dict) -> Spec:
        """From nested objects and lists, as in JSON."""
        _only(given, ("filters", "filter_logic", "grouping", "sorting", "limit", "offset"), "the specification")
        grouping = given.get("grouping")
        if grouping is not None:
            _only(grouping, ("fields", "aggregations"), "grouping")
            grouping = Grouping(tuple(grouping["fields"]), tuple(Aggregation(**a) for a in grouping.get("aggregations", ())))
        return Spec(
            tuple(Filter(**f) for f in given.get("filters") or ()),
            given.get("filter_logic", "AND").upper(),
            grouping,
            tuple(Sort(**s) for s in given.get("sorting") or ()),
            given.get("limit"),
            given.get("offset") or 0,
        )


def simple_filter(field: str, condition: str, value: Any = None, case_sensitive: bool = False) -> Filter:
    return Filter(field, condition, value, None, case_sensitive)


def formatting_filter(field: str, criteria: dict | None = None) -> Filter:
    """Rows whose field has formatting, or the formatting that the criteria state."""
    return Filter(field, "has_formatting", None, criteria)


def aggregation(field: str, operation: str, output_field: str, separator: str = ", ") -> Aggregation:
    return Aggregation(field, operation, output_field, separator)


def sort(field: str, order: str = "asc") -> Sort:
    return Sort(field, order)


def given_only(given: dict, known: tuple[str, ...], what: str) -> dict:
    """The known keys of an object that have a value; unknown keys are an error."""
    return {k: v for k, v in _only(given, known, what).items() if v is not None}


def slide_criteria(**given: Any) -> dict:
    """Search criteria for slides, checked: title, content, layout, notes, section, slide_numbers."""
    from deckhand.operators.slides import check_criteria

    found = {k: v for k, v in given.items() if v is not None}
    if errors := check_criteria(found):
        raise ValueError("; ".join(errors))
    return found


def table_criteria(given: dict) -> dict:
    return given_only(given, ("min_rows", "max_rows", "min_columns", "max_columns", "header_contains", "header_patterns"), "table criteria")


def column_selection(given: dict) -> dict:
    """Arguments of tables.selected()."""
    named = given_only(given, ("specific_columns", "column_patterns", "exclude_columns", "all_columns"), "column selection")
    names = {"specific_columns": "specific", "column_patterns": "patterns", "exclude_columns": "exclude"}
    return {names.get(k, k): v for k, v in named.items()}


def element_filter(given: dict) -> dict:
    """Arguments of formatting.filtered()."""
    known = ("formatting_types", "content_types", "text_contains", "text_patterns", "slide_numbers", "min_font_size", "max_font_size", "colors")
    return given_only(given, known, "formatting filter")
