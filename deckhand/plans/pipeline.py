"""Filter, group, sort and page any DataFrame by a specification; everything compiles to one lazy plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckhand.functions.aggregates import BY_FREQUENCY, aggregate, by_frequency
from deckhand.functions.predicates import combined, condition, numeric, text
from deckhand.plans.spec import Spec


def resolved(df: DataFrame, path: str) -> tuple[Column, str]:
    """A column and its type by a path of names and 0-based positions, as a.b.0.c; a path that isn't there is null."""
    parts = path.split(".")
    kind: T.DataType = df.schema
    column: Column | None = None
    for part in parts:
        if isinstance(kind, T.VariantType):
            rest = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts[parts.index(part) :])
            return F.try_variant_get(column, f"${rest}", "string"), "string"
        if isinstance(kind, T.StructType) and part in kind.names:
            column = F.col(f"`{part}`") if column is None else column[part]
            kind = kind[part].dataType
        elif isinstance(kind, T.ArrayType) and re.fullmatch(r"\d+", part):
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            return F.lit(None).cast("string"), "string"
    return column, kind.simpleString()


def filtered(df: DataFrame, spec: Spec) -> DataFrame:
    return df.where(kept(df, spec)) if spec.filters else df


def kept(df: DataFrame, spec: Spec) -> Column:
    """Whether a row passes the filters."""
    parts = [condition(*resolved(df, f.field), f.condition, f.value, f.case_sensitive, f.formatting_criteria) for f in spec.filters]
    return combined(parts, spec.filter_logic)


def grouped(df: DataFrame, spec: Spec, seq: str) -> DataFrame:
    """One row a group: key columns (empty is null), the aggregations, and seq, the group's first one."""
    g = spec.grouping
    keys = [f.replace(".", "_") for f in g.fields]
    fields = {a.field: f"_v{k}" for k, a in enumerate(g.aggregations)}
    kinds = {f: resolved(df, f) for f in fields}
    columns = [F.when(text(resolved(df, f)[0]) != "", resolved(df, f)[0].cast("string")).alias(k) for f, k in zip(g.fields, keys)]
    rows = df.select(*columns, *(c.alias(fields[f]) for f, (c, _) in kinds.items()), F.col(f"`{seq}`").alias("_seq"))
    plain = [a for a in g.aggregations if a.operation not in BY_FREQUENCY]
    counted = list(dict.fromkeys(fields[a.field] for a in g.aggregations if a.operation in BY_FREQUENCY))
    out = frequencies(rows, keys, counted) if counted else rows
    own = {a.output_field: aggregate(F.col(fields[a.field]), kinds[a.field][1], a.operation, F.col("_seq"), a.separator) for a in plain}
    if not counted:
        out = out.groupBy(*keys).agg(F.min("_seq").alias("_seq"), *(c.alias(n) for n, c in own.items()))
    else:
        # Once a value, counting it; then once a group. What needs no counting is ready after the first step, in the entry of rows.
        each = out.groupBy(*keys, "_entry", *(f"_of{c}" for c in counted)).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"), *(c.alias(f"_own{k}") for k, c in enumerate(own.values())))
        ready = [F.max_by(f"_own{k}", F.when(F.col("_entry") == "", 1)).alias(n) for k, n in enumerate(own)]
        often = [by_frequency(F.col(f"_of{fields[a.field]}"), a.operation, F.when(F.col("_entry") == fields[a.field], F.struct("_n", -F.col("_first")))).alias(a.output_field) for a in g.aggregations if a.operation in BY_FREQUENCY]
        out = each.groupBy(*keys).agg(F.min("_first").alias("_seq"), *ready, *often)
    return out.select(*keys, *(f"`{a.output_field}`" for a in g.aggregations), F.col("_seq").alias(seq))


def frequencies(rows: DataFrame, keys: list[str], counted: list[str]) -> DataFrame:
    """Every row as an entry of its own, with all its values, and as one for each value to be counted, with that alone.

    So however many columns are counted, the input is read once and nothing is joined.
    """
    blank = F.struct(F.lit("").alias("_entry"), *(F.lit(None).cast(rows.schema[c].dataType).alias(f"_of{c}") for c in counted))
    entry = lambda c: F.struct(F.lit(c).alias("_entry"), *((F.col(c) if o == c else F.lit(None).cast(rows.schema[o].dataType)).alias(f"_of{o}") for o in counted))
    entries = F.explode(F.array_compact(F.array(blank, *(F.when(F.col(c).isNotNull(), entry(c)) for c in counted))))
    each = rows.select("*", entries.alias("_e"))
    others = [F.when(F.col("_e._entry") == "", F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in (*keys, "_seq")]
    return each.select(*(f"`{k}`" for k in keys), "_seq", *others, "_e.*")


def sort_key(df: DataFrame, field: str, order: str) -> list[Column]:
    """Numbers by value come before other text, which goes without regard to case; null counts as empty text."""
    c, kind = resolved(df, field)
    number = numeric(c, kind)
    parts = [number, F.when(number.isNull(), F.lower(text(c)))]
    return [parts[0].asc_nulls_last(), parts[1].asc()] if order == "asc" else [parts[0].desc_nulls_last(), parts[1].desc()]


def paged(df: DataFrame, spec: Spec, seq: str) -> DataFrame:
    """Sorted, with the order of ``seq`` among equals, and cut."""
    if spec.sorting or spec.limit is not None or spec.offset:
        df = df.orderBy(*(k for s in spec.sorting for k in sort_key(df, s.field, s.order)), F.col(f"`{seq}`"))
    if spec.offset:
        df = df.offset(spec.offset)
    return df if spec.limit is None else df.limit(spec.limit)


def run(df: DataFrame, spec: Spec | dict, seq: str) -> DataFrame:
    """The whole specification. ``seq`` is a column that orders the input; it goes along, in groups as their first."""
    spec = spec if isinstance(spec, Spec) else Spec.of(spec)
    rows = filtered(df, spec)
    if spec.grouping:
        rows = grouped(rows, spec, seq)
    return paged(rows, spec, seq)


def summary(df: DataFrame, spec: Spec | dict, seq: str) -> DataFrame:
    """One row: how many rows there were, passed the filters, and came out. The input is read once."""
    spec = spec if isinstance(spec, Spec) else Spec.of(spec)
    passes = F.coalesce(kept(df, spec), F.lit(False))
    keys = [text(resolved(df, f)[0]).alias(f"_k{k}") for k, f in enumerate(spec.grouping.fields)] if spec.grouping else []
    rows = df.select(passes.alias("_p"), *keys)
    if spec.grouping:
        each = rows.groupBy("_p", *(f"_k{k}" for k in range(len(keys)))).agg(F.count("*").alias("n"))
        one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original_count"), F.coalesce(F.sum(F.when(F.col("_p"), F.col("n"))), F.lit(0)).alias("filtered_count"), F.count_if("_p").alias("left"))
    else:
        one = rows.agg(F.count("*").alias("original_count"), F.count_if("_p").alias("filtered_count")).withColumn("left", F.col("filtered_count"))
    after = F.greatest(F.col("left") - spec.offset, F.lit(0))
    final = after if spec.limit is None else F.least(after, F.lit(spec.limit))
    return one.select("original_count", "filtered_count", final.cast("long").alias("final_count"), F.lit(spec.grouping is not None).alias("grouped"), F.lit(bool(spec.sorting)).alias("sorted"), F.lit(spec.limit is not None or spec.offset > 0).alias("paged"))
