"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value) -> Column:
    return F.coalesce(col(value), F.lit(""))


def strip(value) -> Column:
    """Text without surrounding white space of any kind."""
    return F.btrim(col(value), F.lit(" \t\r\n\f\x0b"))


def blank_to_null(value) -> Column:
    return F.nullif(col(value), F.lit(""))


@cache
def _constant_list(values: tuple) -> Column:
    joined = "\u0001".join(values).replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"split('{joined}', '\u0001')")


def string_array(values) -> Column:
    """A constant array<string>; a single expression that folds to one literal."""
    return _constant_list(tuple(values))


def among(value, values) -> Column:
    """Membership in a fixed list, as a test against one array literal."""
    return F.array_contains(string_array(values), col(value))


def explode_rows(df, array: str, *keep: str, pos: str | None = None):
    """One row per struct of an array column, with its fields as columns.

    The outer form is used on purpose: for the inner one the optimizer repeats the
    array's whole expression in a filter below the generator.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", "_row")) \
        .where(F.col("_row").isNotNull())
    return rows.select(*keep, *([F.col("_pos").alias(pos)] if pos else []), "_row.*")


def extend(rows: Column, many=None, **fields) -> Column:
    """Add fields to every struct of an array; each value is a function of the struct.

    ``many`` may return several fields at once.  Applied in stages this works as a
    per-row ``let``: a later stage reads what an earlier one computed instead of
    repeating the expression.
    """
    def added(r):
        values = dict(many(r)) if many else {}
        values.update({name: fn(r) for name, fn in fields.items()})
        return reduce(lambda acc, kv: acc.withField(kv[0], kv[1]), values.items(), r)
    return F.transform(rows, added)


def compact(*items) -> Column:
    """array(...) without its NULLs."""
    return F.array_compact(F.array(*items))


def prefixed(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value)


def let(body, **fields) -> Column:
    """Evaluate ``fields`` once and hand them to ``body`` as a struct.

    Inside lambdas Spark does not share common subexpressions, so repeated work
    is bound here explicitly.
    """
    row = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))
