"""CHECK expressions as text, and the rows of a table that violate its constraints.

As in SQL a check passes on null, so violations are the rows for which it is false.
"""

from __future__ import annotations

import functools
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Entity, Kind

if TYPE_CHECKING:
    from ..sources.context import Context


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def raw(sql: str) -> str:
    return sql


def in_list(column: str, values: list) -> str:
    return f"`{column}` IN ({', '.join(map(_literal, values))})" if values else "FALSE"


def not_in_list(column: str, values: list) -> str:
    return f"`{column}` NOT IN ({', '.join(map(_literal, values))})" if values else "TRUE"


def _filled(columns: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN `{c}` IS NOT NULL THEN 1 ELSE 0 END" for c in columns) + ")"


def exactly_one_of(*columns: str) -> str:
    return f"{_filled(list(columns))} = 1"


def at_most_one_of(*columns: str) -> str:
    return f"{_filled(list(columns))} <= 1"


def at_least_one_of(*columns: str) -> str:
    return f"{_filled(list(columns))} >= 1"


def all_not_null(*columns: str) -> str:
    return " AND ".join(f"`{c}` IS NOT NULL" for c in columns)


def between(column: str, low: object, high: object) -> str:
    return f"`{column}` BETWEEN {_literal(low)} AND {_literal(high)}"


def non_negative(column: str) -> str:
    return f"`{column}` >= 0"


def positive(column: str) -> str:
    return f"`{column}` > 0"


def all_of(*checks: str) -> str:
    return " AND ".join(f"({c})" for c in checks) or "TRUE"


def any_of(*checks: str) -> str:
    return " OR ".join(f"({c})" for c in checks) or "FALSE"


def violations(entity: Entity, rows: DataFrame) -> DataFrame:
    """Rows that fail a CHECK, a length, an enumeration or NOT NULL, once for each, with its name in ``check``. One pass."""
    rules = [(c.name, ~F.expr(c.sql)) for c in entity.checks]
    for c in entity.stored_columns():
        at = F.col(f"`{c.name}`")
        if c.required:
            rules.append((f"{c.name} required", at.isNull()))
        if c.max_length is not None:
            rules.append((f"{c.name} length", F.length(at) > c.max_length))
        if c.allowed is not None:
            rules.append((f"{c.name} value", ~at.isin(*c.allowed)))
    if not rules:
        return rows.withColumn("check", F.lit("")).limit(0)
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
    return rows.withColumn("check", F.explode(broken))


def duplicates(entity: Entity, rows: DataFrame, among: DataFrame | None = None, touched: set[str] | None = None) -> DataFrame:
    """(rule, value, n) of key values that occur more than once: keys, alternate keys, unique columns and indexes.

    With ``among`` only values that those rows have, with ``touched`` only rules that name one of these columns.
    """
    found = []
    rules: list[tuple[tuple[str, ...], str | None]] = [(entity.key, None)] if entity.key else []
    rules += [(k, None) for k in entity.alternate_keys] + [((c.name,), None) for c in entity.columns.values() if c.unique]
    rules += [(i.columns, i.filter) for i in entity.indexes if i.unique and i.columns]
    for names, only in rules:
        if touched is not None and touched.isdisjoint(names):
            continue
        some = rows.where(only) if only else rows
        some = some.where(functools.reduce(lambda a, b: a & b, (F.col(f"`{n}`").isNotNull() for n in names)))
        if among is not None:
            some = some.join(among.select(*names).distinct(), list(names), "left_semi")
        counted = some.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
        found.append(counted.select(F.lit(", ".join(names)).alias("rule"), F.concat_ws(",", *(F.col(f"`{n}`").cast("string") for n in names)).alias("value"), "n"))
    return functools.reduce(DataFrame.unionByName, found) if found else rows.select(F.lit("").alias("rule"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).limit(0)


def orphans(context: Context, entity: Entity, rows: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, touched: set[str] | None = None) -> DataFrame:
    """(rule, value) of foreign keys that refer to no row, of the stored tables or of ``tables`` (frames by entity); ``touched`` as for duplicates."""
    rows = context.read(entity, False) if rows is None else rows
    keys = [((n.fk,), n.target, (context.model.get(n.target).key[0],)) for n in entity.navigations.values() if n.kind is Kind.BELONGS_TO]
    keys += [(f.columns, f.target, f.target_columns) for f in entity.foreign_keys]
    found = []
    for names, target, columns in keys:
        if touched is not None and touched.isdisjoint(names):
            continue
        there = (tables or {}).get(target)
        there = context.read(context.model.get(target), False) if there is None else there
        other = there.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
        some = rows.where(functools.reduce(lambda a, b: a & b, (F.col(f"`{n}`").isNotNull() for n in names)))
        gone = some.join(other, list(names), "left_anti")
        found.append(gone.select(F.lit(f"{', '.join(names)} -> {target}").alias("rule"), F.concat_ws(",", *(F.col(f"`{n}`").cast("string") for n in names)).alias("value")))
    return functools.reduce(DataFrame.unionByName, found) if found else rows.select(F.lit("").alias("rule"), F.lit("").alias("value")).limit(0)
