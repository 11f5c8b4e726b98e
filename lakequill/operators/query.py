"""Query: an immutable, lazy wrapper over a DataFrame of one entity's rows.

Every clause returns a new query. What a clause can do at once (filters, joins) it does on the frame; ordering, paging, grouping
and projection are kept until :meth:`Query.to_df` puts them in SQL's order. Nothing runs before a terminal.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import ConversionError, InvalidQuery, NotFound, NotUnique
from ..functions.predicates import ALWAYS, Columns, Field, Link, Predicate, Scope, fresh_alias
from ..model import Entity, parse_type
from ..sources.context import Context

if TYPE_CHECKING:
    from .mutation import BulkUpdate

_RANKING = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
_OFFSET = {"lag": F.lag, "lead": F.lead}
_AGGREGATE = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
_SET = {
    "union": lambda a, b: a.union(b).distinct(), "union_all": lambda a, b: a.union(b),
    "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b),
}


def _name(column: str | Field) -> str:
    return column.name if isinstance(column, Field) else column


@dataclass(frozen=True)
class Agg:
    """An aggregate in HAVING or in a grouped projection; compares with values and with other aggregates."""

    function: str
    column: str | None = None
    distinct: bool = False

    def build(self) -> Column:
        if self.function == "count" and self.column is None:
            return F.count("*")
        c = F.col(f"`{self.column}`")
        if self.distinct:
            return F.expr(f"{self.function}(DISTINCT `{self.column}`)")
        return _AGGREGATE[self.function](c)

    def _compare(self, op: str, other: object) -> Having:
        return Having(lambda put: getattr(put(self), op)(put(other) if isinstance(other, Agg) else F.lit(other)))

    def __eq__(self, other):
        return self._compare("__eq__", other)

    def __ne__(self, other):
        return self._compare("__ne__", other)

    def __gt__(self, other):
        return self._compare("__gt__", other)

    def __ge__(self, other):
        return self._compare("__ge__", other)

    def __lt__(self, other):
        return self._compare("__lt__", other)

    def __le__(self, other):
        return self._compare("__le__", other)

    __hash__ = None


class Having:
    """A condition on aggregates of a group; ``put`` gives the column of an aggregate."""

    def __init__(self, build: Callable):
        self.build = build

    def __and__(self, other: Having) -> Having:
        return Having(lambda put: self.build(put) & other.build(put))

    def __or__(self, other: Having) -> Having:
        return Having(lambda put: self.build(put) | other.build(put))

    def __invert__(self) -> Having:
        return Having(lambda put: ~self.build(put))


def agg(function: str, column: str | Field | None = None, distinct: bool = False) -> Agg:
    if function not in _AGGREGATE:
        raise InvalidQuery(f"unknown aggregate {function!r}")
    return Agg(function, None if column is None else _name(column), distinct)


@dataclass(frozen=True, eq=False)
class Query:
    context: Context
    entity: Entity
    rows: DataFrame
    filtered: bool = True
    orderings: tuple[tuple[str, bool], ...] = ()
    skipped: int | None = None
    taken: int | None = None
    is_distinct: bool = False
    selected: tuple[str, ...] | None = None
    group: tuple[str, ...] | None = None
    aggregates: tuple[tuple[str, Agg], ...] = ()
    havings: tuple[Having, ...] = ()
    windows: tuple[tuple[str, Callable], ...] = ()
    set_operations: tuple[tuple[str, DataFrame], ...] = ()
    includes: tuple[tuple[str, ...], ...] = ()
    ctes: tuple[tuple[str, DataFrame], ...] = ()
    predicate: Predicate = ALWAYS
    changed: bool = False  # joined or taken from a named source

    # --- conditions ---

    @property
    def c(self) -> Columns:
        return Columns(self.entity)

    def where(self, condition: Predicate | Callable[[Columns], Predicate]) -> Query:
        """Keep rows that meet a condition; several conditions add up."""
        predicate = condition if isinstance(condition, Predicate) else condition(self.c)
        if predicate.is_always:
            return self
        alias = fresh_alias()
        rows = self.rows.alias(alias).where(predicate.build(Scope(self.context, self.entity, alias)))
        return replace(self, rows=rows, predicate=self.predicate & predicate)

    filter = where

    # --- joins: one equality of a column here and one there ---

    def _join(self, how: str, entity: str, left: str | Field, right: str | Field, prefix: str | None) -> Query:
        other = self.context.model.get(entity)
        other.get(_name(right))
        side = self.context.read(other, self.context.filter_joined)
        stem = self._stem(prefix or other.table, side.columns)
        side = side.select(*(F.col(f"`{c}`").alias(f"{stem}_{c}" if c in self.rows.columns or prefix else c) for c in side.columns))
        named = _name(right) if _name(right) in side.columns and not prefix and _name(right) not in self.rows.columns else f"{stem}_{_name(right)}"
        a, b = fresh_alias("l"), fresh_alias("r")
        on = F.col(f"`{a}`.`{self.entity.get(_name(left)).name}`") == F.col(f"`{b}`.`{named}`")
        return replace(self, rows=self.rows.alias(a).join(side.alias(b), on, how), changed=True)

    def _stem(self, stem: str, columns: list[str]) -> str:
        """A prefix that keeps the columns of a table that is joined again apart: ``items``, then ``items_2`` and so on."""
        have, n, out = set(self.rows.columns), 1, stem
        while any(f"{out}_{c}" in have for c in columns):
            n += 1
            out = f"{stem}_{n}"
        return out

    def inner_join(self, entity: str, left, right, prefix: str | None = None) -> Query:
        return self._join("inner", entity, left, right, prefix)

    def left_join(self, entity: str, left, right, prefix: str | None = None) -> Query:
        return self._join("left", entity, left, right, prefix)

    def right_join(self, entity: str, left, right, prefix: str | None = None) -> Query:
        return self._join("right", entity, left, right, prefix)

    def full_join(self, entity: str, left, right, prefix: str | None = None) -> Query:
        return self._join("full", entity, left, right, prefix)

    def cross_join(self, entity: str, prefix: str | None = None) -> Query:
        other = self.context.model.get(entity)
        side = self.context.read(other, self.context.filter_joined)
        stem = self._stem(prefix or other.table, side.columns)
        side = side.select(*(F.col(f"`{c}`").alias(f"{stem}_{c}" if c in self.rows.columns or prefix else c) for c in side.columns))
        return replace(self, rows=self.rows.crossJoin(side), changed=True)

    # --- projection, grouping, windows ---

    def select(self, *columns: str | Field) -> Query:
        return replace(self, selected=tuple(_name(c) for c in columns))

    def group_by(self, *columns: str | Field) -> Query:
        return replace(self, group=tuple(_name(c) for c in columns))

    def aggregate(self, **named: Agg) -> Query:
        """Aggregates of each group as columns."""
        return replace(self, aggregates=self.aggregates + tuple(named.items()))

    def having(self, condition: Having) -> Query:
        return replace(self, havings=(*self.havings, condition))

    def window(self, alias: str, function: str, column: str | Field | None = None, partition_by: tuple = (), order_by: tuple = ()) -> Query:
        """A window column; frames are SQL's defaults. Ranking without an order goes by the key."""
        orders = [(_name(o[0]), o[1] == "desc") if isinstance(o, tuple) else (_name(o), False) for o in order_by]
        partition = [_name(p) for p in partition_by]
        if function not in {**_RANKING, **_OFFSET, **_AGGREGATE}:
            raise InvalidQuery(f"unknown window function {function!r}")
        if function in _RANKING and column is not None:
            raise InvalidQuery(f"{function} takes no column")
        if function not in _RANKING and column is None:
            raise InvalidQuery(f"{function} needs a column")
        if function not in _AGGREGATE and not orders:
            orders = [(k, False) for k in self.entity.key]
        spec = Window.partitionBy(*[F.col(f"`{p}`") for p in partition])
        if orders:
            spec = spec.orderBy(*(F.desc(f"`{n}`") if d else F.asc(f"`{n}`") for n, d in orders))
        make = _RANKING[function]() if function in _RANKING else {**_OFFSET, **_AGGREGATE}[function](F.col(f"`{_name(column)}`"))
        return replace(self, windows=(*self.windows, (alias, make.over(spec))))

    # --- order, paging, distinct ---

    def order_by(self, *columns: str | Field) -> Query:
        return replace(self, orderings=self.orderings + tuple((_name(c), False) for c in columns))

    def order_by_desc(self, *columns: str | Field) -> Query:
        return replace(self, orderings=self.orderings + tuple((_name(c), True) for c in columns))

    def skip(self, n: int) -> Query:
        return replace(self, skipped=n)

    def take(self, n: int) -> Query:
        return replace(self, taken=n)

    def distinct(self) -> Query:
        return replace(self, is_distinct=True)

    # --- set operations and named sources ---

    def _combine(self, kind: str, other: Query | DataFrame) -> Query:
        frame = other.to_df() if isinstance(other, Query) else other
        return replace(self, set_operations=(*self.set_operations, (kind, frame)))

    def union(self, other) -> Query:
        return self._combine("union", other)

    def union_all(self, other) -> Query:
        return self._combine("union_all", other)

    def intersect(self, other) -> Query:
        return self._combine("intersect", other)

    def except_(self, other) -> Query:
        return self._combine("except", other)

    def with_cte(self, name: str, source: Query | DataFrame | str, columns: tuple[str, ...] = (), args: tuple = ()) -> Query:
        """Name a query, a frame or raw SQL for :meth:`from_cte`."""
        if isinstance(source, str):
            self.context.register_views()
            for known, frame in self.ctes:
                frame.createOrReplaceTempView(known)
            frame = self.context.spark.sql(source, args=list(args)) if args else self.context.spark.sql(source)
        else:
            frame = source.to_df() if isinstance(source, Query) else source
        if columns:
            frame = frame.toDF(*columns)
        return replace(self, ctes=(*self.ctes, (name, frame)))

    def with_cte_typed(self, name: str, entity: str, condition: Callable[[Columns], Predicate] | None = None) -> Query:
        other = self.context.model.get(entity)
        source = Query(self.context, other, self.context.read(other, self.context.filter_joined))
        return self.with_cte(name, source if condition is None else source.where(condition))

    def with_recursive(self, name: str, entity: str, fk: str, key: str, anchor: Callable[[Columns], Predicate] | None = None, levels: int = 1000) -> Query:
        """Rows reached from the anchor rows by ``row.fk = found.key``, anchor included; what is deeper than ``levels``, a cycle too, raises.

        The session's limit on the rows of a recursion is lifted.
        """
        self.context.spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        other = self.context.model.get(entity)
        rows = self.context.read(other, self.context.filter_joined)
        start = Query(self.context, other, rows) if anchor is None else Query(self.context, other, rows).where(anchor)
        a, b = fresh_alias("all"), fresh_alias("start")
        rows.createOrReplaceTempView(a)
        start.rows.createOrReplaceTempView(b)
        names = ", ".join(f"`{c}`" for c in rows.columns)
        mine = ", ".join(f"t.`{c}`" for c in rows.columns)
        sql = f"WITH RECURSIVE found({names}) MAX RECURSION LEVEL {int(levels)} AS (SELECT {names} FROM {b} UNION ALL SELECT {mine} FROM {a} t JOIN found ON t.`{other.get(fk).name}` = found.`{other.get(key).name}`) SELECT {names} FROM found"
        return self.with_cte(name, self.context.spark.sql(sql))

    def from_cte(self, name: str) -> Query:
        for known, frame in reversed(self.ctes):
            if known == name:
                return replace(self, rows=frame, changed=True)
        raise InvalidQuery(f"no common table expression {name!r}")

    # --- includes ---

    def include(self, navigation: str | Link, *then: str) -> Query:
        """Load related rows as nested columns; ``then`` goes on along the path."""
        first = navigation.nav.name if isinstance(navigation, Link) else navigation
        path, at = (first, *then), self.entity
        for step in path:
            at = self.context.model.get(at.navigation(step).target)
        return replace(self, includes=(*self.includes, path))

    # --- the frame ---

    def to_df(self) -> DataFrame:
        """The rows this query returns, as a lazy DataFrame."""
        df = self.rows
        if self.group is not None:
            df = self._grouped(df)
        elif self.aggregates or self.havings:
            raise InvalidQuery("aggregate() and having() need group_by()")
        if self.windows:
            df = df.withColumns(dict(self.windows))
        # An order by columns that are not selected comes before the projection, where SQL allows it.
        whole = df.columns if self.selected is None else [*self.selected, *(a for a, _ in self.windows)]
        early = any(n not in whole for n, _ in self.orderings) and not (self.set_operations or self.is_distinct or self.group is not None)
        if early:
            df = self._paged(df)
        df = self._project(df)
        for kind, operand in self.set_operations:
            df = _SET[kind](df, operand)
        if self.is_distinct:
            df = df.distinct()
        if not early:
            df = self._paged(df)
        if self.includes:
            from .navigation import nest

            df = nest(self.context, self.entity, df, self.includes, self.filtered, narrow=not self.predicate.is_always or self.taken is not None)
            if self.orderings:
                df = df.orderBy(*(F.desc(f"`{n}`") if d else F.asc(f"`{n}`") for n, d in self.orderings))
        return df

    def _paged(self, df: DataFrame) -> DataFrame:
        hidden = [n for n, _ in self.orderings if n not in df.columns]
        if hidden:
            raise InvalidQuery(f"cannot order by {', '.join(hidden)}: not among the result's columns")
        if self.orderings:
            df = df.orderBy(*(F.desc(f"`{n}`") if d else F.asc(f"`{n}`") for n, d in self.orderings))
        if self.skipped:
            df = df.offset(self.skipped)
        if self.taken is not None:
            df = df.limit(self.taken)
        return df

    def _project(self, df: DataFrame) -> DataFrame:
        if self.selected is None:
            return df
        missing = [c for c in self.selected if c not in df.columns]
        if missing:
            raise InvalidQuery(f"{self.entity.name} query has no column {', '.join(missing)}")
        extra = [a for a, _ in self.windows if a not in self.selected]
        return df.select(*(F.col(f"`{c}`") for c in (*self.selected, *extra)))

    def _grouped(self, df: DataFrame) -> DataFrame:
        found: dict[str, Column] = {name: a.build() for name, a in self.aggregates}
        conditions = []

        def put(a: Agg) -> Column:
            name = f"__having_{len(found)}"
            found[name] = a.build()
            return F.col(name)

        for having in self.havings:
            conditions.append(having.build(put))
        whole = self.selected is None and not self.aggregates
        if whole:  # the row with the least key stands for its group
            order = F.struct(*(F.col(f"`{k}`") for k in self.entity.key)) if self.entity.key else F.struct("*")
            found["__row"] = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order)
        keys = [F.col(f"`{g}`") for g in self.group]
        out = df.groupBy(*keys).agg(*([c.alias(n) for n, c in found.items()] or [F.lit(1).alias("__one")]))
        if conditions:
            out = out.where(functools.reduce(lambda a, b: a & b, conditions))
        if whole:
            return out.select("__row.*")
        return out.select(*keys, *(F.col(n) for n, _ in self.aggregates))

    # --- terminals ---

    def _collect(self, df: DataFrame) -> list[Row]:
        return self.context.timed(self.entity.name, df.collect)

    def to_list(self) -> list[Row]:
        return self._collect(self.to_df())

    def to_tuples(self, *types: str) -> list[tuple]:
        """Selected columns as tuples, cast to types if given; a value that does not convert raises."""
        df = self.to_df()
        if types:
            if len(types) != len(df.columns):
                raise ConversionError(f"{len(df.columns)} columns, {len(types)} types")
            df = df.select(*(F.col(f"`{c}`").cast(parse_type(t)).alias(c) for c, t in zip(df.columns, types, strict=True)))
        return [tuple(r) for r in self._collect(df)]

    def first_or_default(self) -> Row | None:
        rows = self._collect(replace(self, taken=min(1, 1 if self.taken is None else self.taken)).to_df())
        return rows[0] if rows else None

    def first(self) -> Row:
        return self._found(self.first_or_default())

    def last_or_default(self) -> Row | None:
        orderings = self.orderings or tuple((k, False) for k in self.entity.key)
        if not orderings:
            raise InvalidQuery("last() needs an order or a key")
        if self.skipped or self.taken is not None:
            inner = replace(self, orderings=orderings).to_df()
            return replace(self, rows=inner, skipped=None, taken=None, windows=(), set_operations=(), group=None, orderings=tuple((n, not d) for n, d in orderings)).first_or_default()
        return replace(self, orderings=tuple((n, not d) for n, d in orderings)).first_or_default()

    def last(self) -> Row:
        return self._found(self.last_or_default())

    def single_or_default(self) -> Row | None:
        rows = self._collect(replace(self, taken=min(2, 2 if self.taken is None else self.taken)).to_df())
        if len(rows) > 1:
            raise NotUnique(f"more than one {self.entity.name}")
        return rows[0] if rows else None

    def single(self) -> Row:
        return self._found(self.single_or_default())

    def _found(self, row: Row | None) -> Row:
        if row is None:
            raise NotFound(f"no {self.entity.name}")
        return row

    def any(self) -> bool:
        return not self.context.timed(self.entity.name, self.to_df().isEmpty)

    def all(self, condition: Callable[[Columns], Predicate]) -> bool:
        """Whether the condition is true for every row; a null counts as not."""
        alias = fresh_alias()
        met = condition(self.c).build(Scope(self.context, self.entity, alias))
        return self.to_df().alias(alias).where(~F.coalesce(met, F.lit(False))).isEmpty()

    def _by_key(self, keys: dict) -> Query:
        missing = [k for k in self.entity.key if k not in keys]
        if missing or not self.entity.key:
            raise InvalidQuery(f"{self.entity.name} needs all of its key: {', '.join(self.entity.key)}")
        out = self
        for name, value in keys.items():
            out = out.where(lambda c, n=name, v=value: c[n] == v)
        return out

    def find(self, value: object) -> Row | None:
        if len(self.entity.key) != 1:
            raise InvalidQuery(f"{self.entity.name} has {len(self.entity.key)} key columns; use find_by_key")
        return self.find_by_key({self.entity.key[0]: value})

    def find_by_key(self, keys: dict) -> Row | None:
        return self._by_key(keys).first_or_default()

    def contains(self, value: object) -> bool:
        return self.exists_by_id(value)

    def exists_by_id(self, value: object) -> bool:
        return self.exists_by_key({self.entity.key[0]: value})

    def exists_by_key(self, keys: dict) -> bool:
        return self._by_key(keys).any()

    def to_dictionary(self, key: Callable[[Row], object]) -> dict:
        """Rows by a key; the last of equal keys stays."""
        return {key(r): r for r in self.to_list()}

    # --- scalar aggregates ---

    def count(self) -> int:
        """How many rows this query returns."""
        return self.context.timed(self.entity.name, self.to_df().count)

    long_count = count

    def scalar(self, function: str, column: str | Field) -> DataFrame:
        """One row with one column ``value``; sums and averages of nothing are 0.0, minima and maxima null."""
        c = F.col(f"`{self.entity.get(_name(column)).name}`")
        df = replace(self, is_distinct=False, orderings=() if self.taken is None and not self.skipped else self.orderings).to_df()
        if self.is_distinct:
            df = df.select(c).distinct()
        out = _AGGREGATE[function](c)
        if function in ("sum", "avg"):
            out = F.coalesce((F.sum if function == "sum" else F.avg)(c.cast("double") if function == "avg" else c).cast("double"), F.lit(0.0))
        return df.agg(out.alias("value"))

    def sum(self, column) -> float:
        return self.scalar("sum", column).first()["value"]

    def avg(self, column) -> float:
        return self.scalar("avg", column).first()["value"]

    def min(self, column) -> object:
        return self.scalar("min", column).first()["value"]

    def max(self, column) -> object:
        return self.scalar("max", column).first()["value"]

    # --- inspection ---

    def to_sql(self) -> str:
        """The optimised logical plan in text."""
        return self.to_df()._jdf.queryExecution().optimizedPlan().toString()

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    # --- changes ---

    def _changeable(self) -> None:
        if self.changed or self.group is not None or self.set_operations or self.orderings or self.skipped or self.taken is not None or self.is_distinct or self.windows or self.includes:
            raise InvalidQuery("a bulk change takes conditions only")

    def execute_update(self) -> BulkUpdate:
        from .mutation import BulkUpdate as Update

        self._changeable()
        return Update(self)

    def execute_delete(self) -> int:
        from .mutation import bulk_delete

        self._changeable()
        return bulk_delete(self)
