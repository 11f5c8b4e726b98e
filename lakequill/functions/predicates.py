"""Predicates: conditions on an entity's columns as composable values that become Spark columns.

``c.price > 5`` makes a :class:`Predicate`; ``&``, ``|`` and ``~`` combine them, with ``ALWAYS`` and ``NEVER`` as identities.
A predicate is built against a scope (the alias a table has in a plan), so the same value serves a scan, an EXISTS body or a join side.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..model import Entity, Kind

if TYPE_CHECKING:
    from ..sources.context import Context

#: A character that no LIKE pattern escapes with, so that back-slashes in values stand for themselves.
NO_ESCAPE = "\u0001"

_aliases = itertools.count(1)


def fresh_alias(stem: str = "t") -> str:
    return f"__{stem}{next(_aliases)}"


class Scope:
    """Where a predicate's columns are found: an entity under an alias, in a context."""

    def __init__(self, context: Context, entity: Entity, alias: str | None = None, outer: bool = False):
        self.context, self.entity, self.alias, self.is_outer = context, entity, alias, outer

    def column(self, name: str) -> Column:
        stored = self.entity.get(name).name
        found = F.col(f"`{self.alias}`.`{stored}`" if self.alias else f"`{stored}`")
        return found.outer() if self.is_outer else found

    def as_outer(self) -> Scope:
        return Scope(self.context, self.entity, self.alias, True)


class Predicate:
    """A condition; ``build(scope)`` gives its column, None for ALWAYS."""

    def __init__(self, build: Callable[[Scope], Column], constant: bool | None = None, plain: bool = True):
        """``plain``: without subqueries, so that it can stand in a projection as well as in a filter."""
        self._build, self.constant, self.plain = build, constant, plain

    @staticmethod
    def always() -> Predicate:
        return ALWAYS

    @staticmethod
    def never() -> Predicate:
        return NEVER

    @property
    def is_always(self) -> bool:
        return self.constant is True

    @property
    def is_never(self) -> bool:
        return self.constant is False

    def build(self, scope: Scope) -> Column:
        return self._build(scope)

    def and_(self, other: Predicate) -> Predicate:
        if self.is_never or other.is_always:
            return self
        if other.is_never or self.is_always:
            return other
        return Predicate(lambda s: self.build(s) & other.build(s), plain=self.plain and other.plain)

    def or_(self, other: Predicate) -> Predicate:
        if self.is_always or other.is_never:
            return self
        if other.is_always or self.is_never:
            return other
        return Predicate(lambda s: self.build(s) | other.build(s), plain=self.plain and other.plain)

    def not_(self) -> Predicate:
        if self.constant is not None:
            return NEVER if self.constant else ALWAYS
        return Predicate(lambda s: ~self.build(s), plain=self.plain)

    def and_opt(self, other: Predicate | None) -> Predicate:
        return self if other is None else self.and_(other)

    def or_opt(self, other: Predicate | None) -> Predicate:
        return self if other is None else self.or_(other)

    __and__, __or__, __invert__ = and_, or_, not_

    def __bool__(self) -> bool:
        raise InvalidQuery("combine predicates with &, | and ~")


ALWAYS = Predicate(lambda s: F.lit(True), True)
NEVER = Predicate(lambda s: F.lit(False), False)

_OPERATORS = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def _value(value: object) -> Column:
    import enum

    return F.lit(value.value if isinstance(value, enum.Enum) else value)


class Field:
    """A column of an entity in a condition."""

    def __init__(self, entity: Entity, name: str):
        entity.get(name)
        self.entity, self.name = entity, name

    def _compare(self, op: str, other: object) -> Predicate:
        make = _OPERATORS[op]
        if isinstance(other, Field):
            return Predicate(lambda s: make(s.column(self.name), s.column(other.name)))
        return Predicate(lambda s: make(s.column(self.name), _value(other)))

    def __eq__(self, other):  # noqa: D105
        return self._compare("=", other)

    def __ne__(self, other):
        return self._compare("!=", other)

    def __gt__(self, other):
        return self._compare(">", other)

    def __ge__(self, other):
        return self._compare(">=", other)

    def __lt__(self, other):
        return self._compare("<", other)

    def __le__(self, other):
        return self._compare("<=", other)

    __hash__ = None

    def is_true(self) -> Predicate:
        return self == True  # noqa: E712

    def _like(self, before: str, value: str, after: str) -> Predicate:
        return Predicate(lambda s: F.like(s.column(self.name), F.lit(f"{before}{value}{after}"), F.lit(NO_ESCAPE)))

    def contains(self, value: str) -> Predicate:
        """LIKE %value%, case-sensitive; % and _ in the value keep their meaning."""
        return self._like("%", value, "%")

    def starts_with(self, value: str) -> Predicate:
        return self._like("", value, "%")

    def ends_with(self, value: str) -> Predicate:
        return self._like("%", value, "")

    def is_in(self, values: Iterable) -> Predicate:
        """IN a list; an empty list is false for every row."""
        values = list(values)
        if not values:
            return Predicate(lambda s: F.lit(False))
        return Predicate(lambda s: s.column(self.name).isin(*[_value(v) for v in values]))

    def not_in(self, values: Iterable) -> Predicate:
        return ~self.is_in(values)

    def between(self, low, high) -> Predicate:
        return Predicate(lambda s: s.column(self.name).between(_value(low), _value(high)))

    def is_null(self) -> Predicate:
        return Predicate(lambda s: s.column(self.name).isNull())

    def is_not_null(self) -> Predicate:
        return Predicate(lambda s: s.column(self.name).isNotNull())

    def in_subquery(self, entity: str, column: str, where: Callable | None = None) -> Predicate:
        """IN (SELECT column FROM entity WHERE ...), null-aware also when negated."""

        def build(s: Scope) -> Column:
            other = s.context.model.get(entity)
            alias = fresh_alias("in")
            inner = s.context.read(other, s.context.filter_joined).alias(alias)
            scope = Scope(s.context, other, alias)
            if where is not None:
                inner = inner.where(where(Columns(other)).build(scope))
            return s.column(self.name).isin(inner.select(scope.column(column)))

        return Predicate(build, plain=False)


class Link:
    """A navigation in a condition: ``any``, ``none`` and ``all`` of the related rows."""

    def __init__(self, entity: Entity, name: str):
        self.entity, self.nav = entity, entity.navigation(name)

    def _exists(self, s: Scope, where: Callable[[Columns], Predicate] | None, violating: bool = False) -> Column:
        context, nav = s.context, self.nav
        other = context.model.get(nav.target)
        alias, outer = fresh_alias("rel"), s.as_outer()
        inner = context.read(other, context.filter_joined).alias(alias)
        scope = Scope(context, other, alias)
        own_key = self.entity.key[0] if self.entity.key else None
        if nav.kind is Kind.BELONGS_TO:
            meets = scope.column(other.key[0]) == outer.column(nav.fk)
        elif nav.kind is Kind.MANY_TO_MANY:
            rows, first, second = context.join_rows(nav)
            inner = inner.join(rows.select(F.col(second).alias("__m2m_b"), F.col(first).alias("__m2m_a")), F.col("__m2m_b") == scope.column(other.key[0]))
            meets = F.col("__m2m_a") == outer.column(own_key)
        else:
            meets = scope.column(nav.fk) == outer.column(own_key)
        if where is not None:
            condition = where(Columns(other)).build(scope)
            meets = meets & (~condition if violating else condition)
        elif violating:
            meets = meets & F.lit(False)
        return inner.where(meets).exists()

    def any(self, where: Callable[[Columns], Predicate] | None = None) -> Predicate:
        return Predicate(lambda s: self._exists(s, where), plain=False)

    def none(self, where: Callable[[Columns], Predicate] | None = None) -> Predicate:
        return Predicate(lambda s: ~self._exists(s, where), plain=False)

    def all(self, where: Callable[[Columns], Predicate]) -> Predicate:
        """No related row for which the condition is false; true without related rows, null is no violation."""
        return Predicate(lambda s: ~self._exists(s, where, violating=True), plain=False)


class Columns:
    """Attribute access to an entity's columns and navigations; unknown names raise at once."""

    def __init__(self, entity: Entity):
        self._entity = entity

    def __getattr__(self, name: str) -> Field | Link:
        if name.startswith("__"):
            raise AttributeError(name)
        if name in self._entity.navigations:
            return Link(self._entity, name)
        return Field(self._entity, name)

    __getitem__ = __getattr__


def condition(name: str, op: str, *values) -> Callable[[Columns], Predicate]:
    """A condition from an operator in text: comparison, LIKE, IN, BETWEEN, IS NULL, IS NOT NULL."""
    op = op.upper()

    def build(c: Columns) -> Predicate:
        f = c[name]
        if op in _OPERATORS:
            if len(values) != 1:
                raise InvalidQuery(f"{op} needs one value")
            return f._compare(op, values[0])
        if op == "LIKE":
            return f._like("", values[0], "")
        if op in ("IN", "NOT IN"):
            return f.is_in(values) if op == "IN" else f.not_in(values)
        if op == "BETWEEN":
            if len(values) != 2:
                raise InvalidQuery("BETWEEN needs two values")
            return f.between(*values)
        if op in ("IS NULL", "IS NOT NULL"):
            return f.is_null() if op == "IS NULL" else f.is_not_null()
        raise InvalidQuery(f"unknown operator {op!r}")

    return build


def raw(column: Column) -> Predicate:
    """Any Spark column as a predicate: functions and arithmetic beyond the language above."""
    return Predicate(lambda s: column)


def frame_condition(df: DataFrame, context: Context, entity: Entity, predicate: Predicate) -> DataFrame:
    """``df`` (rows of an entity) under a condition."""
    if predicate.is_always:
        return df
    alias = fresh_alias()
    return df.alias(alias).where(predicate.build(Scope(context, entity, alias)))
