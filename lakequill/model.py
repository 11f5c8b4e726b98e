"""Entities, their columns, keys, relationships and constraints: declared once, resolved late.

A :class:`Model` is a registry. Names in queries are looked up when a query is built, so a renamed table or column
reaches every predicate, navigation and filter.
"""

from __future__ import annotations

import enum
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql.types import (
    BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
    StructField, StructType, TimestampNTZType, TimestampType,
)

from .errors import ConfigurationError, UnknownColumn, UnknownEntity, UnknownNavigation

#: Names of scalar types.
TYPES: dict[str, DataType] = {
    "bool": BooleanType(), "boolean": BooleanType(), "tinyint": ByteType(), "smallint": ShortType(), "int": IntegerType(), "bigint": LongType(),
    "float": FloatType(), "double": DoubleType(), "string": StringType(), "uuid": StringType(), "binary": BinaryType(),
    "timestamp": TimestampType(), "timestamp_ntz": TimestampNTZType(), "date": DateType(), "decimal": DecimalType(38, 18),
}


def parse_type(name: str | DataType) -> DataType:
    if isinstance(name, DataType):
        return name
    if name in TYPES:
        return TYPES[name]
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name):
        return DecimalType(int(m[1]), int(m[2]))
    raise ConfigurationError(f"unknown type {name!r}")


@dataclass(frozen=True)
class Column:
    name: str
    type: DataType
    type_name: str
    column: str = ""  # name in storage
    required: bool = False
    auto_increment: bool = False
    concurrency_token: bool = False
    unique: bool = False
    indexed: bool = False
    max_length: int | None = None
    fixed_length: bool = False
    collation: str | None = None
    comment: str | None = None
    computed: str | None = None
    default: object = None
    allowed: tuple[str, ...] | None = None
    ignored: bool = False
    sequence: str | None = None
    column_type: str | None = None  # verbatim type for DDL

    @property
    def stored(self) -> str:
        return self.column or self.name


class Kind(enum.Enum):
    BELONGS_TO = "belongs_to"
    HAS_ONE = "has_one"
    HAS_MANY = "has_many"
    MANY_TO_MANY = "many_to_many"


class OnDelete(enum.Enum):
    CASCADE = "cascade"
    RESTRICT = "restrict"
    SET_NULL = "set_null"
    NO_ACTION = "no_action"


@dataclass(frozen=True)
class Navigation:
    """``fk`` is on this entity for BELONGS_TO, on the other for HAS_ONE and HAS_MANY; M-N goes through ``through``."""

    name: str
    kind: Kind
    target: str
    fk: str
    through: str | None = None  # entity or table of the join rows
    other_fk: str | None = None
    on_delete: OnDelete | None = None


@dataclass(frozen=True)
class Index:
    columns: tuple[str, ...]
    name: str = ""
    unique: bool = False
    filter: str | None = None
    include: tuple[str, ...] = ()
    expression: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    on_delete: OnDelete = OnDelete.NO_ACTION
    name: str = ""


@dataclass(frozen=True)
class Check:
    name: str
    sql: str


@dataclass
class Entity:
    """One registered entity; the methods return it, so that declarations chain."""

    name: str
    table: str
    model: Model
    columns: dict[str, Column] = field(default_factory=dict)
    key: tuple[str, ...] = ()
    navigations: dict[str, Navigation] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    alternate_keys: list[tuple[str, ...]] = field(default_factory=list)
    query_filter: Callable | None = None
    seed: list[dict] = field(default_factory=list)
    schema_name: str | None = None
    comment: str | None = None
    is_view: bool = False
    options: dict[str, str] = field(default_factory=dict)

    # --- columns ---

    def column(self, name: str, type_name: str, *, key: bool = False, **attributes) -> Entity:
        allowed = attributes.pop("enum", None)
        if allowed is not None:
            allowed = tuple(m.value if isinstance(m, enum.Enum) else m for m in allowed)
        self.columns[name] = Column(name, parse_type(type_name), str(type_name), allowed=allowed, **attributes)
        if key:
            self.key += (name,)
            self.columns[name] = replace(self.columns[name], required=True)
        return self

    def configure(self, name: str, **attributes) -> Entity:
        """Override attributes of a column, such as ``column`` (its stored name) or ``required``."""
        self.columns[name] = replace(self.get(name), **attributes)
        return self

    def get(self, name: str) -> Column:
        if name not in self.columns:
            raise UnknownColumn(f"{self.name} has no column {name!r}")
        return self.columns[name]

    def has_key(self, *names: str) -> Entity:
        self.key = tuple(self.get(n).name for n in names)
        return self

    def has_no_key(self) -> Entity:
        self.key = ()
        return self

    def has_alternate_key(self, *names: str) -> Entity:
        self.alternate_keys.append(tuple(self.get(n).name for n in names))
        return self

    # --- table ---

    def to_table(self, table: str) -> Entity:
        self.table = table
        return self

    def to_schema(self, schema: str) -> Entity:
        self.schema_name = schema
        return self

    def to_view(self, name: str) -> Entity:
        self.table, self.is_view = name, True
        return self

    def has_comment(self, text: str) -> Entity:
        self.comment = text
        return self

    def with_options(self, **options: str) -> Entity:
        self.options |= options
        return self

    def ignore(self, name: str) -> Entity:
        return self.configure(name, ignored=True)

    # --- relationships ---

    def belongs_to(self, name: str, target: str, fk: str, on_delete: OnDelete | None = None) -> Entity:
        self.navigations[name] = Navigation(name, Kind.BELONGS_TO, target, fk, on_delete=on_delete)
        return self

    def has_one(self, name: str, target: str, fk: str, on_delete: OnDelete | None = None) -> Entity:
        self.navigations[name] = Navigation(name, Kind.HAS_ONE, target, fk, on_delete=on_delete)
        return self

    def has_many(self, name: str, target: str, fk: str, on_delete: OnDelete | None = None) -> Entity:
        self.navigations[name] = Navigation(name, Kind.HAS_MANY, target, fk, on_delete=on_delete)
        return self

    def many_to_many(self, name: str, target: str, through: str, fk: str, other_fk: str) -> Entity:
        self.navigations[name] = Navigation(name, Kind.MANY_TO_MANY, target, fk, through, other_fk)
        return self

    def navigation(self, name: str) -> Navigation:
        if name not in self.navigations:
            raise UnknownNavigation(f"{self.name} has no navigation {name!r}")
        return self.navigations[name]

    # --- constraints ---

    def has_index(self, *names: str, name: str = "", unique: bool = False, filter: str | None = None, include: Iterable[str] = ()) -> Entity:
        self.indexes.append(Index(tuple(names), name or f"ix_{self.table}_{'_'.join(names)}", unique, filter, tuple(include)))
        return self

    def has_index_expression(self, expression: str, name: str, unique: bool = False) -> Entity:
        self.indexes.append(Index((), name, unique, expression=expression))
        return self

    def has_foreign_key(self, names: Iterable[str], target: str, target_columns: Iterable[str], on_delete: OnDelete = OnDelete.NO_ACTION) -> Entity:
        names = tuple(names)
        self.foreign_keys.append(ForeignKey(names, target, tuple(target_columns), on_delete, f"fk_{self.table}_{'_'.join(names)}"))
        return self

    def has_check(self, name: str, sql: str) -> Entity:
        self.checks.append(Check(name, str(sql)))
        return self

    def has_data(self, *rows: dict) -> Entity:
        self.seed += rows
        return self

    def has_query_filter(self, build: Callable) -> Entity:
        """``build(entity columns) -> Predicate``, applied to every scan, include and bulk change of this entity."""
        self.query_filter = build
        return self

    # --- types ---

    def stored_columns(self) -> list[Column]:
        return [c for c in self.columns.values() if not c.ignored and not c.computed]

    def schema(self) -> StructType:
        """What storage holds, under stored names."""
        return StructType([StructField(c.stored, c.type, not c.required) for c in self.stored_columns()])

    def token(self) -> Column | None:
        return next((c for c in self.columns.values() if c.concurrency_token), None)


class Model:
    """Registry of entities by name."""

    def __init__(self) -> None:
        self.entities: dict[str, Entity] = {}

    def entity(self, name: str, table: str | None = None) -> Entity:
        if name not in self.entities:
            self.entities[name] = Entity(name, table or name.lower(), self)
        return self.entities[name]

    def get(self, name: str) -> Entity:
        if name not in self.entities:
            raise UnknownEntity(f"no entity {name!r}")
        return self.entities[name]

    def by_table(self, table: str) -> Entity | None:
        return next((e for e in self.entities.values() if e.table == table), None)

    def apply(self, *configurations: Callable[[Model], None]) -> Model:
        """Run configuration functions, each of which declares or overrides entities."""
        for configure in configurations:
            configure(self)
        return self


#: Models by context key, built once.
_built: dict[str, Model] = {}


def cached_model(key: str, build: Callable[[], Model]) -> Model:
    if key not in _built:
        _built[key] = build()
    return _built[key]


def dependency_order(model: Model) -> list[Entity]:
    """Principals before dependents; entities of a cycle follow in order of declaration."""
    needs: dict[str, set[str]] = {n: set() for n in model.entities}
    for entity in model.entities.values():
        for nav in entity.navigations.values():
            if nav.target not in needs:
                continue
            if nav.kind is Kind.BELONGS_TO:
                needs[entity.name].add(nav.target)
            elif nav.kind in (Kind.HAS_MANY, Kind.HAS_ONE):
                needs[nav.target].add(entity.name)
        for fk in entity.foreign_keys:
            if fk.target in needs:
                needs[entity.name].add(fk.target)
    done: list[str] = []
    left = [n for n in needs]
    while left:
        ready = [n for n in left if not (needs[n] - {n}) & set(left)] or left[:1]
        done += ready
        left = [n for n in left if n not in ready]
    return [model.entities[n] for n in done]
