"""Changes to whole tables: bulk update and delete, insert, upsert, delta updates and cascades, all copy-on-write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CheckViolation, ConcurrencyConflict, ForeignKeyViolation, InvalidQuery, RequiredViolation, UniqueViolation
from ..functions import checks
from ..functions.predicates import Columns, Scope, fresh_alias
from ..model import Entity, Kind, OnDelete
from ..sources.context import Context
from .query import Query


def _matched(query: Query) -> tuple[DataFrame, Column | None]:
    """All rows of the entity and the condition of those a bulk change is for; without one, ``__hit`` marks them."""
    context, entity = query.context, query.entity
    predicate = query.predicate
    if query.filtered and entity.query_filter is not None:
        predicate = entity.query_filter(Columns(entity)) & predicate
    alias = fresh_alias()
    rows = context.read(entity, False).alias(alias)
    scope = Scope(context, entity, alias)
    if predicate.is_always:
        return rows, F.lit(True)
    if predicate.plain:
        return rows, F.coalesce(predicate.build(scope), F.lit(False))
    if not entity.key:
        raise InvalidQuery(f"a bulk change by subquery needs a key on {entity.name}")
    keys = rows.where(predicate.build(scope)).select(*(F.col(f"`{alias}`.`{k}`").alias(k) for k in entity.key)).withColumn("__hit", F.lit(True))
    return context.read(entity, False).join(keys, list(entity.key), "left"), F.coalesce("__hit", F.lit(False))


class BulkUpdate:
    """Constant assignments to the rows that a query selects."""

    def __init__(self, query: Query):
        self.query, self.values = query, {}

    def set_column(self, name: str, value: object) -> BulkUpdate:
        self.values[self.query.entity.get(getattr(name, "name", name)).name] = value
        return self

    def frame(self) -> DataFrame:
        """The table as it would be."""
        if not self.values:
            raise InvalidQuery("set_column() first")
        rows, hit = _matched(self.query)
        entity = self.query.entity
        out = rows.withColumn("__now", hit).withColumns({n: F.when(F.col("__now"), F.lit(v).cast(entity.get(n).type)).otherwise(F.col(f"`{n}`")) for n, v in self.values.items()})
        return out.select(*(F.col(f"`{c.name}`") for c in entity.stored_columns()))

    def execute(self) -> int:
        out = self.frame()
        context, entity = self.query.context, self.query.entity
        for name, value in self.values.items():
            if value is None and entity.get(name).required:
                raise RequiredViolation(f"{entity.name}.{name} is required")
        rows, hit = _matched(self.query)
        count = rows.where(hit).count()
        if count:
            constants = F.lit(True)
            for name, value in self.values.items():
                constants = constants & F.col(f"`{name}`").eqNullSafe(F.lit(value).cast(entity.get(name).type))
            # Rows that have the new values: those that were changed, and others that had them before.
            check_rows(context, entity, out.where(constants), out, set(self.values))
            context.replace_tables({entity.table: context.to_storage(entity, out)})
        return count


def delete_frame(query: Query) -> DataFrame:
    """The table without the rows that a query selects."""
    rows, hit = _matched(query)
    return rows.where(~hit).select(*(F.col(f"`{c.name}`") for c in query.entity.stored_columns()))


def bulk_delete(query: Query) -> int:
    rows, hit = _matched(query)
    count = rows.where(hit).count()
    if count:
        query.context.replace_tables({query.entity.table: query.context.to_storage(query.entity, delete_frame(query))})
    return count


def _conform(entity: Entity, rows: DataFrame) -> DataFrame:
    """Rows under all stored columns of an entity: defaults for those that are absent."""
    return rows.select(*(
        (F.col(f"`{c.name}`") if c.name in rows.columns else F.lit(c.default)).cast(c.type).alias(c.name) for c in entity.stored_columns()
    ))


def check_rows(context: Context, entity: Entity, rows: DataFrame, whole: DataFrame, touched: set[str] | None = None) -> None:
    """Raise at the first rule that ``rows`` break in the table ``whole``: required, checks, keys and unique columns, foreign keys.

    Unique columns and foreign keys are tried by the values of ``rows`` only; with ``touched`` only those of these columns.
    """
    if bad := checks.violations(entity, rows).head(1):
        rule = bad[0]["check"]
        raise (RequiredViolation if rule.endswith(" required") else CheckViolation)(f"{entity.name}: {rule}")
    if bad := checks.duplicates(entity, whole, rows, touched).head(1):
        raise UniqueViolation(f"{entity.name}({bad[0]['rule']}) {bad[0]['value']} {bad[0]['n']} times")
    if bad := checks.orphans(context, entity, rows, {entity.name: whole}, touched).head(1):
        raise ForeignKeyViolation(f"{entity.name}: {bad[0]['rule']} refers to no row with {bad[0]['value']}")


def insert_frame(context: Context, entity: Entity, rows: DataFrame, current: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """The table with ``rows`` added; absent auto-increment keys follow the greatest one (with gaps). Rows that break a rule raise."""
    current = context.read(entity, False) if current is None else current
    for name in entity.key:
        if entity.get(name).auto_increment and name not in rows.columns:
            top = current.agg(F.coalesce(F.max(name), F.lit(0)).cast("long")).first()[0]
            rows = rows.withColumn(name, F.monotonically_increasing_id() + F.lit(top + 1))
    stored = [F.col(f"`{c.name}`") for c in entity.stored_columns()]
    rows = _conform(entity, rows)
    out = current.select(*stored).unionByName(rows)
    if validate:
        check_rows(context, entity, rows, out)
    return out


def upsert_frame(context: Context, entity: Entity, rows: DataFrame, current: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """The table with ``rows`` in place of those of equal keys, or added. Two rows of one key, and rows that break a rule, raise."""
    if not entity.key:
        raise InvalidQuery(f"upsert needs a key on {entity.name}")
    current = context.read(entity, False) if current is None else current
    rows = _conform(entity, rows)
    kept = current.join(rows.select(*entity.key), list(entity.key), "left_anti")
    out = kept.select(*rows.columns).unionByName(rows)
    if validate:
        check_rows(context, entity, rows, out)
    return out


def delta_frame(entity: Entity, current: DataFrame, delta: DataFrame) -> DataFrame:
    """The table with changed columns of ``delta`` applied row by row.

    ``delta`` has the key, new values as columns, and ``__dirty``, the names of the columns each row changes, so
    that a null can be written and an unchanged column is left alone.
    """
    changed = [c for c in delta.columns if c not in (*entity.key, "__dirty")]
    d = delta.select(*entity.key, *(F.col(f"`{c}`").alias(f"__new_{c}") for c in changed), "__dirty")
    joined = current.join(d, list(entity.key), "left")
    new = {c: F.when(F.array_contains("__dirty", c), F.col(f"`__new_{c}`").cast(entity.get(c).type)).otherwise(F.col(f"`{c}`")) for c in changed}
    return joined.withColumns(new).select(*(F.col(f"`{c.name}`") for c in entity.stored_columns()))


def check_tokens(entity: Entity, current: DataFrame, keys: DataFrame, expected: int) -> None:
    """Every row of ``keys`` (key, and the token if there is one) must still be there."""
    on = [c for c in keys.columns]
    met = current.join(keys, on, "left_semi").count()
    if met != expected:
        raise ConcurrencyConflict(f"{expected - met} of {expected} rows of {entity.name} were changed or deleted meanwhile")


def delete_rule(context: Context, entity: Entity, nav) -> OnDelete:
    """Declared rule, or by the foreign key: required ones cascade, nullable ones become null."""
    if nav.on_delete is not None:
        return nav.on_delete
    return OnDelete.CASCADE if context.model.get(nav.target).get(nav.fk).required else OnDelete.SET_NULL


def _reaches(context: Context, start: str, wanted: str) -> bool:
    """Does a chain of cascading navigations lead from one entity to another."""
    todo, seen = [start], set()
    while todo:
        entity = context.model.get(todo.pop())
        for nav in entity.navigations.values():
            if nav.kind in (Kind.HAS_MANY, Kind.HAS_ONE) and nav.target not in seen and delete_rule(context, entity, nav) is OnDelete.CASCADE:
                if nav.target == wanted:
                    return True
                seen.add(nav.target)
                todo.append(nav.target)
    return False


def cascade_delete(context: Context, entity: Entity, keys: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Remove the rows of ``keys`` and what depends on them from ``tables`` (frames by entity).

    First all keys that go are found, down every chain of cascading navigations and round its cycles, then each
    table is changed once. RESTRICT raises if a row that stays refers to one that goes.
    """

    def rows(e: Entity) -> DataFrame:
        if e.name not in tables:
            tables[e.name] = context.read(e, False)
        return tables[e.name]

    def at(e: Entity, found: DataFrame, name: str) -> DataFrame:
        return found.select(F.col(f"`{e.key[0]}`").alias(name)).distinct()

    gone: dict[str, DataFrame] = {}
    keyless: list[tuple[Entity, str, DataFrame]] = []
    todo = [(entity, keys.select(*entity.key).distinct())]
    while todo:
        e, fresh = todo.pop(0)
        if e.name not in gone:
            gone[e.name] = fresh
        else:
            fresh = fresh.join(gone[e.name], list(e.key), "left_anti")
            gone[e.name] = gone[e.name].unionByName(fresh)
        if _reaches(context, e.name, e.name):
            # A cycle goes round until nothing new is found; each round is cut off from those before.
            fresh, gone[e.name] = context.cut(fresh), context.cut(gone[e.name])
            if fresh.isEmpty():
                continue
        for nav in e.navigations.values():
            if nav.kind in (Kind.HAS_MANY, Kind.HAS_ONE) and delete_rule(context, e, nav) is OnDelete.CASCADE:
                other = context.model.get(nav.target)
                parents = at(e, fresh, nav.fk)
                if other.key:
                    todo.append((other, rows(other).join(parents, nav.fk, "left_semi").select(*other.key)))
                else:
                    keyless.append((other, nav.fk, parents))

    def staying(e: Entity) -> DataFrame:
        return rows(e).join(gone[e.name], list(e.key), "left_anti") if e.name in gone else rows(e)

    for name, found in gone.items():
        e = context.model.get(name)
        for nav in e.navigations.values():
            if nav.kind in (Kind.HAS_MANY, Kind.HAS_ONE) and delete_rule(context, e, nav) is OnDelete.RESTRICT:
                other = context.model.get(nav.target)
                if not staying(other).join(at(e, found, nav.fk), nav.fk, "left_semi").isEmpty():
                    raise ForeignKeyViolation(f"{e.name} is still used by {other.name}")
    for name, found in gone.items():
        e = context.model.get(name)
        for nav in e.navigations.values():
            if nav.kind is Kind.MANY_TO_MANY and nav.through in context.model.entities:
                through = context.model.get(nav.through)
                tables[through.name] = rows(through).join(at(e, found, nav.fk), nav.fk, "left_anti").select(*rows(through).columns)
            elif nav.kind in (Kind.HAS_MANY, Kind.HAS_ONE) and delete_rule(context, e, nav) is OnDelete.SET_NULL:
                other = context.model.get(nav.target)
                marked = rows(other).join(at(e, found, nav.fk).withColumn("__gone", F.lit(True)), nav.fk, "left")
                tables[other.name] = marked.withColumn(nav.fk, F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(nav.fk))).select(*rows(other).columns)
    for other, fk, parents in keyless:
        tables[other.name] = rows(other).join(parents, fk, "left_anti").select(*rows(other).columns)
    for name in gone:
        e = context.model.get(name)
        tables[name] = staying(e).select(*rows(e).columns)
