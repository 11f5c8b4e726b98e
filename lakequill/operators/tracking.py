"""Unit of work: entities added, changed and removed in memory, then written as one change of all tables.

Only the changes live on the driver. Tables are changed by joins with the (small) frames of changes and swapped together.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import enum
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StructField, StructType

from ..errors import CheckViolation, ForeignKeyViolation, InvalidQuery, RequiredViolation, TransactionError, UniqueViolation, Unsupported
from ..functions.checks import violations
from ..model import Entity, Kind, dependency_order
from ..sources.context import Context
from .mutation import cascade_delete, check_tokens, delta_frame, upsert_frame


class State(enum.Enum):
    UNCHANGED = "unchanged"
    ADDED = "added"
    MODIFIED = "modified"
    DELETED = "deleted"
    UPSERTED = "upserted"


@dataclass(eq=False)
class Entry:
    """A tracked row. A foreign key may hold the entry of its principal; it becomes the key when that is known."""

    entity: Entity
    values: dict
    state: State
    original: dict | None = None
    links: list[tuple[str, Entry]] = field(default_factory=list)
    added: bool = False  # tracked as a new row

    def __getitem__(self, name: str) -> object:
        return self.values[name]

    def __setitem__(self, name: str, value: object) -> None:
        self.values[self.entity.get(name).name] = value

    def dirty(self) -> list[str]:
        """Columns whose value differs from the original."""
        if self.original is None:
            return []
        return [n for n in self.values if n not in self.entity.key and self.values[n] != self.original.get(n)]

    def link(self, navigation: str, other: Entry) -> None:
        """Join two entries of a many-to-many navigation; the join row is written when both keys are known."""
        if self.entity.navigation(navigation).kind is not Kind.MANY_TO_MANY:
            raise InvalidQuery(f"{navigation} is not many-to-many")
        self.links.append((navigation, other))


class Interceptor:
    """Hooks around a save; override what is needed. ``on_saving_mut`` may change entries, the others look on."""

    def on_saving_mut(self, unit: UnitOfWork) -> None: ...

    def on_saving(self, entries: list[Entry]) -> None: ...

    def on_saved(self, entries: list[Entry], count: int) -> None: ...

    def on_save_failed(self, entries: list[Entry], error: Exception) -> None: ...


class Audit(Interceptor):
    """Fills time and actor columns of added and changed entries that have them."""

    def __init__(self, actor: str | None = None, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
                 created_at: str = "created_at", updated_at: str = "updated_at", created_by: str = "created_by", updated_by: str = "updated_by"):
        self.actor, self.now = actor, now
        self.names = created_at, updated_at, created_by, updated_by

    def on_saving_mut(self, unit: UnitOfWork) -> None:
        unit.detect_changes()
        created_at, updated_at, created_by, updated_by = self.names
        now = self.now()
        for entry in unit.entries:
            new = entry.state in (State.ADDED, State.UPSERTED)
            if not new and entry.state is not State.MODIFIED:
                continue
            for name, value, wanted in ((created_at, now, new), (created_by, self.actor, new), (updated_at, now, True), (updated_by, self.actor, True)):
                if wanted and name in entry.entity.columns:
                    entry.values[name] = value


class UnitOfWork:
    def __init__(self, context: Context):
        self.context = context
        self.entries: list[Entry] = []
        self._saved: dict | None = None  # what an open transaction goes back to

    # --- tracking ---

    def _entity(self, name: str) -> Entity:
        return self.context.model.get(name)

    def _track(self, name: str, values: dict, state: State) -> Entry:
        entity = self._entity(name)
        for column in values:
            entity.get(column)
        entry = Entry(entity, dict(values), state, None if state in (State.ADDED, State.UPSERTED) else dict(values), added=state is State.ADDED)
        self.entries.append(entry)
        return entry

    def add(self, name: str, /, **values) -> Entry:
        return self._track(name, values, State.ADDED)

    def attach(self, name: str, row: Row | dict) -> Entry:
        values = row.asDict() if isinstance(row, Row) else dict(row)
        return self._track(name, {k: v for k, v in values.items() if k in self._entity(name).columns}, State.UNCHANGED)

    def update(self, name: str, /, **values) -> Entry:
        """A row to be written whole, whatever it was; without its token in ``values`` no conflict is seen."""
        entry = self._track(name, values, State.MODIFIED)
        entry.original = {k: values[k] for k in entry.entity.key}
        token = entry.entity.token()
        if token and token.name in values:
            entry.original[token.name] = values[token.name]
        return entry

    def upsert(self, name: str, /, **values) -> Entry:
        return self._track(name, values, State.UPSERTED)

    def remove(self, entry: Entry) -> None:
        if entry.state is State.ADDED:
            self.detach(entry)
        else:
            entry.state = State.DELETED

    def remove_all(self, name: str) -> None:
        for entry in [e for e in self.entries if e.entity.name == name]:
            self.remove(entry)

    def load_all(self, name: str) -> list[Entry]:
        """Track every row of a table. The rows come to the driver: for tables meant to be edited by hand."""
        self.entries = [e for e in self.entries if e.entity.name != name]
        return [self.attach(name, r) for r in self.context.set(name).to_list()]

    def state_of(self, entry: Entry) -> State | None:
        """State of an entry; None if it is not tracked."""
        self.detect_changes()
        return entry.state if entry in self.entries else None

    def original_of(self, entry: Entry) -> dict | None:
        return None if entry.original is None else dict(entry.original)

    def modified_columns(self, entry: Entry) -> list[str]:
        return entry.dirty()

    def detach(self, entry: Entry) -> None:
        self.entries.remove(entry)

    def clear(self) -> None:
        self.entries.clear()

    def detect_changes(self) -> int:
        """Mark attached entries whose values differ; returns how many changes are pending."""
        for entry in self.entries:
            if entry.state in (State.UNCHANGED, State.MODIFIED) and entry.original is not None:
                changed = bool(entry.dirty())
                if entry.state is State.UNCHANGED and changed:
                    entry.state = State.MODIFIED
        return sum(e.state is not State.UNCHANGED for e in self.entries)

    def has_changes(self) -> bool:
        return self.detect_changes() > 0

    def entries_by_state(self, state: State) -> list[Entry]:
        return [e for e in self.entries if e.state is state]

    def count_by_state(self, state: State) -> int:
        return len(self.entries_by_state(state))

    def accept_changes(self) -> None:
        self.entries = [e for e in self.entries if e.state is not State.DELETED]
        for entry in self.entries:
            entry.state, entry.original = State.UNCHANGED, dict(entry.values)
            entry.links.clear()

    def reject_changes(self) -> None:
        self.entries = [e for e in self.entries if e.original is not None]
        for entry in self.entries:
            entry.state, entry.values = State.UNCHANGED, {**entry.values, **entry.original}
            entry.links.clear()

    # --- saving ---

    def save_changes(self, validate: bool = True) -> int:
        """Write all pending changes, or none; returns how many entries were written."""
        hooks = self.context.interceptors
        for hook in hooks:
            hook.on_saving_mut(self)
        self.detect_changes()
        pending = [e for e in self.entries if e.state is not State.UNCHANGED or e.links]
        for hook in hooks:
            hook.on_saving(pending)
        if not pending:
            for hook in hooks:
                hook.on_saved([], 0)
            return 0
        try:
            tables = self._changed_tables(pending, validate)
            self.context.replace_tables({self._entity(n).table: self.context.to_storage(self._entity(n), df) for n, df in tables.items()})
        except Exception as error:
            for hook in hooks:
                hook.on_save_failed(pending, error)
            raise
        self.accept_changes()
        for hook in hooks:
            hook.on_saved(pending, len(pending))
        return len(pending)

    def _frame(self, entity: Entity, rows: list[dict], names: list[str]) -> DataFrame:
        schema = StructType([StructField(n, entity.get(n).type, True) for n in names])
        return self.context.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def _changed_tables(self, pending: list[Entry], validate: bool) -> dict[str, DataFrame]:
        """The new rows of each table that changes; those that are only looked at are not among them."""
        tables: dict[str, DataFrame] = {}
        found: dict[str, DataFrame] = {}
        order = dependency_order(self.context.model)

        def rows(entity: Entity) -> DataFrame:
            if entity.name not in tables:
                stored = [F.col(f"`{c.name}`") for c in entity.stored_columns()]
                tables[entity.name] = found[entity.name] = self.context.read(entity, False).select(*stored)
            return tables[entity.name]

        for entity in order:
            mine = [e for e in pending if e.entity.name == entity.name]
            stored = [c.name for c in entity.stored_columns()]
            added = [e for e in mine if e.state is State.ADDED]
            if added:
                self._assign_keys(entity, added, rows(entity))
            for entry in mine:
                for name, value in entry.values.items():
                    if isinstance(value, Entry):
                        entry.values[name] = value.values[value.entity.key[0]]
            for entry in (*added, *(e for e in mine if e.state is State.UPSERTED)):
                for c in entity.stored_columns():
                    entry.values.setdefault(c.name, c.default)
            if validate:
                self._validate(entity, [e for e in mine if e.state in (State.ADDED, State.UPSERTED, State.MODIFIED)], added, rows)
            if added:
                tables[entity.name] = rows(entity).unionByName(self._frame(entity, [e.values for e in added], stored))
            if upserts := [e.values for e in mine if e.state is State.UPSERTED]:
                named = [tuple(v.get(k) for k in entity.key) for v in upserts]
                if len(set(named)) < len(named):
                    raise UniqueViolation(f"{entity.name}: two upserts of one key")
                tables[entity.name] = upsert_frame(self.context, entity, self._frame(entity, upserts, stored), rows(entity), validate=False)
            if changed := [e for e in mine if e.state is State.MODIFIED]:
                tables[entity.name] = self._update(entity, changed, rows(entity))
                if validate and entity.checks:
                    # The rows as they will be, with the columns that the entries do not hold.
                    keys = self._frame(entity, [{k: (e.original or {}).get(k, e.values.get(k)) for k in entity.key} for e in changed], list(entity.key))
                    if bad := violations(entity, tables[entity.name].join(keys, list(entity.key), "left_semi")).head(1):
                        raise CheckViolation(f"{entity.name}: {bad[0]['check']}")
        for entry in pending:
            for navigation, other in entry.links:
                self._link(entry, navigation, other, rows, tables)
        for entity in reversed(order):
            if gone := [e for e in pending if e.entity.name == entity.name and e.state is State.DELETED]:
                token = entity.token()
                names = [*entity.key, *([token.name] if token else [])]
                keys = self._frame(entity, [e.original or e.values for e in gone], names)
                check_tokens(entity, rows(entity), keys, len(gone))
                for other in order:
                    rows(other)
                cascade_delete(self.context, entity, keys.select(*entity.key), tables)
        return {n: df for n, df in tables.items() if df is not found.get(n)}

    def _assign_keys(self, entity: Entity, added: list[Entry], current: DataFrame) -> None:
        """Keys left open follow the greatest one in the table, in order of addition."""
        for name in entity.key:
            if not entity.get(name).auto_increment:
                continue
            open_ = [e for e in added if e.values.get(name) is None]
            if open_:
                top = current.agg(F.max(name)).first()[0] or 0
                top = max([top, *(e.values[name] for e in added if e.values.get(name) is not None)])
                for n, entry in enumerate(open_, 1):
                    entry.values[name] = top + n

    def _update(self, entity: Entity, changed: list[Entry], current: DataFrame) -> DataFrame:
        token = entity.token()
        names: dict[str, None] = {}
        rows = []
        for entry in changed:
            dirty = entry.dirty()
            if token and isinstance(token.type, IntegerType | LongType | ShortType) and token.name in entry.original and token.name not in dirty:
                entry.values[token.name] = (entry.original[token.name] or 0) + 1
                dirty.append(token.name)
            names |= dict.fromkeys(dirty)
            rows.append((entry, dirty))
        on = [*entity.key]
        with_token = [e for e in changed if token and token.name in e.original]
        for group, extra in ((with_token, [token.name] if token else []), ([e for e in changed if e not in with_token], [])):
            if group:
                keys = self._frame(entity, [{k: e.original.get(k, e.values.get(k)) for k in [*on, *extra]} for e in group], [*on, *extra])
                check_tokens(entity, current, keys, len(group))
        fields = [StructField(n, entity.get(n).type, True) for n in [*on, *names]]
        from pyspark.sql.types import ArrayType, StringType

        schema = StructType([*fields, StructField("__dirty", ArrayType(StringType()))])
        data = [(*(e.values.get(n) for n in [*on, *names]), dirty) for e, dirty in rows]
        return delta_frame(entity, current, self.context.spark.createDataFrame(data, schema))

    def _link(self, entry: Entry, navigation: str, other: Entry, rows: Callable, tables: dict) -> None:
        nav = entry.entity.navigation(navigation)
        if nav.through not in self.context.model.entities:
            raise Unsupported(f"links need the join table {nav.through} to be an entity")
        through = self._entity(nav.through)
        values = {nav.fk: entry.values[entry.entity.key[0]], nav.other_fk: other.values[other.entity.key[0]]}
        self._assign_keys(through, [made := Entry(through, values, State.ADDED)], rows(through))
        stored = [c.name for c in through.stored_columns()]
        tables[through.name] = rows(through).unionByName(self._frame(through, [made.values], stored))

    def _validate(self, entity: Entity, entries: list[Entry], added: list[Entry], rows: Callable) -> None:
        for entry in entries:
            for c in entity.stored_columns():
                written = entry.state is not State.MODIFIED or c.name in entry.values
                value = entry.values.get(c.name)
                if c.required and written and value is None:
                    raise RequiredViolation(f"{entity.name}.{c.name} is required")
                if c.max_length is not None and isinstance(value, str) and len(value) > c.max_length:
                    raise CheckViolation(f"{entity.name}.{c.name} is longer than {c.max_length}")
                if c.allowed is not None and value is not None and value not in c.allowed:
                    raise CheckViolation(f"{entity.name}.{c.name}: {value!r} is not allowed")
        if not entries:
            return
        stored = [c.name for c in entity.stored_columns()]
        uniques = [(entity.key, added)] if entity.key else []
        uniques += [((c.name,), entries) for c in entity.columns.values() if c.unique]
        uniques += [(k, entries) for k in entity.alternate_keys]
        uniques += [(i.columns, entries) for i in entity.indexes if i.unique and i.columns and not i.filter]
        for names, those in uniques:
            values = [tuple(e.values.get(n) for n in names) for e in those if all(e.values.get(n) is not None for n in names)]
            if len(values) != len(set(values)):
                raise UniqueViolation(f"{entity.name}({', '.join(names)}) twice among the changes")
            if values:
                new = self._frame(entity, [e.values for e in those], list(dict.fromkeys([*entity.key, *names])))
                met = rows(entity).alias("t").join(new.alias("n"), [F.col(f"t.`{n}`") == F.col(f"n.`{n}`") for n in names])
                if those is not added and entity.key:
                    same = F.lit(True)
                    for k in entity.key:
                        same = same & F.col(f"t.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
                    met = met.where(~same)
                if not met.isEmpty():
                    raise UniqueViolation(f"{entity.name}({', '.join(names)}) exists already")
        whole = [e.values for e in entries if all(n in e.values for n in stored)]
        if entity.checks and whole:
            bad = violations(entity, self._frame(entity, whole, stored))
            if not bad.isEmpty():
                raise CheckViolation(f"{entity.name}: {bad.first()['check']}")
        keys = [(nav.fk, nav.target, self._entity(nav.target).key[0]) for nav in entity.navigations.values() if nav.kind is Kind.BELONGS_TO]
        keys += [(fk.columns[0], fk.target, fk.target_columns[0]) for fk in entity.foreign_keys if len(fk.columns) == 1]
        for fk in (f for f in entity.foreign_keys if len(f.columns) > 1):
            tuples = {tuple(e.values.get(n, (e.original or {}).get(n)) for n in fk.columns) for e in entries if any(n in e.values for n in fk.columns)}
            if wanted := [t for t in tuples if None not in t]:
                other = self._entity(fk.target)
                frame = self._frame(other, [dict(zip(fk.target_columns, t, strict=True)) for t in wanted], list(fk.target_columns))
                if not frame.join(rows(other).select(*fk.target_columns), list(fk.target_columns), "left_anti").isEmpty():
                    raise ForeignKeyViolation(f"{entity.name}({', '.join(fk.columns)}) refers to no {fk.target}")
        for name, target, column in keys:
            values = {e.values.get(name) for e in entries if name in e.values} - {None}
            if values:
                other = self._entity(target)
                wanted = self._frame(other, [{column: v} for v in values], [column])
                if not wanted.join(rows(other).select(column), column, "left_anti").isEmpty():
                    raise ForeignKeyViolation(f"{entity.name}.{name} refers to no {target}")

    # --- transactions ---

    def _state(self) -> dict:
        context = self.context
        entries = [(e, dict(e.values), e.state, None if e.original is None else dict(e.original), list(e.links)) for e in self.entries]
        return {"frames": dict(context.frames), "manifest": context.store.manifest() if context.store else None, "entries": entries}

    def _restore(self, state: dict) -> None:
        """Tables and tracked entries as they were; entries tracked since then stay, their changes pending again."""
        known = {id(e) for e, *_ in state["entries"]}
        later = [e for e in self.entries if id(e) not in known]
        self.entries = []
        for entry, values, mode, original, links in state["entries"]:
            entry.values, entry.state, entry.original, entry.links = dict(values), mode, None if original is None else dict(original), list(links)
            self.entries.append(entry)
        for entry in later:
            if entry.added and entry.state is State.UNCHANGED:  # saved since, and undone now
                entry.state, entry.original = State.ADDED, None
            self.entries.append(entry)
        self.context.frames = dict(state["frames"])
        if state["manifest"] is not None and state["manifest"] != self.context.store.manifest():
            self.context.store.replace(state["manifest"])

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Saves inside stay if the block ends well, and are undone if it raises. Transactions do not nest."""
        if self._saved is not None:
            raise TransactionError("a transaction is open already")
        self._saved = self._state()
        handle = Transaction(self)
        try:
            yield handle
        except BaseException:
            if handle.open:
                self._restore(self._saved)
            raise
        finally:
            self._saved = None


class Transaction:
    """Savepoints are names for manifests: going back to one is a swap like any other."""

    def __init__(self, unit: UnitOfWork):
        self.unit, self.points, self.open = unit, {}, True

    def create_savepoint(self, name: str) -> None:
        self.points[name] = self.unit._state()

    def release_savepoint(self, name: str) -> None:
        if self.points.pop(name, None) is None:
            raise TransactionError(f"no savepoint {name!r}")

    def rollback_to(self, name: str) -> None:
        if name not in self.points:
            raise TransactionError(f"no savepoint {name!r}")
        self.unit._restore(self.points[name])

    def rollback(self) -> None:
        self.unit._restore(self.unit._saved)

    def commit(self) -> None:
        self.open = False

    def set_isolation(self, level: str) -> None:
        raise Unsupported("a single writer swaps whole tables: there are no isolation levels to choose")
