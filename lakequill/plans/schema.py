"""Schema tooling: snapshots of a model, their differences, DDL, migrations with a history, and comparison with live tables.

Spark's Parquet tables take only some of ``ALTER TABLE``; changes they refuse (dropped, renamed or retyped columns) are
applied by rewriting the table. Keys, checks and indexes live in the model and are validated before a swap.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..errors import ConstraintViolation, MigrationError, Unsupported
from ..functions.checks import duplicates, orphans, violations
from ..model import Entity, Model, dependency_order
from ..sources.context import Context

# --- snapshots -----------------------------------------------------------------------------------------------------


def _type_name(t: DataType) -> str:
    return t.simpleString()


def snapshot(model: Model) -> dict:
    """A model as plain JSON values, in a stable order."""
    tables = {}
    for entity in model.entities.values():
        if entity.is_view:
            continue
        tables[entity.table] = {
            "columns": {
                c.stored: {"type": _type_name(c.type), "required": c.required, "max_length": c.max_length, "default": c.default, "comment": c.comment, "column_type": c.column_type}
                for c in entity.stored_columns()
            },
            "key": [entity.get(k).stored for k in entity.key],
            "indexes": {i.name: {"columns": list(i.columns), "unique": i.unique, "filter": i.filter, "include": list(i.include), "expression": i.expression} for i in entity.indexes},
            "foreign_keys": {f.name: {"columns": list(f.columns), "target": model.get(f.target).table, "target_columns": list(f.target_columns), "on_delete": f.on_delete.value} for f in entity.foreign_keys},
            "checks": {c.name: c.sql for c in entity.checks},
            "comment": entity.comment,
            "options": dict(entity.options),
        }
    return {"version": 1, "tables": tables}


def save_snapshot(shot: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(shot, file, indent=1, sort_keys=True, default=str)


def load_snapshot(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


EMPTY = {"version": 1, "tables": {}}

# --- differences ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """One difference; ``old`` and ``new`` hold what the kind needs to go forth and back."""

    kind: str
    table: str
    name: str = ""
    old: object = field(default=None, hash=False)
    new: object = field(default=None, hash=False)

    def inverse(self) -> Change:
        kind = self.kind
        for a, b in (("Create", "Drop"), ("Add", "Drop")):
            if kind.startswith(a):
                kind = b + kind[len(a) :]
                break
        else:
            if kind.startswith("Drop"):
                kind = ("Create" if kind in ("DropTable", "DropIndex") else "Add") + kind[4:]
        return Change(kind, self.table, self.name, self.new, self.old)


_PARTS = (("indexes", "Index", "Create"), ("foreign_keys", "ForeignKey", "Add"), ("checks", "Check", "Add"))


def diff(old: dict, new: dict) -> list[Change]:
    """Changes that lead from one snapshot to another: tables first, then columns, then constraints."""
    a, b = old["tables"], new["tables"]
    out: list[Change] = []
    out += [Change("CreateTable", t, new=b[t]) for t in b if t not in a]
    for t in (t for t in b if t in a):
        was, now = a[t], b[t]
        out += [Change("AddColumn", t, c, new=v) for c, v in now["columns"].items() if c not in was["columns"]]
        out += [Change("AlterColumn", t, c, was["columns"][c], v) for c, v in now["columns"].items() if c in was["columns"] and was["columns"][c] != v]
        out += [Change("DropColumn", t, c, old=v) for c, v in was["columns"].items() if c not in now["columns"]]
        if was["key"] != now["key"]:
            out.append(Change("AlterKey", t, "", was["key"], now["key"]))
        for part, stem, make in _PARTS:
            gone = [n for n, v in was[part].items() if now[part].get(n) != v]
            out += [Change(f"Drop{stem}", t, n, old=was[part][n]) for n in gone]
            out += [Change(f"{make}{stem}", t, n, new=v) for n, v in now[part].items() if was[part].get(n) != v]
        if was["comment"] != now["comment"]:
            out.append(Change("AlterTableComment", t, "", was["comment"], now["comment"]))
        if was["options"] != now["options"]:
            out.append(Change("AlterTableOptions", t, "", was["options"], now["options"]))
    out += [Change("DropTable", t, old=a[t]) for t in a if t not in b]
    return out


# --- DDL -----------------------------------------------------------------------------------------------------------


def _quote(text: object) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column_sql(name: str, c: dict) -> str:
    kind = c.get("column_type") or (f"VARCHAR({c['max_length']})" if c["type"] == "string" and c["max_length"] else c["type"].upper())
    parts = [f"`{name}` {kind}"]
    if c["required"]:
        parts.append("NOT NULL")
    if c["default"] is not None:
        value = c["default"]
        parts.append(f"DEFAULT {_quote(value) if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else value}")
    if c["comment"]:
        parts.append(f"COMMENT {_quote(c['comment'])}")
    return " ".join(parts)


#: Kinds that only the model knows: Spark keeps no such objects for Parquet tables.
MODEL_ONLY = ("CreateIndex", "DropIndex", "AddForeignKey", "DropForeignKey", "AddCheck", "DropCheck", "AlterKey")


def change_sql(change: Change) -> list[str]:
    """Statements of one change; those that need a rewrite or only touch the model are comments that say so."""
    t = f"`{change.table}`"
    match change.kind:
        case "CreateTable":
            body = ",\n  ".join(_column_sql(n, c) for n, c in change.new["columns"].items())
            comment = f" COMMENT {_quote(change.new['comment'])}" if change.new["comment"] else ""
            options = ", ".join(f"{_quote(k)} = {_quote(v)}" for k, v in change.new["options"].items())
            return [f"CREATE TABLE {t} (\n  {body}\n) USING parquet{comment}" + (f" TBLPROPERTIES ({options})" if options else "")]
        case "DropTable":
            return [f"DROP TABLE {t}"]
        case "AddColumn":
            new = dict(change.new, required=False)
            return [f"ALTER TABLE {t} ADD COLUMNS ({_column_sql(change.name, dict(new, default=None))})"]
        case "AlterColumn":
            same = {k: v for k, v in change.old.items() if k != "comment"} == {k: v for k, v in change.new.items() if k != "comment"}
            if same:
                return [f"ALTER TABLE {t} ALTER COLUMN `{change.name}` COMMENT {_quote(change.new['comment'] or '')}"]
            return [f"-- rewrite {t}: `{change.name}` {change.old['type']} to {change.new['type']}"]
        case "DropColumn":
            return [f"-- rewrite {t} without `{change.name}`"]
        case "AlterTableComment":
            return [f"COMMENT ON TABLE {t} IS {_quote(change.new or '')}"]
        case "AlterTableOptions":
            gone = [k for k in change.old or {} if k not in (change.new or {})]
            out = [f"ALTER TABLE {t} UNSET TBLPROPERTIES ({', '.join(map(_quote, gone))})"] if gone else []
            if change.new:
                out.append(f"ALTER TABLE {t} SET TBLPROPERTIES ({', '.join(f'{_quote(k)} = {_quote(v)}' for k, v in change.new.items())})")
            return out
    if change.kind in MODEL_ONLY:
        return [f"-- model: {change.kind} {change.name} on {t}"]
    raise MigrationError(f"unknown change {change.kind}")


def script(changes: list[Change], down: bool = False) -> str:
    """All statements, forth or back."""
    if down:
        changes = [c.inverse() for c in reversed(changes)]
    return ";\n".join(s for c in changes for s in change_sql(c)) + (";\n" if changes else "")


def statements(text: str) -> list[str]:
    """Split a script at semicolons outside quotes and comments."""
    out, now = [], []
    for m in re.finditer(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|;|[^;'\"`/-]+|.", text, re.S):
        token = m[0]
        if token == ";":
            out.append("".join(now))
            now = []
        elif not token.startswith(("--", "/*")):
            now.append(token)
    return [s.strip() for s in (*out, "".join(now)) if s.strip()]


# --- applying to a store ------------------------------------------------------------------------------------------


def rewrite(rows: DataFrame, columns: dict[str, dict], renamed: dict[str, str] | None = None) -> DataFrame:
    """Rows under a new set of columns: dropped ones go, new ones get their default, others are cast (a bad cast raises)."""
    renamed = renamed or {}
    out = []
    for name, c in columns.items():
        source = renamed.get(name, name)
        if source in rows.columns:
            out.append(F.col(f"`{source}`").cast(c["type"]).alias(name))
        else:
            if c["required"] and c["default"] is None and not rows.isEmpty():
                raise MigrationError(f"{name} is required, has no default, and the table has rows")
            out.append(F.lit(c["default"]).cast(c["type"]).alias(name))
    return rows.select(*out)


def apply_changes(context: Context, changes: list[Change], target: dict) -> None:
    """Apply changes to the tables of a context's store, all or none; ``target`` is the snapshot they lead to."""
    if context.store is None:
        raise Unsupported("migrations need a store")
    staged: dict[str, str | None] = {}
    for table in dict.fromkeys(c.table for c in changes):
        mine = [c for c in changes if c.table == table]
        kinds = {c.kind for c in mine}
        if "DropTable" in kinds:
            staged[table] = None
            continue
        columns = target["tables"][table]["columns"]
        if "CreateTable" in kinds:
            schema = ", ".join(f"`{n}` {c['type']}" for n, c in columns.items())
            staged[table] = context.store.stage(table, context.spark.createDataFrame([], schema))
        elif kinds & {"AddColumn", "DropColumn", "AlterColumn"}:
            staged[table] = context.store.stage(table, rewrite(context.storage(table), columns))
    for change in changes:
        _hold_to(context, change, target, staged)
    staged[MODEL_TABLE] = context.store.stage(MODEL_TABLE, context.spark.createDataFrame([(json.dumps(target, default=str),)], "snapshot string"))
    context.store.commit(staged)


#: Where the store keeps the snapshot that its tables were last brought to.
MODEL_TABLE = "_model"


def _hold_to(context: Context, change: Change, target: dict, staged: dict[str, str | None]) -> None:
    """Raise if the rows of a table break a key, check, unique index or foreign key that a change brings."""
    table = change.table
    if staged.get(table, "") is None or change.kind not in ("AlterKey", "AddCheck", "CreateIndex", "AddForeignKey"):
        return

    def rows(name: str) -> DataFrame:
        return context.spark.read.parquet(f"{context.store.root}/{staged[name]}") if staged.get(name) else context.storage(name)

    def broken(bad: DataFrame, what: str) -> None:
        if found := bad.head(1):
            raise ConstraintViolation(f"{table}: {what} is broken by {found[0].asDict()}")

    if change.kind == "AddCheck":
        broken(rows(table).where(~F.expr(change.new)), f"check {change.name}")
    elif change.kind == "AlterKey" and change.new:
        broken(rows(table).groupBy(*change.new).count().where("count > 1"), "the key")
        broken(rows(table).where(" or ".join(f"`{c}` is null" for c in change.new)), "the key")
    elif change.kind == "CreateIndex" and change.new["unique"] and change.new["columns"]:
        names = change.new["columns"]
        some = rows(table).where(change.new["filter"]) if change.new["filter"] else rows(table)
        broken(some.where(" and ".join(f"`{c}` is not null" for c in names)).groupBy(*names).count().where("count > 1"), f"index {change.name}")
    elif change.kind == "AddForeignKey":
        names = change.new["columns"]
        other = rows(change.new["target"]).select(*(F.col(f"`{c}`").alias(n) for c, n in zip(change.new["target_columns"], names, strict=True)))
        broken(rows(table).where(" and ".join(f"`{c}` is not null" for c in names)).join(other, list(names), "left_anti"), f"foreign key {change.name}")


def ensure_created(context: Context, seed: bool = True) -> list[str]:
    """Create the tables that are missing, with their seed rows; returns their names."""
    made: dict[str, DataFrame] = {}
    for entity in dependency_order(context.model):
        if entity.is_view or context.store.current(entity.table):
            continue
        names = [c.stored for c in entity.stored_columns()]
        rows = [tuple(r.get(c.name, c.default) for c in entity.stored_columns()) for r in entity.seed] if seed else []
        made[entity.table] = context.spark.createDataFrame(rows, entity.schema()).select(*names)
    staged = {t: context.store.stage(t, df) for t, df in made.items()}
    if made:
        shot = json.dumps(snapshot(context.model), default=str)
        staged[MODEL_TABLE] = context.store.stage(MODEL_TABLE, context.spark.createDataFrame([(shot,)], "snapshot string"))
    context.store.commit(staged)
    return list(made)


def ensure_deleted(context: Context) -> None:
    context.store.commit({e.table: None for e in context.model.entities.values()})


def validate(context: Context, entity: Entity, rows: DataFrame | None = None) -> None:
    """Raise at the first broken rule of an entity's rows."""
    rows = context.read(entity, False) if rows is None else rows
    for what, bad in (("check", violations(entity, rows)), ("unique", duplicates(entity, rows)), ("foreign key", orphans(context, entity, rows))):
        if (row := bad.head(1)):
            raise ConstraintViolation(f"{entity.name} {what}: {row[0].asDict()}")


# --- migrations ----------------------------------------------------------------------------------------------------


@dataclass
class Migration:
    id: str
    changes: list[Change]
    target: dict
    before: dict

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.id):
            raise MigrationError(f"bad migration id {self.id!r}")


def make_migration(id: str, before: dict, model: Model) -> Migration:
    after = snapshot(model)
    return Migration(id, diff(before, after), after, before)


class Migrator:
    """Applies migrations in order and keeps their ids in the table ``_migrations`` of the store."""

    HISTORY = "_migrations"

    def __init__(self, context: Context, migrations: list[Migration]):
        self.context, self.migrations = context, sorted(migrations, key=lambda m: m.id)

    def applied(self) -> list[str]:
        if not self.context.store.current(self.HISTORY):
            return []
        return [r["id"] for r in self.context.storage(self.HISTORY).orderBy("id").collect()]

    def pending(self) -> list[Migration]:
        done = set(self.applied())
        return [m for m in self.migrations if m.id not in done]

    def _record(self, ids: list[str]) -> None:
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        rows = self.context.spark.createDataFrame([(i, now) for i in ids], "id string, applied_at string")
        self.context.store.commit({self.HISTORY: self.context.store.stage(self.HISTORY, rows)})

    def apply_pending(self) -> list[str]:
        done = self.applied()
        for migration in self.pending():
            apply_changes(self.context, migration.changes, migration.target)
            done.append(migration.id)
            self._record(done)
        return done

    def revert_last(self) -> str | None:
        done = self.applied()
        if not done:
            return None
        found = next((m for m in self.migrations if m.id == done[-1]), None)
        if found is None:
            raise MigrationError(f"migration {done[-1]} is not known")
        apply_changes(self.context, [c.inverse() for c in reversed(found.changes)], found.before)
        self._record(done[:-1])
        return found.id

    def revert_to(self, id: str) -> list[str]:
        """Revert, last first, what came after ``id``."""
        if id not in self.applied():
            raise MigrationError(f"{id} is not applied")
        out = []
        while self.applied()[-1] != id:
            out.append(self.revert_last())
        return out

    def generate_script(self, down: bool = False) -> str:
        pending = self.pending() if not down else list(reversed(self.migrations))
        return "\n".join(f"-- {m.id}\n{script(m.changes, down)}" for m in pending)


# --- live tables ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Finding:
    """``kind`` is a change that can be applied, or a warning: SkippedRemoval, NotNullColumnWithoutDefault, UnsupportedChange,
    ConstraintNotIntrospected, IndexDefinitionMismatch, ManualAction."""

    kind: str
    table: str
    column: str = ""
    detail: str = ""


def introspect(context: Context, table: str) -> StructType:
    return context.storage(table).schema


def live_diff(context: Context) -> list[Finding]:
    """Model against stored tables. Columns and tables only storage has are reported, never removed."""
    out: list[Finding] = []
    known = stored_model(context)
    shot = json.loads(json.dumps(snapshot(context.model), default=str))["tables"]
    for entity in context.model.entities.values():
        if entity.is_view:
            continue
        current = context.frames.get(entity.table) is not None or (context.store and context.store.current(entity.table))
        if not current:
            out.append(Finding("CreateTable", entity.table))
            continue
        live = {f.name: f.dataType for f in introspect(context, entity.table)}
        for c in entity.stored_columns():
            if c.stored not in live:
                lost = c.required and c.default is None and not context.storage(entity.table).isEmpty()
                out.append(Finding("NotNullColumnWithoutDefault" if lost else "AddColumn", entity.table, c.stored, _type_name(c.type)))
            elif live[c.stored] != c.type:
                out.append(Finding("AlterColumn", entity.table, c.stored, f"{live[c.stored].simpleString()} to {_type_name(c.type)}"))
        out += [Finding("SkippedRemoval", entity.table, n) for n in live if n not in {c.stored for c in entity.stored_columns()}]
        was = known.get(entity.table)
        if was is None:
            out += [Finding("ConstraintNotIntrospected", entity.table, detail=c.name) for c in (*entity.checks, *entity.indexes, *entity.foreign_keys)]
            continue
        now = shot[entity.table]
        for name, index in now["indexes"].items():
            if name in was["indexes"] and was["indexes"][name] != index:
                out.append(Finding("IndexDefinitionMismatch", entity.table, detail=name))
        if was["key"] != now["key"]:
            out.append(Finding("ManualAction", entity.table, detail=f"key {was['key']} to {now['key']}"))
        for part in ("checks", "foreign_keys", "indexes"):
            out += [Finding("ManualAction", entity.table, detail=f"add {n}") for n in now[part] if n not in was[part]]
    return out


def stored_model(context: Context) -> dict:
    """Tables of the snapshot that the store was last brought to; empty if none is known."""
    if not (context.store and context.store.current(MODEL_TABLE)):
        return {}
    return json.loads(context.storage(MODEL_TABLE).first()["snapshot"])["tables"]


def irreversible(changes: list[Change]) -> list[str]:
    """What going back over changes cannot restore: rows and values that they drop or narrow."""
    out = []
    for c in changes:
        if c.kind == "DropTable":
            out.append(f"{c.table}: its rows")
        elif c.kind == "DropColumn":
            out.append(f"{c.table}.{c.name}: its values")
        elif c.kind == "AlterColumn" and c.old["type"] != c.new["type"]:
            out.append(f"{c.table}.{c.name}: values of {c.old['type']} that {c.new['type']} does not hold")
    return out


def apply_live_diff(context: Context) -> list[Finding]:
    """Bring stored tables up to the model where that loses nothing; returns what was done."""
    found = live_diff(context)
    if refused := [f for f in found if f.kind == "NotNullColumnWithoutDefault"]:
        raise MigrationError(f"required columns without default: {', '.join(f'{f.table}.{f.column}' for f in refused)}")
    done = [f for f in found if f.kind in ("CreateTable", "AddColumn", "AlterColumn")]
    ensure_created(context, seed=False)
    shot = snapshot(context.model)["tables"]
    staged = {}
    for table in {f.table for f in done if f.kind != "CreateTable"}:
        live = context.storage(table)
        extra = {f.name: {"type": f.dataType.simpleString(), "required": False, "default": None} for f in live.schema if f.name not in shot[table]["columns"]}
        staged[table] = context.store.stage(table, rewrite(live, {**shot[table]["columns"], **extra}))
    context.store.commit(staged)
    return done


def reverse_engineer(context: Context, tables: list[str]) -> str:
    """Python source that declares the given tables as entities."""
    lines = ["from lakequill.model import Model", "", "", "def build() -> Model:", "    m = Model()"]
    for table in tables:
        name = "".join(p.capitalize() for p in re.split(r"\W|_", table) if p)
        lines.append(f"    e = m.entity({name!r}, {table!r})")
        lines += [f"    e.column({f.name!r}, {f.dataType.simpleString()!r}{'' if f.nullable else ', required=True'})" for f in introspect(context, table)]
    return "\n".join([*lines, "    return m", ""])


#: What tables in the session catalog take directly (measured on Parquet tables of Spark 4.1).
CAPABILITIES: dict[str, bool] = {
    "create_table": True, "drop_table": True, "add_column": True, "drop_column": False, "rename_column": False, "alter_type": False,
    "column_comment": True, "table_comment": True, "column_default": True, "check": False, "foreign_key": False, "primary_key": False,
    "index": False, "not_null_enforced": False, "varchar_length_enforced": True, "generated_column": False, "merge": False,
}


def dump(value: object) -> str:
    """Changes or findings as JSON lines."""
    return "\n".join(json.dumps(asdict(v), default=str) for v in value)


def catalog_ddl(spark: SparkSession, model: Model) -> list[str]:
    """CREATE TABLE statements of a model, principals first."""
    shot = snapshot(model)["tables"]
    return [change_sql(Change("CreateTable", e.table, new=shot[e.table]))[0] for e in dependency_order(model) if not e.is_view]
