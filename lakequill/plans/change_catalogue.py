"""Catalogue, second part: queries for changes, the unit of work, constraints and the schema tools, each beside its SQL.

Changes are made to frames that a context serves, never to the tables read. Tools that need a store write to a folder of
their own, under the one that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import checks
from ..model import Entity, Model, OnDelete, dependency_order
from ..operators.mutation import cascade_delete, insert_frame, upsert_frame
from ..operators.tracking import Audit, Interceptor, State
from ..sources.connectors import ConnectionString
from ..sources.context import Context, Registry
from . import schema
from .catalogue import query
from .warehouse import warehouse


def _store(c: Context, model: Model) -> Context:
    """A context on an empty store in the shared folder (a temporary one on a single machine)."""
    shared = c.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (c.spark.sparkContext.master or "").startswith("local"):
        raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
    return Context(c.spark, model, f"{shared or tempfile.mkdtemp()}/lakequill-store-{uuid.uuid4().hex[:8]}")


def _editable(c: Context, *tables: str, model: Model | None = None) -> Context:
    """A context whose ``tables`` are frames, so that changes stay in it."""
    own = Context(c.spark, model or warehouse(), c.store.root)
    for table in tables:
        own.use_frame(table, c.storage(table))
    return own


def _code(run) -> str:
    """The code of the error that a call raises."""
    try:
        run()
    except EngineError as error:
        return error.code
    return "none"


def _codes(c: Context, **runs) -> DataFrame:
    return c.spark.createDataFrame([(name, _code(run)) for name, run in runs.items()], "what string, code string")


# --- inserts and upserts ---


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
          UNION ALL SELECT s_suppkey + 1000000, s_name || ' II', s_nationkey, NULL FROM supplier""")
def insert_batch(c):
    rows = c.set("Supplier").to_df().select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.concat("s_name", F.lit(" II")).alias("s_name"), "s_nationkey")
    return insert_frame(c, c.model.get("Supplier"), rows)


def _counted(c: Context) -> Context:
    """Suppliers whose key counts up, with a required name, a unique name, a check and a default."""
    model = warehouse()
    e = model.get("Supplier").configure("s_suppkey", auto_increment=True).configure("s_name", required=True, unique=True).configure("s_acctbal", default=0.5)
    e.has_check("balance", "s_acctbal < 100000")
    return _editable(c, "supplier", model=model)


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
          UNION ALL SELECT max(s_suppkey) + 1, 'first', 3, 0.5 FROM supplier UNION ALL SELECT max(s_suppkey) + 2, 'second', NULL, 0.5 FROM supplier""")
def unit_adds_with_keys(c):
    own = _counted(c)
    first = own.unit.add("Supplier", s_name="first", s_nationkey=3)
    own.unit.add("Supplier", s_name="second")
    own.unit.save_changes()
    assert first["s_suppkey"] is not None
    return own.set("Supplier").to_df()


query(
    """SELECT * FROM (VALUES ('required', 'not_null_violation'), ('unique', 'unique_violation'), ('check', 'check_violation'), ('foreign key', 'foreign_key_violation'),
       ('twice among rows', 'unique_violation'), ('upsert twice', 'unique_violation'), ('upsert check', 'check_violation'), ('update to null', 'not_null_violation'),
       ('update breaks check', 'check_violation'), ('update makes equal', 'unique_violation'), ('update to no nation', 'foreign_key_violation'), ('update is right', 'none')) t(what, code)""", "refused_changes"
)(
    lambda c: (lambda own, e, row: _codes(c, **{
        "required": lambda: insert_frame(own, e, row("NULL", "1", "1D")),
        "unique": lambda: insert_frame(own, e, row(f"'{own.set('Supplier').first()['s_name']}'", "1", "1D")),
        "check": lambda: insert_frame(own, e, row("'x'", "1", "100000D")),
        "foreign key": lambda: insert_frame(own, e, row("'x'", "-7", "1D")),
        "twice among rows": lambda: insert_frame(own, e, row("'x'", "1", "1D").unionAll(row("'x'", "2", "1D"))),
        "upsert twice": lambda: upsert_frame(own, e, row("'x'", "1", "1D").withColumn("s_suppkey", F.lit(1)).unionAll(row("'y'", "1", "1D").withColumn("s_suppkey", F.lit(1)))),
        "upsert check": lambda: upsert_frame(own, e, row("'x'", "1", "1e6D").withColumn("s_suppkey", F.lit(1))),
        "update to null": lambda: own.set("Supplier").execute_update().set_column("s_name", None).execute(),
        "update breaks check": lambda: own.set("Supplier").execute_update().set_column("s_acctbal", 1e6).execute(),
        "update makes equal": lambda: own.set("Supplier").execute_update().set_column("s_name", "same").execute(),
        "update to no nation": lambda: own.set("Supplier").execute_update().set_column("s_nationkey", -7).execute(),
        "update is right": lambda: own.set("Supplier").execute_update().set_column("s_nationkey", 7).execute(),
    }))(own := _counted(c), own.model.get("Supplier"), lambda name, nation, balance: c.spark.range(1).selectExpr(f"cast({name} as string) s_name", f"{nation} s_nationkey", f"{balance} s_acctbal"))
)


# --- the unit of work ---


@query("""SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey <> 2 AND s_suppkey <> 4
          UNION ALL SELECT 4, 'four', NULL, 4.0 UNION ALL SELECT -1, 'new', 5, NULL""")
def unit_saves_everything(c):
    own = _editable(c, "supplier")
    unit = own.unit
    unit.attach("Supplier", own.set("Supplier").find(1))["s_name"] = "renamed"
    unit.remove(unit.attach("Supplier", own.set("Supplier").find(2)))
    unit.upsert("Supplier", s_suppkey=4, s_name="four", s_acctbal=4.0)
    unit.add("Supplier", s_suppkey=-1, s_name="new", s_nationkey=5)
    assert unit.save_changes() == 4
    return own.set("Supplier").to_df()


@query("SELECT 1 AS added, 1 AS modified, 1 AS deleted, true AS pending, 's_name' AS dirty, 0 AS after_reject")
def unit_tracks_states(c):
    own = _editable(c, "supplier")
    unit = own.unit
    unit.add("Supplier", s_suppkey=-1)
    entry = unit.attach("Supplier", own.set("Supplier").find(1))
    entry["s_name"] = "other"
    unit.remove(unit.attach("Supplier", own.set("Supplier").find(2)))
    pending = unit.has_changes()
    row = [unit.count_by_state(s) for s in (State.ADDED, State.MODIFIED, State.DELETED)] + [pending, ",".join(unit.modified_columns(entry))]
    unit.reject_changes()
    return c.spark.createDataFrame([(*row, unit.detect_changes())], "added int, modified int, deleted int, pending boolean, dirty string, after_reject int")


@query("""SELECT * REPLACE (CASE WHEN n_nationkey = 3 THEN 'kept' ELSE n_name END AS n_name) FROM nation""")
def transaction_and_savepoint(c):
    own = _editable(c, "nation")
    update = lambda k, v: own.set("Nation").where(lambda n: n.n_nationkey == k).execute_update().set_column("n_name", v).execute()
    with own.unit.transaction() as t:
        update(3, "kept")
        t.create_savepoint("s")
        update(4, "undone")
        t.rollback_to("s")
    try:
        with own.unit.transaction():
            update(5, "lost")
            raise KeyError
    except KeyError:
        return own.set("Nation").to_df()


@query("SELECT true AS pending_again, false AS stored, true AS saved_later")
def rollback_restores_the_tracker(c):
    own = _editable(c, "nation")
    try:
        with own.unit.transaction():
            own.unit.add("Nation", n_nationkey=99, n_name="late")
            own.unit.save_changes()
            raise KeyError
    except KeyError:
        pass
    pending, stored = own.unit.has_changes(), own.set("Nation").exists_by_id(99)
    own.unit.save_changes()
    return c.spark.createDataFrame([(pending, stored, own.set("Nation").exists_by_id(99))], "pending_again boolean, stored boolean, saved_later boolean")


@query("SELECT 'saving 1, saved 1, failed unique_violation' AS seen, 'me' AS updated_by, TIMESTAMP '2026-01-01' AS updated_at")
def interceptors_and_audit(c):
    model = Model()
    model.entity("Note", "notes").column("id", "int", key=True, auto_increment=True).column("title", "string", unique=True).column("updated_by", "string").column("updated_at", "timestamp_ntz")
    own = Context(c.spark, model).use_frame("notes", c.spark.createDataFrame([], model.get("Note").schema()))
    seen = []

    class Log(Interceptor):
        def on_saving(self, entries):
            if len(seen) < 2:
                seen.append(f"saving {len(entries)}")

        def on_saved(self, entries, count):
            seen.append(f"saved {count}")

        def on_save_failed(self, entries, error):
            seen.append(f"failed {error.code}")

    own.interceptors += [Audit("me", lambda: dt.datetime(2026, 1, 1)), Log()]
    own.unit.add("Note", title="t")
    own.unit.save_changes()
    own.unit.add("Note", title="t")
    _code(own.unit.save_changes)
    return own.set("Note").to_df().select(F.lit(", ".join(seen)).alias("seen"), "updated_by", "updated_at")


def _tagged(c: Context) -> Context:
    """Parts, suppliers and the rows that join them, as entities."""
    model = Model()
    model.entity("P", "p").column("pk", "bigint", key=True).many_to_many("suppliers", "S", "PS", "p_id", "s_id")
    model.entity("S", "s").column("sk", "bigint", key=True).many_to_many("parts", "P", "PS", "s_id", "p_id")
    model.entity("PS", "ps").column("id", "bigint", key=True, auto_increment=True).column("p_id", "bigint").column("s_id", "bigint")
    pairs = c.storage("lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_partkey AS p_id", "l_suppkey AS s_id")
    own = Context(c.spark, model).use_frame("p", c.storage("part").selectExpr("p_partkey AS pk")).use_frame("s", c.storage("supplier").selectExpr("s_suppkey AS sk"))
    return own.use_frame("ps", pairs)


@query("SELECT l_partkey AS p_id, l_suppkey AS s_id FROM lineitem WHERE l_partkey <> 1 UNION ALL SELECT -5, 2")
def many_to_many_rows(c):
    """Join rows go with a deleted side; a link of two entries makes one."""
    own = _tagged(c)
    own.unit.remove(own.unit.attach("P", {"pk": 1}))
    own.unit.add("P", pk=-5).link("suppliers", own.unit.attach("S", {"sk": 2}))
    own.unit.save_changes()
    return own.set("PS").select("p_id", "s_id").to_df()


# --- cascades ---


def _tree(c: Context) -> Context:
    """Parts as a tree that refers to itself, with their line items below."""
    model = Model()
    e = model.entity("Tree", "tree").column("id", "bigint", key=True).column("parent", "bigint")
    e.has_many("children", "Tree", "parent", on_delete=OnDelete.CASCADE).has_many("items", "Item", "part", on_delete=OnDelete.CASCADE)
    model.entity("Item", "items").column("order", "bigint").column("line", "int").column("part", "bigint")
    own = Context(c.spark, model).use_frame("tree", c.storage("part").selectExpr("p_partkey AS id", "p_partkey DIV 2 AS parent"))
    return own.use_frame("items", c.storage("lineitem").selectExpr("l_orderkey AS order", "l_linenumber AS line", "l_partkey AS part"))


_GONE = """WITH RECURSIVE gone AS (SELECT p_partkey AS id FROM part WHERE p_partkey = 3
           UNION SELECT p_partkey FROM part JOIN gone ON p_partkey // 2 = id)"""


def _without_three(c: Context, entity: str) -> DataFrame:
    own, tables = _tree(c), {}
    cascade_delete(own, own.model.get("Tree"), own.set("Tree").where(lambda t: t.id == 3).select("id").to_df(), tables)
    return tables[entity]


query(f"{_GONE} SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part WHERE p_partkey NOT IN (SELECT id FROM gone)", "cascade_self_reference")(lambda c: _without_three(c, "Tree"))
query(f'{_GONE} SELECT l_orderkey AS "order", l_linenumber AS line, l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM gone)', "cascade_below_self_reference")(
    lambda c: _without_three(c, "Item")
)


@query("""WITH RECURSIVE gone AS (SELECT 0 AS side, CAST(3 AS BIGINT) AS id UNION SELECT 1 - side, c_custkey FROM customer JOIN gone ON c_custkey // 2 = id)
          SELECT 'a' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone WHERE side = 0)
          UNION ALL SELECT 'b', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone WHERE side = 1)""")
def cascade_cycle(c):
    """Two entities that cascade into each other."""
    model = Model()
    model.entity("A", "a").column("id", "bigint", key=True).column("up", "bigint").has_many("bs", "B", "up", on_delete=OnDelete.CASCADE)
    model.entity("B", "b").column("id", "bigint", key=True).column("up", "bigint").has_many("as_", "A", "up", on_delete=OnDelete.CASCADE)
    rows = c.storage("customer").selectExpr("c_custkey AS id", "c_custkey DIV 2 AS up")
    own, tables = Context(c.spark, model).use_frame("a", rows).use_frame("b", rows), {}
    cascade_delete(own, model.get("A"), rows.where("id = 3").select("id"), tables)
    return tables["A"].select(F.lit("a").alias("side"), "id").unionByName(tables["B"].select(F.lit("b").alias("side"), "id"))


@query("SELECT * FROM (VALUES ('restrict', 'foreign_key_violation'), ('no rows below', 'none')) t(what, code)")
def cascade_restrict(c):
    def run(keys: str) -> None:
        model = warehouse()
        model.get("Order").has_many("lines", "LineItem", "l_orderkey", on_delete=OnDelete.RESTRICT)
        own = Context(c.spark, model, c.store.root)
        cascade_delete(own, model.get("Order"), own.set("Order").to_df().select("o_orderkey").where(keys), {})

    return _codes(c, **{"restrict": lambda: run("true"), "no rows below": lambda: run("o_orderkey < -1")})


# --- constraints ---

query("SELECT 'l_orderkey, l_partkey' AS rule, l_orderkey || ',' || l_partkey AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1", "duplicate_keys")(
    lambda c: checks.duplicates(Entity("L", "lineitem", c.model, c.model.get("LineItem").columns, ("l_orderkey", "l_partkey")), c.set("LineItem").to_df())
)
_BUILT = {
    "in": (checks.in_list("p_size", [1, 2, 3]), "p_size IN (1, 2, 3)"), "not_in": (checks.not_in_list("p_brand", ["Brand#11"]), "p_brand NOT IN ('Brand#11')"),
    "exactly_one": (checks.exactly_one_of("a", "b"), "(a IS NOT NULL) <> (b IS NOT NULL)"), "at_most_one": (checks.at_most_one_of("a", "b"), "a IS NULL OR b IS NULL"),
    "at_least_one": (checks.at_least_one_of("a", "b"), "a IS NOT NULL OR b IS NOT NULL"), "all": (checks.all_not_null("a", "b"), "a IS NOT NULL AND b IS NOT NULL"),
    "between": (checks.between("p_size", 5, 30), "p_size BETWEEN 5 AND 30"), "non_negative": (checks.non_negative("d"), "d >= 0"), "positive": (checks.positive("d"), "d > 0"),
    "raw": (checks.raw("p_size % 2 = 0"), "p_size % 2 = 0"), "any": (checks.any_of(checks.positive("d"), "p_size = 1"), "d > 0 OR p_size = 1"),
    "every": (checks.all_of(checks.positive("d"), "p_size > 1"), "d > 0 AND p_size > 1"),
}
_PARTS = "SELECT p_partkey, p_brand, p_size, CASE WHEN p_size > 20 THEN 1 END AS a, CASE WHEN p_size > 30 THEN 1 END AS b, p_size - 25 AS d FROM part"


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) AS n FROM ({_PARTS}) WHERE NOT ({sql})""" for n, (_, sql) in _BUILT.items()))
def check_builders(c):
    model = Model()
    e = model.entity("Part", "part").column("p_partkey", "bigint", key=True).column("p_brand", "string").column("p_size", "int").column("a", "int").column("b", "int").column("d", "int")
    for name, (built, _) in _BUILT.items():
        e.has_check(name, built)
    c.register_views()
    return checks.violations(e, c.spark.sql(_PARTS)).groupBy("check").agg(F.count("*").alias("n"))


# --- schema tools ---


def _old_and_new() -> tuple[Model, Model]:
    """A small model, and what became of it."""
    old, new = Model(), Model()
    old.entity("Shelf", "shelves").column("id", "bigint", key=True).column("label", "string").column("width", "int").column("colour", "string").has_index("label", name="ix_label")
    old.entity("Gone", "gone").column("id", "int", key=True)
    (
        new.entity("Shelf", "shelves").column("id", "bigint", key=True).column("label", "string").column("width", "bigint").column("depth", "int", default=7)
        .has_index("label", name="ix_label", unique=True).has_check("wide", "width > 0").has_comment("where books are").with_options(owner="library")
    )
    (
        new.entity("Book", "books").column("id", "bigint", key=True).column("shelf", "bigint").has_foreign_key(["shelf"], "Shelf", ["id"])
        .has_data({"id": 1, "shelf": None}, {"id": 2, "shelf": None})
    )
    return old, new


_CHANGES = """SELECT * FROM (VALUES ('CreateTable', 'books', ''), ('AddColumn', 'shelves', 'depth'), ('AlterColumn', 'shelves', 'width'), ('DropColumn', 'shelves', 'colour'),
    ('DropIndex', 'shelves', 'ix_label'), ('CreateIndex', 'shelves', 'ix_label'), ('AddCheck', 'shelves', 'wide'), ('AlterTableComment', 'shelves', ''),
    ('AlterTableOptions', 'shelves', ''), ('DropTable', 'gone', '')) t(kind, "table", name)"""


@query(_CHANGES)
def schema_diff(c):
    found = schema.diff(*map(schema.snapshot, _old_and_new()))
    return c.spark.createDataFrame([(f.kind, f.table, f.name) for f in found], "kind string, table string, name string")


@query("SELECT * FROM (VALUES ('gone: its rows'), ('shelves.colour: its values'), ('shelves.width: values of int that bigint does not hold')) t(lost)")
def schema_irreversible(c):
    return c.spark.createDataFrame([(x,) for x in schema.irreversible(schema.diff(*map(schema.snapshot, _old_and_new())))], "lost string")


@query("SELECT 5 AS up, 2 AS creates, true AS back_is_inverse, true AS snapshot_round_trips, 'Shelf, Book' AS order_of_creation")
def schema_script(c):
    old, new = map(schema.snapshot, _old_and_new())
    changes = schema.diff(old, new)
    back = schema.diff(new, old)
    inverse = {(x.inverse().kind, x.table, x.name) for x in changes} == {(x.kind, x.table, x.name) for x in back}
    again = json.loads(json.dumps(old)) == old
    up = schema.statements(schema.script(changes))
    order = ", ".join(e.name for e in dependency_order(_old_and_new()[1]))
    return c.spark.createDataFrame([(len(up), len(schema.catalog_ddl(c.spark, _old_and_new()[1])), inverse, again, order)], "up int, creates int, back_is_inverse boolean, snapshot_round_trips boolean, order_of_creation string")


def _migrated(c: Context) -> tuple[Context, schema.Migrator]:
    old, new = _old_and_new()
    own = _store(c, new)
    first = schema.make_migration("0001_first", schema.EMPTY, old)
    migrator = schema.Migrator(own, [first, schema.make_migration("0002_second", first.target, new)])
    schema.Migrator(own, [first]).apply_pending()
    own.store.commit({"shelves": own.store.stage("shelves", c.storage("part").selectExpr("p_partkey AS id", "p_partkey || ' ' || p_name AS label", "p_size AS width", "p_brand AS colour"))})
    return own, migrator


@query("SELECT p_partkey AS id, p_partkey || ' ' || p_name AS label, CAST(p_size AS BIGINT) AS width, 7 AS depth FROM part")
def migrate_forth(c):
    own, migrator = _migrated(c)
    assert migrator.apply_pending() == ["0001_first", "0002_second"]
    return own.set("Shelf").to_df()


@query("SELECT p_partkey AS id, p_partkey || ' ' || p_name AS label, p_size AS width, CAST(NULL AS VARCHAR) AS colour FROM part")
def migrate_back(c):
    own, migrator = _migrated(c)
    migrator.apply_pending()
    assert migrator.revert_to("0001_first") == ["0002_second"]
    return own.storage("shelves")


@query("SELECT 'constraint' AS code, true AS unchanged")
def migrate_holds_rows_to_rules(c):
    """A check that rows break stops the migration before anything changes."""
    own, migrator = _migrated(c)
    own.store.commit({"shelves": own.store.stage("shelves", own.storage("shelves").withColumn("width", F.lit(0)))})
    return c.spark.createDataFrame([(_code(migrator.apply_pending), "colour" in own.storage("shelves").columns)], "code string, unchanged boolean")


@query("SELECT * FROM (VALUES (1), (2)) t(id)")
def bootstrap_with_seed(c):
    own = _store(c, _old_and_new()[1])
    assert schema.ensure_created(own) == ["shelves", "books"] and schema.ensure_created(own) == []
    rows = own.set("Book").select("id").to_df()
    return rows.withColumn("id", F.col("id").cast("int"))


@query("SELECT 0 AS tables")
def ensure_deleted(c):
    own = _store(c, _old_and_new()[1])
    schema.ensure_created(own)
    schema.ensure_deleted(own)
    return c.spark.createDataFrame([(sum(own.store.current(e.table) is not None for e in own.model.entities.values()),)], "tables int")


@query("""SELECT * FROM (VALUES ('AddColumn', 'shelves', 'depth', 'int'), ('AlterColumn', 'shelves', 'width', 'int to bigint'), ('SkippedRemoval', 'shelves', 'colour', ''),
          ('IndexDefinitionMismatch', 'shelves', '', 'ix_label'), ('ManualAction', 'shelves', '', 'add wide'), ('CreateTable', 'books', '', '')) t(kind, "table", "column", detail)""")
def live_diff(c):
    own, _ = _migrated(c)
    return c.spark.createDataFrame([(f.kind, f.table, f.column, f.detail) for f in schema.live_diff(own)], "kind string, table string, column string, detail string")


@query("SELECT p_partkey AS id, p_partkey || ' ' || p_name AS label, CAST(p_size AS BIGINT) AS width, p_brand AS colour, 7 AS depth FROM part")
def live_diff_applied(c):
    own, _ = _migrated(c)
    schema.apply_live_diff(own)
    return own.storage("shelves")


@query("SELECT column_name AS name, data_type AS type FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(column_name, data_type)")
def introspect_table(c):
    return c.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.introspect(c, "nation")], "name string, type string")


@query("SELECT true AS declares_the_columns")
def reverse_engineer(c):
    space: dict = {}
    exec(schema.reverse_engineer(c, ["nation"]), space)  # noqa: S102  source that was made here
    built = space["build"]().get("Nation")
    return c.spark.createDataFrame([(list(built.columns) == c.storage("nation").columns,)], "declares_the_columns boolean")


# --- context ---

query("SELECT 'postgres' AS scheme, 'db.example' AS host, 5433 AS port, 'shop' AS database, 'me' AS \"user\", 'p@ss' AS password", "connection_string")(
    lambda c: (lambda s: c.spark.createDataFrame([(s.scheme, s.host, s.port, s.database, s.user, s.password)], "scheme string, host string, port int, database string, user string, password string"))(
        ConnectionString.parse("postgres://me:p%40ss@db.example:5433/shop"))
)
query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 1", "raw_execute")(lambda c: c.spark.createDataFrame([(c.execute("SELECT * FROM nation WHERE n_regionkey = ?", 1),)], "n long"))
query("SELECT true AS same, count(*) AS nations FROM nation", "context_registry")(
    lambda c: (lambda r: c.spark.createDataFrame([(r.get("k") is r.get("k"), r.get("k").set("Nation").count())], "same boolean, nations long"))(Registry().add(lambda key: c, "k"))
)
query("SELECT 1 AS slow", "slow_queries_are_noted")(
    lambda c: (lambda own: (own.set("Nation").count(), c.spark.createDataFrame([(len(own.slow_queries),)], "slow int"))[1])(Context(c.spark, warehouse(), c.store.root, slow_query_s=0.0))
)
