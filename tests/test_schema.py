"""Snapshots, differences, DDL, migrations, live comparison, connectors, contexts and streams."""

import json

import pytest

from lakequill import cli
from lakequill.errors import ConfigurationError, ConstraintViolation, MigrationError
from lakequill.model import Model, cached_model
from lakequill.plans import schema
from lakequill.plans.warehouse import open_warehouse, warehouse
from lakequill.sources.connectors import ConnectionString
from lakequill.sources.context import Context, Registry
from lakequill.streaming import events


def first() -> Model:
    m = Model()
    m.entity("Item", "items").column("id", "int", key=True).column("name", "string", max_length=10).column("value", "int").has_data({"id": 1, "name": "one", "value": 5})
    return m


def second() -> Model:
    m = Model()
    m.entity("Item", "items").column("id", "int", key=True).column("name", "string", max_length=10).column("value", "bigint").column("extra", "string", default="x")
    m.get("Item").has_check("positive", "value > 0").has_index("name", unique=True)
    m.entity("Other", "others").column("id", "int", key=True)
    return m


def test_diff_and_script_go_forth_and_back():
    a, b = schema.snapshot(first()), schema.snapshot(second())
    kinds = [c.kind for c in schema.diff(a, b)]
    assert kinds == ["CreateTable", "AddColumn", "AlterColumn", "CreateIndex", "AddCheck"]
    assert schema.diff(a, a) == []
    back = [c.inverse().kind for c in reversed(schema.diff(a, b))]
    assert back == ["DropCheck", "DropIndex", "AlterColumn", "DropColumn", "DropTable"]
    assert {c.kind for c in schema.diff(b, a)} == set(back)
    assert "ADD COLUMNS (`extra` STRING" in schema.script(schema.diff(a, b))
    assert json.loads(json.dumps(a)) == a


def test_ddl_runs(spark):
    for text in schema.catalog_ddl(spark, second()):
        name = text.split("`")[1]
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(text)
        spark.sql(f"DROP TABLE {name}")


def test_statements():
    assert schema.statements("a 'x;y'; -- c;\n b `;`;; /* ; */ c") == ["a 'x;y'", "b `;`", "c"]


def test_migrations(spark, tmp_path):
    one = schema.make_migration("0001_first", schema.EMPTY, first())
    two = schema.make_migration("0002_second", one.target, second())
    c = Context(spark, second(), str(tmp_path))
    m = schema.Migrator(c, [two, one])
    assert m.apply_pending() == ["0001_first", "0002_second"] and m.pending() == []
    assert c.storage("items").dtypes == [("id", "int"), ("name", "string"), ("value", "bigint"), ("extra", "string")]
    assert m.revert_to("0001_first") == ["0002_second"]
    assert c.storage("items").columns == ["id", "name", "value"] and c.store.current("others") is None
    assert "0002_second" in m.generate_script()
    with pytest.raises(MigrationError):
        m.revert_to("nope")
    with pytest.raises(MigrationError):
        schema.Migration("bad id", [], {}, {})


def test_create_seed_and_live_diff(spark, tmp_path):
    c = Context(spark, first(), str(tmp_path))
    assert schema.ensure_created(c) == ["items"] and c.set("Item").count() == 1
    assert schema.live_diff(c) == []
    later = Context(spark, second(), str(tmp_path))
    assert {f.kind for f in schema.live_diff(later)} == {"CreateTable", "AddColumn", "AlterColumn", "ManualAction"}
    schema.apply_live_diff(later)
    assert later.set("Item").to_list()[0].asDict() == {"id": 1, "name": "one", "value": 5, "extra": "x"}
    assert [f.kind for f in schema.live_diff(c) if f.kind != "ConstraintNotIntrospected"] == ["AlterColumn", "SkippedRemoval"]
    later.model.get("Item").column("must", "int", required=True)
    with pytest.raises(MigrationError):
        schema.apply_live_diff(later)
    assert "m.entity('Items', 'items')" in schema.reverse_engineer(c, ["items"])
    schema.ensure_deleted(c)
    assert c.store.current("items") is None


def test_validate(spark, tmp_path):
    c = Context(spark, second(), str(tmp_path)).use_frame("items", spark.createDataFrame([(1, "a", -1, "x"), (2, "b", 1, "x")], "id int, name string, value long, extra string"))
    with pytest.raises(ConstraintViolation, match="positive"):
        schema.validate(c, c.model.get("Item"))
    c.use_frame("items", spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "x")], "id int, name string, value long, extra string"))
    with pytest.raises(ConstraintViolation, match="unique"):
        schema.validate(c, c.model.get("Item"))


def test_renamed_columns_and_computed(spark):
    m = Model()
    m.entity("T", "t").column("a", "int", key=True, column="stored_a").column("b", "int").column("twice", "int", computed="b * 2").column("hidden", "int").ignore("hidden")
    c = Context(spark, m).use_frame("t", spark.createDataFrame([(1, 5), (2, 6)], "stored_a int, b int"))
    assert [r.asDict() for r in c.set("T").where(lambda t: t.twice > 10).to_list()] == [{"a": 2, "b": 6, "twice": 12}]


def test_connection_strings():
    s = ConnectionString.parse_auto("postgres://me:p%40ss@db:5433/shop?sslmode=require")
    assert (s.user, s.password, s.host, s.port, s.database, s.options) == ("me", "p@ss", "db", 5433, "shop", {"sslmode": "require"})
    assert ConnectionString.parse(s.build()) == s and s.jdbc_url() == "jdbc:postgresql://db:5433/shop" and "p%40ss" not in s.redacted()
    a = ConnectionString.parse_auto('Server=h;Port=3307;Database=d;User Id=u;Password="a;b";Timeout=5')
    assert (a.host, a.port, a.database, a.user, a.password, a.options) == ("h", 3307, "d", "u", "a;b", {"Timeout": "5"})
    assert ConnectionString.parse("sqlite::memory:").database == ":memory:"
    for bad in ("mysql:///db", "postgres://h"):
        with pytest.raises(ConfigurationError):
            ConnectionString.parse(bad).validate()
    with pytest.raises(ConfigurationError):
        ConnectionString.parse("oracle://h/d")


def test_registry_and_model_cache(spark):
    made = []
    r = Registry().add(lambda key: made.append(key) or Context(spark, cached_model("w", warehouse)), None)
    assert r.get("x") is r.get("x") and r.get("y") is not r.get("x") and made == ["x", "y"]
    assert r.get("x").model is r.get("y").model
    with pytest.raises(ConfigurationError):
        Registry().get("z")


def test_cli(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    spec = "lakequill.plans.warehouse:warehouse"
    assert cli.main(["init"]) == 0 and cli.main(["add", "first", "--model", spec]) == 0
    cli.main(["list"])
    cli.main(["script"])
    cli.main(["ddl", "--model", spec])
    cli.main(["capabilities"])
    out = capsys.readouterr().out
    assert "0001_first" in out and "CREATE TABLE `orders`" in out and '"merge": false' in out


def test_streams_take_the_same_predicates(spark, tmp_path):
    c = open_warehouse(spark, "/root/testdata/sf0.001")
    entity = c.model.get("Event")
    source = tmp_path / "in"
    c.storage("events").write.parquet(str(source))
    rows = events.where(c, entity, events.read_stream(c, entity, str(source)), lambda e: e.value > 0)
    from pyspark.sql import functions as F

    out = events.windowed(rows, "ts", "1 hour", "10 minutes", ["event_type"], n=F.count("*"))
    q = out.writeStream.format("memory").queryName("ev").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = c.set("Event").where(lambda e: e.value > 0).count()
    assert spark.table("ev").agg(F.sum("n")).first()[0] == want
