"""Bulk changes, the unit of work, cascades, constraints and transactions, on stores in temporary folders."""

import datetime as dt

import pytest

from lakequill.errors import (
    CheckViolation, ConcurrencyConflict, ForeignKeyViolation, InvalidQuery, RequiredViolation, TransactionError, UniqueViolation, Unsupported,
)
from lakequill.functions import checks
from lakequill.model import Model, OnDelete, dependency_order
from lakequill.operators.tracking import Audit, Interceptor, State
from lakequill.plans.schema import ensure_created
from lakequill.sources.context import Context


def build(rule: OnDelete | None = None) -> Model:
    m = Model()
    (
        m.entity("Blog", "blogs").column("blog_id", "int", key=True, auto_increment=True).column("url", "string", required=True, max_length=20)
        .column("rating", "int").column("version", "int", concurrency_token=True, default=1).column("updated_by", "string")
        .has_many("posts", "Post", "blog_id", on_delete=rule).has_check("rating", checks.between("rating", 0, 10)).has_index("url", unique=True)
    )
    (
        m.entity("Post", "posts").column("post_id", "int", key=True, auto_increment=True).column("title", "string").column("blog_id", "int")
        .column("published", "boolean", default=False).belongs_to("blog", "Blog", "blog_id").many_to_many("tags", "Tag", "PostTag", "post_id", "tag_id")
    )
    m.entity("Tag", "tags").column("tag_id", "int", key=True, auto_increment=True).column("name", "string", enum=["a", "b"])
    m.entity("PostTag", "post_tags").column("id", "int", key=True, auto_increment=True).column("post_id", "int").column("tag_id", "int")
    m.entity("Category", "categories").column("id", "int", key=True).column("parent_id", "int").has_many("children", "Category", "parent_id", on_delete=OnDelete.CASCADE)
    return m


@pytest.fixture
def c(spark, tmp_path):
    c = Context(spark, build(), str(tmp_path))
    ensure_created(c)
    for i in range(1, 4):
        c.unit.add("Blog", url=f"b{i}", rating=i)
    assert c.unit.save_changes() == 3
    return c


def all_of(c, name):
    return c.set(name).order_by(c.model.get(name).key[0]).to_list()


def test_insert_assigns_keys_and_resolves_principals(c):
    blog = c.unit.add("Blog", url="new")
    post = c.unit.add("Post", title="t", blog_id=blog)
    tag = c.unit.add("Tag", name="a")
    post.link("tags", tag)
    assert c.unit.save_changes() == 3
    assert blog["blog_id"] == 4 and post["blog_id"] == 4 and post["published"] is False
    rows = c.set("Post").include("tags").to_list()
    assert rows[0]["tags"][0]["name"] == "a"


def test_update_writes_dirty_columns_and_sees_conflicts(c):
    first = c.unit.attach("Blog", c.set("Blog").find(1))
    first["rating"] = None
    assert c.unit.has_changes() and c.unit.count_by_state(State.MODIFIED) == 1
    c.unit.save_changes()
    row = c.set("Blog").find(1)
    assert row["rating"] is None and row["version"] == 2 and row["url"] == "b1"
    stale = c.unit.attach("Blog", {**row.asDict(), "version": 1})
    stale["rating"] = 5
    with pytest.raises(ConcurrencyConflict):
        c.unit.save_changes()
    assert c.set("Blog").find(1)["rating"] is None
    c.unit.reject_changes()
    assert not c.unit.has_changes()


def test_compare_and_swap(c):
    step = lambda: c.set("Blog").where(lambda b: (b.blog_id == 1) & (b.version == 1)).execute_update().set_column("version", 2).execute()
    assert step() == 1 and step() == 0


def test_bulk_changes(c):
    assert c.set("Blog").where(lambda b: b.rating < 3).execute_update().set_column("rating", 9).execute() == 2
    assert [r["rating"] for r in all_of(c, "Blog")] == [9, 9, 3]
    c.unit.add("Post", title="p", blog_id=2)
    c.unit.save_changes()
    assert c.set("Blog").where(lambda b: b.posts.any()).execute_update().set_column("url", "has").execute() == 1
    assert c.set("Blog").where(lambda b: b.posts.none()).execute_delete() == 2
    assert [r["url"] for r in all_of(c, "Blog")] == ["has"]
    with pytest.raises(InvalidQuery):
        c.set("Blog").take(1).execute_delete()
    with pytest.raises(InvalidQuery):
        c.set("Blog").execute_update().execute()


def test_bulk_changes_obey_the_global_filter(c, spark):
    c.model.get("Blog").has_query_filter(lambda b: b.rating >= 2)
    assert c.set("Blog").execute_update().set_column("updated_by", "x").execute() == 2
    assert c.set("Blog").execute_delete() == 2
    assert [r["blog_id"] for r in c.set_ignoring_filters("Blog").to_list()] == [1]


def test_upsert_and_delete(c):
    c.unit.upsert("Blog", blog_id=2, url="two", rating=7)
    c.unit.upsert("Blog", blog_id=9, url="nine")
    c.unit.save_changes()
    assert [(r["blog_id"], r["url"]) for r in all_of(c, "Blog")] == [(1, "b1"), (2, "two"), (3, "b3"), (9, "nine")]
    gone = c.unit.attach("Blog", c.set("Blog").find(9))
    c.unit.remove(gone)
    c.unit.save_changes()
    assert not c.set("Blog").exists_by_id(9)


@pytest.mark.parametrize(("rule", "left"), [(OnDelete.CASCADE, []), (OnDelete.SET_NULL, [None]), (None, [None]), (OnDelete.NO_ACTION, [1])])
def test_cascade_rules(spark, tmp_path, rule, left):
    c = Context(spark, build(rule), str(tmp_path))
    ensure_created(c)
    blog = c.unit.add("Blog", url="b")
    c.unit.add("Post", title="p", blog_id=blog)
    c.unit.save_changes()
    c.unit.remove(blog)
    c.unit.save_changes()
    assert [r["blog_id"] for r in c.set("Post").to_list()] == left and c.set("Blog").count() == 0


def test_restrict_and_self_reference(spark, tmp_path):
    c = Context(spark, build(OnDelete.RESTRICT), str(tmp_path))
    ensure_created(c)
    blog = c.unit.add("Blog", url="b")
    c.unit.add("Post", title="p", blog_id=blog)
    for i, p in ((1, None), (2, 1), (3, 2), (4, None)):
        c.unit.add("Category", id=i, parent_id=p)
    c.unit.save_changes()
    c.unit.remove(blog)
    with pytest.raises(ForeignKeyViolation):
        c.unit.save_changes()
    c.unit.clear()
    c.unit.remove(c.unit.attach("Category", c.set("Category").find(1)))
    c.unit.save_changes()
    assert [r["id"] for r in c.set("Category").to_list()] == [4]


@pytest.mark.parametrize(
    ("values", "error"),
    [({"rating": 3}, RequiredViolation), ({"url": "b1"}, UniqueViolation), ({"url": "x", "rating": 11}, CheckViolation), ({"url": "x" * 21}, CheckViolation), ({"url": "y", "blog_id": 1}, UniqueViolation)],
)
def test_constraints(c, values, error):
    c.unit.add("Blog", **values)
    with pytest.raises(error):
        c.unit.save_changes()
    assert c.set("Blog").count() == 3


def test_foreign_keys_and_enumerations(c):
    c.unit.add("Post", title="p", blog_id=77)
    with pytest.raises(ForeignKeyViolation):
        c.unit.save_changes()
    c.unit.clear()
    c.unit.add("Tag", name="z")
    with pytest.raises(CheckViolation):
        c.unit.save_changes()


def test_hooks_and_audit(c):
    seen = []

    class Log(Interceptor):
        def on_saving(self, entries):
            seen.append(("saving", len(entries)))

        def on_saved(self, entries, count):
            seen.append(("saved", count))

        def on_save_failed(self, entries, error):
            seen.append(("failed", type(error).__name__))

    c.interceptors += [Audit("me", lambda: dt.datetime(2026, 1, 1)), Log()]
    c.unit.save_changes()
    c.unit.add("Blog", url="z")
    c.unit.save_changes()
    c.unit.add("Blog", url="z")
    with pytest.raises(UniqueViolation):
        c.unit.save_changes()
    assert seen == [("saving", 0), ("saved", 0), ("saving", 1), ("saved", 1), ("saving", 1), ("failed", "UniqueViolation")]
    assert c.set("Blog").where(lambda b: b.url == "z").single()["updated_by"] == "me"


def test_transactions(c):
    with pytest.raises(ValueError):
        with c.unit.transaction():
            c.set("Blog").execute_delete()
            assert c.set("Blog").count() == 0
            raise ValueError
    assert c.set("Blog").count() == 3
    with c.unit.transaction() as t:
        c.set("Blog").where(lambda b: b.blog_id == 1).execute_delete()
        t.create_savepoint("s")
        c.set("Blog").execute_delete()
        t.rollback_to("s")
        with pytest.raises(TransactionError), c.unit.transaction():
            pass
        with pytest.raises(Unsupported):
            t.set_isolation("serializable")
    assert c.set("Blog").count() == 2
    assert c.store.vacuum() > 0 and c.set("Blog").count() == 2


def test_dependency_order():
    names = [e.name for e in dependency_order(build())]
    assert names.index("Blog") < names.index("Post") and len(names) == 5


def test_check_builders(spark):
    df = spark.createDataFrame([(1, None, 5), (None, None, -1), (1, 2, 0)], "a int, b int, n int")
    count = lambda sql: df.where(sql).count()
    assert count(checks.exactly_one_of("a", "b")) == 1 and count(checks.at_most_one_of("a", "b")) == 2 and count(checks.at_least_one_of("a", "b")) == 2
    assert count(checks.all_not_null("a", "b")) == 1 and count(checks.non_negative("n")) == 2 and count(checks.positive("n")) == 1
    assert count(checks.in_list("n", [5, 0])) == 2 and count(checks.not_in_list("n", [5])) == 2 and count(checks.in_list("n", [])) == 0
    assert count(checks.any_of(checks.positive("n"), checks.in_list("a", [1]))) == 2 and count(checks.all_of()) == 3


def test_tables_that_are_only_read_are_not_written(spark, tmp_path):
    """Changes of frames leave the folder they came from alone, whatever else they look at."""
    from lakequill.plans.catalogue import QUERIES

    for table in ("region", "nation", "supplier", "customer", "orders", "lineitem", "part", "events"):
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    before = sorted(tmp_path.rglob("*"))
    for name in ("unit_adds_with_keys", "transaction_and_savepoint", "rollback_restores_the_tracker"):
        QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(tmp_path.rglob("*")) == before, name


def test_links_outlast_a_deletion_in_the_same_save(c):
    post, tag = c.unit.add("Post", title="p"), c.unit.add("Tag", name="a")
    c.unit.save_changes()
    post.link("tags", tag)
    c.unit.remove(c.unit.attach("Blog", c.set("Blog").find(3)))
    c.unit.save_changes()
    assert c.set("PostTag").count() == 1 and c.set("Blog").count() == 2
