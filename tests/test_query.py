"""Clauses, joins, grouping, windows, set operations and terminals on hand-made rows."""

import pytest

from lakequill.errors import ConversionError, InvalidQuery, NotFound, NotUnique
from lakequill.model import Model
from lakequill.operators.query import agg
from lakequill.sources.context import Context


@pytest.fixture(scope="module")
def c(spark):
    m = Model()
    (
        m.entity("Blog", "blogs").column("blog_id", "int", key=True).column("title", "string").column("rating", "int").column("views", "bigint")
        .column("published", "boolean").column("category", "string").has_many("posts", "Post", "blog_id")
    )
    m.entity("Post", "posts").column("post_id", "int", key=True).column("title", "string").column("blog_id", "int").belongs_to("blog", "Blog", "blog_id")
    m.entity("Emp", "emp").column("emp_id", "int", key=True).column("name", "string").column("dept", "string").column("salary", "bigint")
    m.entity("Node", "nodes").column("id", "int", key=True).column("parent", "int")
    c = Context(spark, m)
    c.use_frame("blogs", spark.createDataFrame(
        [(1, "Rust", 9, 100, True, "tech"), (2, "Async", 7, 50, True, "tech"), (3, "Cooking", 3, 10, False, "food")],
        "blog_id int, title string, rating int, views bigint, published boolean, category string"))
    c.use_frame("posts", spark.createDataFrame([(1, "P1", 1), (2, "P2", 1)], "post_id int, title string, blog_id int"))
    c.use_frame("emp", spark.createDataFrame(
        [(1, "Alice", "Engineering", 100000), (2, "Bob", "Engineering", 90000), (3, "Carol", "Engineering", 110000),
         (4, "Dave", "Sales", 80000), (5, "Eve", "Sales", 85000), (6, "Frank", "Sales", 80000)],
        "emp_id int, name string, dept string, salary bigint"))
    c.use_frame("nodes", spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 9)], "id int, parent int"))
    return c


def titles(q):
    return [r["title"] for r in q.to_list()]


def test_paging_and_scalars(c):
    b = c.set("Blog")
    assert titles(b.order_by("blog_id").skip(1).take(1)) == ["Async"]
    assert (b.min("rating"), b.max("rating"), b.max("views")) == (3, 9, 100)
    assert b.count() == 3 and b.take(2).count() == 2 and b.skip(1).count() == 2
    assert b.sum("rating") == 19.0 and round(b.avg("rating"), 3) == 6.333
    none = b.where(lambda x: x.rating > 100)
    assert (none.sum("rating"), none.avg("rating"), none.min("rating"), none.max("rating")) == (0.0, 0.0, None, None)
    assert b.where(lambda x: x.published.is_true()).distinct().count() == 2


def test_having(c):
    b = c.set("Blog").group_by("category").select("category")
    keys = lambda h: sorted(r["category"] for r in b.having(h).to_list())
    assert keys((agg("count") > 1) & (agg("sum", "views") > 100)) == ["tech"]
    assert keys((agg("count") > 5) | (agg("sum", "views") > 100)) == ["tech"]
    assert keys(~(agg("count") > 1)) == ["food"]
    assert keys(agg("sum", "views") > agg("count", "blog_id")) == ["food", "tech"]
    assert len(b.having(agg("count") > 1).having(agg("sum", "views") < 0).to_list()) == 0
    assert sorted(titles(c.set("Blog").group_by("category"))) == ["Cooking", "Rust"]
    with pytest.raises(InvalidQuery):
        c.set("Blog").having(agg("count") > 1).to_df()


def test_joins(c):
    b = c.set("Blog")
    assert len(b.inner_join("Post", "blog_id", "blog_id").to_list()) == 2
    assert len(b.left_join("Post", "blog_id", "blog_id").to_list()) == 4
    assert len(b.right_join("Post", "blog_id", "blog_id").to_list()) == 2
    assert len(b.full_join("Post", "blog_id", "blog_id").to_list()) == 4
    assert len(b.cross_join("Post").to_list()) == 6
    joined = b.left_join("Post", "blog_id", "blog_id").to_df()
    assert "posts_title" in joined.columns and "posts_blog_id" in joined.columns
    assert joined.where("blog_id = 3").first()["posts_title"] is None
    twice = b.inner_join("Post", "blog_id", "blog_id", prefix="a").inner_join("Post", "blog_id", "blog_id", prefix="b").to_df()
    assert twice.count() == 4 and {"a_title", "b_title"} <= set(twice.columns)


def test_set_operations(c):
    b = c.set("Blog")
    tech = b.where(lambda x: x.category == "tech")
    assert len(b.union(b).to_list()) == 3 and len(b.union_all(b).to_list()) == 6
    assert titles(b.except_(tech)) == ["Cooking"] and sorted(titles(b.intersect(tech))) == ["Async", "Rust"]
    assert titles(b.union(b).order_by_desc("blog_id").take(1)) == ["Cooking"]


def test_windows(c):
    rows = c.set("Emp").window("rn", "row_number", None, ("dept",), (("salary", "desc"), "emp_id")).window("total", "sum", "salary", ("dept",)).to_list()
    assert {r["name"]: r["rn"] for r in rows} == {"Carol": 1, "Alice": 2, "Bob": 3, "Eve": 1, "Dave": 2, "Frank": 3}
    assert {r["dept"]: r["total"] for r in rows} == {"Engineering": 300000, "Sales": 245000}
    ranks = c.set("Emp").window("r", "rank", None, ("dept",), ("salary",)).window("d", "dense_rank", None, ("dept",), ("salary",)).to_list()
    assert {r["name"]: (r["r"], r["d"]) for r in ranks if r["dept"] == "Sales"} == {"Dave": (1, 1), "Frank": (1, 1), "Eve": (3, 2)}
    lag = c.set("Emp").window("p", "lag", "salary", ("dept",), ("salary", "emp_id")).to_list()
    assert {r["name"]: r["p"] for r in lag if r["dept"] == "Engineering"} == {"Bob": None, "Alice": 90000, "Carol": 100000}
    with pytest.raises(InvalidQuery):
        c.set("Emp").window("x", "lag")


def test_named_sources(c):
    high = lambda e: e.salary > 85000
    q = c.set("Emp").with_cte_typed("high", "Emp", high).from_cte("high")
    assert len(q.to_list()) == 3
    assert [r["name"] for r in q.order_by_desc("salary").to_list()] == ["Carol", "Alice", "Bob"]
    q = c.set("Emp").with_cte_typed("t", "Emp", lambda e: (e.salary > 100000) | (e.dept == "Sales")).from_cte("t")
    assert q.count() == 4
    tree = c.set("Node").with_recursive("f", "Node", "parent", "id", lambda n: n.id == 1).from_cte("f")
    assert sorted(r["id"] for r in tree.to_list()) == [1, 2, 3, 4]
    with pytest.raises(InvalidQuery):
        c.set("Emp").from_cte("nope")


def test_recursion_on_a_cycle_raises(c, spark):
    own = Context(spark, c.model).use_frame("nodes", spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int"))
    with pytest.raises(Exception, match="RECURSION"):
        own.set("Node").with_recursive("f", "Node", "parent", "id", lambda n: n.id == 1).from_cte("f").to_list()


def test_terminals(c):
    e = c.set("Emp")
    assert e.order_by("emp_id").first()["name"] == "Alice" and e.last()["name"] == "Frank"
    assert e.order_by("salary", "emp_id").last()["name"] == "Carol"
    assert e.order_by("emp_id").take(2).last()["name"] == "Bob"
    nobody = e.where(lambda x: x.salary < 0)
    assert nobody.first_or_default() is None and nobody.last_or_default() is None and nobody.single_or_default() is None
    for call in (nobody.first, nobody.last, nobody.single):
        with pytest.raises(NotFound):
            call()
    with pytest.raises(NotUnique):
        e.single()
    assert e.where(lambda x: x.name == "Eve").single()["emp_id"] == 5
    assert e.any() and not nobody.any()
    assert e.all(lambda x: x.salary > 0) and not e.all(lambda x: x.dept == "Sales")
    assert e.find(3)["name"] == "Carol" and e.find(99) is None and e.contains(3) and not e.exists_by_id(99)
    assert set(e.to_dictionary(lambda r: r["dept"])) == {"Sales", "Engineering"}
    assert e.order_by("emp_id").take(1).select("name", "salary").to_tuples("string", "double") == [("Alice", 100000.0)]
    with pytest.raises(ConversionError):
        e.select("name").to_tuples("string", "int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        e.select("name").to_tuples("int")
    assert "Filter" in e.where(lambda x: x.salary > 1).to_sql() or "Project" in e.to_sql()


def test_clauses_in_any_order(c):
    """A filter after HAVING still is a WHERE."""
    q = c.set("Blog").group_by("category").having(agg("count") >= 1).where(lambda b: b.rating > 5).select("category")
    assert [r["category"] for r in q.to_list()] == ["tech"]
