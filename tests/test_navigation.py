"""Includes: nested columns for each kind of relationship, filters and lazy loads."""

import pytest

from lakequill.errors import UnknownNavigation
from lakequill.model import Model
from lakequill.operators.navigation import load
from lakequill.sources.context import Context


@pytest.fixture(scope="module")
def c(spark):
    m = Model()
    (
        m.entity("Blog", "blogs").column("blog_id", "int", key=True).column("url", "string")
        .has_many("posts", "Post", "blog_id").has_one("setting", "Setting", "blog_id")
    )
    (
        m.entity("Post", "posts").column("post_id", "int", key=True).column("title", "string").column("blog_id", "int").column("tenant_id", "int")
        .belongs_to("blog", "Blog", "blog_id").has_many("comments", "Comment", "post_id")
    )
    m.entity("Comment", "comments").column("comment_id", "int", key=True).column("text", "string").column("post_id", "int")
    m.entity("Setting", "settings").column("setting_id", "int", key=True).column("blog_id", "int").column("theme", "string")
    m.entity("Student", "students").column("student_id", "int", key=True).column("name", "string").many_to_many("courses", "Course", "Enrollment", "student_id", "course_id")
    m.entity("Course", "courses").column("course_id", "int", key=True).column("title", "string")
    m.entity("Enrollment", "enrollments").column("enrollment_id", "int", key=True).column("student_id", "int").column("course_id", "int")
    c = Context(spark, m)
    for name, rows, schema in (
        ("blogs", [(1, "a"), (2, "b"), (3, "c")], "blog_id int, url string"),
        ("posts", [(1, "p1", 1, 1), (2, "p2", 1, 2), (3, "p3", 2, 1), (4, "none", None, 1)], "post_id int, title string, blog_id int, tenant_id int"),
        ("comments", [(1, "x", 1), (2, "y", 1), (3, "z", 3)], "comment_id int, text string, post_id int"),
        ("settings", [(1, 1, "dark"), (2, 1, "light")], "setting_id int, blog_id int, theme string"),
        ("students", [(1, "Alice"), (2, "Bob")], "student_id int, name string"),
        ("courses", [(1, "Rust 101"), (2, "ORM Design"), (3, "Empty")], "course_id int, title string"),
        ("enrollments", [(1, 1, 1), (2, 1, 2)], "enrollment_id int, student_id int, course_id int"),
    ):
        c.use_frame(name, spark.createDataFrame(rows, schema))
    return c


def test_has_many_nested_and_has_one(c):
    rows = {r["blog_id"]: r for r in c.set("Blog").include("posts", "comments").include("setting").order_by("blog_id").to_list()}
    assert [p["title"] for p in rows[1]["posts"]] == ["p1", "p2"]
    assert [x["text"] for x in rows[1]["posts"][0]["comments"]] == ["x", "y"]
    assert rows[1]["posts"][1]["comments"] == [] and rows[3]["posts"] == []
    assert rows[1]["setting"]["theme"] == "dark" and rows[2]["setting"] is None


def test_belongs_to_keeps_rows_without_principal(c):
    rows = {r["post_id"]: r["blog"] for r in c.set("Post").include("blog").to_list()}
    assert rows[1]["url"] == "a" and rows[4] is None and len(rows) == 4


def test_many_to_many(c):
    rows = {r["name"]: [x["title"] for x in r["courses"]] for r in c.set("Student").include("courses").to_list()}
    assert rows == {"Alice": ["Rust 101", "ORM Design"], "Bob": []}


def test_narrowed_include_and_paging(c):
    rows = c.set("Blog").where(lambda b: b.blog_id == 1).include("posts", "comments").to_list()
    assert len(rows) == 1 and len(rows[0]["posts"]) == 2
    assert len(c.set("Blog").include("posts").order_by("blog_id").take(1).to_list()[0]["posts"]) == 2


def test_filters_reach_includes(c, spark):
    import copy

    m = copy.deepcopy(c.model)
    m.get("Post").has_query_filter(lambda p: p.tenant_id == 1)
    own = Context(spark, m)
    own.frames = dict(c.frames)
    assert sorted(r["post_id"] for r in own.set("Post").to_list()) == [1, 3, 4]
    assert own.set_ignoring_filters("Post").count() == 4
    counts = {r["blog_id"]: len(r["posts"]) for r in own.set("Blog").include("posts").to_list()}
    assert counts == {1: 1, 2: 1, 3: 0}
    assert {r["blog_id"]: len(r["posts"]) for r in own.set_ignoring_filters("Blog").include("posts").to_list()}[1] == 2


def test_lazy_load_and_unknown_names(c):
    blog = c.set("Blog").find(1)
    assert [p["title"] for p in load(c, "Blog", blog, "posts")] == ["p1", "p2"]
    assert load(c, "Post", c.set("Post").find(1), "blog")["url"] == "a"
    assert {x["title"] for x in load(c, "Student", c.set("Student").find(1), "courses")} == {"Rust 101", "ORM Design"}
    with pytest.raises(UnknownNavigation):
        c.set("Blog").include("nope")
