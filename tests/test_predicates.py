"""Predicate algebra and the EXISTS family, with the fixture rows of FIXTURES.md."""

import pytest

from lakequill.errors import InvalidQuery, UnknownColumn
from lakequill.functions.predicates import ALWAYS, NEVER, condition
from lakequill.model import Model
from lakequill.sources.context import Context


@pytest.fixture(scope="module")
def blogs(spark):
    m = Model()
    m.entity("Blog", "blogs").column("blog_id", "int", key=True).column("url", "string").has_many("posts", "Post", "blog_id")
    (
        m.entity("Post", "posts").column("post_id", "int", key=True).column("title", "string").column("blog_id", "int").column("published", "boolean")
        .belongs_to("blog", "Blog", "blog_id")
    )
    c = Context(spark, m)
    c.use_frame("blogs", spark.createDataFrame([(i, f"b{i}") for i in range(1, 5)], "blog_id int, url string"))
    posts = [(1, "Post 1A", 1, True), (2, "Post 1B", 1, False), (3, "rust intro", 2, True), (4, "rust advanced", 2, True), (5, "Post 3A", 3, False)]
    c.use_frame("posts", spark.createDataFrame(posts, "post_id int, title string, blog_id int, published boolean"))
    return c


def ids(query):
    return sorted(r["blog_id"] for r in query.to_list())


def test_exists_family(blogs):
    s = blogs.set("Blog")
    assert ids(s.where(lambda b: b.posts.any(lambda p: p.published.is_true()))) == [1, 2]
    assert ids(s.where(lambda b: b.posts.none(lambda p: p.published.is_true()))) == [3, 4]
    assert ids(s.where(lambda b: b.posts.all(lambda p: p.published.is_true()))) == [2, 4]
    assert ids(s.where(lambda b: ~b.posts.any(lambda p: p.published.is_true()))) == [3, 4]
    assert ids(s.where(lambda b: ~b.posts.all(lambda p: p.published.is_true()))) == [1, 3]
    assert ids(s.where(lambda b: b.posts.any(lambda p: p.title.contains("rust")))) == [2]
    assert ids(s.where(lambda b: b.posts.any())) == [1, 2, 3]
    assert ids(s.where(lambda b: b.posts.any(lambda p: p.blog.any(lambda x: x.url == "b3")))) == [3]


def test_in_subquery(blogs, spark):
    s = blogs.set("Blog")
    assert ids(s.where(lambda b: b.blog_id.in_subquery("Post", "blog_id"))) == [1, 2, 3]
    assert ids(s.where(lambda b: ~b.blog_id.in_subquery("Post", "blog_id"))) == [4]
    empty = lambda p: p.post_id < 0
    assert ids(s.where(lambda b: b.blog_id.in_subquery("Post", "blog_id", empty))) == []
    assert ids(s.where(lambda b: ~b.blog_id.in_subquery("Post", "blog_id", empty))) == [1, 2, 3, 4]
    with_null = Context(spark, blogs.model).use_frame("blogs", blogs.frames["blogs"])
    with_null.use_frame("posts", spark.sql("SELECT 1 post_id, 't' title, CAST(NULL AS INT) blog_id, true published"))
    assert ids(with_null.set("Blog").where(lambda b: ~b.blog_id.in_subquery("Post", "blog_id"))) == []


def test_algebra_laws(blogs):
    p = blogs.columns("Blog").blog_id > 2
    assert (ALWAYS & p) is p and (p & ALWAYS) is p and (NEVER | p) is p and (p | NEVER) is p
    assert (NEVER & p).is_never and (p & NEVER).is_never and (ALWAYS | p).is_always and (p | ALWAYS).is_always
    assert (~ALWAYS).is_never and (~NEVER).is_always
    assert p.and_opt(None) is p and p.or_opt(None) is p
    assert ids(blogs.set("Blog").where(NEVER)) == []
    assert ids(blogs.set("Blog").where(ALWAYS)) == [1, 2, 3, 4]
    with pytest.raises(InvalidQuery):
        bool(p)


def test_like_keeps_wildcards_and_backslashes(spark):
    m = Model()
    m.entity("T", "t").column("id", "int", key=True).column("s", "string")
    c = Context(spark, m).use_frame("t", spark.createDataFrame([(1, "a_b"), (2, "axb"), (3, "a\\b"), (4, "A_B")], "id int, s string"))
    found = lambda v: sorted(r["id"] for r in c.set("T").where(lambda t: t.s.contains(v)).to_list())
    assert found("a_b") == [1, 2, 3]
    assert found("\\") == [3]
    assert found("A") == [4]


def test_conditions_by_name_and_unknown_columns(blogs):
    s = blogs.set("Blog")
    assert ids(s.where(condition("blog_id", "between", 2, 3))) == [2, 3]
    assert ids(s.where(condition("blog_id", "not in", 2, 3))) == [1, 4]
    assert ids(s.where(condition("url", "is null"))) == []
    assert ids(s.where(lambda b: b.blog_id.is_in([]))) == []
    assert ids(s.where(lambda b: b.blog_id.not_in([]))) == [1, 2, 3, 4]
    with pytest.raises(UnknownColumn):
        s.where(lambda b: b.nope == 1)
    with pytest.raises(InvalidQuery):
        s.where(condition("blog_id", "~", 1))
