"""Catalogue: one query for each operator of the engine on the star schema, beside the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.predicates import ALWAYS, NEVER, condition, raw
from ..model import OnDelete
from ..operators.mutation import cascade_delete, delta_frame, upsert_frame
from ..operators.navigation import load
from ..operators.query import Query, agg
from ..sources.context import Context
from .warehouse import open_warehouse, warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Register a function of a context, returning a query or a frame, with its SQL."""

    def register(make: Callable[[Context], Query | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(open_warehouse(spark, sf_dir))
            return out.to_df() if isinstance(out, Query) else out

        key = name or make.__name__
        run.__name__ = key
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return make

    return register


def _value(context: Context, **values) -> DataFrame:
    """A terminal's result as one row."""
    columns = (F.lit(v).cast("bigint") if type(v) is int else F.lit(v) for v in values.values())
    return context.spark.range(1).select(*(c.alias(k) for c, k in zip(columns, values, strict=True)))


# --- scans and predicates ---

query("SELECT * FROM nation", "scan_table")(lambda c: c.set("Nation"))
query("SELECT * FROM nation WHERE n_regionkey = 1", "raw_sql")(lambda c: c.sql("SELECT * FROM nation WHERE n_regionkey = ?", 1, entity="Nation"))

for _name, _op, _sql in (("eq", "=", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("ge", ">=", ">="), ("lt", "<", "<"), ("le", "<=", "<=")):
    query(f"SELECT * FROM orders WHERE o_orderstatus {_sql} 'O'", f"filter_cmp_{_name}")(lambda c, op=_op: c.set("Order").where(condition("o_orderstatus", op, "O")))
    query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice {_sql} (SELECT o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1)", f"filter_price_{_name}")(
        lambda c, op=_op: c.set("Order").where(condition("o_totalprice", op, c.set("Order").last()["o_totalprice"])).select("o_orderkey", "o_totalprice")
    )


@query("SELECT * FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '1-URGENT')")
def filter_and_or_not(c):
    return c.set("Order").where(lambda o: ((o.o_orderstatus == "F") | (o.o_totalprice > 200000.0)) & ~(o.o_orderpriority == "1-URGENT"))


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def filter_date(c):
    return c.set("Order").where(lambda o: (o.o_orderdate >= dt.datetime(1996, 1, 1)) & (o.o_orderdate < dt.datetime(1997, 1, 1)))


query("SELECT * FROM part WHERE p_name LIKE '%ar%'", "filter_like_contains")(lambda c: c.set("Part").where(lambda p: p.p_name.contains("ar")))
query("SELECT * FROM part WHERE p_type LIKE 'S%'", "filter_like_prefix")(lambda c: c.set("Part").where(lambda p: p.p_type.starts_with("S")))
query("SELECT * FROM part WHERE p_brand LIKE '%3'", "filter_like_suffix")(lambda c: c.set("Part").where(lambda p: p.p_brand.ends_with("3")))
query("SELECT * FROM part WHERE p_name LIKE '%a_e%'", "filter_like_wildcard")(lambda c: c.set("Part").where(lambda p: p.p_name.contains("a_e")))
query("SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "filter_in")(
    lambda c: c.set("Customer").where(lambda x: x.c_mktsegment.is_in(["BUILDING", "MACHINERY"]))
)
query("SELECT * FROM customer WHERE 1 = 0", "filter_in_empty")(lambda c: c.set("Customer").where(lambda x: x.c_mktsegment.is_in([])))
query("SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "filter_not_in")(
    lambda c: c.set("Customer").where(lambda x: x.c_mktsegment.not_in(["BUILDING", "MACHINERY"]))
)
query("SELECT * FROM customer", "filter_not_in_empty")(lambda c: c.set("Customer").where(lambda x: x.c_mktsegment.not_in([])))
query("SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", "filter_between")(lambda c: c.set("LineItem").where(lambda x: x.l_quantity.between(10.0, 20.0)))


def _with_nulls(c: Context) -> Query:
    """Orders without a priority where it is low."""
    rows = c.storage("orders").withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return c.use_frame("orders", rows).set("Order")


_NULLED = "SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders"
query(f"SELECT * FROM ({_NULLED}) WHERE o_orderpriority IS NULL", "filter_null")(lambda c: _with_nulls(c).where(lambda o: o.o_orderpriority.is_null()))
query(f"SELECT * FROM ({_NULLED}) WHERE o_orderpriority IS NOT NULL", "filter_not_null")(lambda c: _with_nulls(c).where(lambda o: o.o_orderpriority.is_not_null()))
query(f"SELECT * FROM ({_NULLED}) WHERE o_orderpriority NOT IN ('1-URGENT')", "filter_not_in_nulls")(lambda c: _with_nulls(c).where(lambda o: o.o_orderpriority.not_in(["1-URGENT"])))
query(f"SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN (SELECT o_orderpriority FROM ({_NULLED}))", "not_in_subquery_nulls")(
    lambda c: (_with_nulls(c), c.set("Customer").where(lambda x: ~x.c_mktsegment.in_subquery("Order", "o_orderpriority")).select("c_custkey"))[1]
)
query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "exists_any")(
    lambda c: c.set("Customer").where(lambda x: x.orders.any(lambda o: o.o_totalprice > 250000.0))
)
query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "exists_none")(
    lambda c: c.set("Customer").where(lambda x: x.orders.none(lambda o: o.o_orderstatus == "F"))
)
query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))", "exists_all")(
    lambda c: c.set("Customer").where(lambda x: x.orders.all(lambda o: o.o_totalprice > 20000.0))
)
query("SELECT * FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "exists_or")(
    lambda c: c.set("Customer").where(lambda x: (x.c_acctbal < 0.0) | x.orders.any(lambda o: o.o_orderpriority == "1-URGENT"))
)
query("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')", "exists_belongs_to")(
    lambda c: c.set("Order").where(lambda o: o.customer.any(lambda x: x.c_mktsegment == "BUILDING"))
)
query(
    "SELECT * FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size > 48)", "exists_many_to_many"
)(lambda c: c.set("Supplier").where(lambda s: s.parts.any(lambda p: p.p_size > 48)))
query(
    "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000))",
    "exists_nested",
)(lambda c: c.set("Nation").where(lambda n: n.customers.any(lambda x: x.orders.any(lambda o: o.o_totalprice > 300000.0))))
query("SELECT * FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)", "in_subquery")(
    lambda c: c.set("Customer").where(lambda x: x.c_custkey.in_subquery("Supplier", "s_suppkey"))
)
query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", "not_in_subquery")(
    lambda c: c.set("Customer").where(lambda x: ~x.c_custkey.in_subquery("Order", "o_custkey", lambda o: o.o_totalprice > 100000.0))
)
query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "in_subquery_filtered")(
    lambda c: c.set("Customer").where(lambda x: x.c_custkey.in_subquery("Order", "o_custkey", lambda o: o.o_orderstatus == "P"))
)


@query("SELECT * FROM part WHERE p_size > 10 AND (p_brand = 'Brand#11' OR p_retailprice < 1200)")
def predicate_compose(c):
    p = c.columns("Part")
    wanted = ALWAYS.and_opt(p.p_size > 10).and_opt(None) & NEVER.or_opt(p.p_brand == "Brand#11").or_opt(p.p_retailprice < 1200.0)
    return c.set("Part").where(wanted)


# --- projection ---

query("SELECT c_custkey, c_name FROM customer", "select_cols")(lambda c: c.set("Customer").select("c_custkey", "c_name"))
query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "distinct_rows")(lambda c: c.set("LineItem").select("l_returnflag", "l_linestatus").distinct())
query("SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)", "count_distinct_rows")(
    lambda c: _value(c, n=c.set("LineItem").select("l_returnflag", "l_linestatus").distinct().count())
)
query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_name FROM part", "select_typed")(
    lambda c: c.spark.createDataFrame(c.set("Part").select("p_partkey", "p_size", "p_name").to_tuples("string", "double", "string"), "p_partkey string, p_size double, p_name string")
)
query("SELECT s_suppkey, s_name FROM supplier", "select_raw_rows")(
    lambda c: c.spark.createDataFrame(c.set("Supplier").select("s_suppkey", "s_name").to_tuples(), "s_suppkey long, s_name string")
)

# --- joins ---

query("SELECT n.*, r.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "join_inner")(lambda c: c.set("Nation").inner_join("Region", "n_regionkey", "r_regionkey"))
query("SELECT c.*, o.* FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "join_left")(lambda c: c.set("Customer").left_join("Order", "c_custkey", "o_custkey"))
query("SELECT s.*, n.* FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey", "join_right")(lambda c: c.set("Supplier").right_join("Nation", "s_nationkey", "n_nationkey"))
query("SELECT s.*, c.* FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey", "join_full")(lambda c: c.set("Supplier").full_join("Customer", "s_suppkey", "c_custkey"))
query("SELECT r.*, n.* FROM region r CROSS JOIN nation n", "join_cross")(lambda c: c.set("Region").cross_join("Nation"))
query(
    "SELECT l.*, o.*, p.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 45", "join_two"
)(lambda c: c.set("LineItem").where(lambda x: x.l_quantity > 45.0).inner_join("Order", "l_orderkey", "o_orderkey").inner_join("Part", "l_partkey", "p_partkey"))

query(
    """SELECT s.*, a.*, b.n_nationkey AS nation_n_nationkey, b.n_name AS nation_n_name, b.n_regionkey AS nation_n_regionkey,
       d.n_nationkey AS nation_2_n_nationkey, d.n_name AS nation_2_n_name, d.n_regionkey AS nation_2_n_regionkey
       FROM supplier s JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_regionkey LEFT JOIN nation d ON s_suppkey = d.n_nationkey""", "join_same_table_again"
)(
    lambda c: c.set("Supplier").inner_join("Nation", "s_nationkey", "n_nationkey").inner_join("Nation", "s_nationkey", "n_regionkey").left_join("Nation", "s_suppkey", "n_nationkey")
)

# --- scalar aggregates ---

for _f, _sql in (
    ("sum", "round(coalesce(sum(l_quantity), 0.0), 2)"), ("avg", "round(coalesce(avg(l_quantity), 0.0), 6)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)"),
):
    query(f"SELECT {_sql} AS value FROM lineitem WHERE l_returnflag = 'R'", f"agg_{_f}")(
        lambda c, f=_f: c.set("LineItem").where(lambda x: x.l_returnflag == "R").scalar(f, "l_quantity").select(
            F.round("value", 2 if f == "sum" else 6).alias("value") if f in ("sum", "avg") else F.col("value"))
    )
query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'", "agg_count")(lambda c: _value(c, n=c.set("LineItem").where(lambda x: x.l_returnflag == "R").count()))
query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'", "agg_long_count")(lambda c: _value(c, n=c.set("LineItem").where(lambda x: x.l_returnflag == "R").long_count()))
query("SELECT 0.0::DOUBLE AS value", "agg_empty_zero")(lambda c: c.set("LineItem").where(lambda x: x.l_quantity < 0.0).scalar("sum", "l_quantity"))
query("SELECT CAST(sum(DISTINCT p_size) AS DOUBLE) AS value FROM part", "agg_sum_distinct")(lambda c: c.set("Part").distinct().scalar("sum", "p_size"))
query("SELECT avg(v) AS value FROM (SELECT DISTINCT p_size AS v FROM part)", "agg_avg_distinct")(lambda c: c.set("Part").distinct().scalar("avg", "p_size"))

# --- grouping ---

query("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", "group_by")(
    lambda c: c.set("Order").group_by("o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority")
)
query(
    "SELECT o.* FROM orders o JOIN (SELECT min(o_orderkey) AS k FROM orders GROUP BY o_orderstatus) m ON o.o_orderkey = m.k", "group_by_representative"
)(lambda c: c.set("Order").group_by("o_orderstatus"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 8) AS avg_disc,
          min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_by_aggregates(c):
    out = (
        c.set("LineItem").group_by("l_returnflag", "l_linestatus")
        .aggregate(sum_qty=agg("sum", "l_quantity"), avg_disc=agg("avg", "l_discount"), min_tax=agg("min", "l_tax"), max_tax=agg("max", "l_tax"), n=agg("count"))
    )
    return out.to_df().withColumns({"sum_qty": F.round("sum_qty", 2), "avg_disc": F.round("avg_disc", 8)})


for _name, _having, _sql in (
    ("cmp", agg("count", "o_orderkey") > 12, "count(o_orderkey) > 12"),
    ("and", (agg("count") > 8) & (agg("max", "o_totalprice") > 250000.0), "count(*) > 8 AND max(o_totalprice) > 250000"),
    ("or", (agg("count") > 16) | (agg("min", "o_totalprice") < 3000.0), "count(*) > 16 OR min(o_totalprice) < 3000"),
    ("not", ~(agg("avg", "o_totalprice") > 150000.0), "NOT (avg(o_totalprice) > 150000)"),
    ("agg_vs_agg", agg("min", "o_totalprice") < agg("avg", "o_orderkey"), "min(o_totalprice) < avg(o_orderkey)"),
):
    query(f"SELECT o_custkey FROM orders GROUP BY o_custkey HAVING {_sql}", f"having_{_name}")(
        lambda c, h=_having: c.set("Order").group_by("o_custkey").having(h).select("o_custkey")
    )

query(
    """SELECT p_brand, count(DISTINCT p_size) AS n, CAST(sum(DISTINCT p_size) AS BIGINT) AS total, round(avg(DISTINCT p_size), 8) AS mean,
       min(DISTINCT p_size) AS low, max(DISTINCT p_size) AS high FROM part GROUP BY p_brand""", "group_by_distinct_aggregates"
)(
    lambda c: c.set("Part").group_by("p_brand").aggregate(
        n=agg("count", "p_size", True), total=agg("sum", "p_size", True), mean=agg("avg", "p_size", True), low=agg("min", "p_size", True), high=agg("max", "p_size", True)
    ).to_df().withColumn("mean", F.round("mean", 8))
)

# --- windows ---

_OVER = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"
for _f, _column, _sql in (
    ("row_number", None, f"CAST(row_number() OVER ({_OVER}) AS INTEGER)"),
    ("lag", "o_totalprice", f"lag(o_totalprice) OVER ({_OVER})"),
    ("lead", "o_totalprice", f"lead(o_totalprice) OVER ({_OVER})"),
    ("min", "o_totalprice", f"min(o_totalprice) OVER ({_OVER})"),
    ("max", "o_totalprice", f"max(o_totalprice) OVER ({_OVER})"),
    ("count", "o_totalprice", f"count(o_totalprice) OVER ({_OVER})"),
    ("sum", "o_totalprice", f"round(sum(o_totalprice) OVER ({_OVER}), 2)"),
    ("avg", "o_totalprice", f"round(avg(o_totalprice) OVER ({_OVER}) + 0.00001, 4)"),
):
    query(f"SELECT o_orderkey, o_custkey, {_sql} AS w FROM orders", f"win_{_f}")(
        lambda c, f=_f, column=_column: c.set("Order").window("w", f, column, ("o_custkey",), (("o_totalprice", "desc"), "o_orderkey")).select("o_orderkey", "o_custkey")
        .to_df().withColumn("w", F.round(F.col("w") + (0.0 if f == "sum" else 0.00001), 2 if f == "sum" else 4) if f in ("sum", "avg") else F.col("w"))
    )
for _f in ("rank", "dense_rank"):
    query(f"SELECT p_partkey, p_brand, CAST({_f}() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS w FROM part", f"win_{_f}")(
        lambda c, f=_f: c.set("Part").window("w", f, None, ("p_brand",), ("p_size",)).select("p_partkey", "p_brand")
    )
query(
    "SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS total, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INTEGER) AS rn FROM customer", "win_multi"
)(
    lambda c: c.set("Customer").window("total", "sum", "c_acctbal", ("c_nationkey",)).window("rn", "row_number", None, ("c_mktsegment",)).select("c_custkey")
    .to_df().withColumn("total", F.round("total", 2))
)
query(
    "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS w FROM orders WHERE o_orderstatus = 'F'", "win_filtered"
)(lambda c: c.set("Order").where(lambda o: o.o_orderstatus == "F").window("w", "row_number", None, ("o_custkey",)).select("o_orderkey"))

# --- order and paging ---

query("SELECT * FROM customer ORDER BY c_custkey", "order_asc")(lambda c: c.set("Customer").order_by("c_custkey"))
query("SELECT * FROM customer ORDER BY c_custkey DESC", "order_desc")(lambda c: c.set("Customer").order_by_desc("c_custkey"))
query("SELECT * FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey", "order_multi")(
    lambda c: c.set("Customer").order_by("c_mktsegment").order_by_desc("c_acctbal").order_by("c_custkey")
)
query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 7", "take")(lambda c: c.set("Order").order_by("o_orderkey").take(7))
query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 9 OFFSET 21", "skip_take")(lambda c: c.set("Order").order_by("o_orderkey").skip(21).take(9))


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(c):
    return large_recent_orders(c)


def large_recent_orders(c: Context) -> Query:
    return c.set("Order").where(lambda o: (o.o_totalprice > 100000.0) & (o.o_orderstatus == "F")).order_by_desc("o_totalprice").order_by("o_orderkey").take(10)


# --- set operations and named sources ---

for _name, _sql in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    query(f"SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 {_sql} SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000", f"set_{_name}")(
        lambda c, n=_name: c.set("Customer").where(lambda x: x.c_acctbal > 5000.0).select("c_nationkey")._combine(n, c.set("Supplier").where(lambda s: s.s_acctbal > 8000.0).select("s_nationkey"))
    )
query(
    "(SELECT n_nationkey FROM nation UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 ORDER BY 1 LIMIT 5", "set_chain"
)(
    lambda c: c.set("Nation").select("n_nationkey").union(c.set("Supplier").select("s_nationkey"))
    .except_(c.set("Customer").where(lambda x: x.c_acctbal > 9900.0).select("c_nationkey")).order_by("n_nationkey").take(5)
)
query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT * FROM big WHERE o_orderstatus = 'O'", "cte_typed")(
    lambda c: c.set("Order").with_cte_typed("big", "Order", lambda o: o.o_totalprice > 200000.0).from_cte("big").where(lambda o: o.o_orderstatus == "O")
)
query(
    "WITH a AS (SELECT * FROM orders WHERE o_totalprice > 200000), b AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM b WHERE o_totalprice > 100", "cte_multi"
)(
    lambda c: c.set("Order").with_cte_typed("a", "Order", lambda o: o.o_totalprice > 200000.0).with_cte_typed("b", "Order", lambda o: o.o_orderstatus == "F")
    .from_cte("b").where(lambda o: o.o_totalprice > 100.0).select("o_orderkey")
)
query("SELECT o_custkey AS who, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey", "cte_raw")(
    lambda c: c.set("Order").with_cte("t", "SELECT o_custkey, count(*) FROM orders WHERE o_totalprice > ? GROUP BY o_custkey", ("who", "n"), (1000,)).from_cte("t").to_df()
)


@query("""WITH RECURSIVE tree AS (SELECT p_partkey, p_partkey // 2 AS parent, p_name FROM part),
          found AS (SELECT * FROM tree WHERE p_partkey = 3 UNION ALL SELECT t.* FROM tree t JOIN found f ON t.parent = f.p_partkey)
          SELECT p_partkey, parent, p_name FROM found""")
def cte_recursive(c):
    model = warehouse()
    model.entity("Tree", "tree").column("p_partkey", "bigint", key=True).column("parent", "bigint").column("p_name", "string")
    own = Context(c.spark, model, c.store.root)
    own.use_frame("tree", c.storage("part").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("parent"), "p_name"))
    return own.set("Tree").with_recursive("found", "Tree", "parent", "p_partkey", lambda t: t.p_partkey == 3).from_cte("found")


@query("""WITH RECURSIVE step AS (SELECT 1 + max(p_partkey) // 105 AS n FROM part),
          found AS (SELECT p_partkey, 0 AS level FROM part, step WHERE p_partkey < n
                    UNION ALL SELECT p.p_partkey, level + 1 FROM part p, step, found f WHERE p.p_partkey - n = f.p_partkey)
          SELECT p_partkey FROM found""")
def cte_recursive_deep(c):
    """A chain of over 100 levels."""
    step = 1 + c.set("Part").max("p_partkey") // 105
    model = warehouse()
    model.entity("Chain", "chain").column("p_partkey", "bigint", key=True).column("parent", "bigint")
    own = Context(c.spark, model, c.store.root)
    own.use_frame("chain", c.storage("part").select("p_partkey", (F.col("p_partkey") - step).alias("parent")))
    return own.set("Chain").with_recursive("found", "Chain", "parent", "p_partkey", lambda t: t.p_partkey < step).from_cte("found").select("p_partkey")


# --- terminals: each result as one row ---

query("SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 1", "terminal_first")(lambda c: _value(c, k=c.set("Order").order_by("o_orderkey").first()["o_orderkey"]))
query("SELECT max(o_orderkey) AS k FROM orders", "terminal_last")(lambda c: _value(c, k=c.set("Order").last()["o_orderkey"]))
query("SELECT n_name FROM nation WHERE n_nationkey = 7", "terminal_single")(lambda c: _value(c, n_name=c.set("Nation").where(lambda n: n.n_nationkey == 7).single()["n_name"]))
query("SELECT c_name FROM customer WHERE c_custkey = 11", "terminal_find")(lambda c: _value(c, c_name=c.set("Customer").find(11)["c_name"]))
query("SELECT l_quantity FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 1) AND l_linenumber = 1 LIMIT 1", "terminal_find_by_key")(
    lambda c: _value(c, l_quantity=c.set("LineItem").find_by_key({"l_orderkey": c.set("LineItem").where(lambda x: x.l_linenumber == 1).min("l_orderkey"), "l_linenumber": 1})["l_quantity"])
)
query("SELECT count(*) > 0 AS v FROM customer WHERE c_acctbal < 0", "terminal_any")(lambda c: _value(c, v=c.set("Customer").where(lambda x: x.c_acctbal < 0.0).any()))
query("SELECT count(*) = 0 AS v FROM part WHERE NOT (p_size >= 1)", "terminal_all")(lambda c: _value(c, v=c.set("Part").all(lambda p: p.p_size >= 1)))
query("SELECT count(*) > 0 AS v FROM part WHERE p_partkey = 5", "terminal_contains")(lambda c: _value(c, v=c.set("Part").contains(5)))
query("SELECT count(*) > 0 AS v FROM part WHERE p_partkey = -5", "terminal_exists_by_id")(lambda c: _value(c, v=c.set("Part").exists_by_id(-5)))
query("SELECT count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 12)", "terminal_count")(lambda c: _value(c, n=c.set("Order").order_by("o_orderkey").take(12).count()))
query("SELECT n_name AS k, n_regionkey AS v FROM nation WHERE n_regionkey < 2", "terminal_to_dictionary")(
    lambda c: c.spark.createDataFrame(
        [(k, r["n_regionkey"]) for k, r in c.set("Nation").where(lambda n: n.n_regionkey < 2).to_dictionary(lambda r: r["n_name"]).items()], "k string, v int")
)

query("SELECT c_name FROM customer WHERE c_custkey = 11 UNION ALL SELECT 'none'", "terminal_first_or_default")(
    lambda c: c.spark.createDataFrame([(r["c_name"] if r else "none",) for k in (11, -1) for r in [c.set("Customer").where(lambda x: x.c_custkey == k).first_or_default()]], "c_name string")
)
query("SELECT count(*) > 0 AS v FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber = 1", "terminal_exists_by_key_map")(
    lambda c: _value(c, v=c.set("LineItem").exists_by_key({"l_orderkey": c.set("LineItem").min("l_orderkey"), "l_linenumber": 1}))
)
query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "terminal_to_list_with_includes")(
    lambda c: c.spark.createDataFrame([(r["n_name"], r["region"]["r_name"]) for r in c.set("Nation").include("region").to_list()], "n_name string, r_name string")
)
query("SELECT count(*) AS n FROM nation", "terminal_load_all")(lambda c: _value(c, n=len(c.unit.load_all("Nation"))))
query("SELECT true AS filtered, 3 AS taken, 1 AS orderings, true AS has_predicate", "query_state")(
    lambda c: (lambda q: c.spark.createDataFrame([(q.filtered, q.taken, len(q.orderings), not q.predicate.is_always)], "filtered boolean, taken int, orderings int, has_predicate boolean"))(
        c.set("Nation").where(lambda n: n.n_nationkey > 3).order_by("n_name").take(3))
)
query("SELECT true AS names_table, true AS has_limit", "query_to_sql")(
    lambda c: (lambda t: _value(c, names_table="n_regionkey" in t, has_limit="Limit" in t))(c.set("Nation").order_by("n_name").take(3).to_sql())
)
query("SELECT p_partkey FROM part WHERE p_size * 2 > 60 AND upper(p_name) LIKE '%RING%'", "filter_raw_fragment")(
    lambda c: c.set("Part").where(raw(F.expr("p_size * 2 > 60 AND upper(p_name) LIKE '%RING%'"))).select("p_partkey")
)
query("SELECT p_partkey FROM part WHERE p_size > 25", "filter_bare_boolean")(lambda c: _flagged(c).set("Flagged").where(lambda f: f.big.is_true()).select("p_partkey"))
query("SELECT p_partkey FROM part WHERE NOT (p_size > 25)", "filter_bare_boolean_not")(lambda c: _flagged(c).set("Flagged").where(lambda f: ~f.big.is_true()).select("p_partkey"))


def _flagged(c: Context) -> Context:
    model = warehouse()
    model.entity("Flagged", "flagged").column("p_partkey", "bigint", key=True).column("big", "boolean")
    return Context(c.spark, model, c.store.root).use_frame("flagged", c.storage("part").selectExpr("p_partkey", "p_size > 25 AS big"))


# --- includes ---

query(
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0", "include_has_many"
)(
    lambda c: c.set("Customer").where(lambda x: x.c_acctbal > 0.0).include("orders").to_df()
    .select("c_custkey", F.explode_outer("orders").alias("o")).select("c_custkey", "o.o_orderkey", "o.o_totalprice")
)
query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", "include_belongs_to")(
    lambda c: c.set("Nation").include("region").to_df().select("n_nationkey", "region.r_name")
)
query("SELECT s_suppkey, count(p_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey", "include_many_to_many")(
    lambda c: c.set("Supplier").include("parts").to_df().select("s_suppkey", F.size("parts").cast("bigint").alias("n"))
)
query(
    """SELECT r_regionkey, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers
       FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey""", "include_nested"
)(
    lambda c: c.set("Region").include("nations", "customers").to_df().select(
        "r_regionkey", F.size("nations").cast("bigint").alias("nations"),
        F.aggregate("nations", F.lit(0), lambda a, n: a + F.size(n["customers"])).cast("bigint").alias("customers"))
)
query(
    """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
       (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""", "include_two"
)(
    lambda c: c.set("Nation").include("customers").include("suppliers").to_df()
    .select("n_nationkey", F.size("customers").cast("bigint").alias("customers"), F.size("suppliers").cast("bigint").alias("suppliers"))
)



@query("SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def include_has_one(c):
    model = warehouse()
    model.get("Customer").has_one("first", "Order", "o_custkey")
    return Context(c.spark, model, c.store.root).set("Customer").include("first").to_df().select("c_custkey", F.col("first.o_orderkey").alias("first_order"))


query("SELECT n_nationkey, r_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey", "include_by_names")(
    lambda c: functools.reduce(lambda q, n: q.include(n), ["region", "suppliers"], c.set("Nation")).to_df().select("n_nationkey", "region.r_name", F.size("suppliers").cast("bigint").alias("suppliers"))
)
query(
    """SELECT (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7) AS one,
       (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS many,
       (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 1) AS across""", "lazy_loads"
)(
    lambda c: _value(c, one=load(c, "Nation", c.set("Nation").find(7), "region")["r_name"], many=len(load(c, "Nation", c.set("Nation").find(7), "customers")),
                     across=len(load(c, "Supplier", c.set("Supplier").find(1), "parts")))
)

# --- global filters ---


def _filtered(c: Context, **options) -> Context:
    model = warehouse()
    model.get("Order").has_query_filter(lambda o: o.o_orderstatus == "O")
    return Context(c.spark, model, c.store.root, **options)


query("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000", "global_filter")(lambda c: _filtered(c).set("Order").where(lambda o: o.o_totalprice > 100000.0))
query("SELECT * FROM orders WHERE o_totalprice > 100000", "ignore_filters")(lambda c: _filtered(c).set_ignoring_filters("Order").where(lambda o: o.o_totalprice > 100000.0))
query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey", "global_filter_include")(
    lambda c: _filtered(c).set("Customer").include("orders").to_df().select("c_custkey", F.size("orders").cast("bigint").alias("n"))
)
query("SELECT c.*, o.* FROM customer c JOIN orders o ON c_custkey = o_custkey WHERE o_orderstatus = 'O'", "global_filter_joined")(
    lambda c: _filtered(c, filter_joined=True).set("Customer").inner_join("Order", "c_custkey", "o_custkey")
)

# --- changes: the table as it would be ---

query(
    "SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN '9-LATER' ELSE o_orderpriority END AS o_orderpriority) FROM orders", "bulk_update"
)(lambda c: c.set("Order").where(lambda o: (o.o_orderstatus == "P") & (o.o_totalprice < 100000.0)).execute_update().set_column("o_orderpriority", "9-LATER").frame())
query(
    "SELECT * REPLACE (CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment) FROM customer", "bulk_update_exists"
)(lambda c: c.set("Customer").where(lambda x: x.orders.any(lambda o: o.o_totalprice > 300000.0)).execute_update().set_column("c_mktsegment", "VIP").frame())


@query("SELECT * FROM orders WHERE NOT coalesce(o_totalprice < 50000, false)")
def bulk_delete(c):
    from ..operators.mutation import delete_frame

    return delete_frame(c.set("Order").where(lambda o: o.o_totalprice < 50000.0))


@query("""SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey > 3
          UNION ALL SELECT s_suppkey, 'new', s_nationkey, 0.0 FROM supplier WHERE s_suppkey <= 3
          UNION ALL SELECT s_suppkey + 1000000, 'added', s_nationkey, 1.5 FROM supplier WHERE s_suppkey <= 2""")
def upsert(c):
    now = c.set("Supplier").to_df()
    changed = now.where("s_suppkey <= 3").withColumns({"s_name": F.lit("new"), "s_acctbal": F.lit(0.0)})
    added = now.where("s_suppkey <= 2").withColumns({"s_suppkey": F.col("s_suppkey") + 1000000, "s_name": F.lit("added"), "s_acctbal": F.lit(1.5)})
    return upsert_frame(c, c.model.get("Supplier"), changed.unionByName(added))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN NULL ELSE s_name END AS s_name, s_nationkey,
          CASE WHEN s_suppkey IN (1, 2) THEN 7.0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def delta_update(c):
    entity = c.model.get("Supplier")
    delta = c.spark.createDataFrame([(1, None, 7.0, ["s_name", "s_acctbal"]), (2, None, 7.0, ["s_acctbal"])], "s_suppkey long, s_name string, s_acctbal double, __dirty array<string>")
    return delta_frame(entity, c.read(entity), delta)


def _without_order(c: Context, rule: OnDelete, table: str) -> DataFrame:
    model = warehouse()
    model.get("Order").has_many("lines", "LineItem", "l_orderkey", on_delete=rule)
    own = Context(c.spark, model, c.store.root)
    keys = own.set("Order").where(lambda o: o.o_orderkey < 50).select("o_orderkey").to_df()
    tables: dict[str, DataFrame] = {}
    cascade_delete(own, model.get("Order"), keys, tables)
    return tables[table]


query("SELECT * FROM lineitem WHERE NOT (l_orderkey < 50)", "cascade_delete")(lambda c: _without_order(c, OnDelete.CASCADE, "LineItem"))
query("SELECT * REPLACE (CASE WHEN l_orderkey < 50 THEN NULL ELSE l_orderkey END AS l_orderkey) FROM lineitem", "cascade_set_null")(
    lambda c: _without_order(c, OnDelete.SET_NULL, "LineItem")
)

# --- checks ---

query(
    """SELECT l_orderkey, l_linenumber, 'quantity' AS "check" FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45)
       UNION ALL SELECT l_orderkey, l_linenumber, 'discount' FROM lineitem WHERE NOT (l_discount >= 0 AND l_discount < 0.09)""", "check_violations"
)(lambda c: checks.violations(c.model.get("LineItem"), c.set("LineItem").to_df()).select("l_orderkey", "l_linenumber", "check"))
query("SELECT CAST(0 AS BIGINT) AS n", "foreign_key_orphans")(lambda c: checks.orphans(c, c.model.get("Order")).agg(F.count("*").alias("n")))
