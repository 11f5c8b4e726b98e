"""Model of the star-schema tables that the query catalogue runs on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import checks
from ..model import Model
from ..sources.context import Context


def warehouse() -> Model:
    m = Model()
    m.entity("Region", "region").column("r_regionkey", "int", key=True).column("r_name", "string").has_many("nations", "Nation", "n_regionkey")
    (
        m.entity("Nation", "nation").column("n_nationkey", "int", key=True).column("n_name", "string").column("n_regionkey", "int")
        .belongs_to("region", "Region", "n_regionkey").has_many("customers", "Customer", "c_nationkey").has_many("suppliers", "Supplier", "s_nationkey")
    )
    (
        m.entity("Customer", "customer").column("c_custkey", "bigint", key=True).column("c_name", "string").column("c_nationkey", "int")
        .column("c_acctbal", "double").column("c_mktsegment", "string")
        .belongs_to("nation", "Nation", "c_nationkey").has_many("orders", "Order", "o_custkey")
    )
    (
        m.entity("Supplier", "supplier").column("s_suppkey", "bigint", key=True).column("s_name", "string").column("s_nationkey", "int").column("s_acctbal", "double")
        .belongs_to("nation", "Nation", "s_nationkey").many_to_many("parts", "Part", "lineitem", "l_suppkey", "l_partkey")
    )
    (
        m.entity("Part", "part").column("p_partkey", "bigint", key=True).column("p_name", "string").column("p_brand", "string").column("p_type", "string")
        .column("p_size", "int").column("p_retailprice", "double").has_many("lines", "LineItem", "l_partkey")
        .many_to_many("suppliers", "Supplier", "lineitem", "l_partkey", "l_suppkey")
    )
    (
        m.entity("Order", "orders").column("o_orderkey", "bigint", key=True).column("o_custkey", "bigint").column("o_orderstatus", "string")
        .column("o_totalprice", "double").column("o_orderdate", "timestamp_ntz").column("o_orderpriority", "string")
        .belongs_to("customer", "Customer", "o_custkey").has_many("lines", "LineItem", "l_orderkey")
    )
    (
        m.entity("LineItem", "lineitem").column("l_orderkey", "bigint", key=True).column("l_partkey", "bigint").column("l_suppkey", "bigint")
        .column("l_linenumber", "int", key=True).column("l_quantity", "double").column("l_extendedprice", "double").column("l_discount", "double")
        .column("l_tax", "double").column("l_returnflag", "string").column("l_linestatus", "string").column("l_shipdate", "timestamp_ntz")
        .belongs_to("order", "Order", "l_orderkey").belongs_to("part", "Part", "l_partkey").belongs_to("supplier", "Supplier", "l_suppkey")
        .has_check("quantity", checks.between("l_quantity", 1, 45)).has_check("discount", checks.all_of(checks.non_negative("l_discount"), "l_discount < 0.09"))
    )
    (
        m.entity("Event", "events").column("event_id", "bigint", key=True).column("ts", "timestamp_ntz").column("user_id", "bigint")
        .column("event_type", "string").column("value", "double").column("props", "string")
    )
    return m


def open_warehouse(spark: SparkSession, sf_dir: str, **options) -> Context:
    return Context(spark, warehouse(), sf_dir, **options)
