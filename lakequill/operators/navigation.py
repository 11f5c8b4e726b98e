"""Eager loading: related rows as nested columns, one join per navigation whatever the number of parents.

Each to-many side is aggregated by its foreign key before it is joined, so two of them on one parent do not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.predicates import fresh_alias
from ..model import Entity, Kind, Navigation
from ..sources.context import Context


def _tree(paths: tuple[tuple[str, ...], ...]) -> dict:
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path:
            at = at.setdefault(step, {})
    return tree


def nest(context: Context, entity: Entity, df: DataFrame, paths: tuple[tuple[str, ...], ...], filtered: bool = True, narrow: bool = False) -> DataFrame:
    """``df`` with a column for each first step of ``paths``: a struct, or an array of structs ordered by key.

    Parents without related rows get null or an empty array. ``filtered`` applies the global filters of related
    entities. ``narrow`` reduces related rows to those of the given parents before they are grouped: worth a join when the
    parents are a part of their table.
    """
    for name, below in _tree(paths).items():
        df = _attach(context, entity, df, entity.navigation(name), below, filtered, narrow)
    return df


def _key(entity: Entity) -> str:
    if len(entity.key) != 1:
        raise InvalidQuery(f"navigations need one key column on {entity.name}")
    return entity.key[0]


def _attach(context: Context, entity: Entity, df: DataFrame, nav: Navigation, below: dict, filtered: bool, narrow: bool) -> DataFrame:
    other = context.model.get(nav.target)
    related = context.read(other, filtered)
    own = nav.fk if nav.kind is Kind.BELONGS_TO else _key(entity)
    join_key = fresh_alias("k")
    parents = df.select(F.col(f"`{own}`").alias(join_key)).distinct() if narrow else None
    if nav.kind is Kind.MANY_TO_MANY:
        rows, first, second = context.join_rows(nav)
        pairs = rows.select(F.col(f"`{first}`").alias(join_key), F.col(f"`{second}`").alias("__to")).where(f"{join_key} is not null")
        if parents is not None:
            pairs = pairs.join(parents, join_key, "left_semi")
        related = _below(context, other, related, below, filtered, narrow)
        related = pairs.join(related.withColumn("__to", F.col(f"`{_key(other)}`")), "__to").drop("__to")
    else:
        at = _key(other) if nav.kind is Kind.BELONGS_TO else nav.fk
        related = related.withColumn(join_key, F.col(f"`{at}`")).where(F.col(join_key).isNotNull())
        if parents is not None:
            related = related.join(parents, join_key, "left_semi")
        related = _below(context, other, related, below, filtered, narrow)
    columns = [c for c in related.columns if c != join_key]
    item = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("item")
    if nav.kind is Kind.BELONGS_TO:
        side = related.select(join_key, item.alias(nav.name))
    elif nav.kind is Kind.HAS_ONE:
        order = F.col(f"`{other.key[0]}`") if other.key else item
        side = related.groupBy(join_key).agg(F.min_by(item, order).alias(nav.name))
    else:
        order = F.struct(*(F.col(f"`{k}`") for k in other.key), item) if other.key else F.struct(item)
        ordered = F.array_sort(F.collect_list(order)) if _sortable(related, columns) else F.collect_list(order)
        side = related.groupBy(join_key).agg(F.transform(ordered, lambda x: x["item"]).alias(nav.name))
    out = df.join(side, F.col(f"`{own}`") == F.col(join_key), "left").drop(join_key)
    if nav.kind in (Kind.HAS_MANY, Kind.MANY_TO_MANY):
        out = out.withColumn(nav.name, F.coalesce(nav.name, F.array().cast(out.schema[nav.name].dataType)))
    return out


def _sortable(df: DataFrame, columns: list[str]) -> bool:
    return not any("map<" in t for c, t in df.dtypes if c in columns)


def _below(context: Context, entity: Entity, related: DataFrame, below: dict, filtered: bool, narrow: bool) -> DataFrame:
    for name, more in below.items():
        related = _attach(context, entity, related, entity.navigation(name), more, filtered, narrow)
    return related


def load(context: Context, entity_name: str, row: Row, navigation: str, depth: int = 0) -> list[Row] | Row | None:
    """Related rows of one row, by a query of its own. For lists of rows use include: it takes one join for all."""
    if depth > 16:
        raise InvalidQuery("lazy loading goes 16 levels deep at most")
    entity = context.model.get(entity_name)
    nav = entity.navigation(navigation)
    query = context.set(nav.target)
    if nav.kind is Kind.BELONGS_TO:
        return query.find(row[nav.fk])
    own = row[_key(entity)]
    if nav.kind is Kind.MANY_TO_MANY:
        rows, first, second = context.join_rows(nav)
        wanted = rows.where(F.col(f"`{first}`") == F.lit(own)).select(F.col(f"`{second}`").alias(_key(query.entity)))
        return query.rows.join(wanted, _key(query.entity)).collect()
    found = query.where(lambda c: c[nav.fk] == own).order_by(*query.entity.key)
    return found.first_or_default() if nav.kind is Kind.HAS_ONE else found.to_list()
