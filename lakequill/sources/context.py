"""Context: a session's model, tables and global filters; the entry point for queries and changes."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, UnknownEntity
from ..functions.predicates import Columns, frame_condition
from ..model import Entity, Model, Navigation
from .store import TableStore

if TYPE_CHECKING:
    from ..operators.query import Query
    from ..operators.tracking import UnitOfWork


class Context:
    """Reads tables of ``root`` (a store or a folder of ``<table>.parquet``), given frames, or the session catalog.

    ``filter_joined`` extends global filters to join sides, subqueries and named sources; by default they
    apply to the root of a query, its includes and bulk changes.
    """

    def __init__(self, spark: SparkSession, model: Model, root: str | None = None, *, filter_joined: bool = False, slow_query_s: float | None = None):
        self.spark, self.model, self.filter_joined, self.slow_query_s = spark, model, filter_joined, slow_query_s
        self.store = TableStore(spark, root) if root else None
        self.frames: dict[str, DataFrame] = {}
        self.interceptors: list = []
        self.slow_queries: list[tuple[str, float]] = []
        self._unit: UnitOfWork | None = None

    # --- sources ---

    def use_frame(self, table: str, df: DataFrame) -> Context:
        """Serve a table from a DataFrame."""
        self.frames[table] = df
        return self

    def storage(self, table: str) -> DataFrame:
        if table in self.frames:
            return self.frames[table]
        if self.store and (path := self.store.current(table)):
            return self.spark.read.parquet(path)
        if self.spark.catalog.tableExists(table):
            return self.spark.table(table)
        raise UnknownEntity(f"no table {table!r}")

    def read(self, entity: Entity, filtered: bool = True) -> DataFrame:
        """Rows of an entity under its column names, computed columns added, the global filter applied if ``filtered``."""
        table = f"{entity.schema_name}.{entity.table}" if entity.schema_name else entity.table
        rows = self.storage(table)
        wanted = [F.col(f"`{c.stored}`").alias(c.name) for c in entity.stored_columns()] if entity.columns else ["*"]
        computed = {c.name: F.expr(c.computed) for c in entity.columns.values() if c.computed and not c.ignored}
        rows = rows.select(*wanted)
        if computed:
            rows = rows.withColumns(computed)
        return self.filtered(entity, rows) if filtered else rows

    def filtered(self, entity: Entity, rows: DataFrame) -> DataFrame:
        if entity.query_filter is None:
            return rows
        return frame_condition(rows, self, entity, entity.query_filter(Columns(entity)))

    def join_rows(self, nav: Navigation) -> tuple[DataFrame, str, str]:
        """Rows that join a many-to-many navigation, and their columns for this and the other side."""
        if nav.through in self.model.entities:
            return self.read(self.model.get(nav.through), self.filter_joined), nav.fk, nav.other_fk
        return self.storage(nav.through), nav.fk, nav.other_fk

    # --- queries ---

    def set(self, name: str) -> Query:
        from ..operators.query import Query

        entity = self.model.get(name)
        return Query(self, entity, self.read(entity), filtered=True)

    def set_ignoring_filters(self, name: str) -> Query:
        from ..operators.query import Query

        entity = self.model.get(name)
        return Query(self, entity, self.read(entity, False), filtered=False)

    def columns(self, name: str) -> Columns:
        return Columns(self.model.get(name))

    def sql(self, text: str, *args: object, entity: str | None = None) -> Query | DataFrame:
        """Raw SQL with ``?`` placeholders over the registered tables, as rows or as an entity's rows."""
        self.register_views()
        rows = self.spark.sql(text, args=list(args)) if args else self.spark.sql(text)
        if entity is None:
            return rows
        from ..operators.query import Query

        found = self.model.get(entity)
        return Query(self, found, rows.select(*(F.col(f"`{c}`") for c in found.columns if not found.get(c).ignored)))

    def register_views(self) -> None:
        for entity in self.model.entities.values():
            try:
                self.storage(entity.table).createOrReplaceTempView(entity.table)
            except UnknownEntity:
                continue

    def timed(self, what: str, run: Callable):
        """Run an action; those over the threshold are noted with their time."""
        began = time.monotonic()
        try:
            return run()
        finally:
            took = time.monotonic() - began
            if self.slow_query_s is not None and took > self.slow_query_s:
                self.slow_queries.append((what, took))

    # --- changes ---

    @property
    def unit(self) -> UnitOfWork:
        """The pending changes of this context."""
        if self._unit is None:
            from ..operators.tracking import UnitOfWork

            self._unit = UnitOfWork(self)
        return self._unit

    def replace_tables(self, tables: dict[str, DataFrame]) -> None:
        """New rows (under stored names) for several tables, all or none."""
        plain = {t: df for t, df in tables.items() if t in self.frames or self.store is None}
        stored = {t: df for t, df in tables.items() if t not in plain}
        if stored:
            self.store.commit({t: self.store.stage(t, df) for t, df in stored.items()})
        for table, df in plain.items():
            self.frames[table] = df

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` without its lineage: a checkpoint in the folder that ``spark.checkpoint.dir`` names."""
        context = self.spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            shared = self.spark.conf.get("spark.checkpoint.dir", None)
            if not shared and not (context.master or "").startswith("local"):
                raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lakequill-"))
        return df.checkpoint()

    def execute(self, text: str, *args: object) -> int:
        """Run one raw SQL statement; the rows it changed if it says so, else the rows it returned."""
        rows = self.sql(text, *args)
        if rows.columns == ["num_affected_rows"]:
            return rows.first()[0]
        return rows.count() if rows.columns else 0

    def to_storage(self, entity: Entity, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f"`{c.name}`").cast(c.type).alias(c.stored) for c in entity.stored_columns()))


class Registry:
    """Contexts by key, made on demand by factories; a factory without a key serves any key."""

    def __init__(self) -> None:
        self._factories: dict[str | None, Callable[[str | None], Context]] = {}
        self._made: dict[str | None, Context] = {}

    def add(self, factory: Callable[[str | None], Context], key: str | None = None) -> Registry:
        self._factories[key] = factory
        return self

    def get(self, key: str | None = None) -> Context:
        if key not in self._made:
            factory = self._factories.get(key) or self._factories.get(None)
            if factory is None:
                raise ConfigurationError(f"no context {key!r}")
            self._made[key] = factory(key)
        return self._made[key]
