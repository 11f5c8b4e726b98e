"""The query language over streams: predicates and projections are plain columns, so they stand in streaming plans too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..functions.predicates import Columns, Predicate, frame_condition
from ..model import Entity
from ..sources.context import Context


def read_stream(context: Context, entity: Entity, path: str, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream of an entity's rows, its global filter applied."""
    reader = context.spark.readStream.schema(entity.schema())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path).select(*(F.col(f"`{c.stored}`").alias(c.name) for c in entity.stored_columns()))
    return context.filtered(entity, rows)


def where(context: Context, entity: Entity, rows: DataFrame, condition: Callable[[Columns], Predicate]) -> DataFrame:
    predicate = condition(Columns(entity))
    if not predicate.plain:
        raise Unsupported("subqueries over streams are not supported")
    return frame_condition(rows, context, entity, predicate)


def windowed(rows: DataFrame, time: str, length: str, late: str, by: list[str], slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates by time window; rows later than ``late`` behind the newest are dropped and their windows closed."""
    stamp = F.col(f"`{time}`").cast("timestamp")
    framed = rows.withColumn(time, stamp).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = framed.groupBy(window.alias("w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def upsert_each_batch(context: Context, entity: Entity, latest_by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is upserted by key. A batch that is run again changes nothing more.

    Of rows of one key in a batch the one with the greatest ``latest_by`` is written, of equals the greatest in all columns;
    without ``latest_by`` such rows raise, as in any upsert.
    """
    from ..operators.mutation import upsert_frame

    def write(batch: DataFrame, epoch: int) -> None:
        latest = batch
        if latest_by is not None:
            newest = F.max(F.struct(F.col(f"`{latest_by}`").alias("by"), F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("row")))
            latest = batch.groupBy(*entity.key).agg(newest.alias("__newest")).select("__newest.row.*")
        context.replace_tables({entity.table: context.to_storage(entity, upsert_frame(context, entity, latest))})

    return write
