"""Shelf sources: JSON shelf lists and the default grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's default grid: shelf k (from 1) sits at
# x = (k mod 5) * 90 + 10, y = floor(k / 5) * 40 + 10, named "Raf k".
GRID_COLUMNS = 5
GRID_DX, GRID_DY, GRID_MARGIN = 90, 40, 10
SHELF_NAME_PREFIX = "Raf "

SHELF_SCHEMA = "array<struct<name:string,x:double,y:double>>"


def grid_position(k: Column) -> tuple[Column, Column]:
    x = (k % GRID_COLUMNS) * GRID_DX + GRID_MARGIN
    y = F.floor(k / GRID_COLUMNS) * GRID_DY + GRID_MARGIN
    return x.cast("double"), y.cast("double")


def shelf_grid(keys: DataFrame, k_col: str, by: list[str] | None = None) -> DataFrame:
    """One shelf per key ``k`` (1-based): ``pos, name, x, y`` (+ ``by``).

    ``pos`` (input order) is ``k - 1``.
    """
    by = by or []
    k = F.col(k_col).cast("long")
    x, y = grid_position(k)
    return keys.select(*by, (k - 1).alias("pos"),
                       F.concat(F.lit(SHELF_NAME_PREFIX), k.cast("string")).alias("name"),
                       x.alias("x"), y.alias("y"))


def shelves_from_json(df: DataFrame, json_col: str, by: list[str] | None = None) -> DataFrame:
    """A JSON array of ``{name, x, y}`` per row -> ``pos, name, x, y`` (+ ``by``).

    A row whose JSON is not a non-empty list fails the query, as in the reference.
    """
    by = by or []
    parsed = F.from_json(F.col(json_col), SHELF_SCHEMA)
    shelves = F.when(F.coalesce(F.size(parsed), F.lit(-1)) > 0, parsed).otherwise(
        F.raise_error(F.lit("a shelf list must be a non-empty JSON array")).cast(SHELF_SCHEMA))
    return (df.select(*by, shelves.alias("_s"))
            .select(*by, F.posexplode("_s").alias("pos", "_e"))
            .select(*by, "pos", "_e.name", "_e.x", "_e.y"))


def require_shelves(shelves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Guards: at least one shelf, names unique within a store."""
    by = by or []
    if shelves.limit(1).count() == 0:
        raise ValueError("shelf list is empty")
    dup = shelves.groupBy(*by, "name").count().where("count > 1").limit(1).count()
    if dup:
        raise ValueError("shelf names must be unique")
    return shelves
