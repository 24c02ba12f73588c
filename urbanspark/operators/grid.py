"""The analysis grid: origin-anchored square cells, identity, quality and determinism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import cover, spatial


def grid_version(size: int) -> str:
    return f"grid-{size}m"


def cell_id(version: Column | str, i: Column, j: Column) -> Column:
    return F.concat_ws(":", F.lit(version) if isinstance(version, str) else version, i, j)


def cell_size_of(version: Column) -> Column:
    return F.regexp_extract(version, r"^grid-(\d+)m$", 1).cast("int")


def square_grid(districts: DataFrame, size: int) -> DataFrame:
    """Cells whose centre some district covers, each with its district (lowest order, then id).

    Columns: cell_id, grid_version, grid_i, grid_j, cell_size_m, x, y, district_id. Indices
    count from the plane's origin, so a cell has the same identity in every run.
    """
    g = F.col("geom")
    low = lambda k: F.floor(g[k] / size)
    columns = districts.select(F.explode(F.sequence(low("xmin"), low("xmax"))).alias("i"), low("ymin").alias("j0"), low("ymax").alias("j1")).groupBy("i").agg(F.collect_set(F.struct("j0", "j1")).alias("spans"))
    # one column of cells is a row here: dealing the columns deals the grid
    spans = columns.repartition("i").select("i", F.explode("spans").alias("s")).select("i", F.explode(F.sequence("s.j0", "s.j1")).alias("j")).distinct()
    centres = spans.select("i", "j", F.struct("i", "j").alias("at"), ((F.col("i") + 0.5) * size).alias("x"), ((F.col("j") + 0.5) * size).alias("y"))
    owned = spatial.assign_polygon(centres, districts, "at").select("at.i", "at.j", "district_id")
    version = grid_version(size)
    return owned.select(
        cell_id(version, F.col("i"), F.col("j")).alias("cell_id"),
        F.lit(version).alias("grid_version"),
        F.col("i").cast("int").alias("grid_i"),
        F.col("j").cast("int").alias("grid_j"),
        F.lit(size).alias("cell_size_m"),
        ((F.col("i") + 0.5) * size).alias("x"),
        ((F.col("j") + 0.5) * size).alias("y"),
        "district_id",
    )


def cell_geometry() -> Column:
    half = F.col("cell_size_m") / 2
    return G.rectangle(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)


def grid_quality(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: counts, districts, invalid geometries, wrong areas, duplicates and bounds."""
    g = F.col("__g")
    area = F.col("cell_size_m") * F.col("cell_size_m")
    return cells.withColumn("__g", cell_geometry()).agg(
        F.count("*").alias("cells"),
        F.count_distinct("district_id").alias("districts"),
        F.count_if(~G.st_is_valid(g)).alias("invalid"),
        F.count_if(F.abs(G.st_area(g) - area) > tolerance).alias("wrong_area"),
        (F.count("*") - F.count_distinct("grid_i", "grid_j")).alias("duplicates"),
        *G.extent(g),
    )


def grid_diff(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(state, n): created, unchanged, missing or mismatched cells; a grid with mismatches is refused."""
    e = expected.select("cell_id", F.struct("district_id", "x", "y").alias("e"))
    s = stored.select("cell_id", F.struct("district_id", "x", "y").alias("s"))
    state = F.when(F.col("s").isNull(), "created").when(F.col("e").isNull(), "missing").when(F.col("e").eqNullSafe(F.col("s")), "unchanged").otherwise("mismatched")
    return e.join(s, "cell_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def grid_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("grid_version", "district_id").agg(F.count("*").alias("cells"), F.min("x").alias("xmin"), F.max("x").alias("xmax"))


def assign_districts(points: DataFrame, districts: DataFrame, point_id: str) -> DataFrame:
    return spatial.assign_polygon(points, districts, point_id)


def covered_by_any(points: DataFrame, districts: DataFrame) -> DataFrame:
    """Points inside the union of the districts."""
    return cover.semi(points, cover.covering(districts.select("geom"), []))
