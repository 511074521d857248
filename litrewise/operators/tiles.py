"""Heat layers for every zoom level from one rollup. Nothing here starts a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.functions.tiles import check_zoom, tile_key

ZOOM = 12


def heat_tiles(df: DataFrame, metric: str = "price_index", *, zoom: int = ZOOM, floor: float = 90.0) -> DataFrame:
    """Per fuel, zoom level from 0 to `zoom` and tile: rows, sum and mean of `metric`, and the
    heat weight (the mean's excess over `floor`, null below).

    Observations are summed once, for the deepest tiles; all other levels are rolled up from
    those sums, where a tile's ancestors are its key without the last bits. Rows off the map or
    without `metric` are left out. Partial sums are formed before both shuffles, so that one
    busy tile is never one task's rows.
    """
    check_zoom(zoom)
    placed = df.select("name", F.col(metric).alias("_value"), tile_key(F.col("lat"), F.col("long"), zoom).alias("tile"))
    placed = placed.filter(F.col("tile").isNotNull() & F.col("_value").isNotNull())
    deepest = placed.groupBy("name", "tile").agg(F.count("_value").alias("n_rows"), F.sum("_value").alias("total"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("zoom")
    lifted = deepest.select("name", levels, "tile", "n_rows", "total")
    # Multiplication by a power of two: shifts by a column need another one's type.
    ancestor = F.floor(F.col("tile") / F.pow(F.lit(4.0), F.lit(zoom) - F.col("zoom"))).cast("long")
    rolled = lifted.groupBy("name", "zoom", ancestor.alias("tile")).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"))
    mean = F.col("total") / F.col("n_rows")
    weight = F.when(mean > floor, mean - F.lit(floor))
    return rolled.withColumns({"avg_index": mean, "weight": weight})
