"""Nearest grid node, terrain joins, crops and raster comparisons on long tables.

A grid is a table with one row per cell; ``y`` and ``x`` are columns. Distances are only
ever computed against the *static* grid; weather then follows by an equi-join on (y, x).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tinderframe.functions.physics import EARTH_RADIUS_KM, great_circle_km
from tinderframe.operators.clean import within_bbox
from tinderframe.session import cut_lineage

_FAN = 4  # a cell splits into 4 x 4 smaller ones
_MAX_DEPTH = 12
_BROADCAST_CELLS = 100_000  # counted beforehand; about 10 MB of cell rows


def _cell(x: Column, origin: float, side: float, depth: int) -> Column:
    """Index of the cell of ``x`` along one axis at ``depth``."""
    parts = _FAN**depth
    return F.least(F.floor((x - origin) / side * parts), F.lit(parts - 1)).cast("long")


def _gap_km(lat: Column, lon: Column, box: str) -> Column:
    """A lower bound of the distance from a point to anything in a lat/lon box.

    Distance is at least the gap in latitude, and at least the distance to the nearer
    meridian; the box is also tried one turn to either side.
    """
    b = F.col(box)
    dlat = F.greatest(b["lat0"] - lat, lat - b["lat1"], F.lit(0.0))
    turns = [F.greatest(b["lon0"] - lon + k, lon - k - b["lon1"], F.lit(0.0)) for k in (-360.0, 0.0, 360.0)]
    dlon = F.least(*turns, F.lit(90.0))
    to_meridian = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(dlon)))
    return EARTH_RADIUS_KM * F.greatest(F.radians(dlat), to_meridian)


def nearest_join(
    points: DataFrame,
    grid: DataFrame,
    point_key: str = "stid",
    lat: str = "lat",
    lon: str = "lon",
    node: Sequence[str] = ("y", "x"),
    leaf: int = 32,
    digits: int = 6,
) -> DataFrame:
    """Nearest grid node of every point by great-circle distance, ties by node key. Exact.

    The static grid is reduced to distinct locations and stored once for all levels below.

    The grid is divided into cells, each into 4 x 4 smaller ones, down to a depth where
    none holds more than ``leaf`` distinct locations. A point walks down from the whole
    grid: a cell stays a candidate only if its nearest edge is not farther than the closest
    known node. So a point meets a handful of cells per level and finally the nodes of a
    few small cells, however unevenly nodes or points are spread: never all pairs of a
    crowded area. Cells join on their parent's index; they are broadcast while their counted
    number is small, and shuffled (with AQE splitting crowded cells) beyond.
    """
    node = list(node)
    # equal locations tie, so only the smallest node key of each can win
    nodes = cut_lineage(grid.groupBy(lat, lon).agg(F.min(F.struct(*node)).alias("_node")))
    lat0, lat1, lon0, lon1 = nodes.agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon)).first()
    if lat0 is None:
        return points.select(point_key, *[F.lit(None).alias(c) for c in node], F.lit(None).alias("dist_km")).limit(0)
    side = max(lat1 - lat0, lon1 - lon0, 1e-9)

    def at(depth: int) -> list[Column]:
        return [
            _cell(F.col(lat), lat0, side, depth).alias("cy"),
            _cell(F.col(lon), lon0, side, depth).alias("cx"),
        ]

    # one small job: the fullest cell of every depth, from counts at the finest one
    finest = nodes.groupBy(*at(_MAX_DEPTH)).count()
    levels = finest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(_MAX_DEPTH))))
    shrink = F.pow(F.lit(_FAN), F.lit(_MAX_DEPTH) - F.col("depth")).cast("long")
    per_cell = levels.groupBy("depth", F.floor(F.col("cy") / shrink), F.floor(F.col("cx") / shrink)).agg(
        F.sum("count").alias("n")
    )
    shape = per_cell.groupBy("depth").agg(F.max("n").alias("fullest"), F.count(F.lit(1)).alias("cells"))
    shape = {row["depth"]: row for row in shape.collect()}
    depth = next((d for d in range(_MAX_DEPTH + 1) if shape[d]["fullest"] <= leaf), _MAX_DEPTH)

    cand = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        point_key,
        F.col(lat).alias("_plat"),
        F.col(lon).alias("_plon"),
        # the root cell; not a literal, which would turn the first join into a nested loop
        F.floor(F.col(lat) * 0.0).alias("cy"),
        F.floor(F.col(lon) * 0.0).alias("cx"),
    )
    for d in range(1, depth + 1):
        cells = (
            nodes.groupBy(*at(d))
            .agg(
                F.struct(
                    F.min(lat).alias("lat0"), F.max(lat).alias("lat1"), F.min(lon).alias("lon0"), F.max(lon).alias("lon1")
                ).alias("box"),
                F.max(lat).alias("rep_lat"),
                F.max_by(lon, lat).alias("rep_lon"),
            )
            .withColumns({"py": F.floor(F.col("cy") / _FAN), "px": F.floor(F.col("cx") / _FAN)})
        )
        if shape[d]["cells"] <= _BROADCAST_CELLS:
            cells = F.broadcast(cells)
        parents = cand.withColumnsRenamed({"cy": "py", "cx": "px"})
        near = parents.join(cells, ["py", "px"]).withColumns(
            {
                "_low": _gap_km(F.col("_plat"), F.col("_plon"), "box"),
                "_known": great_circle_km(F.col("_plat"), F.col("_plon"), F.col("rep_lat"), F.col("rep_lon")),
            }
        )
        best = F.min("_known").over(W.partitionBy(point_key))
        # the allowance keeps ties that differ only by rounding
        cand = (
            near.withColumn("_best", best)
            .where(F.col("_low") <= F.col("_best") * (1 + 1e-9) + 10.0**-digits)
            .select(point_key, "_plat", "_plon", "cy", "cx")
        )
    members = nodes.select("_node", F.col(lat).alias("_nlat"), F.col(lon).alias("_nlon"), *at(depth))
    dist = F.round(great_circle_km(F.col("_plat"), F.col("_plon"), F.col("_nlat"), F.col("_nlon")), digits)
    found = (
        cand.join(members, ["cy", "cx"])
        .groupBy(point_key)
        .agg(F.min(F.struct(dist.alias("dist_km"), F.col("_node"))).alias("_hit"))
    )
    return found.select(point_key, *[F.col(f"_hit._node.{c}").alias(c) for c in node], F.col("_hit.dist_km"))


def grid_at_points(cube: DataFrame, located: DataFrame, node: Sequence[str] = ("y", "x")) -> DataFrame:
    """Values of a time cube at located points (output of :func:`nearest_join`).

    One node may serve many stations. The located table is the small side: Spark sees its
    size at run time and picks a broadcast or a (skew-split) shuffle join.
    """
    return cube.join(located, list(node))


def terrain_join(cube: DataFrame, terrain: DataFrame, node: Sequence[str] = ("y", "x")) -> DataFrame:
    """Repeat static fields over every time step of a cube."""
    return cube.join(terrain, list(node))


def merge_layers(layers: Sequence[DataFrame], axes: Sequence[str] = ("time", "y", "x")) -> DataFrame:
    """Put the variables of several layers side by side, keeping cells any layer has.

    One union and one aggregate instead of a chain of outer joins: each layer shuffles once.
    """
    axes = list(axes)
    wide = None
    for layer in layers:
        wide = layer if wide is None else wide.unionByName(layer, allowMissingColumns=True)
    values = [c for c in wide.columns if c not in axes]
    return wide.groupBy(*axes).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def layer_mismatch(a: DataFrame, b: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Cells that only one of two layers has; empty means the same shape."""
    axes = list(axes)
    marked = a.select(*axes, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(*axes, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return marked.groupBy(*axes).agg(F.max("a").alias("in_a"), F.max("b").alias("in_b")).where("in_a <> in_b")


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Share of common keys on which each column agrees (1.0 = the same coordinates)."""
    both = a.select(*keys, *cols).join(b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols]), list(keys))
    return both.agg(*[F.avg((F.abs(F.col(c) - F.col(f"_b_{c}")) <= tol).cast("double")).alias(c) for c in cols])


def flip_rows(grid: DataFrame, y: str = "y") -> DataFrame:
    """Turn the row axis over: the first row becomes the last."""
    top = grid.agg((F.max(y) + F.min(y)).alias("t")).scalar()
    return grid.withColumn(y, top - F.col(y))


def _hull(corners: DataFrame, y: str, x: str) -> Column:
    return corners.agg(
        F.struct(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1")).alias("h")
    ).scalar()


def tight_crop(grid: DataFrame, bbox: Sequence[float], y="y", x="x", lat="lat", lon="lon") -> DataFrame:
    """Smallest block of rows and columns that holds every cell of the box."""
    h = _hull(grid.where(within_bbox(F.col(lat), F.col(lon), bbox)), y, x)
    return grid.where(F.col(y).between(h["y0"], h["y1"]) & F.col(x).between(h["x0"], h["x1"]))


def corner_crop(grid: DataFrame, corners: DataFrame, corner_key: str, y="y", x="x", lat="lat", lon="lon") -> DataFrame:
    """Block spanned by the nodes nearest to the given corner points."""
    h = _hull(nearest_join(corners, grid, corner_key, lat, lon, (y, x)), y, x)
    return grid.where(F.col(y).between(h["y0"], h["y1"]) & F.col(x).between(h["x0"], h["x1"]))


def only_in_second(a: Column, b: Column) -> Column:
    """Cells missing in the first raster although the second has a value."""
    return a.isNull() & b.isNotNull()


def raster_difference(grid: DataFrame, a: Column, b: Column, node: Sequence[str] = ("y", "x")) -> DataFrame:
    """Mean, extremes and their places of ``a - b`` in one pass; ties go to the smallest node."""
    d = F.col("_d")
    key = F.struct(*node)
    diffs = grid.select(*node, (a - b).alias("_d")).where(d.isNotNull())
    low = F.min(F.struct(d.alias("d"), key.alias("n")))
    high = F.min(F.struct((-d).alias("d"), key.alias("n")))
    return diffs.agg(F.count(d).alias("n_cells"), F.avg(d).alias("mean_diff"), low.alias("lo"), high.alias("hi")).select(
        "n_cells",
        "mean_diff",
        F.col("lo.d").alias("min_diff"),
        *[F.col(f"lo.n.{c}").alias(f"min_{c}") for c in node],
        (-F.col("hi.d")).alias("max_diff"),
        *[F.col(f"hi.n.{c}").alias(f"max_{c}") for c in node],
    )


def polygon_bbox(df: DataFrame, key: str, rings: str) -> DataFrame:
    """Bounding box of polygons given as rings of ``[lon, lat]`` vertices."""
    vertex = df.select(key, F.explode(rings).alias("_ring")).select(key, F.explode("_ring").alias("_p"))
    lon, lat = F.get("_p", 0), F.get("_p", 1)
    return vertex.groupBy(key).agg(
        F.min(lat).alias("lat_min"), F.min(lon).alias("lon_min"), F.max(lat).alias("lat_max"), F.max(lon).alias("lon_max")
    )
