"""Queries on grids, nearest nodes and rasters."""

from pyspark.sql import functions as F

from tinderframe.catalog.inputs import BBOX, Inputs, query, r
from tinderframe.operators import clean as C, spatial as SP

LAT0, LON0, LAT1, LON1 = BBOX

_KM = (
    "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) "
    "* pow(sin(radians(g.lon - p.lon) / 2), 2), 1.0)))"
)
_NEAREST = f"""select stid, y, x, dist_km from (
      select p.stid, g.y, g.x, round({_KM}, 6) as dist_km,
        row_number() over (partition by p.stid order by round({_KM}, 6), g.y, g.x) as rn
      from stations p cross join grid g) where rn = 1"""


@query("nearest_node", "stations grid", f"select stid, y, x, {r('dist_km')} as dist_km from ({_NEAREST})")
def nearest_node(t: Inputs):
    return SP.nearest_join(t.stations, t.grid)


@query(
    "grid_weather",
    "stations grid atm",
    f"""with near as ({_NEAREST}), cube as (select y, x, stid as hr0, rh from grid join (select stid, avg(rh) as rh from atm group by stid) a on a.stid = (y + x) % 16)
    select near.stid, near.y, near.x, cube.hr0 as slot, {r('cube.rh')} as rh from near join cube on near.y = cube.y and near.x = cube.x""",
)
def grid_weather(t: Inputs):
    """Weather of the nearest node: located once on the static grid, then joined by node."""
    by_slot = t.atm.groupBy(F.col("stid").alias("slot")).agg(F.avg("rh").alias("rh"))
    cube = t.grid.select("y", "x", ((F.col("y") + F.col("x")) % 16).alias("slot")).join(by_slot, "slot")
    located = SP.nearest_join(t.stations, t.grid).drop("dist_km")
    return SP.grid_at_points(cube, located).select("stid", "y", "x", "slot", "rh")


@query(
    "terrain_join",
    "grid atm",
    f"""select g.y, g.x, a.hr, {r('a.rh')} as rh, {r('case when abs(g.elev + 9999) > 0.001 and g.lsm > 0 then g.elev end')} as elev,
      {r('case when g.lon * -3 > 180 then g.lon * -3 - 360 else g.lon * -3 end')} as lon
    from grid g join atm a on g.x = a.stid and g.y = a.hr""",
)
def terrain_join(t: Inputs):
    """Static fields (fill value removed, land only) repeated over a weather cube."""
    elev = C.land_only(C.null_fill_value(F.col("elev"), tol=0.001), F.col("lsm"))
    terrain = t.grid.select("y", "x", elev.alias("elev"), C.wrap_longitude(F.col("lon") * -3).alias("lon"))
    cube = t.atm.select(F.col("hr").alias("y"), F.col("stid").alias("x"), "hr", "rh")
    return SP.terrain_join(cube, terrain).select("y", "x", "hr", "rh", "elev", "lon")


@query(
    "raster_diff",
    "grid",
    f"""with d as (select y, x, case when elev <> -9999 then elev end - (1000 + y * 3 + x) as d from grid)
    select count(d) as n_cells, {r('avg(d)')} as mean_diff, {r('min(d)')} as min_diff,
      (select y from d where d is not null order by d, y, x limit 1) as min_y, (select x from d where d is not null order by d, y, x limit 1) as min_x,
      {r('max(d)')} as max_diff,
      (select y from d where d is not null order by d desc, y, x limit 1) as max_y, (select x from d where d is not null order by d desc, y, x limit 1) as max_x
    from d""",
)
def raster_diff(t: Inputs):
    second = (1000 + F.col("y") * 3 + F.col("x")).cast("double")
    return SP.raster_difference(t.grid, C.null_fill_value(F.col("elev")), second)


@query(
    "raster_gaps",
    "grid",
    "select y, x from grid where elev = -9999 and lsm > 0",
)
def raster_gaps(t: Inputs):
    """Cells without elevation that are land in the mask."""
    return t.grid.where(
        SP.only_in_second(C.null_fill_value(F.col("elev")), C.land_only(F.col("lsm"), F.col("lsm")))
    ).select("y", "x")


@query(
    "tight_crop",
    "grid",
    f"""with h as (select min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from grid
      where lat between {LAT0} and {LAT1} and lon between {LON0} and {LON1})
    select y, x, {r('lat')} as lat, {r('lon')} as lon from grid, h where y between y0 and y1 and x between x0 and x1""",
)
def tight_crop(t: Inputs):
    return SP.tight_crop(t.grid, BBOX).select("y", "x", "lat", "lon")


@query(
    "corner_crop",
    "stations grid",
    f"""with near as ({_NEAREST}), h as (select min(near.y) as y0, max(near.y) as y1, min(near.x) as x0, max(near.x) as x1
      from near join stations using (stid) where elev > 9000)
    select y, x from grid, h where y between y0 and y1 and x between x0 and x1""",
)
def corner_crop(t: Inputs):
    """Block spanned by the nodes nearest to the highest stations."""
    return SP.corner_crop(t.grid, t.stations.where("elev > 9000"), "stid").select("y", "x")


@query("flip_rows", "grid", f"select (select max(y) + min(y) from grid) - y as y, x, {r('elev')} as elev from grid")
def flip_rows(t: Inputs):
    return SP.flip_rows(t.grid).select("y", "x", "elev")


@query(
    "merge_layers",
    "grid",
    f"""select coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, {r('a.elev')} as elev, b.lsm
    from (select y, x, elev from grid where elev > 0) a full join (select y, x, lsm from grid where lsm > 0) b on a.y = b.y and a.x = b.x""",
)
def merge_layers(t: Inputs):
    a = t.grid.where("elev > 0").select("y", "x", "elev")
    b = t.grid.where("lsm > 0").select("y", "x", "lsm")
    return SP.merge_layers([a, b], ["y", "x"])


@query(
    "layer_mismatch",
    "grid",
    """with a as (select y, x from grid where elev > 0), b as (select y, x from grid where lsm > 0)
    select y, x, 1 as in_a, 0 as in_b from (select * from a except select * from b)
    union all select y, x, 0, 1 from (select * from b except select * from a)""",
)
def layer_mismatch(t: Inputs):
    return SP.layer_mismatch(t.grid.where("elev > 0"), t.grid.where("lsm > 0"), ["y", "x"])


@query(
    "grid_agreement",
    "grid",
    f"""with b as (select y, x, case when y % 5 = 0 then lat + 0.01 else lat end as lat, lon from grid)
    select {r('avg(cast(a.lat = b.lat as int))')} as lat, {r('avg(cast(a.lon = b.lon as int))')} as lon from grid a join b on a.y = b.y and a.x = b.x""",
)
def grid_agreement(t: Inputs):
    other = t.grid.withColumn("lat", F.when(F.col("y") % 5 == 0, F.col("lat") + 0.01).otherwise(F.col("lat")))
    return SP.agreement(t.grid, other, ["y", "x"], ["lat", "lon"])


@query(
    "polygon_bbox",
    "stations grid",
    f"""select p.stid % 10 as fire, {r('min(g.lat)')} as lat_min, {r('min(g.lon)')} as lon_min, {r('max(g.lat)')} as lat_max, {r('max(g.lon)')} as lon_max
    from ({_NEAREST}) p join grid g on g.y = p.y group by 1""",
)
def polygon_bbox(t: Inputs):
    """Rings made of the grid row nearest to each station."""
    line = t.grid.groupBy("y").agg(F.collect_list(F.array("lon", "lat")).alias("ring"))
    near = SP.nearest_join(t.stations, t.grid).select("stid", "y")
    shapes = near.join(line, "y").select((F.col("stid") % 10).alias("fire"), F.array("ring").alias("rings"))
    return SP.polygon_bbox(shapes, "fire", "rings")
