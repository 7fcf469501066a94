"""What rides are ridden on: ways by their tags, rasterised to a grid table, and rides measured against it.

Ways and rides become sets of packed grid cells by SQL functions alone. The grid is a table partitioned by half-degree
tile, so a probe reads only the tiles that the rides touch. Cells are classified once each, however many rides share
them: by what runs through them, else by their eight neighbours, which may lie in another tile. A tile has 6.25 million
cells at most, by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the grid: cells and tiles in degrees, bits and offsets of a packed key, metres a degree.
CELL_DEG, TILE_CELLS = 0.0002, 2500
LON_BITS, LAT_OFFSET, LON_OFFSET = 21, 1 << 19, 1 << 20
METRES_LON, METRES_LAT = 111_320.0, 110_540.0
#: Tag values by class.
UNPAVED = "unpaved gravel fine_gravel compacted dirt earth ground grass sand mud pebblestone rock rocks stone woodchips shells".split()
PAVED = "asphalt paved concrete concrete:plates concrete:lanes paving_stones sett chipseal cobblestone unhewn_cobblestone metal bricks".split()
PAVED_HIGHWAYS = "motorway trunk primary secondary tertiary motorway_link trunk_link primary_link secondary_link tertiary_link unclassified residential living_street service road cycleway busway".split()
IGNORED_HIGHWAYS = "proposed construction abandoned razed platform corridor elevator bus_stop raceway".split()
#: Tiles of a probe that are named in its scan; beyond that it reads them all.
NAMED_TILES = 2000


def way_class(tags: Column) -> Column:
    """'p' (paved), 'u' (unpaved) or null (unknown) from a way's tags, a map: a known surface decides, then the kind of
    highway. An untagged path made for bicycles is unknown, as it may well be paved."""
    highway = tags["highway"]
    surface = F.lower(F.trim(F.element_at(F.split(F.coalesce(tags["surface"], F.lit("")), ";"), 1)))
    by_kind = F.when(highway == "track", F.when(tags["tracktype"].eqNullSafe("grade1"), "p").otherwise("u")).when(highway == "bridleway", "u")
    by_kind = by_kind.when(highway == "path", F.when(~tags["bicycle"].eqNullSafe("designated"), "u")).when(highway.isin(PAVED_HIGHWAYS), "p")
    return F.when((highway != "") & ~highway.isin(IGNORED_HIGHWAYS), F.when(surface.isin(UNPAVED), "u").when(surface.isin(PAVED), "p").otherwise(by_kind))


def cell_key(lon: Column, lat: Column) -> Column:
    """The packed cell, nearest by rounding half to even."""
    part = lambda c, offset: F.rint(c / CELL_DEG).cast("long") + offset
    return F.shiftleft(part(lat, LAT_OFFSET), LON_BITS).bitwiseOR(part(lon, LON_OFFSET))


def key_cells(key: Column) -> tuple[Column, Column]:
    """Rows and columns of a packed cell on the grid, (lat, lon)."""
    return F.shiftright(key, LON_BITS) - LAT_OFFSET, key.bitwiseAND(F.lit((1 << LON_BITS) - 1)) - LON_OFFSET


def tile_of(key: Column) -> Column:
    """The name of a cell's half-degree tile."""
    lat, lon = key_cells(key)
    return F.concat_ws("_", F.lit("t"), F.floor(lat / TILE_CELLS), F.floor(lon / TILE_CELLS))


def rasterised(lines: DataFrame, ids: list[str], coords: str = "coords", step_m: float = 5.0) -> DataFrame:
    """ids and key: the different cells that each line (an array of [lon, lat, ...]) runs through, with points at most
    step_m apart. Lines of fewer than two points have none; legs with a null are passed over."""
    leg = F.transform(F.sequence(F.lit(0), F.size(coords) - 2), lambda i: F.struct(F.get(coords, i).alias("a"), F.get(coords, i + 1).alias("b")))
    legs = lines.filter(F.size(coords) >= 2).select(*ids, F.explode(leg).alias("leg")).select(*ids, *[F.get(f"leg.{e}", F.lit(k)).alias(f"{c}{n}") for n, e in enumerate("ab") for k, c in enumerate("xy")]).dropna(subset=["x0", "y0", "x1", "y1"])
    wide = (F.col("x1") - F.col("x0")) * METRES_LON * F.cos(F.radians((F.col("y1") + F.col("y0")) / 2))
    n = F.floor(F.sqrt(F.pow(wide, F.lit(2)) + F.pow((F.col("y1") - F.col("y0")) * METRES_LAT, F.lit(2))) / step_m).cast("int") + 1
    points = legs.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    along = lambda c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("k") / F.col("n")
    return points.select(*ids, cell_key(along("x"), along("y")).alias("key")).distinct()


def surface_grid(ways: DataFrame) -> DataFrame:
    """tile, key, paved, unpaved of the cells that ways (tags, a map, and coords) of a known class run through."""
    known = ways.select(way_class(F.col("tags")).alias("class"), "coords").dropna(subset=["class"])
    cells = rasterised(known, ["class"])
    return cells.groupBy("key").agg(F.bool_or(F.col("class") == "p").alias("paved"), F.bool_or(F.col("class") == "u").alias("unpaved")).select(tile_of(F.col("key")).alias("tile"), "key", "paved", "unpaved")


def write_grid(grid: DataFrame, path: str) -> None:
    """The grid table, a folder a tile, sorted by key so that a probe skips row groups."""
    grid.repartition("tile").sortWithinPartitions("tile", "key").write.partitionBy("tile").parquet(path, mode="overwrite")


def read_grid(spark: SparkSession, path: str, tiles: list[str] | None = None) -> DataFrame:
    """The grid table, of the named tiles alone if some are given."""
    grid = spark.read.schema("key long, paved boolean, unpaved boolean, tile string").parquet(path)
    return grid if tiles is None or len(tiles) > NAMED_TILES else grid.filter(F.col("tile").isin(tiles))


def classified(keys: DataFrame, grid: DataFrame) -> DataFrame:
    """key and class of each different key: P, U, A (both) or N (no way there or next to it), null where the grid has no
    tile at all. A cell that holds a way is told by it alone, others by their eight neighbours."""
    tiles = grid.select("tile").distinct().withColumn("covered", F.lit(True))
    own = keys.select("key").distinct().withColumn("tile", tile_of(F.col("key")))
    cells = grid.select("tile", "key", "paved", "unpaved")
    seen = own.join(tiles, "tile", "left").join(cells, ["tile", "key"], "left")
    told = lambda p, u, none: F.when(p & u, "A").when(p, "P").when(u, "U").otherwise(none)
    around = F.array(*[F.lit((dy << LON_BITS) + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    asked = seen.filter("covered AND paved IS NULL").select(F.col("key").alias("of"), F.explode(around).alias("d")).select("of", (F.col("of") + F.col("d")).alias("key"))
    beside = asked.withColumn("tile", tile_of(F.col("key"))).join(cells, ["tile", "key"]).groupBy(F.col("of").alias("key")).agg(F.bool_or("paved").alias("p"), F.bool_or("unpaved").alias("u"))
    met = seen.join(beside, "key", "left")
    return met.select("key", F.when(F.col("paved").isNotNull(), told(F.col("paved"), F.col("unpaved"), F.lit("N"))).when(F.col("covered"), told(F.coalesce("p", F.lit(False)), F.coalesce("u", F.lit(False)), F.lit("N"))).alias("class"))


def unpaved_shares(cells: DataFrame, classes: DataFrame, ids: list[str], least_covered: float = 0.6, least_known: int = 50, threshold: float = 0.15) -> DataFrame:
    """ids, cells, covered, paved, unpaved, share (null: not measurable) and offroad, of each ride's cells (ids, key):
    enough of the ride must lie in covered tiles, and enough of its cells be of a known class."""
    n = lambda c: F.count_if(F.col("class") == c)
    counts = cells.join(classes, "key").groupBy(*ids).agg(F.count(F.lit(1)).alias("cells"), F.count("class").alias("covered"), n("P").alias("paved"), n("U").alias("unpaved"))
    known = F.col("paved") + F.col("unpaved")
    share = F.when((F.col("covered") / F.col("cells") >= least_covered) & (known >= F.greatest(F.lit(least_known), F.lit(1))), F.col("unpaved") / known)
    return counts.withColumn("share", share).withColumn("offroad", F.coalesce(F.col("share") >= threshold, F.lit(False)))


def measured(rides: DataFrame, path: str, ids: list[str], **how) -> DataFrame:
    """unpaved_shares of rides (ids, coords) against the grid table at path; only the tiles near them are read."""
    cells = rasterised(rides, ids).checkpoint()
    near = cells.select(F.explode(F.array(*[F.col("key") + (dy << LON_BITS) + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)])).alias("key"))
    tiles = [r[0] for r in near.select(tile_of(F.col("key"))).distinct().limit(NAMED_TILES + 1).collect()]
    return unpaved_shares(cells, classified(cells, read_grid(rides.sparkSession, path, tiles)), ids, **how)
