"""Packed grid cells, tiles and curve keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets of the four staggered grids, in cells: two points closer than half a cell share a cell of one of them.
STAGGERED = ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5))
PACK = 10_000_000
METRES_A_DEGREE = 111_320.0


def degrees(metres: float, latitude: float) -> tuple[float, float]:
    """Cell size in degrees of latitude and longitude."""
    import math

    return metres / METRES_A_DEGREE, metres / (METRES_A_DEGREE * math.cos(math.radians(latitude)))


def packed(lat: Column, lon: Column, lat_deg: Column | float, lon_deg: Column | float, dx: float = 0.0, dy: float = 0.0) -> Column:
    """One long for a cell."""
    return (F.floor(lon / lon_deg + dx) * PACK + F.floor(lat / lat_deg + dy)).cast("long")


def staggered(df: DataFrame, lat_deg: Column | float, lon_deg: Column | float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A row for each of the four cells of a point, with ``grid`` and ``cell``."""
    cells = F.array(*[packed(F.col(lat), F.col(lon), lat_deg, lon_deg, dx, dy) for dx, dy in STAGGERED])
    return df.select("*", F.posexplode(cells).alias("grid", "cell"))


def neighbours(df: DataFrame, x: str, y: str, reach: int = 1) -> DataFrame:
    """A row for each cell within ``reach`` of a cell, as ``nx``, ``ny``."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    out = df.withColumn("step_", F.explode(F.array(*steps)))
    return out.withColumn("nx", F.col(x) + F.col("step_.i")).withColumn("ny", F.col(y) + F.col("step_.j")).drop("step_")


def position_cell(lat: Column, lon: Column, lon_deg: float = 3e-5, lat_deg: float = 2e-5) -> Column:
    return (F.floor(lon / lon_deg) * 100_000_000 + F.floor(lat / lat_deg)).cast("long")


def position_centre(cell: Column, lon_deg: float = 3e-5, lat_deg: float = 2e-5) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a position cell; the row part lies within half the packing factor."""
    row = F.pmod(cell + 50_000_000, F.lit(100_000_000)) - 50_000_000
    column = (cell - row) / 100_000_000
    return (row + 0.5) * lat_deg, (column + 0.5) * lon_deg


def quarter_hectare(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Column and row of the cell of 50 x 50 m of a point; the width follows the cosine of the row's middle latitude, taken
    as a series that every engine computes alike."""
    rows = METRES_A_DEGREE / 50
    row = F.floor(lat * rows)
    t = F.radians((row + 0.5) / rows) * F.radians((row + 0.5) / rows)
    return F.floor(lon * rows * (1 - t / 2 + t * t / 24 - t * t * t / 720)), row


def mercator_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile of a point; latitudes beyond the map count as its edge."""
    n = 1 << zoom
    clamped = F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(clamped) + 1 / F.cos(clamped)) / F.pi()) / 2 * n)
    edge = lambda c: F.greatest(F.least(c, F.lit(n - 1)), F.lit(0)).cast("long")
    return edge(x), edge(y)


def overview(df: DataFrame, zoom: int, size: float, colour: str, value: str) -> DataFrame:
    """Rows (``latitude``, ``longitude``) snapped to cells of ``size`` Web Mercator metres: count and mean value for each
    tile, cell centre and colour."""
    radius = 6_378_137.0
    tx, ty = mercator_tile(F.col("latitude"), F.col("longitude"), zoom)
    lat = F.radians(F.col("latitude"))
    mx, my = radius * F.radians(F.col("longitude")), radius * F.log(F.tan(lat) + 1 / F.cos(lat))
    centre = lambda m: (F.floor(m / size) + 0.5) * size
    return df.groupBy(tx.alias("tx"), ty.alias("ty"), centre(mx).alias("cx"), centre(my).alias("cy"), colour).agg(F.count("*").alias("trees"), F.avg(value).alias(f"mean_{value}"))


def morton(x: Column, y: Column, bits: int) -> Column:
    """The low bits of two numbers, interleaved; y takes the odd places."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for c, place in ((x, 2 * b), (y, 2 * b + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Place of a cell on the Hilbert curve of a square of ``2 ** bits``: the quadrant of each level, turned by the
    levels above. The turn is one of four states, so a level is two small lookups."""
    order = [[0, 1, 3, 2], [0, 3, 1, 2], [2, 1, 3, 0], [2, 3, 1, 0]]
    turn = [[1, 0, 2, 0], [0, 3, 1, 1], [2, 2, 0, 3], [3, 1, 3, 2]]
    table = lambda t: F.array(*[F.lit(v) for row in t for v in row])
    orders, turns = table(order), table(turn)
    steps = F.array(*[F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")) * 2 + F.shiftright(y, b).bitwiseAND(F.lit(1).cast("long")) for b in range(bits - 1, -1, -1)])
    zero = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).alias("s"))
    at = lambda s, q: (s["s"] * 4 + q).cast("int")
    return F.aggregate(steps, zero, lambda s, q: F.struct((s["d"] * 4 + F.get(orders, at(s, q))).alias("d"), F.get(turns, at(s, q)).alias("s")))["d"]


def metric_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Local metres east and north of an origin (equirectangular)."""
    import math

    return (lon - lon0) * (METRES_A_DEGREE * math.cos(math.radians(lat0))), (lat - lat0) * METRES_A_DEGREE


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_008.8 * F.asin(F.sqrt(a))


def pairs_within(left: DataFrame, right: DataFrame, reach: float, x: str = "x", y: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of two tables closer than ``reach``: an equi-join of each left row's 3 x 3 cells with the cell of
    the right row, then the distance. The columns of the sides get ``l_`` and ``r_`` before their names."""
    cell = lambda c: F.floor(F.col(c) / reach)
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], cell(x).alias("cx_"), cell(y).alias("cy_"))  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], cell(x).alias("nx"), cell(y).alias("ny"))
    near = neighbours(l, "cx_", "cy_").join(r, ["nx", "ny"])
    for k in keys:
        near = near.where(F.col(f"l_{k}") == F.col(f"r_{k}"))
    distance = F.sqrt((F.col(f"l_{x}") - F.col(f"r_{x}")) ** 2 + (F.col(f"l_{y}") - F.col(f"r_{y}")) ** 2)
    return near.withColumn("distance", distance).where(F.col("distance") <= reach).drop("cx_", "cy_", "nx", "ny")
