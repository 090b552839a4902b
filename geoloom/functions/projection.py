"""Transverse Mercator both ways, zones of the universal grid, and grid references, as column functions.

The map is Kruger's series to the fourth power of the third flattening (under a micrometre within a zone). Places beyond 84
degrees north or 80 south have no zone: their results are null, as are those of null coordinates. Longitudes count round the
globe. Zones keep the exceptions for southern Norway and Svalbard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid of WGS 84, and the grid's scale and false origin
A, FLAT = 6378137.0, 1 / 298.257223563
SCALE, EAST_0, SOUTH_0 = 0.9996, 500_000.0, 10_000_000.0
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")  # by zone modulo 3
ROWS = "ABCDEFGHJKLMNPQRSTUV"

N = FLAT / (2 - FLAT)
RADIUS = SCALE * A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)  # of the meridian's circle, scaled
ECC = 2 * math.sqrt(N) / (1 + N)
# Coefficients of the series in N
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACKWARD = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def around(lon: Column) -> Column:
    """A longitude from -180 to below 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def zone(lon: Column, lat: Column) -> Column:
    x = around(lon)
    plain = (F.floor((x + 180) / 6) + 1).cast("int")
    norway = lat.between(56, 63.999999999999) & (x >= 3) & (x < 12)
    svalbard = (lat >= 72) & (x >= 0) & (x < 42)
    wide = F.when(x < 9, 31).when(x < 21, 33).when(x < 33, 35).otherwise(37)
    return F.when(lat.between(-80, 84), F.when(norway, 32).when(svalbard, wide).otherwise(plain))


def band(lat: Column) -> Column:
    """The letter of a latitude's band of eight degrees; the last one has twelve."""
    at = F.least(F.floor((lat + 80) / 8), F.lit(19)).cast("int") + 1
    return F.when(lat.between(-80, 84), F.substr(F.lit(BANDS), at, F.lit(1)))


def meridian(zone: Column) -> Column:
    """The longitude in the middle of a zone."""
    return zone * 6 - 183.0


def _waves(terms: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """Sums of the terms times sin 2jx cosh 2jy, and times cos 2jx sinh 2jy."""
    along = across = F.lit(0.0)
    for j, c in enumerate(terms, 1):
        along = along + c * F.sin(2 * j * x) * F.cosh(2 * j * y)
        across = across + c * F.cos(2 * j * x) * F.sinh(2 * j * y)
    return along, across


def _let(value: Column, step) -> Column:
    """step(value), with the value made once however often step names it; the optimizer doesn't copy it into its uses."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def to_utm(lon: Column, lat: Column, zone_no: Column | None = None) -> Column:
    """struct(zone, south, easting, northing) in metres, in a place's own zone or the one that is given."""

    def conformal(p: Column) -> Column:
        east = F.radians(around(lon - meridian(p.z)))
        return F.struct(p.z.alias("z"), east.alias("e"), F.sinh(F.atanh(p.s) - ECC * F.atanh(ECC * p.s)).alias("t"))

    def transverse(p: Column) -> Column:
        return F.struct(p.z.alias("z"), F.atan2(p.t, F.cos(p.e)).alias("x"), F.atanh(F.sin(p.e) / F.sqrt(1 + p.t * p.t)).alias("y"))

    def gridded(p: Column) -> Column:
        along, across = _waves(FORWARD, p.x, p.y)
        northing = RADIUS * (p.x + along) + F.when(lat < 0, SOUTH_0).otherwise(0.0)
        return F.struct(p.z.alias("zone"), (lat < 0).alias("south"), (EAST_0 + RADIUS * (p.y + across)).alias("easting"), northing.alias("northing"))

    number = (zone(lon, lat) if zone_no is None else zone_no).cast("int")
    known = lat.between(-80, 84) & lon.isNotNull() & (F.lit(True) if zone_no is None else zone_no.isNotNull())
    start = F.struct(number.alias("z"), F.sin(F.radians(lat)).alias("s"))
    return F.when(known, _let(_let(_let(start, conformal), transverse), gridded))


def from_utm(zone_no: Column, south: Column, easting: Column, northing: Column) -> Column:
    """struct(lon, lat) in degrees."""

    def transverse(p: Column) -> Column:
        along, across = _waves(BACKWARD, p.x, p.y)
        return F.struct((p.x - along).alias("x"), (p.y - across).alias("y"))

    def conformal(p: Column) -> Column:
        return F.struct(F.asin(F.sin(p.x) / F.cosh(p.y)).alias("chi"), F.atan2(F.sinh(p.y), F.cos(p.x)).alias("e"))

    def degrees(p: Column) -> Column:
        lat = p.chi + sum((c * F.sin(2 * j * p.chi) for j, c in enumerate(LATITUDE, 1)), F.lit(0.0))
        return F.struct(around(meridian(zone_no) + F.degrees(p.e)).alias("lon"), F.degrees(lat).alias("lat"))

    start = F.struct(((northing - F.when(south, SOUTH_0).otherwise(0.0)) / RADIUS).alias("x"), ((easting - EAST_0) / RADIUS).alias("y"))
    known = zone_no.isNotNull() & south.isNotNull() & easting.isNotNull() & northing.isNotNull()
    return F.when(known, _let(_let(_let(start, transverse), conformal), degrees))


def _letter(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), at.cast("int") + 1, F.lit(1))


def mgrs(lon: Column, lat: Column, digits: int = 5) -> Column:
    """The grid reference, e.g. 17TPJ3008433438: zone, band, letters of the square of 100 km, and `digits` each of easting and
    northing, rounded down."""

    def text(u: Column) -> Column:
        square = F.floor(u.easting / 100_000) - 1
        column = F.when(u.zone % 3 == 0, _letter(COLUMNS[0], square)).when(u.zone % 3 == 1, _letter(COLUMNS[1], square)).otherwise(_letter(COLUMNS[2], square))
        row = _letter(ROWS, F.pmod(F.floor(u.northing / 100_000) + F.when(u.zone % 2 == 0, 5).otherwise(0), F.lit(20)))
        part = lambda v: F.lpad(F.floor(F.pmod(v, F.lit(100_000.0)) / 10 ** (5 - digits)).cast("string"), digits, "0")
        tail = [part(u.easting), part(u.northing)] if digits else []
        return F.concat(u.zone.cast("string"), band(lat), column, row, *tail)

    return _let(to_utm(lon, lat), text)


def from_mgrs(reference: Column) -> Column:
    """struct(zone, south, easting, northing, size) of the south-western corner of a reference's square and its side in metres;
    null for text of another form, and for squares that their zone doesn't have."""
    form = "^([0-9]{1,2})([C-HJ-NP-X])([A-HJ-NP-Z])([A-HJ-NP-V])((?:[0-9]{2}){0,5})$"
    text = F.upper(F.regexp_replace(reference, " ", ""))
    part = lambda k: F.regexp_extract(text, form, k)
    number, at = part(1).try_cast("int"), F.instr(F.lit(BANDS), part(2)) - 1
    half = (F.length(part(5)) / 2).cast("int")
    size = F.pow(F.lit(10.0), 5 - half)
    digits = lambda start: F.coalesce(F.substr(part(5), start, half).try_cast("double"), F.lit(0.0)) * size
    column = F.when(number % 3 == 0, F.instr(F.lit(COLUMNS[0]), part(3))).when(number % 3 == 1, F.instr(F.lit(COLUMNS[1]), part(3))).otherwise(F.instr(F.lit(COLUMNS[2]), part(3)))
    row = F.pmod(F.instr(F.lit(ROWS), part(4)) - 1 - F.when(number % 2 == 0, 5).otherwise(0), F.lit(20)) * 100_000.0
    south = at < 10
    # rows repeat after 2,000 km; a band has one of each from a little below its lower edge on
    low = to_utm(meridian(number), at * 8 - 80.0, number).northing - 200_000
    northing = row + F.ceil((low - row) / 2_000_000) * 2_000_000.0
    fits = F.rlike(text, F.lit(form)) & number.between(1, 60) & (column > 0)
    corner = F.struct(number.alias("zone"), south.alias("south"), (column * 100_000.0 + digits(F.lit(1))).alias("easting"), (northing + digits(half + 1)).alias("northing"), size.alias("size"))
    return F.when(fits, corner)
