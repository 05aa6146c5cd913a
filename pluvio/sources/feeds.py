"""Listings, strike files, raster attributes and place labels, as column expressions over text."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.functions.classify import colours_to_dbz, rate_of_dbz
from pluvio.functions.const import AEQD_LAT, AEQD_LON
from pluvio.operators.grid import in_bbox
from pluvio.operators.stages import written
from pluvio.operators.warnings import storm_related, warsaw

log = logging.getLogger(__name__)

# Names of files, and of a strike file's columns.
RASTER_NAME = r"\d{16}dBR\.sri\.h5"
STRIKE_NAME = r"^(\d{4})\.(\d{2})\.(\d{2})\.(\d{2})\.(\d{2})\.ld\.csv$"
LAT_NAMES = ("lat", "latitude", "szerokosc", "szerokość", "szer")
LON_NAMES = ("lon", "lng", "longitude", "dlugosc", "długość", "dług")
TIME_NAMES = ("time", "czas", "datetime", "timestamp", "data")
TIME_FORMATS = ("yyyy-MM-dd HH:mm[:ss][.SSS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]")
NOBODY, OFFICE = "anon", "IMGW-PIB"


def raster_files(pages: DataFrame, text: str = "html") -> DataFrame:
    """``name, frame_time`` of the raster files that pages list, each once; names whose stamp is no time are left out."""
    names = pages.select(F.explode(F.regexp_extract_all(text, F.lit(RASTER_NAME), 0)).alias("name")).distinct()
    stamp = F.try_to_timestamp(F.substring("name", 1, 14), F.lit("yyyyMMddHHmmss"))
    return names.withColumn("frame_time", F.unix_timestamp(stamp)).where("frame_time is not null")


def strike_file_time(name: Column) -> Column:
    """Time of a strike file by its name."""
    return F.try_to_timestamp(F.regexp_replace(name, STRIKE_NAME, "$1-$2-$3 $4:$5"), F.lit("yyyy-MM-dd HH:mm"))


def strike_files(names: DataFrame, now: Column, most: int = 16) -> DataFrame:
    """The newest strike files between sixteen minutes ago and one minute ahead."""
    at = strike_file_time(F.col("name"))
    return names.distinct().withColumn("at", at).where((F.col("at") >= now - F.expr("interval 16 minutes")) & (F.col("at") <= now + F.expr("interval 1 minute"))).orderBy(F.desc("at"), "name").limit(most)


def whole_scans(files: DataFrame) -> DataFrame:
    """The files of scans in which no file is a web page in place of data; one such page voids its scan."""
    page = F.lower(F.ltrim("body")).startswith("<")
    return files.join(files.where(page).select("scan_id").distinct(), "scan_id", "left_anti")


def _cells(line: Column) -> Column:
    semicolons, commas = F.size(F.split(line, ";")), F.size(F.split(line, ","))
    return F.transform(F.when((semicolons > 1) & (semicolons >= commas), F.split(line, ";")).otherwise(F.split(line, ",")), lambda x: F.trim(x))


def _when(cell: Column) -> Column:
    """A cell as a time, by the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(cell, F.lit(f)) for f in TIME_FORMATS])


def _column(header: Column, names: tuple[str, ...]) -> Column:
    """Place of the first of ``names`` that the header has, from 1; null if none."""
    return F.coalesce(*[F.nullif(F.array_position(header, n), F.lit(0)) for n in names])


def strikes(files: DataFrame) -> DataFrame:
    """``name, lat, lon, at`` of the strikes in files (``name, body``).

    Lines are cut at semicolons or commas. A header may name the columns; where it does not, or
    what it names is out of range, the first cell from 48 to 56 is the latitude and the first from
    13 to 25 the longitude. The time is the named cell, else the first that looks like one, else
    that of the file's name. Lines without place or time are left out.
    """
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.transform(_cells(F.element_at("lines", 1)), lambda c: F.regexp_replace(F.lower(c), "^\ufeff", ""))
    named = F.exists("first", lambda c: c.rlike("[a-zą-ż]") & c.try_cast("double").isNull())
    header = F.when(named, F.col("first")).otherwise(F.array().cast("array<string>"))
    read = files.withColumn("lines", lines).where((F.size("lines") > 0) & ~F.ltrim("body").startswith("<"))
    read = read.withColumn("first", first).withColumn("header", header)
    read = read.select("name", _column(F.col("header"), LAT_NAMES).alias("i"), _column(F.col("header"), LON_NAMES).alias("j"), _column(F.col("header"), TIME_NAMES).alias("k"), F.explode(F.when(F.size("header") > 0, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))).alias("line"))
    read = read.withColumn("cells", _cells(F.col("line"))).withColumn("numbers", F.transform("cells", lambda c: c.try_cast("double")))
    is_lat, is_lon = (lambda x: x.between(48, 56)), (lambda x: x.between(13, 25))
    own = lambda array, at: F.try_element_at(F.col(array), F.col(at).cast("int"))
    named = is_lat(own("numbers", "i")) & is_lon(own("numbers", "j"))
    place = lambda at, fits: F.when(F.coalesce(named, F.lit(False)), own("numbers", at)).otherwise(F.try_element_at(F.filter("numbers", fits), F.lit(1)))
    seen = F.filter(F.transform("cells", _when), lambda x: x.isNotNull())
    at = F.coalesce(_when(own("cells", "k")), F.try_element_at(seen, F.lit(1)), strike_file_time(F.col("name")))
    return read.select("name", place("i", is_lat).alias("lat"), place("j", is_lon).alias("lon"), at.alias("at")).dropna()


def number_attribute(raw: Column, fallback: Column) -> Column:
    """An attribute as a number; the fallback where it is none."""
    return F.coalesce(F.when(F.trim(raw) != "", F.trim(raw).try_cast("double")), fallback)


def projection_origin(projdef: Column) -> tuple[Column, Column]:
    """Latitude and longitude of origin in a projection's definition, with the composite's own as fallback."""
    part = lambda name: F.regexp_extract(projdef, name + r"=([+-]?\d+(?:\.\d+)?)", 1)
    return number_attribute(part("lat_0"), F.lit(AEQD_LAT)), number_attribute(part("lon_0"), F.lit(AEQD_LON))


def attribute_clock(date: Column, time: Column) -> Column:
    """Epoch seconds of a date of eight digits and a time of six; null otherwise."""
    fits = F.trim(date).rlike(r"^\d{8}$") & F.trim(time).rlike(r"^\d{6}$")
    return F.when(fits, F.unix_timestamp(F.try_to_timestamp(F.concat(F.trim(date), F.trim(time)), F.lit("yyyyMMddHHmmss"))))


def place_label(city: Column, town: Column, village: Column, name: Column, county: Column, display: Column) -> Column:
    """The first of these that is not empty; of the display name what stands before the first comma."""
    some = lambda x: F.when(x != "", x)
    return F.coalesce(*map(some, (city, town, village, name, county, F.substring_index(display, ",", 1))), F.lit("Wybrany punkt"))


WARNING = "array<struct<id:string,nazwa_zdarzenia:string,stopien:string,prawdopodobienstwo:string,obowiazuje_od:string,obowiazuje_do:string,opublikowano:string,tresc:string,biuro:string,teryt:array<string>>>"
COUNTY = "struct<powiaty:array<struct<t:string,n:string,b:array<double>,g:array<array<array<array<double>>>>>>>"


def official_warnings(pages: DataFrame, text: str = "body") -> DataFrame:
    """The warnings of feeds in JSON, each page an array: ``id, event, degree, probability, starts, ends, published, body, office, teryt, storm``.

    A degree that is no number is 0, a missing probability null, a missing office the institute's
    own, missing codes none. Times are Warsaw's; an unreadable one is null.
    """
    w = pages.select(F.explode(F.from_json(text, WARNING)).alias("w")).select("w.*")
    return w.select(
        "id", F.col("nazwa_zdarzenia").alias("event"), F.coalesce(F.col("stopien").try_cast("double"), F.lit(0.0)).cast("int").alias("degree"), F.when(F.col("prawdopodobienstwo") != "", F.col("prawdopodobienstwo").try_cast("double")).alias("probability"),
        warsaw(F.col("obowiazuje_od")).alias("starts"), warsaw(F.col("obowiazuje_do")).alias("ends"), F.col("opublikowano").alias("published"), F.col("tresc").alias("body"), F.coalesce("biuro", F.lit(OFFICE)).alias("office"),
        F.coalesce("teryt", F.array().cast("array<string>")).alias("teryt"), storm_related(F.col("nazwa_zdarzenia")).alias("storm"),
    )


def counties(files: DataFrame, text: str = "body") -> DataFrame:
    """``t, n, b, g`` of the counties in files in JSON: code, name, box (west, south, east, north) and polygons of rings of points."""
    return files.select(F.explode(F.from_json(text, COUNTY)["powiaty"]).alias("c")).select("c.*")


def county_edges(found: DataFrame) -> DataFrame:
    """Counties as the edges that ``in_polygon`` reads, one row for each edge of each ring; rings of one polygon after the first are holes, and each polygon is a county's part of its own."""
    rings = found.select("t", "b", F.posexplode("g").alias("part", "rings")).select("t", "b", "part", F.posexplode("rings").alias("ring", "points"))
    ends = F.transform(F.sequence(F.lit(1), F.size("points")), lambda i: F.struct(F.element_at("points", i)[0].alias("x1"), F.element_at("points", i)[1].alias("y1"), F.element_at("points", i % F.size("points") + 1)[0].alias("x2"), F.element_at("points", i % F.size("points") + 1)[1].alias("y2")))
    box = [F.col("b")[i].alias(n) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y"))]
    return rings.where(F.size("points") > 0).select(F.col("t").alias("code"), "part", "ring", *box, F.inline(ends))


def tile_hits(pixels: DataFrame, stride: int = 2) -> DataFrame:
    """Of decoded tiles' pixels (frame_time, x, y, px, py, r, g, b, a) every ``stride``-th both ways, as hits within the radar's box: ``frame_time, lat, lon, rate``."""
    rows = colours_to_dbz(pixels.where((F.col("px") % stride == 0) & (F.col("py") % stride == 0))).where("dbz is not null")
    lat, lon = geo.tile_pixel(6, F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    return in_bbox(rows.select("frame_time", lat.alias("lat"), lon.alias("lon"), rate_of_dbz(F.col("dbz")).alias("rate")))


def complete_frames(tiles: DataFrame, cover: DataFrame) -> DataFrame:
    """``frame_time, complete``: whether every tile of the ``cover`` (x, y) came (``tiles``: frame_time, x, y)."""
    need = cover.distinct().agg(F.count("*").alias("need"))  # one row
    had = tiles.join(cover.distinct(), ["x", "y"], "left_semi").select("frame_time", "x", "y").distinct().groupBy("frame_time").agg(F.count("*").alias("had"))
    frames = tiles.select("frame_time").distinct().join(had, "frame_time", "left")
    return frames.crossJoin(F.broadcast(need)).select("frame_time", (F.coalesce("had", F.lit(0)) == F.col("need")).alias("complete"))


def client_key(forwarded: Column, real_ip: Column) -> Column:
    """By whom a call is counted: the first address it was forwarded for, else its own, else nobody."""
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.coalesce(some(F.substring_index(forwarded, ",", 1)), some(real_ip), F.lit(NOBODY))


def search_key(query: Column) -> Column:
    """A search as it is looked up; null under two characters."""
    key = F.lower(F.trim(query))
    return F.when(F.length(key) >= 2, key)


def attempt(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What a source returns, or None if it fails, so that the others stand without it. All of it is read and written here, so that a source which fails late fails here too; what is asked for should be small."""
    try:
        return written(read())
    except (PySparkException, OSError) as error:
        log.warning("a source failed: %s", str(error).splitlines()[0])
        return None


def first_that_works(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The rows of the first source that can be read whole; if none can, the error of the first, which is the preferred one, is raised."""
    preferred = None
    for read in sources:
        try:
            return written(read())
        except (PySparkException, OSError) as error:
            log.warning("a source failed: %s", str(error).splitlines()[0])
            preferred = preferred or error
    if preferred is None:
        raise ValueError("there is no source")
    raise preferred


def trusted(threats: DataFrame, snapshots: DataFrame, key: str = "scan_id") -> DataFrame:
    """Threats of snapshots whose radar was there; without radar nothing is said."""
    return threats.join(snapshots.where(~F.col("radar_unavailable")).select(key).distinct(), key, "left_semi")
