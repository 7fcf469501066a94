"""What comes beside the recordings: listings with dates, activity summaries, fixtures and open-data tracks."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.ranged import array_rows, can_seek, opened

# Headers of a listing in the languages it is exported in, without accents, case and punctuation.
HEADERS = {
    "filename": ["filename", "nomdufichier", "nomfichier", "fichier"],
    "type": ["activitytype", "typedactivite", "typedelactivite", "typeactivite"],
    "name": ["activityname", "nomdelactivite", "nomdactivite", "nomactivite"],
    "date": ["activitydate", "datedelactivite", "datedactivite", "dateactivite"],
}
# French month names and short forms, without accents.
FRENCH_MONTHS = {"janv": 1, "janvier": 1, "fevr": 2, "fevrier": 2, "mars": 3, "avr": 4, "avril": 4, "mai": 5, "juin": 6, "juil": 7, "juillet": 7, "aout": 8, "sept": 9, "septembre": 9, "oct": 10, "octobre": 10, "nov": 11, "novembre": 11, "dec": 12, "decembre": 12}
ACCENTS = ("àâäçéèêëîïôöùûüÿñ", "aaaceeeeiioouuuyn")
MAX_FIELD = 64 << 20


def plain(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), *ACCENTS)


def listing_date(c: Column, last_year: int) -> Column:
    """The UTC time of 'Mar 2, 2024, 7:30:00 AM', '2 mars 2024, 07:30:00' or ISO 8601 (session time zone UTC); null
    for anything else and for years before 2000 or after last_year."""
    text = F.trim(c)
    words = F.split(F.regexp_replace(text, "[, ]+", " "), " ")  # day, month's name, year, time
    months = F.create_map(*[F.lit(v) for kv in FRENCH_MONTHS.items() for v in kv])
    month = F.try_element_at(months, F.rtrim(plain(F.get(words, F.lit(1))), F.lit(".")))
    spelled = F.when(F.size(words) == 4, F.concat_ws(" ", F.get(words, F.lit(2)), month.cast("string"), F.get(words, F.lit(0)), F.get(words, F.lit(3))))
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in ("MMM d, yyyy, h:mm:ss a", "MMM d, yyyy h:mm:ss a")]
    tried.append(F.try_to_timestamp(spelled, F.lit("yyyy M d H:mm:ss")))
    tried.append(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")))
    found = F.coalesce(*tried)
    return F.when(F.year(found).between(2000, last_year), found)


def read_listing(spark: SparkSession, path: str, last_year: int) -> DataFrame:
    """filename, type, name, date of a listing; columns it lacks are null, rows without a file name are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=MAX_FIELD)
    strip = str.maketrans(*ACCENTS)
    known = {"".join(ch for ch in c.lstrip("﻿").lower().translate(strip) if ch.isalnum() and ch.isascii()): c for c in reversed(rows.columns)}
    pick = {k: next((F.col(f"`{known[a]}`") for a in names if a in known), F.lit(None).cast("string")) for k, names in HEADERS.items()}
    return rows.select(F.trim(pick["filename"]).alias("filename"), pick["type"].alias("type"), pick["name"].alias("name"), listing_date(pick["date"], last_year).alias("date")).filter("filename <> ''")


INNER = "summarizedActivitiesExport"
SUMMARY = "path string, started double, type string, name string, complete boolean"


def _summary_row(path: str, row: dict | None, fine: bool) -> tuple | None:
    if row is None:
        return None if fine else (path, None, None, None, False)
    times = [v for k in ("beginTimestamp", "startTimeGmt") if isinstance(v := row.get(k), int | float) and not isinstance(v, bool) and 946_684_800_000 <= v <= 4_102_444_800_000]
    kind, name = row.get("activityType"), row.get("name")
    kind = kind.get("typeKey") if isinstance(kind, dict) else kind
    return path, times[0] / 1000 if times else None, kind if isinstance(kind, str) else None, (name.strip() or None) if isinstance(name, str) else None, True


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """path, started (epoch seconds), type, name and complete of the rows of summary files; a file that breaks off
    keeps the rows before the fault and adds one with complete = false. A file is read in chunks and a row at a time is
    held, where Arrow can open the file system; else whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    seeks = can_seek(path)

    def run(batches):
        for b in batches:
            for k, p in enumerate(b["path"]):
                with opened(p) if seeks else io.BytesIO(bytes(b["content"].iloc[k])) as stream:
                    part = []
                    for row, fine in array_rows(stream, INNER):
                        made = _summary_row(p, row, fine)
                        if made is not None:
                            part.append(made)
                        if len(part) == 1000:
                            yield pd.DataFrame(part, columns=names).astype({"started": float})
                            part = []
                    if part:
                        yield pd.DataFrame(part, columns=names).astype({"started": float})

    names = [c.split(" ")[0] for c in SUMMARY.split(", ")]
    return files.select("path", *[] if seeks else ["content"]).mapInPandas(run, SUMMARY)


def read_fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip; lines that are no such object are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """properties, part and coords of the lines of GeoJSON sequences: a Feature a line, bare or after a record
    separator. Each part of a MultiLineString is a row; other geometries and broken lines are left out."""
    whole = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    f = spark.read.text(path).select(F.from_json(F.regexp_replace("value", r"^[\x1e\s]+", ""), whole).alias("f")).select("f.properties", "f.geometry.*")
    single = F.array(F.from_json("coordinates", "array<array<double>>"))
    multi = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("type") == "LineString", single).when(F.col("type") == "MultiLineString", multi)
    return f.select("properties", F.posexplode(parts).alias("part", "coords")).filter(F.size("coords") >= 2)


def in_bbox(coords: str, west: float, south: float, east: float, north: float) -> Column:
    """Whether the line's box and the given one overlap."""
    lo = lambda k: F.array_min(F.transform(coords, lambda p: p[k]))
    hi = lambda k: F.array_max(F.transform(coords, lambda p: p[k]))
    return (lo(0) <= east) & (hi(0) >= west) & (lo(1) <= north) & (hi(1) >= south)


def crosses_bbox(coords: str, west: float, south: float, east: float, north: float) -> Column:
    """Whether some leg of the line meets the box (a line whose box overlaps it may still pass by its corner)."""

    def meets(i: Column) -> Column:
        a, b = F.get(coords, i), F.get(coords, i + 1)
        near, far = [F.lit(0.0)], [F.lit(1.0)]
        for k, lo, hi in ((0, west, east), (1, south, north)):
            p, d = F.get(a, F.lit(k)), F.get(b, F.lit(k)) - F.get(a, F.lit(k))
            ends = [F.when(d != 0, (F.lit(v) - p) / F.nullif(d, F.lit(0.0))).when(p.between(lo, hi), F.lit(s * float("inf"))).otherwise(F.lit(-s * float("inf"))) for v, s in ((lo, -1), (hi, 1))]
            near.append(F.when(d != 0, F.least(*ends)).otherwise(ends[0]))
            far.append(F.when(d != 0, F.greatest(*ends)).otherwise(ends[1]))
        return F.greatest(*near) <= F.least(*far)

    return F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(coords) - 2)), meets) & (F.size(coords) >= 2)


#: Surfaces of the open track data by category, and of the national extract by what its nature says.
CATEGORY_SURFACES = {"1": "asphalt", "1A": "asphalt", "1B": "asphalt", "2": "compacted", "2A": "compacted", "2B": "dirt", "2C": "dirt", "3": "dirt", "3A": "dirt", "3B": "ground", "3C": "ground", "NR": "dirt", "Route": "asphalt", "Piste revêtue": "asphalt", "Piste non revêtue": "dirt", "Chemin": "dirt", "Sentier": "ground"}
NATURE_SURFACES = {"sol naturel": "dirt", "revêtue": "asphalt", "revetue": "asphalt", "empierrée": "gravel", "empierree": "gravel", "stabilisée": "compacted", "stabilisee": "compacted"}


def category_surface(category: Column) -> Column:
    """The surface of a category of the open track data; unknown ones are dirt."""
    return F.coalesce(F.create_map(*[F.lit(v) for pair in CATEGORY_SURFACES.items() for v in pair])[category], F.lit("dirt"))


def nature_surface(nature: Column) -> Column:
    """The surface that a nature's text tells, by the first phrase it holds; dirt if it holds none."""
    said = F.lower(F.coalesce(nature, F.lit("")))
    return F.coalesce(*[F.when(F.contains(said, F.lit(k)), F.lit(v)) for k, v in NATURE_SURFACES.items()], F.lit("dirt"))


def read_open_tracks(spark: SparkSession, path: str) -> DataFrame:
    """ref, troncon, statut, surface, coords of open track records, a JSON object a line: bare or under `fields`, the
    geometry bare or within a Feature, the lines of a MultiLineString joined to one. Records without one are left out."""
    shape = "type string, coordinates string, geometry struct<type:string,coordinates:string>"
    own = f"n_dfci_1 string, n_dfci_2 string, statut_operationnel string, cat_act string, geo_shape struct<{', '.join(f'{n}:{k}' for n, k in (c.split(' ', 1) for c in shape.split(', ')))}>"
    r = spark.read.text(path).select(F.from_json("value", f"{own}, fields struct<{own.replace(' string', ':string').replace(' struct', ':struct')}>").alias("r"))
    said = F.coalesce("r.fields", F.struct(*[F.col(f"r.{c}").alias(c) for c in ("n_dfci_1", "n_dfci_2", "statut_operationnel", "cat_act", "geo_shape")]))
    geo = F.coalesce("f.geo_shape", "g")
    flat = r.select(said.alias("f"), F.col("r.geo_shape").alias("g")).select("f", geo.alias("geo")).select("f", F.when(F.col("geo.type") == "Feature", F.col("geo.geometry")).otherwise(F.struct("geo.type", "geo.coordinates")).alias("geo"))
    coords = F.when(F.col("geo.type") == "LineString", F.from_json("geo.coordinates", "array<array<double>>")).when(F.col("geo.type") == "MultiLineString", F.flatten(F.from_json("geo.coordinates", "array<array<array<double>>>")))
    text = lambda *names: F.coalesce(*[F.nullif(F.col(f"f.{n}"), F.lit("")) for n in names], F.lit(""))
    rows = flat.select(text("n_dfci_1", "n_dfci_2").alias("ref"), text("n_dfci_2").alias("troncon"), text("statut_operationnel").alias("statut"), category_surface(F.col("f.cat_act")).alias("surface"), F.transform(coords, lambda p: F.slice(p, 1, 2)).alias("coords"))
    return rows.filter(F.size("coords") >= 2)


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """tags (a map) and coords of the ways of a GeoJSON sequence: single lines alone, as an export of ways has them."""
    whole = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    f = spark.read.text(path).select(F.from_json(F.regexp_replace("value", r"^[\x1e\s]+", ""), whole).alias("f")).filter("f.geometry.type = 'LineString'")
    return f.select(F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("tags"), F.from_json("f.geometry.coordinates", "array<array<double>>").alias("coords")).filter(F.size("coords") >= 2)


def extract_edges(features: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """ref, surface, coords of a national extract's tracks (properties, part, coords, as read_tracks has them) that meet
    the box west, south, east, north."""
    rows = features if box is None else features.filter(crosses_bbox("coords", *box))
    return rows.select(F.coalesce(F.col("properties")["cleabs"], F.lit("")).alias("ref"), nature_surface(F.col("properties")["nature_detail_dfci"]).alias("surface"), "coords")
