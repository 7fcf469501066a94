"""What an activity is, told from the type names of recordings, listings and summaries: dimension joins and cascades.

A type is brought to a key (lower case, without accents, letters and digits only) and looked up; explicit out-of-scope
types are skipped, generic ones ("a bike ride") are road by default only, and unknown ones say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of listings in English and French, by the sport they stand for; "skip": out of scope.
LISTED = {
    "road": "ride ebikeride roadride velomobile velo veloderoute veloelectrique vae",
    "gravel": "gravelride velogravel gravel",
    "mtb": "mountainbikeride mountainbiking emountainbikeride vtt velotoutterrain vttelectrique vtae",
    "running": "run trailrun hike walk courseapied randonnee marche",
    "skip": "virtualride virtualrun treadmillrun indoorcycling indoorrunning swim rowing kayaking standuppaddling alpineski backcountryski nordicski snowshoe snowboard iceskate inlineskate yoga crossfit weighttraining workout surfing kitesurf windsurf rockclimbing golf wheelchair handcycle elliptical stairstepper velovirtuel courseapiedvirtuelle natation skialpin skiderandonnee skidefond raquettes entrainement musculation aviron kayak canoe surf escalade elliptique patinageaglace roller fauteuilroulant",
}
# Type names within recordings, and those that say nothing.
RECORDED = {
    "mtb": "mountain_biking bmx downhill_biking e_bike_mountain mtb mountain_bike_ride e_mountain_bike_ride",
    "gravel": "gravel_cycling cyclocross mixed_surface gravel gravel_ride",
    "road": "road_cycling road_biking recumbent_cycling track_cycling e_bike_fitness e_bike_ride",
    "running": "9 running trail_running trail_run track_running street_running run walking casual_walking speed_walking hiking hike walk",
    "nothing": "cycling ride biking bike e_biking 1",
    "skip": "treadmill_running treadmill virtual_ride virtual_run indoor_cycling indoor_running stationary_cycling trainer spinning virtual_activity indoor_walking spin snowshoeing alpine_skiing downhill_skiing cross_country_skiing nordic_skiing backcountry_skiing snowboarding ice_skating inline_skating swimming open_water_swimming lap_swimming rowing kayaking canoeing stand_up_paddling sup surfing kitesurfing windsurfing sailing yoga pilates crossfit weight_training strength_training workout elliptical stair_stepper stair_climbing rock_climbing climbing bouldering golf wheelchair handcycle handcycling motorcycling motorbike motorcycle moto scooter e_scooter electric_scooter motor_vehicle atv quad snowmobile driving car skateboarding skateboard",
}
# Types that say no more than "a bike ride", in listings and in summaries; and what summaries add.
GENERIC = "ride ebikeride velo veloelectrique vae"
GENERIC_SUMMARY = "cycling e_bike_fitness biking bike"
SUMMARY = {"mtb": "enduro_mtb e_enduro_mtb", "road": "e_bike_road", "running": "ultra_run"}
# Numbers of the public profile of recordings: sports, and sub-sports of cycling by sport.
CYCLING, RUNNING = (2, 21), (1, 11, 17)
SUB_SPORTS = {"mtb": {8: "mountain", 9: "downhill", 29: "bmx", 47: "e_bike_mountain"}, "gravel": {46: "gravel_cycling", 11: "cyclocross", 49: "mixed_surface"}, "road": {7: "road", 48: "commuting", 28: "e_bike_fitness", 10: "recumbent", 13: "track_cycling", 4: "track", 2: "street"}}
SUB_GENERIC = (0, 254)
SPORTS = ("road", "gravel", "mtb", "offroad", "running")
ACCENTS = ("àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _key(name: str) -> str:
    return name.replace("_", "")


def dimension() -> list[tuple[str, str | None, bool, bool, str | None, bool, bool]]:
    """key; sport, skip and generic as recordings have it; sport, skip and generic as summaries do, of every known type."""
    listed = {_key(n): s for s, names in LISTED.items() for n in names.split()}
    own = {_key(n): s for s, names in RECORDED.items() for n in names.split() if s != "skip"}
    skipped = {_key(n) for n in RECORDED["skip"].split()}
    summary = {_key(n): s for s, names in SUMMARY.items() for n in names.split()}
    generic, bare = ({_key(n) for n in names.split()} for names in (GENERIC, GENERIC_SUMMARY))
    out = []
    for k in sorted({*listed, *own, *skipped, *summary, *bare}):
        said = "skip" if k in skipped else own.get(k, listed.get(k))
        sport = said if said in SPORTS else None
        recorded = (sport, said == "skip", sport == "road" and k in generic)
        if k in bare:
            told = ("road", False, True)
        elif k in summary:
            told = (summary[k], False, False)
        else:
            told = recorded
        out.append((k, *recorded, *told))
    return out


def normal(c: Column) -> Column:
    """The key of a type name."""
    return F.regexp_replace(F.translate(F.lower(c), *ACCENTS), "[^a-z0-9]", "")


def by_name(c: Column) -> Column:
    """The sport that a generic ride's name tells, or null."""
    name = F.lower(c)
    return F.when(name.contains("gravel"), "gravel").when(name.contains("vtt") | name.contains("mtb") | name.contains("mountain"), "mtb")


def known_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dimension(), "key string, sport string, skip boolean, generic boolean, told string, told_skip boolean, told_generic boolean")


def classified(rows: DataFrame, type_col: str) -> DataFrame:
    """rows with sport, skip and generic of the type of a recording; a type that is unknown or null has no sport and is
    not skipped."""
    table = F.broadcast(known_types(rows.sparkSession).select("key", "sport", "skip", "generic"))  # some 200 rows
    return rows.withColumn("_key", normal(F.col(type_col))).join(table, F.col("_key") == F.col("key"), "left").drop("_key", "key").fillna({"skip": False, "generic": False})


def cascade(*candidates: tuple[Column, Column]) -> tuple[Column, Column]:
    """Sport and whether it is a default only, of candidates (sport, generic), those of most authority first: the first
    that is a sport, but a road that a later gravel or mtb refines; a default if all that speak are generic."""
    valid = [F.when(s.isin(*SPORTS), s) for s, _ in candidates]
    first = F.coalesce(*valid)
    finer = F.coalesce(*[F.when(v.isin("gravel", "mtb"), v) for v in valid])
    sport = F.when((first == "road") & finer.isNotNull(), finer).otherwise(first)
    vague = [v.isNull() | F.coalesce(g, F.lit(False)) for v, (_, g) in zip(valid, candidates, strict=True)]
    all_vague = vague[0]
    for v in vague[1:]:
        all_vague = all_vague & v
    return sport, F.coalesce((sport == "road") & all_vague, F.lit(False))


def _values() -> str:
    quote = lambda v: "CAST(NULL AS STRING)" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in dimension()).replace("CAST(NULL AS STRING)", "NULL")


_KEY = f"regexp_replace(translate(lower(t), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[^a-z0-9]', ''[[||, 'g']])"
_KINDS = f"kinds(key, sport, skip, generic, told, told_skip, told_generic) AS (VALUES {_values()})"
#: Names as they come: every known one, in three spellings, and some that nobody knows.
_SAMPLES = ["GravelRide", "Mountain Bike Ride", "mountain_biking", "E-Bike Ride", "Vélo électrique", "Yoga", "cycling", "1", "9", "VirtualRide", "Trail Run", "tennis_v2", "road_biking", "enduro_mtb", "E_Bike_Fitness", "Snowshoe", "Randonnée", "motorcycle", "ultra_run", "", "bike"]
_TYPES = "ty AS (SELECT event_id, user_id, value, [[element_at(array(" + ", ".join(f"'{s}'" for s in _SAMPLES) + f"), CAST(event_id % {len(_SAMPLES)} AS INT) + 1)||list_extract(list_value(" + ", ".join(f"'{s}'" for s in _SAMPLES) + f"), CAST(event_id % {len(_SAMPLES)} AS INT) + 1)]] AS t, CASE event_id % 5 WHEN 0 THEN 'Gravel du soir' WHEN 1 THEN 'Sortie VTT' WHEN 2 THEN 'Morning ride' WHEN 3 THEN NULL ELSE 'Mountain loop' END AS name FROM {{events}})".replace("{{", "{").replace("}}", "}")
_NAMED = "CASE WHEN lower(name) LIKE '%gravel%' THEN 'gravel' WHEN lower(name) LIKE '%vtt%' OR lower(name) LIKE '%mtb%' OR lower(name) LIKE '%mountain%' THEN 'mtb' END"
_SUBS = " ".join(f"WHEN sub IN ({', '.join(map(str, subs))}) THEN '{sport}'" for sport, subs in SUB_SPORTS.items())
_FIT = f"""CASE WHEN sp IN {CYCLING} THEN CASE WHEN sub IS NULL OR sub IN {SUB_GENERIC} THEN 'road' {_SUBS} END WHEN sp IN {RUNNING} THEN 'running' END"""
_VALID = "IN ('road', 'gravel', 'mtb', 'offroad', 'running')"

SQL = {
    "c02_listing_types": f"WITH {_KINDS}, {_TYPES} SELECT event_id, t, k.sport, k.key IS NOT NULL AS known FROM (SELECT *, {_KEY} AS tk FROM ty) ty LEFT JOIN kinds k ON ty.tk = k.key",
    "c06_recording_types": f"WITH {_KINDS}, {_TYPES} SELECT event_id, t, k.sport, coalesce(k.skip, FALSE) AS skip, coalesce(k.generic, FALSE) AS generic FROM (SELECT *, {_KEY} AS tk FROM ty) ty LEFT JOIN kinds k ON ty.tk = k.key",
    "c07_fit_sports": f"SELECT event_id, sp, sub, {_FIT} AS sport, sp IN {CYCLING} AND (sub IS NULL OR sub IN {SUB_GENERIC}) AS generic FROM (SELECT event_id, CAST(event_id % 25 AS INT) AS sp, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(event_id / 25) AS INT) % 60 END AS sub FROM {{events}}) x",
    "c08_summary_types": f"WITH {_KINDS}, {_TYPES} SELECT event_id, t, name, CASE WHEN NOT told_generic THEN told END AS sport, CASE WHEN told_generic THEN coalesce({_NAMED}, 'road') END AS hint, coalesce(told_generic AND {_NAMED} IS NULL, FALSE) AS generic, coalesce(told_skip, FALSE) AS skip FROM (SELECT *, {_KEY} AS tk FROM ty) ty LEFT JOIN kinds k ON ty.tk = k.key",
    "c09_archive_cascade": f"""WITH {_KINDS}, {_TYPES},
a AS (SELECT event_id, CASE WHEN k.sport = 'road' THEN coalesce({_NAMED}, 'road') ELSE k.sport END AS s1, coalesce(k.generic AND {_NAMED} IS NULL, FALSE) AS g1, CAST(event_id % 23 AS INT) AS sp, CAST(floor(event_id / 3) AS INT) % 50 AS sub, CASE event_id % 11 WHEN 0 THEN 'mtb' WHEN 1 THEN 'road' END AS pick, CASE event_id % 13 WHEN 0 THEN 'mtb' WHEN 1 THEN 'running' END AS explicit, CASE event_id % 6 WHEN 0 THEN 'road' WHEN 1 THEN 'gravel' END AS hint FROM (SELECT *, {_KEY} AS tk FROM ty) ty LEFT JOIN kinds k ON ty.tk = k.key),
b AS (SELECT *, {_FIT} AS s2, sp IN {CYCLING} AND sub IN {SUB_GENERIC} AS g2, coalesce(hint = 'road', FALSE) AS g3 FROM a),
c AS (SELECT *, coalesce(CASE WHEN s1 {_VALID} THEN s1 END, s2, hint) AS first_one, coalesce(CASE WHEN s1 IN ('gravel', 'mtb') THEN s1 END, CASE WHEN s2 IN ('gravel', 'mtb') THEN s2 END, CASE WHEN hint IN ('gravel', 'mtb') THEN hint END) AS finer FROM b),
d AS (SELECT *, CASE WHEN first_one = 'road' AND finer IS NOT NULL THEN finer ELSE first_one END AS told FROM c)
SELECT event_id, CASE WHEN explicit IS NOT NULL THEN explicit ELSE coalesce(told, pick) END AS sport, explicit IS NULL AND coalesce(told = 'road' AND (s1 IS NULL OR g1) AND (s2 IS NULL OR g2) AND (hint IS NULL OR g3) AND coalesce(pick <> 'road', TRUE), FALSE) AS is_default FROM d""",
    "c10_queued_sport": "SELECT event_id, stored, CASE WHEN stored IS NULL OR stored = 'unknown' OR stored LIKE 'pick:%' THEN NULL ELSE stored END AS listed, CASE WHEN stored LIKE 'pick:_%' THEN substr(stored, 6) END AS picked FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pick:mtb' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL WHEN 3 THEN 'gravel' WHEN 4 THEN 'pick:' ELSE '' END AS stored FROM {events}) x".replace("stored IS NULL OR", "stored IS NULL OR stored = '' OR"),
    "c19_display_text": """SELECT event_id, CASE WHEN coalesce(m, 0) = 0 THEN '-' WHEN m >= 1000 THEN concat(CAST(CAST(floor(m / 100 + CAST(0.5 AS DOUBLE)) / 10 AS DECIMAL(12, 1)) AS STRING), ' km') ELSE concat(CAST(CAST(floor(m + CAST(0.5 AS DOUBLE)) AS BIGINT) AS STRING), ' m') END AS distance,
CASE WHEN minutes < 60 THEN concat(CAST(minutes AS STRING), ' min') WHEN minutes % 60 = 0 THEN concat(CAST(CAST(floor(minutes / 60) AS BIGINT) AS STRING), 'h') ELSE concat(CAST(CAST(floor(minutes / 60) AS BIGINT) AS STRING), 'h ', CAST(minutes % 60 AS STRING), 'm') END AS duration,
CASE WHEN size < 1024 THEN concat(CAST(size AS STRING), ' B') WHEN size < 1048576 THEN concat(CAST(CAST(floor(size / 1024) AS BIGINT) AS STRING), ' kB') ELSE concat(CAST(CAST(floor(size / 1048576) AS BIGINT) AS STRING), ' MB') END AS file_size
FROM (SELECT event_id, value * 37 AS m, event_id % 300 AS minutes, event_id * 4099 AS size FROM {events}) x""",
    "c21_promotion": "SELECT event_id, incoming, existing, coalesce(incoming = 'manual_upload', FALSE) AND coalesce(existing <> 'manual_upload', TRUE) AS promote FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'manual_upload' WHEN 1 THEN 'strava_api' END AS incoming, CASE event_id % 4 WHEN 0 THEN 'manual_upload' WHEN 1 THEN 'strava_api' WHEN 2 THEN 'garmin' END AS existing FROM {events}) x",
    "c23_synthetic_accounts": "SELECT c_custkey, lower(email) LIKE '%@strava.local' AND password IS NULL AS synthetic FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '@STRAVA.local') WHEN c_custkey % 3 = 1 THEN concat(c_name, '@example.org') ELSE concat(c_name, '@strava.local.example') END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS password FROM {customer}) x",
    "f16_owner_scope": "SELECT o.event_id AS asked, e.event_id AS found FROM (SELECT event_id, user_id FROM {events} WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id + 1 FROM {events} WHERE event_id % 3 = 1 UNION ALL SELECT event_id + 100000000, user_id FROM {events} WHERE event_id % 3 = 2) o LEFT JOIN {events} e ON e.event_id = o.event_id AND e.user_id = o.user_id",
    "f21_sport_chip": "SELECT chip, sport, count(*) AS n FROM (SELECT 'all' AS chip UNION ALL SELECT 'offroad' UNION ALL SELECT 'road' UNION ALL SELECT 'mtb') c JOIN (SELECT CASE user_id % 5 WHEN 0 THEN 'road' WHEN 1 THEN 'gravel' WHEN 2 THEN 'mtb' WHEN 3 THEN 'running' ELSE 'offroad' END AS sport FROM {events}) e ON chip = 'all' OR chip = 'offroad' AND sport IN ('mtb', 'offroad', 'gravel') OR chip = sport GROUP BY chip, sport",
}
