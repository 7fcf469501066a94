"""Type names, cascades and defaults, by cases."""

import pytest
from pyspark.sql import functions as F

from waymark.plans import kinds

CASES = {
    "GravelRide": ("gravel", False, False), "gravel_ride": ("gravel", False, False), "Gravel Ride": ("gravel", False, False), "Mountain Bike Ride": ("mtb", False, False),
    "Yoga": (None, True, False), "VirtualRide": (None, True, False), "Zwift": (None, False, False), "cycling": (None, False, False), "1": (None, False, False), "9": ("running", False, False),
    "E-Bike Ride": ("road", False, True), "Vélo": ("road", False, True), "Vélo de route": ("road", False, False), "Ride": (None, False, False), "Velomobile": ("road", False, False),
    "Randonnée": ("running", False, False), "motorbike": (None, True, False), "Natation": (None, True, False), "": (None, False, False), None: (None, False, False), "—": (None, False, False),
}


def test_recording_types(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string")
    assert {r["t"]: (r["sport"], r["skip"], r["generic"]) for r in kinds.classified(rows, "t").collect()} == CASES


def test_summary_types():
    told = {r[0]: r[4:] for r in kinds.dimension()}
    assert told["cycling"] == ("road", False, True) == told["ebikefitness"] == told["bike"]
    assert told["enduromtb"] == ("mtb", False, False) and told["ultrarun"] == ("running", False, False)
    assert told["indoorcycling"] == (None, True, False) and "tennisv2" not in told


@pytest.mark.parametrize(("said", "want"), [
    ([("road", True), ("mtb", False)], ("mtb", False)),
    ([("road", True), ("road", True)], ("road", True)),
    ([("road", True), ("road", False)], ("road", False)),
    ([("gravel", False), ("mtb", False)], ("gravel", False)),
    ([(None, False), ("running", False), ("mtb", False)], ("running", False)),
    ([("unknown", False), (None, False)], (None, False)),
    ([("road", False), ("running", False)], ("road", False)),
    ([(None, True)], (None, False)),
])
def test_cascade(spark, said, want):
    df = spark.createDataFrame([tuple(x for pair in said for x in pair)], ", ".join(f"s{i} string, g{i} boolean" for i in range(len(said))))
    sport, default = kinds.cascade(*[(F.col(f"s{i}"), F.col(f"g{i}")) for i in range(len(said))])
    assert tuple(df.select(sport, default).first()) == want


def test_generic_names(spark):
    names = ["Gravel du soir", "Sortie VTT", "mountain loop", "Morning", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(kinds.by_name(F.col("n"))).collect()] == ["gravel", "mtb", "mtb", None, None]


def test_folding_takes_compatibility_forms_apart(spark):
    from waymark.functions.text import folded

    said = ["Śłōw Ride Ångström ﬁ", "Ⅳ½²", "Vélo électrique", "", None, "Straße №1"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string")
    assert [r[0] for r in df.orderBy("k").select(folded("s")).collect()] == ["sowrideangstromfi", "iv122", "veloelectrique", "", None, "straeNo1"]
