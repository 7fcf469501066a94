"""Ingest, account merges and the change feed against walks over the rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waymark.operators import accounts, changes

RIDE = "id long, user_id long, provider string, provider_activity_id string, file_hash string, source string, activity_date timestamp, distance_m double, created_at timestamp, contribute boolean, geometry string"
NOON = datetime(2024, 5, 1, 12)


def ride(i, user, pid=None, fhash=None, source="strava_api", minute=0.0, metres=1000.0, at=None, provider="file"):
    when = None if minute is None else NOON + timedelta(minutes=minute)
    return (i, user, provider, pid, fhash, source, when, metres, NOON + timedelta(seconds=i if at is None else at), source == "manual_upload", f"g{i}")


def walk(stored, incoming):
    """A row at a time, as arrivals come."""
    held = [dict(zip("id user provider pid hash source at metres created".split(), r)) for r in stored]
    out = {}
    for r in sorted(incoming, key=lambda r: (r[8], r[0])):
        n = dict(zip("id user provider pid hash source at metres created".split(), r))
        own = [h for h in held if h["user"] == n["user"]]
        hit = lambda f: min((h for h in own if f(h)), key=lambda h: (h["created"], h["id"]), default=None)
        by = "provider_id"
        found = hit(lambda h: n["pid"] is not None and (h["provider"], h["pid"]) == (n["provider"], n["pid"]))
        if found is None:
            by, found = "file_hash", hit(lambda h: n["hash"] is not None and h["hash"] == n["hash"])
        if found is not None:
            out[n["id"]] = (found["id"], "already_exists", by)
            continue
        near = [h for h in own if n["at"] and h["at"] and n["metres"] and h["metres"] and abs((h["at"] - n["at"]).total_seconds()) <= 300 and n["metres"] * 0.95 <= h["metres"] <= n["metres"] * 1.05]
        if near:
            twin = min(near, key=lambda h: (h["source"] != "manual_upload", h["created"], h["id"]))
            up = n["source"] == "manual_upload" and twin["source"] != "manual_upload"
            out[n["id"]] = (twin["id"], "promoted" if up else "already_exists", "twin")
            if up:
                twin["source"], twin["metres"] = n["source"], n["metres"]
            continue
        held.append(n)
        out[n["id"]] = (n["id"], "created", None)
    return out


def test_ingest_equals_a_walk(spark):
    r = random.Random(6)
    stored = [ride(k, r.randrange(4), pid=f"p{k}" if k % 2 else None, fhash=f"h{k}" if k % 3 else None, source=r.choice(["strava_api", "manual_upload", None]), minute=r.choice([None, r.uniform(0, 400)]), metres=r.choice([None, 0.0, 1000.0, r.uniform(900, 1100)])) for k in range(40)]
    incoming = [ride(1000 + k, r.randrange(4), pid=r.choice([None, None, f"q{k}"]), fhash=r.choice([None, f"n{k}"]), source=r.choice(["strava_api", "manual_upload"]), minute=r.choice([None, r.uniform(0, 400)]), metres=r.choice([None, 0.0, r.uniform(900, 1100)]), at=5000 + r.randrange(30)) for k in range(80)]
    for k in range(12):  # keys of what is stored, whoever has it
        s = r.choice(stored)
        incoming.append(ride(2000 + k, s[1] if k % 4 else 9, pid=s[3], fhash=s[4], minute=None, at=6000 + k))
    for k, s in enumerate(stored):  # uploads of what is stored, some from a source that the community may not see
        if s[6] and s[7]:
            incoming.append(ride(2500 + k, s[1], source="manual_upload", minute=(s[6] - NOON).total_seconds() / 60 + 2, metres=s[7] * 1.02, at=6500 + k))
    for k, i in enumerate(incoming[:10]):  # again in one batch
        incoming.append(ride(3000 + k, i[1], pid=i[3], fhash=i[4] or f"x{k}", minute=None, at=7000 + k))
    got = accounts.ingest(spark.createDataFrame(stored, RIDE), spark.createDataFrame(incoming, RIDE)).collect()
    assert len(got) == len(incoming)
    want = walk(stored, incoming)
    mine = {x["id"]: (x["activity_id"], x["status"], x["by"]) for x in got}
    keyless = {i for i in mine if i >= 3000}  # these share the fate of an earlier arrival that need not be stored
    assert {i: v for i, v in mine.items() if i not in keyless} == {i: v for i, v in want.items() if i not in keyless}
    assert all(mine[3000 + k][0] == mine[i[0]][0] for k, i in enumerate(incoming[:10]) if i[3] or i[4])
    assert {v[1] for v in mine.values()} == {"created", "promoted", "already_exists"}


def test_ingested_table(spark):
    stored = [ride(1, 7, pid="a", minute=None), ride(2, 7, minute=30), ride(3, 7, minute=60)]
    incoming = [ride(11, 7, pid="a", minute=500), ride(12, 7, fhash="f", source="manual_upload", minute=31, metres=1010.0), ride(13, 7, source="manual_upload", minute=200)]
    s, n = spark.createDataFrame(stored, RIDE), spark.createDataFrame(incoming, RIDE)
    rows = {r["id"]: r for r in accounts.ingested(s, n, accounts.ingest(s, n)).collect()}
    assert sorted(rows) == [1, 2, 3, 13]
    assert rows[1]["activity_date"] == NOON + timedelta(minutes=500) and rows[1]["geometry"] == "g1"
    assert (rows[2]["source"], rows[2]["geometry"], rows[2]["distance_m"], rows[2]["file_hash"], rows[2]["contribute"], rows[2]["activity_date"]) == ("manual_upload", "g12", 1010.0, "f", True, NOON + timedelta(minutes=30))
    assert tuple(rows[3]) == stored[2] and tuple(rows[13]) == incoming[2]


def test_chains_end_where_they_end(spark):
    links = [(k, k - 1) for k in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, None)]
    got = dict(accounts.roots(spark.createDataFrame(links, "node long, target long")).collect())
    assert got == {**{k: 0 for k in range(1, 70)}, 100: None, 101: None, 102: None, 103: None}
    assert accounts.roots(spark.createDataFrame([], "node long, target long")).collect() == []


def test_a_chain_of_four_accounts(spark):
    users = spark.createDataFrame([(k, f"u{k}@strava.local", None) for k in (1, 2, 3, 6, 7)] + [(4, "Real@x.org", "pw"), (5, "V@STRAVA.local", "pw")], "user_id long, email string, hashed_password string")
    pairs = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (3, 4, 2), (5, 4, 3), (9, 4, 4), (1, 4, 5), (6, 7, 6), (7, 6, 7)], "absorbed long, survivor long, rank long")
    rides = [ride(10, 4, pid="same"), ride(11, 1, pid="same"), ride(12, 2, minute=100.0), ride(13, 4, minute=104.0), ride(14, 3, source="manual_upload", minute=200.0), ride(15, 4, minute=201.0, metres=1040.0), ride(16, 1, minute=300.0), ride(17, 5, minute=400.0), ride(18, 6, minute=0.0)]
    routes = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 6), (5, 5)], "route long, owner_id long")
    owners, after = accounts.merge_accounts(pairs, users, spark.createDataFrame(rides, RIDE), {"routes": (routes, "owner_id"), "trips": (routes.withColumnRenamed("owner_id", "o"), "o")})
    assert {(r["absorbed"], r["survivor"]): (r["owner"], r["outcome"]) for r in owners.collect()} == {(1, 2): (4, "merged"), (2, 3): (4, "merged"), (3, 4): (4, "merged"), (5, 4): (None, "refused"), (9, 4): (None, "missing"), (1, 4): (None, "repeated"), (6, 7): (None, "circle"), (7, 6): (None, "circle")}
    assert {r["user_id"] for r in after["users"].collect()} == {4, 5, 6, 7}
    assert {(r["id"], r["user_id"]) for r in after["activities"].collect()} == {(10, 4), (13, 4), (14, 4), (16, 4), (17, 5), (18, 6)}
    assert {tuple(r) for r in after["routes"].collect()} == {tuple(r) for r in after["trips"].collect()} == {(1, 4), (2, 4), (3, None), (4, 6), (5, 5)}


def test_feed_replays_to_the_same_table(spark, tmp_path):
    base = spark.createDataFrame([(k, "road" if k % 2 else None, k % 3 == 0) for k in range(30)], "id long, sport string, vague boolean")
    one, feed1 = changes.update(base, "id", F.col("vague"), {"sport": F.lit("gravel"), "vague": F.lit(False)})
    changed = feed1.collect()
    assert {r["key"] for r in changed} == set(range(0, 30, 3)) and all(r["before"]["vague"] and r["after"]["sport"] == "gravel" for r in changed)
    planned = base.select("id", "sport")  # planned before the first update: what it changed is no longer so
    two, feed2 = changes.update(one, "id", F.col("sport").isNotNull(), {"sport": F.lit("mtb")}, expected=planned)
    assert {r["key"] for r in feed2.collect()} == {k for k in range(30) if k % 2 and k % 3}
    three = two.filter("id <> 5").unionByName(spark.createDataFrame([(99, "new", None)], base.schema))
    path = str(tmp_path / "feed")
    for v, feed in enumerate([feed1, feed2, changes.difference(two, three, "id")], 1):
        changes.append(feed, path, v)
        changes.append(feed, path, v)  # a retry
    rows = lambda df: sorted(map(tuple, df.collect()))
    for upto, want in ((1, one), (2, two), (3, three), (None, three)):
        assert rows(changes.replayed(base, changes.feeds(spark, path, upto=upto), "id")) == rows(want)
    assert rows(changes.replayed(one, changes.feeds(spark, path, since=1), "id")) == rows(three)
    kinds = {(r["key"], r["kind"]) for r in changes.feeds(spark, path, since=2).collect()}
    assert kinds == {(5, "delete"), (99, "insert")}


def test_no_change_is_no_feed(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    same, feed = changes.update(base, "id", F.lit(True), {"v": F.col("v")})
    assert feed.count() == 0 and same.count() == 2 and changes.difference(base, same, "id").count() == 0
    assert changes.difference(base, base.withColumn("v", F.lit("x")), "id", watched=["id"]).count() == 0
