"""Arrivals merged into what is stored, and accounts merged into others, as set operations with the outcome of each row.

Keys decide first, by joins; what is left meets by time within one user. A user is a person, so the starts that a task
sorts and the rows of one stretch of starts are few; nothing else is gathered.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.pairing import resolve_pairs
from waymark.session import ensure_checkpoint_dir

#: The source that the community may see, minutes and share of the distance within which rides are twins.
COMMUNITY, NEAR_MINUTES, NEAR_SHARE = "manual_upload", 5, 0.05
SYNTHETIC = "@strava.local"


def roots(pointers: DataFrame) -> DataFrame:
    """node, root of pointers (node, target), one a node: where a chain of them ends, null if it runs in a circle.

    Each round doubles the stretch that a pointer skips, so a chain of n takes log2(n) rounds; rounds are kept as
    reliable checkpoints and only counts go to the driver."""
    ensure_checkpoint_dir(pointers.sparkSession)
    now = pointers.select("node", F.col("target").alias("root")).dropna().checkpoint()
    n, rounds = now.count(), 0
    while n and rounds <= n.bit_length() + 1:
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left")
        now = moved.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")).checkpoint()
        if not now.filter("on").limit(1).count():
            break
        now, rounds = now.drop("on"), rounds + 1
    else:
        now = now.withColumn("on", F.lit(False))
    nodes = now.select(F.col("node").alias("root"), F.lit(True).alias("again"))
    return now.join(nodes, "root", "left").select("node", F.when(F.col("again").isNull(), F.col("root")).alias("root"))


def promotes(incoming: Column, existing: Column) -> Column:
    """Whether a copy that the community may see comes upon one that it may not."""
    return incoming.eqNullSafe(F.lit(COMMUNITY)) & ~existing.eqNullSafe(F.lit(COMMUNITY))


def _twins(rows: pd.DataFrame) -> pd.DataFrame:
    """Walks through the arrivals of one stretch of one user's starts."""
    held = rows[rows["stored"]].to_dict("records")
    out = []
    for r in rows[~rows["stored"]].sort_values(["created_at", "id"], kind="stable").to_dict("records"):
        near = [h for h in held if abs((h["activity_date"] - r["activity_date"]).total_seconds()) <= NEAR_MINUTES * 60 and r["distance_m"] * (1 - NEAR_SHARE) <= h["distance_m"] <= r["distance_m"] * (1 + NEAR_SHARE)] if r["distance_m"] > 0 else []
        if not near:
            held.append(r)
            out.append((r["id"], r["id"], "created"))
            continue
        twin = min(near, key=lambda h: (h["source"] != COMMUNITY, h["created_at"], h["id"]))
        up = r["source"] == COMMUNITY and twin["source"] != COMMUNITY
        out.append((r["id"], twin["id"], "promoted" if up else "already_exists"))
        if up:
            twin["source"], twin["distance_m"] = COMMUNITY, r["distance_m"]
    return pd.DataFrame(out, columns=["id", "activity_id", "status"])


def _standing_twins(stored: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The outcome of each arrival that has a twin among the rides as they stand. Both meet in buckets of time as wide as
    the tolerance; a person starts few rides in three of them."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = NEAR_MINUTES * 60_000_000
    bucket = F.floor(micros("activity_date") / width)
    held = stored.withColumn("b", bucket).select("user_id", "b", F.struct(~F.col("source").eqNullSafe(F.lit(COMMUNITY)), "created_at", "id").alias("rank"), F.col("source").alias("held_source"), F.col("activity_date").alias("held_date"), F.col("distance_m").alias("held_m"))
    asked = arrivals.filter("distance_m > 0").withColumn("b", F.explode(F.array(*[bucket + k for k in (-1, 0, 1)])))
    near = (F.abs(micros("activity_date") - micros("held_date")) <= width) & F.col("held_m").between(F.col("distance_m") * (1 - NEAR_SHARE), F.col("distance_m") * (1 + NEAR_SHARE))
    twin = asked.join(held, ["user_id", "b"]).filter(near).groupBy("id").agg(F.min(F.struct("rank", promotes(F.col("source"), F.col("held_source")).alias("up"))).alias("t"))
    return twin.select("id", F.col("t.rank.id").alias("activity_id"), F.when(F.col("t.up"), "promoted").otherwise("already_exists").alias("status"), F.lit("twin").alias("by"))


def ingest(stored: DataFrame, incoming: DataFrame, standing: bool = False) -> DataFrame:
    """id, activity_id, status, by of each arrival; both tables have id, user_id, provider, provider_activity_id,
    file_hash, source, activity_date, distance_m and created_at.

    By provider id, then by file hash, then as the twin of a ride of the same user within five minutes and five
    per cent (the community's copy first, then the oldest), else created. A twin that the community may not see is
    promoted by an upload that it may. An arrival with the provider id or hash of an earlier arrival shares its
    activity and already exists. Arrivals count in order of created_at and id; a null key matches nothing, and one
    without a date or length has no twin. Standing: twins are rides as they stood before all arrivals, which then are no
    twins of each other and leave what others come upon as it was."""
    ensure_checkpoint_dir(incoming.sparkSession)
    new = incoming.checkpoint()
    keys = {"provider_id": ["user_id", "provider", "provider_activity_id"], "file_hash": ["user_id", "file_hash"]}
    # Arrivals that repeat a key of an earlier one point to it.
    first = lambda cols: F.first("id").over(Window.partitionBy(*cols).orderBy("created_at", "id"))
    known = lambda cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    leads = [new.filter(known(cols)).select("id", first(cols).alias("lead"), F.lit(k).alias("by")) for k, cols in keys.items()]
    pointer = leads[0].unionByName(leads[1]).filter("id <> lead").groupBy("id").agg(F.min(F.struct(F.col("by") != "provider_id", "lead", "by")).alias("p"))
    pointer = pointer.select("id", "p.lead", "p.by").checkpoint()
    ends = roots(pointer.select(F.col("id").alias("node"), F.col("lead").alias("target")))
    rest, found = new.join(pointer.select("id"), "id", "left_anti"), []
    for k, cols in keys.items():
        there = stored.filter(known(cols)).groupBy(*cols).agg(F.min(F.struct("created_at", F.col("id").alias("activity_id"))).alias("at"))
        hit = rest.filter(known(cols)).join(there, cols).select("id", F.col("at.activity_id").alias("activity_id"), F.lit("already_exists").alias("status"), F.lit(k).alias("by")).checkpoint()
        found.append(hit)
        rest = rest.join(hit.select("id"), "id", "left_anti")
    columns = ["id", "user_id", "source", "activity_date", "distance_m", "created_at"]
    dated = lambda df: df.select(*columns).dropna(subset=["user_id", "activity_date", "distance_m"])
    if standing:
        twins = _standing_twins(dated(stored), dated(rest)).checkpoint()
    else:
        both = dated(stored).withColumn("stored", F.lit(True)).unionByName(dated(rest).withColumn("stored", F.lit(False)))
        by_user = Window.partitionBy("user_id").orderBy("activity_date", "id")
        gap = F.unix_micros(F.col("activity_date").cast("timestamp")) - F.unix_micros(F.lag("activity_date").over(by_user).cast("timestamp"))
        stretch = both.withColumn("cut", F.when(gap <= NEAR_MINUTES * 60_000_000, 0).otherwise(1)).withColumn("stretch", F.sum("cut").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
        sized = stretch.withColumn("arrivals", F.count_if(~F.col("stored")).over(Window.partitionBy("user_id", "stretch"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "stretch"))).filter("arrivals > 0 AND n > 1")
        kind = dict(incoming.dtypes)["id"]
        twins = sized.groupBy("user_id", "stretch").applyInPandas(lambda pdf: _twins(pdf), f"id {kind}, activity_id {kind}, status string").withColumn("by", F.lit("twin")).checkpoint()
    alone = rest.join(twins.select("id"), "id", "left_anti").select("id", F.col("id").alias("activity_id"), F.lit("created").alias("status"), F.lit(None).cast("string").alias("by"))
    told = twins.withColumn("by", F.when(F.col("status") != "created", F.col("by"))).unionByName(alone)
    for hit in found:
        told = told.unionByName(hit)
    told = told.checkpoint()
    shared = pointer.join(ends, pointer["id"] == ends["node"]).select("id", "by", F.col("root").alias("lead")).join(told.select(F.col("id").alias("lead"), "activity_id"), "lead")
    return told.unionByName(shared.select("id", "activity_id", F.lit("already_exists").alias("status"), "by"))


def ingested(stored: DataFrame, incoming: DataFrame, outcomes: DataFrame, replaced: tuple[str, ...] = ("distance_m", "elevation_gain_m", "file_hash", "geometry"), each: bool = False) -> DataFrame:
    """stored after ingest(): what was created is added; a promoted row has the source and consent of its upload and of
    `replaced`, where there are such columns, what the upload has (of several the last; each: a row for each of them); a row found by provider id gets a missing
    date."""
    told = incoming.join(outcomes.select("id", "activity_id", "status", "by"), "id")
    order = F.struct("created_at", "id")
    up = F.struct(*[F.col(c) for c in incoming.columns])
    promoted = told.filter("status = 'promoted'")
    ups = promoted.select("activity_id", up.alias("up")) if each else promoted.groupBy("activity_id").agg(F.max_by(up, order).alias("up"))
    dates = told.filter("by = 'provider_id' AND activity_date IS NOT NULL").groupBy("activity_id").agg(F.min_by("activity_date", order).alias("date"))
    added = told.filter("status = 'created'").select(*[F.col(c) for c in stored.columns])
    kept = stored.unionByName(added).join(ups, F.col("id") == ups["activity_id"], "left").drop("activity_id").join(dates, F.col("id") == dates["activity_id"], "left").drop("activity_id")
    values = {}
    for c in stored.columns:
        if c in ("source", "contribute"):
            values[c] = F.when(F.col("up").isNotNull(), F.col(f"up.{c}")).otherwise(F.col(c))
        elif c in replaced:
            values[c] = F.coalesce(F.col(f"up.{c}"), F.col(c))
        elif c == "activity_date":
            values[c] = F.coalesce(F.col(c), F.col("date"))
    return kept.withColumns(values).select(stored.columns)


def merge_owners(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """absorbed, survivor, owner and outcome of pairs (absorbed, survivor, rank), one a row; of an account's pairs the
    first by rank counts ('repeated': the others).

    Only accounts of the synthetic kind, without a password, may be absorbed ('refused' otherwise); both must be users
    ('missing'). Chains end at the account that is absorbed by none; pairs that run in a circle merge nothing
    ('circle')."""
    known = users.select("user_id", (F.lower("email").endswith(SYNTHETIC) & F.col("hashed_password").isNull()).alias("synthetic"))
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("absorbed").orderBy("rank", "survivor")))
    met = ranked.join(known.select(F.col("user_id").alias("absorbed"), F.coalesce("synthetic", F.lit(False)).alias("synthetic")), "absorbed", "left").join(known.select(F.col("user_id").alias("survivor"), F.lit(True).alias("there")), "survivor", "left")
    said = F.when(F.col("synthetic").isNull() | F.col("there").isNull(), "missing").when(F.col("absorbed") == F.col("survivor"), "same").when(~F.col("synthetic"), "refused").when(F.col("k") > 1, "repeated").otherwise("merged")
    told = met.select("absorbed", "survivor", "rank", said.alias("outcome")).checkpoint()
    ends = roots(told.filter("outcome = 'merged'").select(F.col("absorbed").alias("node"), F.col("survivor").alias("target")))
    out = told.join(ends, told["absorbed"] == ends["node"], "left")
    merged = F.col("outcome") == "merged"
    return out.select("absorbed", "survivor", F.when(merged, F.col("root")).alias("owner"), F.when(merged & F.col("root").isNull(), "circle").otherwise(F.col("outcome")).alias("outcome"))


def duplicate_rides(activities: DataFrame, owners: DataFrame) -> DataFrame:
    """id of each ride to drop as accounts merge: of two of one future owner, one of them absorbed, that share a provider
    id, or are within five minutes and five per cent, the one that the community may not see, else the absorbed one.
    Each ride of a survivor is paired once, in the order of ids."""
    mapped = activities.join(owners.filter("outcome = 'merged'").select(F.col("absorbed").alias("user_id"), F.col("owner")), "user_id", "left")
    a = mapped.filter("owner IS NOT NULL").select(F.col("id").alias("absorbed"), "owner", F.col("source").alias("a_source"), F.col("provider"), F.col("provider_activity_id"), F.col("activity_date").alias("at"), F.col("distance_m").alias("am"))
    s = mapped.filter("owner IS NULL").select(F.col("id").alias("survivor"), F.col("user_id").alias("owner"), F.col("source").alias("s_source"), F.col("provider"), F.col("provider_activity_id"), F.col("activity_date").alias("st"), F.col("distance_m").alias("sm"))
    by_key = a.join(s, ["owner", "provider", "provider_activity_id"])
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (NEAR_MINUTES * 60))
    near = a.filter("am > 0").drop("provider", "provider_activity_id").withColumn("b", F.explode(F.array(*[bucket("at") + k for k in (-1, 0, 1)]))).join(s.drop("provider", "provider_activity_id").withColumn("b", bucket("st")), ["owner", "b"])
    near = near.filter((F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("st").cast("timestamp"))) <= NEAR_MINUTES * 60_000_000) & F.col("sm").between(F.col("am") * (1 - NEAR_SHARE), F.col("am") * (1 + NEAR_SHARE)))
    both = by_key.select("absorbed", "survivor", "a_source", "s_source").unionByName(near.select("absorbed", "survivor", "a_source", "s_source"))
    taken = resolve_pairs(both.select("absorbed", "survivor", F.struct("absorbed", "survivor").alias("rank"), promotes(F.col("a_source"), F.col("s_source")).alias("keep_absorbed")))
    return taken.select(F.when(F.col("keep_absorbed"), F.col("survivor")).otherwise(F.col("absorbed")).alias("id")).distinct()


def reassigned(table: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """table with the owner of each absorbed account's rows replaced; other rows, nulls among them, as they are."""
    moves = owners.filter("outcome = 'merged'").select(F.col("absorbed").alias("_absorbed"), F.col("owner").alias("_owner"))
    return table.join(moves, F.col(owner) == F.col("_absorbed"), "left").withColumn(owner, F.coalesce("_owner", owner)).select(table.columns)


def merge_accounts(pairs: DataFrame, users: DataFrame, activities: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The outcome of each pair, and users, activities and the other tables (name: table and owner column) after it:
    duplicate rides dropped, all else reassigned, absorbed users gone."""
    ensure_checkpoint_dir(users.sparkSession)
    owners = merge_owners(pairs, users).checkpoint()
    gone = owners.filter("outcome = 'merged'").select(F.col("absorbed").alias("user_id"))
    after = {"users": users.join(gone, "user_id", "left_anti").select(users.columns)}
    after["activities"] = reassigned(activities.join(duplicate_rides(activities, owners), "id", "left_anti").select(activities.columns), "user_id", owners)
    return owners, after | {name: reassigned(t, c, owners) for name, (t, c) in tables.items()}
