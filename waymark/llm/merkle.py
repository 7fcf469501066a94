"""A Merkle manifest of a dataset: a tree of SHA-256 digests for each source, and one over the sources.

Leaves are digests of whole rows, made where the rows are read; from there on only ids and digests move. A range
exchange puts them in order, and prefix sums over its partitions give each its place among the leaves of its source, so
a source that holds a third of all rows is spread like any other. Places fall into aligned buckets of FAN ** 3 leaves:
whatever the size of the tree, the lowest levels of a bucket need nothing outside it. Executors get whole buckets as
Arrow tables and let DuckDB build their levels, an ordered string_agg and a sha256 each; Spark combines the buckets'
roots, FAN at a time, into subroots and the root, hands every bucket the siblings above it as one more row of its
stream, and a second pass over the buckets takes the leaves' proofs and folds them.

A task holds at most two buckets and one batch; nothing is broadcast but a row per partition of the range exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, join_hot

FAN, LEVELS = 16, 3
PARTITION_ROWS = 250_000
#: Leaves that a DuckDB run takes at once, beside the bucket that ends them.
BATCH_LEAVES = 8192
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(fields: list[Column]) -> Column:
    """SHA-256, in hex, of the fields one after another: `-` for a null, else UTF-8 byte count, `:` and value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(df: DataFrame, by: list[str]) -> DataFrame:
    """df, which has a non-null text column g, with place: 0, 1, ... along each g in the order of by (nulls first), rows
    alike in any order. df is read twice: checkpoint it."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PARTITION_ROWS))
    keys = ["g", *by, "tie"]
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    run = Window.partitionBy("pid", "g").orderBy(*by, "tie")
    dealt = checkpointed(dealt).withColumn("inside", F.row_number().over(run) - 1)
    ends = checkpointed(dealt.groupBy("pid").agg(F.min("g").alias("first"), F.max(F.struct("g", "inside")).alias("last")))  # a row per partition
    # Only the group with which a partition begins can have begun before it, and ended the partitions where it did.
    met = ends.select("pid", F.col("last.g").alias("g"), (F.col("last.inside") + 1).alias("rows"), F.lit(False).alias("asks"))
    met = met.unionByName(ends.select("pid", F.col("first").alias("g"), F.lit(0).alias("rows"), F.lit(True).alias("asks")))
    before = met.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("g").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.filter("asks").select("pid", F.col("g").alias("first"), "before")
    return dealt.join(F.broadcast(before), "pid").withColumn("place", F.col("inside") + F.when(F.col("g") == F.col("first"), F.col("before")).otherwise(0)).drop("pid", "tie", "inside", "first", "before")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stream, which is sorted by g and bucket, in tables that cut no bucket in two."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows <= BATCH_LEAVES:
            continue
        t = pa.Table.from_batches(held)
        g, k = t["g"].to_pylist(), t["bucket"].to_pylist()
        cut = len(k) - 1
        while cut and (g[cut - 1], k[cut - 1]) == (g[-1], k[-1]):
            cut -= 1
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        rows = len(k) - cut
    if rows:
        yield pa.Table.from_batches(held)


def _levels(fan: int, levels: int) -> list[str]:
    """The levels of all buckets of table `stream` (g, bucket, pos, leaf, ...; pos is null for what is no leaf) as
    tables l1, l2, ... of (b, pos, run, h); a bucket has as many as it needs to come down to one node, and all if its
    source has other buckets."""
    full = " ".join(f"WHEN count(*) <= {fan**k} AND bucket = 0 THEN {k}" for k in range(levels))
    made = [
        "CREATE TABLE nodes AS SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY g, bucket) AS b, * FROM stream",
        f"CREATE TABLE depth AS SELECT b, CASE {full} ELSE {levels} END AS d FROM nodes WHERE pos IS NOT NULL GROUP BY b, bucket",
        "CREATE TABLE l0 AS SELECT b, pos, leaf AS h FROM nodes WHERE pos IS NOT NULL",
    ]
    for k in range(1, levels + 1):
        made.append(f"CREATE TABLE l{k} AS SELECT *, sha256(run) AS h FROM (SELECT b, pos // {fan} AS pos, string_agg(h, '' ORDER BY l.pos) AS run FROM l{k - 1} l JOIN depth USING (b) WHERE d >= {k} GROUP BY b, l.pos // {fan})")
    return made


def _roots_sql(levels: int) -> str:
    tops = " UNION ALL ".join(f"SELECT b, h FROM l{k} JOIN depth USING (b) WHERE d = {k}" for k in range(levels + 1))
    return f"SELECT any_value(g) AS g, any_value(bucket) AS bucket, any_value(t.h) AS h FROM nodes JOIN ({tops}) t USING (b) GROUP BY b"


def _proofs_sql(fan: int, levels: int, outer: int) -> str:
    """For each leaf: leaf, subroot, root, proof (all siblings), folded (the altered or else the same leaf, folded)."""
    sides = ", ".join(f"left(l{k}.run, 64 * (n.pos // {fan ** (k - 1)} % {fan})) AS a{k}, substr(l{k}.run, 64 * (n.pos // {fan ** (k - 1)} % {fan}) + 65) AS z{k}" for k in range(1, levels + 1))
    joins = " ".join(f"LEFT JOIN l{k} ON l{k}.b = n.b AND l{k}.pos = n.pos // {fan**k}" for k in range(1, levels + 1))
    sql = f"WITH f0 AS (SELECT n.r, n.id, n.leaf, coalesce(n.altered, n.leaf) AS f, o.subroot, o.root, o.lefts, o.rights, {sides} FROM nodes n JOIN nodes o ON o.b = n.b AND o.pos IS NULL {joins} WHERE n.pos IS NOT NULL)"
    for k in range(1, levels + 1):
        sql += f", f{k} AS (SELECT * REPLACE (CASE WHEN a{k} IS NULL THEN f ELSE sha256(concat(a{k}, f, z{k})) END AS f) FROM f{k - 1})"
    for k in range(1, outer + 1):
        sql += f", f{levels + k} AS (SELECT * REPLACE (CASE WHEN len(lefts) < {k} THEN f ELSE sha256(concat(lefts[{k}], f, rights[{k}])) END AS f) FROM f{levels + k - 1})"
    inner = ", ".join(f"a{k}, z{k}" for k in range(1, levels + 1))
    above = "list_aggregate(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), 'string_agg', '')"
    return sql + f" SELECT id, leaf, subroot, root, concat({inner}, coalesce({above}, '')) AS proof, f AS folded FROM f{levels + outer} ORDER BY r"


def _duck(tables: Iterator[pa.Table], fan: int, levels: int, wanted) -> Iterator[pa.Table]:
    """Each table of whole buckets through the level queries and then the query wanted(connection)."""
    for t in tables:
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("stream", t)
            for sql in _levels(fan, levels):
                con.execute(sql)
            yield con.execute(wanted(con)).to_arrow_table()


def climb(nodes: DataFrame, most: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Of trees over nodes g, idx, h, n (nodes of g, most at most): tops g, h, and for each node its paths g, idx, lefts,
    rights (the digests left and right of the way, level by level)."""
    none = F.array().cast("array<string>")
    tops, levels = [], []
    while True:
        tops.append(nodes.filter("n = 1"))
        if most <= 1:
            break
        runs = nodes.filter("n > 1").groupBy("g", F.floor(F.col("idx") / fan).alias("up"), F.ceil(F.col("n") / fan).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("hs"))
        runs = checkpointed(runs)  # fan digests a row at most
        child = runs.select("g", "up", "hs", F.explode(F.sequence(F.lit(0), F.size("hs") - 1)).alias("i"))
        levels.append(child.select("g", "up", (F.col("up") * fan + F.col("i")).alias("idx"), F.array_join(F.slice("hs", F.lit(1), F.col("i")), "").alias("left"), F.array_join(F.slice("hs", F.col("i") + 2, F.lit(fan)), "").alias("right")))
        nodes = runs.select("g", F.col("up").alias("idx"), F.sha2(F.array_join("hs", "").cast("binary"), 256).alias("h"), "n")
        most = -(-most // fan)
    ends = [t.select("g", "idx", none.alias("lefts"), none.alias("rights")) for t in tops]
    paths = ends[-1]
    for level, end in zip(reversed(levels), reversed(ends[:-1])):
        above = paths.withColumnRenamed("idx", "up")
        longer = level.join(above, ["g", "up"]).select("g", "idx", F.concat(F.array("left"), "lefts").alias("lefts"), F.concat(F.array("right"), "rights").alias("rights"))
        paths = longer.unionByName(end)
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return found.select("g", "h"), paths


def prove(docs: DataFrame, id_col="doc_id", group_col="source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None, alter: dict[str, Column] | None = None, proofs: bool = False, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: id, leaf, subroot of its source, root, proof_sha256 (of all siblings on its way to the
    root), folded_root (the leaf, or for rows where `altered` holds that of the row with the columns in `alter` replaced,
    folded with those siblings), verified (folded_root is the root); and the siblings themselves with proofs.

    A source's leaves ascend by id, nulls first, then by leaf, so repeated rows have places of their own and any order of
    them gives one tree. The null source comes first. Columns other than those named are ignored, whatever their names; a
    null field and an empty one have different leaves. An empty table gives an empty result."""
    spark = docs.sparkSession
    leaf = digest([F.col(f) for f in fields])
    again = digest([(alter or {}).get(f, F.col(f)) for f in fields])
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, and never null
    leaves = checkpointed(docs.select(F.col(id_col).alias("id"), g.alias("g"), leaf.alias("leaf"), F.when(F.lit(False) if altered is None else altered, again).alias("altered")))
    width = fan**levels
    bucketed = checkpointed(placed(leaves, ["id", "leaf"]).select("id", "g", "leaf", "altered", F.floor(F.col("place") / width).alias("bucket"), (F.col("place") % width).alias("pos")))
    kind = dict(bucketed.dtypes)["id"]
    dealt = lambda df: df.repartition("g", "bucket").sortWithinPartitions("g", "bucket", F.col("pos").asc_nulls_first())

    def roots(batches):
        for t in _duck(_whole(batches), fan, levels, lambda con: _roots_sql(levels)):
            yield from t.to_batches()

    tops = checkpointed(dealt(bucketed.select("g", "bucket", "pos", "leaf")).mapInArrow(roots, "g string, bucket long, h string"))
    count = checkpointed(tops.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    most = count.agg(F.max("n")).first()[0] or 1
    subroots, inside = climb(join_hot(tops.withColumnRenamed("bucket", "idx"), count, "g"), most, fan)
    subroots = checkpointed(subroots)
    sources = subroots.count()
    ranked = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), ["source"])
    ranked = checkpointed(ranked.select("g", "source", F.col("place").alias("idx"), "h", F.lit(sources).cast("long").alias("n")))
    whole, outside = climb(ranked.drop("source"), sources, fan)
    way = ranked.select("idx", F.col("source").alias("g"), F.col("h").alias("subroot")).join(outside.drop("g"), "idx").withColumnsRenamed({"lefts": "a", "rights": "z"}).drop("idx")
    root = whole.first()  # one row, or none if the table is empty
    way = checkpointed(way.join(count, "g").withColumn("root", F.lit(root and root["h"]).cast("string")))
    above = join_hot(inside, way, "g").select("g", F.col("idx").alias("bucket"), F.concat("lefts", "a").alias("lefts"), F.concat("rights", "z").alias("rights"), "subroot", "root")
    stream = dealt(bucketed.unionByName(above, allowMissingColumns=True))
    names = fresh(docs.select(id_col), "leaf", "subroot", "root", "proof", "folded")

    def fold(batches):
        steps = lambda con: con.execute("SELECT coalesce(max(len(lefts)), 0) FROM nodes").fetchone()[0]
        for t in _duck(_whole(batches), fan, levels, lambda con: _proofs_sql(fan, levels, steps(con))):
            yield from t.to_batches(max_chunksize=BATCH_LEAVES)

    folded = stream.mapInArrow(fold, f"id {kind}, leaf string, subroot string, root string, proof string, folded string")
    return folded.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), *["proof"] * proofs)


def lower_capitals(text: Column) -> Column:
    """text with A-Z, and no other letters, in lower case."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


def duckdb_sql(levels: int = 5, above: int = 3) -> str:
    """The rows of the query in one statement, for up to 16 ** levels documents a source and 16 ** above sources."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    tree = lambda n, k: f"""r{n}{k + 1} AS (SELECT s, pos // 16 AS pos, string_agg(h, '' ORDER BY {n}{k}.pos) AS run, any_value(n) AS n FROM {n}{k} WHERE n > 1 GROUP BY s, {n}{k}.pos // 16),
{n}{k + 1} AS (SELECT s, pos, sha256(run) AS h, (n + 15) // 16 AS n FROM r{n}{k + 1} UNION ALL SELECT s, pos, h, n FROM {n}{k} WHERE n = 1)"""  # noqa: E731
    ups = [("d", k) for k in range(1, levels + 1)] + [("e", k) for k in range(1, above + 1)]
    place = {"d": "q.pos", "e": "q.src"}
    sides = ", ".join(f"left(r{n}{k}.run, 64 * ({place[n]} // {16 ** (k - 1)} % 16)::INT) AS a{n}{k}, substr(r{n}{k}.run, 64 * ({place[n]} // {16 ** (k - 1)} % 16) + 65) AS z{n}{k}" for n, k in ups)
    joins = " ".join(f"LEFT JOIN r{n}{k} ON r{n}{k}.s IS NOT DISTINCT FROM {'q.s' if n == 'd' else '0'} AND r{n}{k}.pos = {place[n]} // {16**k}" for n, k in ups)
    folds, last = "", "p"
    for n, k in ups:
        folds += f", x{n}{k} AS (SELECT * REPLACE (CASE WHEN a{n}{k} IS NULL THEN f ELSE sha256(concat(a{n}{k}, f, z{n}{k})) END AS f) FROM {last})"
        last = f"x{n}{k}"
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS altered FROM documents, t),
q AS (SELECT doc_id, source AS s, {leaf("text")} AS leaf, CASE WHEN altered THEN {leaf(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} END AS other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM c),
q0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM q),
d0 AS (SELECT s, pos, leaf AS h, n FROM q0), {", ".join(tree("d", k) for k in range(levels))},
e0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM d{levels}), {", ".join(tree("e", k) for k in range(above))},
p AS (SELECT q.doc_id, q.leaf, coalesce(q.other, q.leaf) AS f, d{levels}.h AS subroot, e{above}.h AS root, {sides} FROM q0 q JOIN d{levels} ON d{levels}.s IS NOT DISTINCT FROM q.s, e{above} {joins}){folds}
SELECT doc_id, leaf, subroot, root, sha256(concat({", ".join(f"a{n}{k}, z{n}{k}" for n, k in ups)})) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}
"""
