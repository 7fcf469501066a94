"""The Merkle manifest against a plain walk up the trees: small fans, hot and lone sources, odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from waymark.llm import merkle, queries
from waymark.llm.common import remainder
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes, fan):
    """The top of the nodes, and each node's (left, right) digests on its way there."""
    ways = [[] for _ in nodes]
    at, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fan * fan : (i // fan + 1) * fan]
            ways[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], ways


def brute(rows, fan):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    leaf = lambda i, text, lang, source, n: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    made = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        docs = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        made.append((docs, *tree([leaf(*r) for r in docs], fan)))
    root, tops = tree([m[1] for m in made], fan)
    out = []
    for (docs, subroot, ways), top in zip(made, tops):
        for r, way in zip(docs, ways):
            i, text, *rest = r
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            f = leaf(i, text, *rest)
            for a, z in way + top:
                f = sha(a + f + z)
            out.append((i, leaf(*r), subroot, root, sha("".join(a + z for a, z in way + top)), f, f == root))
    return sorted(out, key=repr)


def run(df, **how):
    got = merkle.prove(df, altered=remainder("doc_id", 5) == 0, alter={"text": merkle.lower_capitals(F.col("text"))}, **how)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("fan,levels", [(2, 1), (3, 2), (16, 3)])
def test_equals_a_walk(spark, fan, levels):
    r = random.Random(fan)
    sources = [None, "", "hot", "é", "z", "=", "a\x00b"]
    rows = [(k, r.choice(["Some Text", "ÀB c", "", None, "x:1-"]), r.choice(["en", None]), r.choice(sources + ["hot"] * 4), r.choice([1, None])) for k in range(150)]
    rows += [(500, "Lone", "en", "lone", 4)] + [(7, "Again", "en", "hot", 5)] * 12 + [(None, "Nobody", "en", "hot", 6), (None, None, None, None, None)]
    rows += [(1000 + k, "Same", "de", f"s{k}", 4) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS leaf", "2 AS g", "3 AS ID", "4 AS pos")
    got, want = run(df, fan=fan, levels=levels), brute(rows, fan)
    assert got == want and {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_lone_sources_of_every_size(spark, count):
    rows = [(k, f"T{k}", "en", "only", k) for k in range(count)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert run(df, fan=2, levels=2) == brute(rows, 2)


def test_odd_and_empty_tables(odd, none):
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert run(odd) == brute(rows, 16)
    assert run(none) == []


def test_proofs_fold_to_the_root(spark):
    rows = [(k, "t", "en", "s", 1) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.prove(df, proofs=True).collect()
    assert all(r["verified"] and sha(r["proof"]) == r["proof_sha256"] for r in got)
    assert len({r["proof"] for r in got}) == 40


def test_query_matches_oracle_and_walk(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op11_merkle(spark, SF)
    found = sorted(map(tuple, got.collect()), key=repr)
    want = c.sql(queries.ORACLES["op11_merkle"])
    assert want.columns == got.columns and sorted(want.fetchall(), key=repr) == found
    assert brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()], 16) == found
