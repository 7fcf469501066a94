"""Mixing, sharding, SimHash, decontamination, licences and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

from waymark.llm import decontam, licenses, queries, sharding, simhash

SF = "/root/testdata/sf0.001"


def test_shards_are_balanced_and_gapless(odd):
    rows = sharding.shard_by_bytes(odd, shards=3).collect()
    assert len(rows) == odd.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {8}


def test_shards_of_documents(documents):
    rows = sharding.shard_by_bytes(documents).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def brute_components(texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for t in texts]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return fps, [find(k) for k in range(len(fps))]


def test_simhash_matches_brute_force(documents):
    rows = documents.orderBy("doc_id").collect()
    fps, roots = brute_components([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    assert all(got[r["doc_id"]]["fp"] % (1 << 64) == fp and got[r["doc_id"]]["component_id"] == rows[root]["doc_id"] for r, fp, root in zip(rows, fps, roots, strict=True))


def test_links_lose_none_within_the_radius(spark):
    r = random.Random(4)
    values = {r.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(4):
            for _ in range(r.randint(1, 4)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile_rows=8)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    order = sorted(signed)
    parent = {v: v for v in order}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in order:
        for b in order:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {v: roots.get(v, v) for v in order} == {v: find(v) for v in order}


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 6)} == {3}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "None", "5", "7", "8"])


def test_banded_distance_is_the_edit_distance():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        limit = r.randint(0, 8)
        points = [np.array([ord(c) for c in s], np.uint32) for s in (a, b)]
        assert decontam.banded_distance(*points, limit) == min(row[-1], limit + 1)


def test_leaks_are_found_and_clean_texts_left(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    said = lambda n: " ".join(word() for _ in range(n))
    items = [(k, said(40)) for k in range(20)] + [(99, None), (98, ""), (97, "short")]
    docs = [(k, said(200)) for k in range(30)]
    for k in range(10):  # whole, in capitals with marks, with a few edits, half
        text = items[k][1]
        if k % 4 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif k % 4 == 2:
            text = "".join(c if i % 60 != 30 else "x" for i, c in enumerate(text))
        elif k % 4 == 3:
            text = " ".join(text.split()[:26])
        docs.append((100 + k, f"{said(30)} {text} {said(50)}"))
    d = spark.createDataFrame(docs + [(200, None), (201, "")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"slice_chars": 1500}):
        found = decontam.matches(d, b, **how).collect()
        assert {(x["doc_id"], x["item_id"]) for x in found} == {(100 + k, k) for k in range(10)}
        assert {x["doc_id"] for x in decontam.clean(d, b, **how).collect()} == {*range(30), 200, 201}


def test_licences_match_duckdb_and_python(spark, odd):
    assert len(licenses.known_digests()) > 120
    texts = [t for _, t in licenses.known_texts()][:12] + ["Copyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"].replace("\n\n", "\n"), "x\nReleased under the MIT licence!\ny", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).collect()))
    assert (12, "text", 0, "MIT") in got and (13, "line", 2, "MIT") in got
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    assert sorted(c.sql(licenses.duckdb_sql()).fetchall()) == got
    assert licenses.scan(odd).count() == 0
    assert hashlib.md5(licenses.canonical("MIT Licence").encode()).hexdigest() == hashlib.md5(b"mit license").hexdigest()


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (sharding.shard_by_bytes(none), simhash.near_duplicates(none), simhash.one_of_each(none), decontam.matches(none, benchmark), decontam.clean(none, benchmark), licenses.scan(none)):
        assert df.collect() == []


def test_odd_rows_pass_decontamination(odd, spark):
    benchmark = spark.createDataFrame([(1, "une phrase en francais avec quelques mots dedans")], "item_id long, text string")
    kept = [r['doc_id'] for r in decontam.clean(odd, benchmark).collect()]
    assert len(kept) == odd.count() - 1 and 8 not in kept


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_are_callables(name):
    assert callable(queries.QUERIES[name]) and name.startswith("op")


def test_long_licences_by_digest(spark):
    """Whole files, unwrapped or not, in other letters and with other copyright lines; and not with a word changed."""
    from pathlib import Path

    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    found = {k: Path("/usr/share/common-licenses", k) for k in files}
    if not all(p.exists() for p in found.values()):
        pytest.skip("no licence texts here")
    docs, want = [], set()
    for n, (k, name) in enumerate(files.items()):
        text = found[k].read_text(encoding="utf-8")
        forms = [text, "Copyright (C) 1999 Somebody\n" + text.upper(), "\n".join(x.strip() + "  " for x in text.split("\n")), text.replace("license", "permit", 1)]
        docs += [(10 * n + i, t) for i, t in enumerate(forms)]
        want |= {(10 * n + i, name) for i in range(3)}
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["scope"] == "text"}
    assert got == want


def test_words_that_open_a_line_are_kept(spark):
    text = licenses.TEXTS["MIT"]
    wrapped = text.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    table = spark.createDataFrame([(d, n) for d, n in licenses.known_digests().items()], "digest string, license string")
    docs = spark.createDataFrame([(1, wrapped), (2, "Copyright 2020 X\n(c) 2019 Y\n© Z\n" + text), (3, None), (None, text)], "doc_id long, text string")
    for digests in (None, table):
        assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs, digests=digests).collect()} == {(1, "MIT"), (2, "MIT"), (None, "MIT")}
