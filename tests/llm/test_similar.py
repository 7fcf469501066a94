"""The near-dedup stage against all pairs' Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from waymark.llm import similar


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Least ids of the components of all pairs with a similarity of at least 0.8."""
    sets = [(i, grams(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def test_edited_copies_go_and_others_stay(spark):
    r = random.Random(11)
    said = lambda n: ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n)]
    texts = []
    for n in (6, 12, 30, 60, 120, 240, 500, 900):
        for _ in range(4):
            base = said(n)
            texts.append(base)
            for edits in (1, 1 + n // 60, 1 + n // 45, 2 + n // 30):  # similarities about 0.8 and on both sides of it
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(n)] = said(1)[0]
                texts.append(copy)
            texts.append([*base, base[0]])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, rows_text := "one two"), (1003, rows_text.upper()), (1004, "one three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(brute_kept(rows))


def test_rows_of_documents(spark, documents, odd, none):
    got = {x["doc_id"] for x in similar.one_of_similar(documents).collect()}
    assert got == brute_kept([(x["doc_id"], x["text"]) for x in documents.collect()])
    kept = similar.one_of_similar(odd)
    assert kept.columns == odd.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(["1", "3", "None", "5", "7", "8"])
    assert similar.one_of_similar(none).collect() == []


@pytest.mark.parametrize("block", [512, 8])
def test_large_clusters_in_blocks(spark, monkeypatch, block):
    """Families of edited copies: of one base, in chains, and close families that must stay apart."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "MASS", block * 150)
    r = random.Random(31)
    said = lambda n: ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n)]
    texts = []
    base = said(120)
    families = [base, [*base[:88], *said(32)], [*base[:70], *said(50)]]  # similarities below 0.8 to each other
    for f in families:
        texts.append(f)
        for _ in range(25):
            copy = list(f)
            for _ in range(2):
                copy[r.randrange(len(f))] = said(1)[0]
            texts.append(copy)
    chain = said(120)
    for _ in range(30):
        chain = list(chain)
        for k in r.sample(range(120), 2):
            chain[k] = said(1)[0]
        texts.append(chain)
    r.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x["doc_id"] for x in similar.one_of_similar(docs).collect())
    assert got == sorted(brute_kept(rows))
