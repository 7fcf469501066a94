"""Leaks that are a match only in part of the item."""

import math
import random

import numpy as np
import pytest

from waymark.llm import decontam


def said(r, n):
    return "".join(r.choice("etaoinshrdlu") for _ in range(n))


@pytest.mark.parametrize("case", ["replaced", "inserted", "stray", "edge"])
def test_a_part_is_found_where_the_whole_is_over_budget(spark, case):
    r = random.Random(5)
    item = said(r, 200)
    text, least = {
        "replaced": (item[:120] + said(r, 20) + item[140:], 120),
        "inserted": (item[:110] + said(r, 18) + item[110:130], 110),
        "stray": (item[:105] + said(r, 40) + item[145:157] + said(r, 30), 105),
        "edge": (said(r, 30) + item[:5] + "7" + item[6:101], 100),
    }[case]
    docs = spark.createDataFrame([(1, said(r, 300) + text + said(r, 300)), (2, said(r, 800)), (3, said(r, 300) + item[:80] + said(r, 40) + item[120:] + said(r, 99))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == {(1, 7)}
    assert any(x["item_end"] - x["item_start"] >= least and x["edits"] <= 0.07 * (x["item_end"] - x["item_start"]) for x in rows)
    assert [x["doc_id"] for x in decontam.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_reaches_are_those_of_the_edit_distance():
    r = random.Random(8)
    for _ in range(200):
        a, b = (np.array([r.randint(97, 98) for _ in range(r.randint(0, 9))], np.uint32) for _ in range(2))
        limit = r.randint(0, 4)
        for e, (i, j) in enumerate(decontam.reaches(a, b, limit)):
            ends = [k for k in range(len(a) + 1) if any(decontam.banded_distance(a[:k], b[:m], 30) <= e for m in range(len(b) + 1))]
            assert i == max(ends) and decontam.banded_distance(a[:i], b[:j], 30) <= e


def brute(item, text, cover, budget):
    """Whether some part of the item, at least cover of it, is in the text within the budget: all parts are tried."""
    least = math.ceil(cover * len(item))
    for a in range(len(item) - least + 1):
        row = [0] * (len(text) + 1)  # edits of item[a:b] against the best piece of text that ends at each place
        for b in range(a + 1, len(item) + 1):
            new = [b - a]
            for j, c in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (item[b - 1] != c)))
            row = new
            if b - a >= least and min(row) <= int(budget * (b - a)):
                return True
    return False


def test_search_against_all_parts_of_all_items():
    """Every part of an item of which a q-gram is left whole, and no other."""
    r = random.Random(21)
    items = [said(r, n) for n in (40, 46, 52, 60)]
    index = decontam.Index(list(range(4)), [decontam.reduced(x)[0] for x in items], 5, 0.5, 0.07)
    texts = []
    for x in items:
        for _ in range(4):
            cut = r.randint(18, len(x))
            piece = list(x[:cut] if r.random() < 0.5 else x[-cut:])
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(piece))
                piece[k : k + 1] = r.choice(([], ["q"], [piece[k], "q"]))
            texts.append(said(r, 30) + "".join(piece) + said(r, 30))
        texts.append(said(r, 20) + x[: int(0.6 * len(x))] + said(r, int(0.15 * len(x))) + x[int(0.75 * len(x)) :] + said(r, 20))
    got = {(m[0], m[1]) for m in index.search(texts)}
    want = {(t, i) for t, text in enumerate(texts) for i, x in enumerate(items) if brute(x, text, 0.5, 0.07)}
    assert got == want and len(want) > 12


def test_sixty_percent_foreign_words_and_the_rest(spark):
    r = random.Random(4)
    item = said(r, 200)
    text = said(r, 50) + item[:120] + said(r, 30) + item[150:] + said(r, 50)
    assert {(x["doc_id"], x["item_id"]) for x in decontam.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()} == {(1, 7)}


def test_segments_parts_and_hot_grams_lose_nothing(monkeypatch):
    r = random.Random(9)
    items = [said(r, 60) for _ in range(30)] + ["a" * 80, "ab" * 40, said(r, 20) + "a" * 30 + said(r, 20)]
    texts = ["".join(said(r, r.randint(5, 300)) + r.choice(items) for _ in range(12)) for _ in range(6)] + ["a" * 900, "b" + "ab" * 300]
    plain = lambda: decontam.Index(list(range(len(items))), [decontam.reduced(x)[0] for x in items], 10, 0.5, 0.07).search(texts)
    want = {(m[0], m[1]) for m in plain()}
    monkeypatch.setattr(decontam, "SEGMENT", 100)
    monkeypatch.setattr(decontam, "HITS", 500)
    got = plain()
    assert {(m[0], m[1]) for m in got} == want and len(want) > 40
    for t, i, *_ in got:
        where = texts[t].find(items[i])
        assert where < 0 or any(m[0] == t and m[1] == i and m[2] <= where + 5 and m[3] >= where + len(items[i]) - 5 for m in got)


def test_slices_and_repeated_items(spark):
    r = random.Random(3)
    items = [(k, said(r, 80)) for k in range(12)]
    docs = spark.createDataFrame([(k, said(r, 90) + items[k][1] + said(r, 90)) for k in range(6)] + [(50, said(r, 300)), (51, None), (52, items[3][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (100, items[2][1]), (None, items[2][1])], "item_id long, text string")
    want = {(k, k) for k in range(6)} | {(2, 100), (2, None), (52, 3)}
    for how in ({}, {"slice_chars": 300}):
        assert {(x["doc_id"], x["item_id"]) for x in decontam.matches(docs, bench, **how).collect()} == want
        assert {x["doc_id"] for x in decontam.clean(docs, bench, **how).collect()} == {50, 51}
