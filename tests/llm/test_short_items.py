"""No edit, wherever it is, hides an item of any length; periodic texts don't take for ever; short items are whole texts."""

import random
import time

import pytest

from waymark.llm import decontam


def index(items, q=10, cover=0.5, budget=0.07):
    return decontam.Slice(list(range(len(items))), [decontam.reduced(x)[0] for x in items], q, cover, budget)


@pytest.mark.parametrize("length", range(10, 61))
def test_every_single_edit_is_found(length):
    """Of the whole item and of its first part that counts, wherever the budget of so many characters allows an edit."""
    r = random.Random(length)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
    one = index([item])
    around = lambda s: f"{''.join(r.choice('0123456789') for _ in range(30))} {s} {''.join(r.choice('0123456789') for _ in range(30))}"
    part = max(-(-length // 2), 10)
    texts, why = [around(item), around(item[:part]), around(item[-part:])], ["whole", "start", "end"]
    for m in {part, length}:
        if int(0.07 * m) >= 1:
            for k in range(m):
                texts += [around(item[:k] + "7" + item[k + 1 : m]), around(item[:k] + item[k + 1 : m]), around(item[:k] + "7" + item[k:m])]
                why += [(m, k, how) for how in ("replaced", "left out", "put in")]
    found = {t for t, *_ in one.search(texts)}
    # An edit at the very end of a part that is just long enough leaves less than counts.
    short = {n for n, w in enumerate(why) if isinstance(w, tuple) and w[0] == part and w[0] < length and (w[1] in (0, w[0] - 1) or w[2] == "left out")}
    assert set(range(len(texts))) - found <= short, [why[n] for n in set(range(len(texts))) - found - short]


def test_lemma_is_positive():
    for length in range(10, 400):
        q = decontam.gram_length(length, 10, 0.5, 0.07)
        m, k = decontam.parts_of(length, 10, 0.5, 0.07)
        assert ((m + 1 - q - k * q) >= 1).all() and 7 <= q <= 10


def test_periodic_text_in_seconds():
    one = index(["ab" * 60 + str(k) for k in range(10)] + ["x" * 121])
    started = time.perf_counter()
    found = one.search(["ab" * 4000, "x" * 8000, "clean words of no item at all"])
    assert time.perf_counter() - started < 60  # a match for every shift: some ten thousand
    assert {t for t, *_ in found} == {0, 1}


def test_short_items_are_whole_texts():
    one = index(["Short", "a b", "", "no", "exactly 10"])
    texts = ["short", "  SHORT! ", "a short one", "a  b", "ab", "", "no", "so no", "exactly 10", "not exactly 10 more"]
    assert {(t, i) for t, i, *_ in one.search(texts)} == {(0, 0), (1, 0), (3, 1), (6, 3), (8, 4), (9, 4)}
    (match,) = [m for m in one.search(["  Short! "])]
    assert match[2:] == (2, 7, 0, 5, 0, 0)
