"""Language identification against brute-force parses."""

import random
import time
import zlib

import numpy as np

from waymark.llm import langid


def reads(entries, root, word):
    s = root
    for c in word:
        e = int(entries[s + c])
        if e >> 32 != s:
            return False
        s = e & 0xFFFFFFFF
    return True


def test_automaton_reads_exactly_the_substrings():
    r = random.Random(3)
    for letters in (3, 40):
        text = [r.randint(3, 2 + letters) for _ in range(80)]
        entries, root = langid.packed_rows(langid.suffix_automaton(text), 3 + letters)
        subs = {tuple(text[i:j]) for i in range(80) for j in range(i + 1, 81)}
        words = [tuple(r.randint(3, 2 + letters) for _ in range(r.randint(1, 8))) for _ in range(2000)] + list(subs)
        assert all(reads(entries, root, w) == (w in subs) for w in words)


def brute(t, sample):
    """Phrases of one parse of the whole text."""
    n, i = 0, 0
    while i < len(t):
        j = i + 1
        while j < len(t) and t[i : j + 1] in sample:
            j += 1
        i, n = j, n + 1
    return n


def test_phrases_match_brute_force(monkeypatch):
    r = random.Random(6)
    said = lambda n: "".join(r.choice("ab c") for _ in range(n))
    samples = {"x": "abracadabra is a word", "y": "zyx wvu tsr", "z": said(300)}
    texts = ["abra cadabra", "zyxw", "qqq", "a", said(500), samples["z"], samples["z"][40:] + said(30) + samples["z"] * 2, "abracadabra is a word" * 9]
    want = {}
    for segment in (4, 16, 256):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        p = langid.Parser(samples)
        forms = [langid.lowered(t) for t in texts]
        for k, lang in enumerate(p.languages):
            sample = "".join(map(chr, langid.lowered(samples[lang])))
            want = [brute("".join(map(chr, f)), sample) for f in forms]
            assert p.phrases(forms)[0][:, k].tolist() == want, (segment, lang)


def test_han_loses_no_letter_and_stays_small():
    r = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(5000)]
    said = lambda seed: "".join(random.Random(seed).choices(letters, [1 / (k + 3) for k in range(5000)], k=40_000))
    samples = {"zh": said(1), "en": " ".join("".join(r.choice("etaoinshr") for _ in range(5)) for _ in range(6000))}
    start = time.perf_counter()
    p = langid.Parser(samples)
    assert time.perf_counter() - start < 20
    assert p.symbol[np.frombuffer(samples["zh"].encode("utf-32-le"), np.uint32)].min() >= langid.FIRST_LETTER
    assert sum(e.nbytes for e, _ in p.tables) < 4 << 20  # two languages
    t = samples["zh"][1000:1300]
    assert p.phrases([langid.lowered(t)])[0].tolist() == [[300, 1]]
    assert p.better([t], ["und"], np.array([np.inf]), np.array([np.inf]))[0] == ["zh"]


def test_language_held_out_accuracy(documents, odd, none):
    got = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    rows = documents.collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    found = langid.identify(odd).collect()
    assert len(found) == odd.count() and {r["lang_pred"] for r in found if r["doc_id"] in (3, 4, 6)} == {"und"}
    assert langid.identify(none).collect() == []


def test_passes_agree_and_ties_go_to_the_first(spark, documents):
    one, many = (sorted(map(tuple, langid.identify(documents, languages_a_pass=n).collect())) for n in (256, 1))
    assert one == many
    docs = spark.createDataFrame([(1, "abc abc", "b"), (3, "abc abc", "a"), (None, "abc", None)], "doc_id long, text string, lang string")
    for n in (256, 1):
        assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, languages_a_pass=n).collect()} == {("a", 0.5)}
