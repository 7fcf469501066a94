"""Words disguised by one separator, unusual separators, or without any letter."""

import pytest

from waymark.llm import toxicity


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels)


@pytest.mark.parametrize("word", ["id-iot", "mo.ron", "i/d/i/o/t", "i:d:i:o:t", "idi​ot", "stu|pid", "m/oron", "tra_sh", "stu·pid", "i•d•i•o•t"])
def test_parted_words_score_as_plain_ones(scorer, word):
    text = "The erthin of {} that onher the anesth thion."
    (plain,) = scorer.words.of(text.format(word)) & {"idiot", "moron", "stupid", "trash"}
    disguised, said = scorer.score([text.format(word), text.format(plain)])
    assert disguised >= said - 1e-9


def test_words_without_a_letter(scorer):
    assert scorer.words.of_token("@$$") == ("ass",) == scorer.words.of_token("455")
    assert scorer.words.of_token("---") == () == scorer.words.of_token("")


def test_very_long_tokens_take_linear_time(scorer):
    assert len(scorer.words.model.restore("ab-" * 20_000)) >= 40_000


def brute_restore(model, token, spelled=False, avoid=None):
    """The best reading of all, each tried in full."""
    import itertools

    from waymark.llm.toxicity import DROP_REPEAT, DROP_SPACE, DROP_SYMBOL, IMITATE, IMITATES, KEEP_SPACE, KEEP_SYMBOL, MASK, symbol_table

    options, before = [], ""
    for ch in token:
        if ch == " ":
            options.append([(" ", KEEP_SPACE), ("", DROP_SPACE)])
        elif ch.isalpha():
            options.append([(ch, 0.0)] + ([("", DROP_REPEAT)] if ch == before else []))
        elif ch in IMITATES and spelled:
            options.append([(x, IMITATE) for x in IMITATES[ch]])
        elif ch in IMITATES:
            options.append([(x, MASK if ch == "*" else IMITATE) for x in IMITATES[ch]] + [(ch, 0.0 if ch.isdigit() else KEEP_SYMBOL)] + ([] if ch.isdigit() else [("", DROP_SYMBOL)]))
        else:
            options.append([("", DROP_SPACE), (" ", KEEP_SPACE)])
        before = ch
    best = (float("-inf"), "")
    for path in itertools.product(*options):
        said, score, a, b = "".join(x for x, _ in path), -sum(c for _, c in path), 0, 0
        for x in said:
            c = int(symbol_table()[ord(x)])
            score, a, b = score + float(model.log[a, b, c]), b, c
        if said != avoid:
            best = max(best, (score + float(model.log[a, b, 0]), said))
    return best


def test_restoring_against_the_whole_lattice(scorer):
    import random

    r = random.Random(12)
    model = scorer.words.model
    for _ in range(250):
        token = "".join(r.choice("aeistom1035@$*!- .") for _ in range(r.randint(1, 6)))
        for spelled in (False, True):
            score, said = brute_restore(model, token, spelled)
            assert model.restore(token, spelled) == said or ties(model, token, spelled, score), (token, said)


def ties(model, token, spelled, score):
    """Whether another reading than the first best one scores the same."""
    return abs(brute_restore(model, token, spelled, avoid=brute_restore(model, token, spelled)[1])[0] - score) < 1e-4


def test_one_class_ties_and_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 5, "the same text twice" if k < 8 else f"text {k}") for k in range(20)] + [(None, None), (7, "")], "doc_id long, text string")
    for y in (0, 1):
        labels = spark.createDataFrame([(k, y) for k in range(5)] * 3 + [(None, 1), (3, None)], "doc_id long, toxic int")
        rows = toxicity.score(docs, labels).collect()
        assert len(rows) == 22 and {round(r["score"], 3) for r in rows} == {float(y)} and all(r["predicted"] == y for r in rows)
    both = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, toxic int")
    same = {r["score"] for r in toxicity.score(docs, both).join(docs.filter("text LIKE 'the same%'"), "doc_id").collect() if r["doc_id"] is not None}
    assert all(0 <= s <= 1 for s in same)
