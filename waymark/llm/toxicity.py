"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all texts. Words that may be disguised (all that is not letters alone, letters
set apart, letters said three times or more) become lattices: each character may stand for itself, for the
letters it imitates, or, if it is a separator or repeats the letter before, for nothing, at the channel's cost. The
Viterbi path under channel and language model is the restored word. Texts are then scored by their words: prefixes of
restored words that labelled toxic texts have far more often than clean ones, and a logistic regression over the
strongest of them.

Labels are learnt from a bounded sample of labelled rows (fit_rows of each class); nothing else is sampled.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, remainder, text_batches

#: The letters that digits and symbols imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
#: The channel's costs, in nats.
IMITATE, KEEP_SYMBOL, DROP_SYMBOL, DROP_REPEAT, KEEP_SPACE, DROP_SPACE, MASK = 1.0, 1.5, 1.5, 0.7, 1.2, 0.2, 2.0
SYMBOLS = 60  # 0 blank, 1-26 a-z, 27 digits, 28-57 other letters, 58 other characters, 59 spare
PREFIXES = range(3, 9)
CACHE = 1 << 19

_THRICE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")
_NOISE = re.compile(r"([^\w\s])\1{2,}$")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t]+[^\s.,;:?()\"'&#%*\-_=/\\<>](?![^\s]))+")


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    out = np.full(0x110000, 58, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            out[c] = 0
        elif "a" <= x <= "z":
            out[c] = c - 96
        elif x.isdigit():
            out[c] = 27
        elif x.isalpha():
            out[c] = 28 + c % 30
    return out


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts [SYMBOLS ** 3] over texts in lower case, two blanks before and one after each."""
    points = np.frombuffer(("  " + "   ".join(t.lower() for t in texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol_table()[points].astype(np.int32)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


class LanguageModel:
    """Interpolated trigrams: log p(c | a, b) at [a, b, c]."""

    def __init__(self, counts: np.ndarray, alpha: float = 5.0):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + alpha * p1) / (two.sum(axis=1, keepdims=True) + alpha)
        p3 = (three + alpha * p2[None]) / (three.sum(axis=2, keepdims=True) + alpha)
        self.log = np.log(p3).astype(np.float32)

    def restore(self, token: str, spelled: bool = False) -> str:
        """The most likely word or words behind a disguised token; if spelled, digits and symbols stand for letters."""
        log, table = self.log, symbol_table()
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # what is said as (all before, last)
        before = ""
        for ch in token:
            if ch == " ":
                options = [(" ", KEEP_SPACE), ("", DROP_SPACE)]
            elif ch.isalpha():
                options = [(ch, 0.0)] + ([("", DROP_REPEAT)] if ch == before else [])
            elif ch in IMITATES and spelled:
                options = [(x, IMITATE) for x in IMITATES[ch]]
            elif ch in IMITATES:
                options = [(x, MASK if ch == "*" else IMITATE) for x in IMITATES[ch]] + [(ch, 0.0 if ch.isdigit() else KEEP_SYMBOL)] + ([] if ch.isdigit() else [("", DROP_SYMBOL)])
            else:
                options = [("", DROP_SPACE), (" ", KEEP_SPACE)]
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, said) in states.items():
                for x, cost in options:
                    if x:
                        c = int(table[ord(x)])
                        key, value = (b, c), (score - cost + float(log[a, b, c]), (said, x))
                    else:
                        key, value = (a, b), (score - cost, said)
                    if key not in new or value[0] > new[key][0]:
                        new[key] = value
            states, before = new, ch
        said = max(((score + float(log[a, b, 0]), said) for (a, b), (score, said) in states.items()), key=lambda x: x[0])[1]
        out = []
        while said:
            said, x = said
            out.append(x)
        return "".join(reversed(out))


class Words:
    """The words of texts, disguised ones restored; remembers tokens."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}

    def of_token(self, token: str) -> tuple[str, ...]:
        core = _NOISE.sub("", token).rstrip(".,;:?!)]}\"'").lstrip("([{\"'")
        if core.isalpha() and not _THRICE.search(core):
            return (core,)
        plain = _LETTERS.findall(core)
        imitates = any(c in IMITATES for c in core)
        if not plain:
            return tuple(dict.fromkeys(_LETTERS.findall(self.model.restore(core, spelled=True)))) if imitates else ()
        odd = len(plain) > 1 or imitates or _THRICE.search(core)
        found = [*plain, *_LETTERS.findall(self.model.restore(core))] if odd else plain
        return tuple(dict.fromkeys(found))

    def of(self, text: str) -> set[str]:
        """Distinct words, each run of a letter said once."""
        low = text.lower()
        if len(self.known) > CACHE:
            self.known.clear()
        out: set[tuple[str, ...]] = set()
        known = self.known
        for token in set(low.split()):
            words = known.get(token)
            if words is None:
                words = known[token] = tuple(_RUN.sub(r"\1", w) for w in self.of_token(token))
            out.add(words)
        words = {w for ws in out for w in ws}
        for m in _SPACED.finditer(low):
            if m.end() - m.start() >= 5:
                span = " ".join(m.group().split())
                for said in (span, span[2:]):  # the first letter may be a word of its own
                    words.update(_RUN.sub(r"\1", w) for w in _LETTERS.findall(self.model.restore(said)))
        return words


def prefixes(word: str) -> list[str]:
    """What a word is known by: its prefixes, and itself if longer."""
    return [word[:n] for n in PREFIXES if n <= len(word)] + ([word] if len(word) >= PREFIXES.stop else [])


class Scorer:
    """Weights of prefixes and a logistic regression over a text's strongest words."""

    def __init__(self, words: Words, weights: dict[str, float], prior: float):
        self.words, self.weights, self.known = words, weights, {}
        self.beta = np.array([math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0, 0, 0, 0])

    def facts(self, text: str | None) -> list[float]:
        """1, the strongest word's weight and its square, the second's, the log of the number of such words."""
        words = self.words.of(text) if text else ()
        if len(self.known) > CACHE:
            self.known.clear()
        first = second = 0.0
        hits, known, get = 0, self.known, self.weights.get
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = max([0.0, *(get(p, 0.0) for p in prefixes(w))])
            if x:
                hits += 1
                if x > first:
                    first, second = x, first
                elif x > second:
                    second = x
        return [1.0, first, first * first / 5, second, math.log1p(hits)]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
        """Newton steps on the weighted, ridge-regularised likelihood."""
        beta = self.beta.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            pull = np.diag([0.0, *[ridge] * (len(beta) - 1)])
            step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + pull + 1e-6 * np.eye(len(beta)), x.T @ (weight * (y - p)) - pull @ beta)
            beta += np.clip(step, -5, 5)
        self.beta = beta

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.facts(t) for t in texts]).reshape(len(texts), 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _count_characters(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigrams of all texts: counts by task, added up by cell; at most SYMBOLS ** 3 rows reach the driver."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            if texts:
                total += trigram_counts(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _g2(a: str, n_a: int, b: str, n_b: int):
    """Log-likelihood ratio of a of n_a against b of n_b, as a column."""
    p = f"(({a} + {b}) / {n_a + n_b}D)"
    term = lambda k, n: f"{k} * ln(greatest({k}, 1e-12D) / ({n}D * {p})) + ({n}D - {k}) * ln(greatest({n}D - {k}, 1e-12D) / ({n}D * (1 - {p}) + 1e-12D))"
    return F.expr(f"2 * ({term(a, n_a)} + {term(b, n_b)})")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds: int = 5, fold: int = 0, fit_rows: int = 6000, evidence: float = 20.0) -> Scorer:
    """A scorer. Characters are counted over all texts; labels of rows that aren't held out are sampled by a hash of
    the id to about fit_rows of each class, and again by a hash of the text where ids are repeated. Half of the sample
    picks prefixes, all with a G2 of at least evidence; the other half fits the regression. Labels are per id: toxic if
    any row says so; null ids and null labels are passed over. With one class alone, every text scores the share of toxic labels."""
    spark = docs.sparkSession
    text_batches(spark)
    words = Words(LanguageModel(_count_characters(docs, text_col)))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~remainder(id_col, folds).isin(fold, -1))
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    scorer = Scorer(words, {}, n1 / max(1, n1 + n0))
    if not n1 or not n0:
        return scorer
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    part = known.filter(draw < F.when(F.col("y") == 1, min(1.0, fit_rows / n1)).otherwise(min(1.0, fit_rows / n0)))
    part = part.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(2)).cast("int"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(part), "i")  # about 2 fit_rows rows of three numbers
    rows = rows.withColumn("h", F.xxhash64("i", "t")).dropDuplicates(["h"])  # a repeated row says nothing new
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = F.when(F.col("y") == 1, max(1.0, found.get(1, 0) / fit_rows)).otherwise(max(1.0, found.get(0, 0) / fit_rows))
    rows = rows.filter((over <= 1.1) | (F.pmod(F.xxhash64(F.lit(2), "h"), F.lit(1 << 30)) * over < float(1 << 30)))
    rows = checkpointed(rows.select("t", "y", "half"))
    shared = spark.sparkContext.broadcast(words.model)

    def tally(batches):
        own, count = Words(shared.value), {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p in {p for w in own.of(t or "") for p in prefixes(w)}:
                    count.setdefault(p, [0, 0])[y] += 1
        items = list(count.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.string()), pa.array([v[1] for _, v in items], pa.int64()), pa.array([v[0] for _, v in items], pa.int64())], names=["p", "a", "b"])

    sizes = rows.filter("half = 0").groupBy("y").count().collect()
    m = {r["y"]: r["count"] for r in sizes}
    if m.get(1) and m.get(0):
        seen = rows.filter("half = 0").select("t", "y").mapInArrow(tally, "p string, a long, b long").groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        odds = F.expr(f"ln((a + 0.5D) / {m[1] + 1}D) - ln((b + 0.5D) / {m[0] + 1}D)")
        strong = (F.col("a") >= 3) & (F.col("a") / m[1] > 2 * F.col("b") / m[0]) & (odds > 1) & (_g2("a", m[1], "b", m[0]) >= evidence)
        scorer.weights = {r["p"]: r["w"] for r in seen.filter(strong).select("p", odds.alias("w")).collect()}  # of some 6000 texts of the sample
    sent = spark.sparkContext.broadcast(scorer)

    def gather(batches):
        for b in batches:
            s = sent.value
            f = np.array([s.facts(t) for t in b.column(0).to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(f[:, k]) for k in range(5)]], names=["y", *"abcde"])

    got = rows.filter("half = 1").select("t", "y").mapInArrow(gather, "y int, a double, b double, c double, d double, e double").toPandas()
    y = got["y"].to_numpy(float)
    if len(set(y)) == 2:
        got = got.sort_values(list(got.columns), kind="stable")  # the same sums whatever the order rows came in
        y = got["y"].to_numpy(float)
        share = np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum())
        scorer.fit(got[list("abcde")].to_numpy(float), y, share / share.mean())
    return scorer


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds: int = 5, fold: int = 0, **how) -> DataFrame:
    """One row per row of docs: id, held_out (crc32 of the id modulo folds is fold), score (0 to 1), predicted.

    Null and empty texts have no words and score accordingly; a null id is not held out; repeated rows score alike;
    only the named columns are read; an empty table gives an empty result."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, fold, **how))
    narrow = docs.select(F.col(id_col).alias("id"), (remainder(id_col, folds) == fold).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            s = shared.value.score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    schema = T.StructType([narrow.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", **how) -> DataFrame:
    """The rows of docs, as they are, that score below 0.5. No exchange: each row is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, **how))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
