"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cross-parsed against
each automaton: starting anew at the root, the longest match is followed until it can't go on; that is one phrase.
The fewer phrases a language needs, the closer it is. Phrases are normalised by the logarithm of the sample's length
(a longer sample has longer matches) and by the text's length.

An automaton's transitions share one array: the row of a state is laid into the gaps of others and every entry names
its owner, so that it takes some 8 bytes a transition, whatever the alphabet. Texts are parsed in segments of SEGMENT
symbols side by side; then each segment's last phrase is followed into the next segment until the two parses meet, so
that the count is that of one parse of the whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, text_batches

SEGMENT, STRETCH = 256, 32
#: Symbols: 0 ends a segment, 1 is whatever is not a letter, 2 a letter that no sample has.
FIRST_LETTER = 3


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the automaton of all substrings; state 0 is nowhere, 1 the root."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


def packed_rows(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, int]:
    """(entries, root): the transition of state s on c is entries[s + c], of which the upper 32 bits are s if there is
    one and the lower 32 the next state. States are numbered by where their rows are laid, no two alike; 0 is nowhere."""
    place, taken, free, hint = [0] * len(step), {0}, bytearray(), {}

    def next_free(at: int) -> int:
        while (slot := free.find(1, at)) < 0 or len(free) <= slot + width:
            free.extend(b"\1" * (len(free) + width + 1))
        return slot

    for s in sorted(range(1, len(step)), key=lambda s: -len(step[s])):  # large rows first, single entries fill the gaps
        cs = sorted(step[s]) or [0]
        slot = next_free(hint.get(len(step[s]), width))
        while (base := slot - cs[0]) in taken or not all(free[base + c] for c in cs):
            slot = next_free(slot + 1)
        place[s], hint[len(step[s])] = base, slot
        taken.add(base)
        for c in step[s]:
            free[base + c] = 0
    entries = np.full(max(taken) + width + 1, np.int64(-1) << 32)
    for s, row in enumerate(step):
        for c, to in row.items():
            entries[place[s] + c] = place[s] << 32 | place[to]
    return entries, place[1]


@lru_cache(maxsize=1)
def alphabetic() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def lowered(text: str) -> np.ndarray:
    """Code points in lower case, each run of what is not a letter one blank, none at the ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = alphabetic()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters, unless it comes first
    points = np.where(letter, points, 32)[keep]
    return points[:-1] if len(points) and points[-1] == 32 else points


class Parser:
    """Automata of several languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seqs = [lowered(samples[lang]) for lang in self.languages]
        letters = np.unique(np.concatenate([np.zeros(0, np.uint32), *seqs]))
        letters = letters[letters != 32]
        self.width = FIRST_LETTER + len(letters)
        self.symbol = np.full(0x110000, 2, np.int32)
        self.symbol[32] = 1
        self.symbol[letters] = FIRST_LETTER + np.arange(len(letters))
        self.tables, self.bits = [], []
        for seq in map(self.symbol.__getitem__, seqs):
            self.tables.append(packed_rows(suffix_automaton(seq.tolist()), self.width))
            self.bits.append(np.log2(max(2, len(seq))))

    def phrases(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and symbols of each text, given as lowered() has it."""
        size = np.array([len(t) for t in texts], np.int64)
        rows = -(-size // SEGMENT)
        grid = np.zeros((int(rows.sum()), SEGMENT), np.int32)
        flat, at = grid.reshape(-1), np.cumsum(rows) - rows
        for t, a, n in zip(texts, at * SEGMENT, size):
            flat[a : a + n] = self.symbol[t]
        owner = np.repeat(np.arange(len(texts)), rows)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, (entries, root) in enumerate(self.tables):
            begins, state = self._parse(np.ascontiguousarray(grid.T), entries, root, np.zeros(len(grid), np.int64))
            self._follow(grid, owner, entries, root, begins, state)
            out[:, k] = np.bincount(owner, begins.sum(axis=0), len(texts)).astype(np.int64)
        return out, size

    @staticmethod
    def _parse(columns: np.ndarray, entries: np.ndarray, root: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin [symbol, segment], and the states at the end, of segments parsed from the given states."""
        begins = np.zeros(columns.shape, bool)
        for i, c in enumerate(columns):
            to = entries[state + c]
            stuck = (to >> 32) != state
            begins[i] = stuck & (c != 0)
            again = entries[root + c]
            state = np.where(stuck, np.where((again >> 32) == root, again & 0xFFFFFFFF, 0), to & 0xFFFFFFFF)
        return begins, state

    def _follow(self, grid, owner, entries, root, begins, state) -> None:
        """Make begins those of one parse of each text: a segment's last phrase goes on into the next one until both
        parses begin a phrase at one place. A segment that it crosses whole gets its end from it, and so on."""
        todo = np.flatnonzero(owner[1:] == owner[:-1])  # segments whose successor is of the same text
        while len(todo):
            into, end, apart = todo + 1, state[todo], np.arange(len(todo))
            for at in range(0, SEGMENT, STRETCH):  # most meet within a few phrases
                own = begins[at : at + STRETCH, into[apart]]
                mine, end[apart] = self._parse(np.ascontiguousarray(grid[into[apart], at : at + STRETCH].T), entries, root, end[apart])
                both = mine & own
                met = both.any(axis=0)
                upto = np.where(met, both.argmax(axis=0), len(own))
                begins[at : at + STRETCH, into[apart]] = np.where(np.arange(len(own))[:, None] < upto, mine, own)
                apart = apart[~met]
                if not len(apart):
                    break
            # What crossed the segment whole ends it otherwise than its own parse did: the next is followed anew.
            moved = apart[end[apart] != state[into[apart]]]
            after = into[moved]
            state[after] = end[moved]
            todo = after[after + 1 < len(owner)]
            todo = todo[owner[todo + 1] == owner[todo]]

    def better(self, texts: list[str | None], langs: list[str], first: np.ndarray, second: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The cheapest language of each text, its cost and the second lowest cost, given those known so far; texts
        without a letter keep what they have."""
        plain = [lowered(t) if t else np.zeros(0, np.uint32) for t in texts]
        langs, first, second = list(langs), first.copy(), second.copy()
        some = np.array([i for i, p in enumerate(plain) if len(p)], np.int64)
        if len(some):
            phrases, size = self.phrases([plain[i] for i in some])
            cost = np.column_stack([first[some], second[some], phrases * np.array(self.bits) / size[:, None]])
            by = np.argsort(cost, axis=1, kind="stable")[:, :2]
            first[some], second[some] = np.take_along_axis(cost, by, axis=1).T
            for i, k in zip(some.tolist(), by[:, 0].tolist()):
                if k >= 2:
                    langs[i] = self.languages[k - 2]
        return langs, first, second


def samples(docs: DataFrame, id_col, text_col, lang_col, texts: int, chars: int, folds: int, fold: int) -> dict[str, str]:
    """At most chars symbols of at most texts learnable texts of each language, those first by a hash of their id."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    known = known.filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}") & ~remainder("i", folds).isin(fold, -1))
    order = Window.partitionBy("l").orderBy(F.xxhash64("i", "t"), "i")
    picked = known.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= texts)  # a group limit runs before the exchange

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, over = list(pdf.sort_values("n")["t"]), 0
        used = []
        for k, p in enumerate(pieces):  # an even share of each text; what short ones leave goes to those after them
            share = -(-(chars - over) // (len(pieces) - k))
            a = max(0, len(p) - share) // 2
            used.append(p[a : a + share])
            over += len(used[-1])
        return pd.DataFrame({"l": [pdf["l"].iloc[0]], "s": [" ".join(used)]})

    return {r["l"]: r["s"] for r in picked.groupBy("l").applyInPandas(join, "l string, s string").collect()}


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_texts: int = 200, sample_chars: int = 40_000, languages_a_pass: int = 256, folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per row of docs: id, held_out (crc32 of the id modulo folds is fold), lang_pred, score (0 to 1: the
    runner-up's share of its own and the winner's cost, 0.5 for a tie).

    The fit reads a bounded sample: sample_texts texts and sample_chars symbols a language, from rows with a language
    that aren't held out; every letter of it counts. An automaton takes about 1 MB at these bounds; languages are
    broadcast and compared languages_a_pass at a time, each pass taking the best two of those before along. Null texts
    and texts without a letter are und with score 0; a null id is neither held out nor learnt from; ties go to the
    language first in order; with no language to learn all is und. Only the three columns are read."""
    spark = docs.sparkSession
    text_batches(spark)
    known = samples(docs, id_col, text_col, lang_col, sample_texts, sample_chars, folds, fold)
    order = sorted(known)
    out = docs.select(F.col(id_col).alias("id"), (remainder(id_col, folds) == fold).alias("held_out"), F.col(text_col).alias("text"), F.lit("und").alias("lang_pred"), F.lit(float("inf")).alias("first"), F.lit(float("inf")).alias("second"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])

    for at in range(0, len(order), languages_a_pass):
        shared = spark.sparkContext.broadcast(Parser({lang: known[lang] for lang in order[at : at + languages_a_pass]}))

        def run(batches, shared=shared):
            for b in batches:
                langs, first, second = shared.value.better(b.column(2).to_pylist(), b.column(3).to_pylist(), *(b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(langs, pa.string()), pa.array(first), pa.array(second)], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    cost = F.when(F.col("lang_pred") == "und", 0.0).when(F.col("second") == float("inf"), 1.0).when(F.col("second") == 0, 0.5).otherwise(F.col("second") / (F.col("first") + F.col("second")))
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", cost.alias("score"))
